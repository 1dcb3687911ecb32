from sievekit.operators.citations import dedup_citations
from sievekit.operators.joins import flag_by_member
from sievekit.plans.corpus import build_corpus

SCHEMA = "eppi_id string, ordinal long, title string, abstract string, author array<string>, year int, volume string, cite_label string, human_code int"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def parts(spark):
    inc = [("a", 0, "A study of things", LONG, ["Smith, J."], 2001, "4", "included", 1),
           ("b", 1, "Another study of something", "", ["Li, X."], 2002, "7", "included", 1),
           ("c", 2, "Alone", "nothing like the others at all in here", None, None, None, "included", 1)]
    exc = [("d", 0, "A study of things", LONG + " sixteen", ["Smith, J."], 2001, "4", "excluded", 0),
           ("e", 1, "Another study of somethings", None, ["Li, Xi"], 2002, None, "excluded", 0),
           ("", 2, "Editorial", None, None, None, None, "excluded", 0), ("", 3, "Editorial", "", None, None, None, "excluded", 0)]
    bench = [("d", 0, "x", None, None, None, None, "benchmark", 1), ("", 1, "not in the list", "own text of a missing study", None, None, None, "benchmark", 1)]
    return [spark.createDataFrame(r, SCHEMA) for r in (inc, exc, bench)]


def test_build(spark):
    inc, exc, bench = parts(spark)
    corpus, out = build_corpus([inc, exc], bench, 3)
    got = {r["eppi_id"] or r["title"]: r for r in corpus.filter("title <> 'Editorial'").collect()}
    a = got["a"]  # merged with d, whose id the benchmark list has; labels conflict
    assert (a["n_members"], a["labels"], a["is_benchmark"], a["cite_label"], a["human_code"]) == (2, "excluded, included", True, "benchmark", 1)
    assert got["not in the list"]["cite_label"] == "benchmark" and got["not in the list"]["n_members"] is None
    assert got["c"]["cite_label"] == "included" and not got["c"]["is_benchmark"]
    assert sorted(r["position"] for r in corpus.collect()) == list(range(1, 8))  # no row is lost
    again, _ = build_corpus([inc.repartition(3), exc], bench, 3)
    assert sorted(corpus.drop("human_code").collect(), key=str) == sorted(again.drop("human_code").collect(), key=str)


def test_fields_merge_records_without_abstracts(spark):
    inc, exc, bench = parts(spark)
    corpus, out = build_corpus([inc, exc], bench, 3, merge=dedup_citations)
    got = {r["eppi_id"]: r for r in corpus.filter("eppi_id IS NOT NULL").collect()}
    assert set(got) == {"a", "b", "c"} and got["b"]["labels"] == "excluded, included" and got["b"]["human_code"] == 1
    pair = out["title_pairs"].collect()  # the two editorials: equal titles without any evidence
    assert len(pair) == 1 and (pair[0]["similarity"], pair[0]["agree"], pair[0]["differ"]) == (1.0, 0, 0)


def test_missing_ids_name_no_member(spark):
    unique = spark.createDataFrame([(1, None), (2, "x")], "cluster_id long, eppi_id string")
    clusters = spark.createDataFrame([(1, None), (2, "x"), (2, "y"), (2, "y")], "cluster_id long, eppi_id string")
    ids = spark.createDataFrame([(None,), ("y",), ("q",)], "eppi_id string")
    out = {r["cluster_id"]: r["hit"] for r in flag_by_member(unique, clusters, ids, "hit").collect()}
    assert out == {1: False, 2: True}
