import corpus_pipeline
from sievekit.llm.common import stash
from tests.llm.test_exact_dedup import digest
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_packing import check_pack
from tests.llm.test_quality_rules import statistics

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after[name] = [tuple(r) for r in docs.collect()]
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    kept = after["quality_rules"]
    stats = {r[0]: statistics(r[1]) for r in rows}
    failed = {k for k, s in stats.items() if s[0] < 50 or 100 * s[4] > 50 * s[0]}
    assert set(kept) <= set(rows) and not failed & {r[0] for r in kept}
    assert {r[0] for r in rows if r[0] in good} - failed <= {r[0] for r in kept}
    least = {}
    for r in kept:
        least[digest(r[1])] = min(least.get(digest(r[1]), r[0]), r[0])
    assert sorted(after["exact_dedup"]) == sorted(r for r in kept if least[digest(r[1])] == r[0])
    alone = {a for a, _, c in components(after["exact_dedup"]) if a == c}
    assert sorted(after["ngram_jaccard_join"]) == sorted(r for r in after["exact_dedup"] if r[0] in alone)
    mixed = after["poisson_mixing"]
    assert set(mixed) <= set(after["ngram_jaccard_join"]) and len(mixed) > len(set(mixed)) > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_pack(mixed, packed, 2048)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0
