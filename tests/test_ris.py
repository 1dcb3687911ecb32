"""Citation-file reading/writing on small hand-written fixtures (invented text)."""

import os
import tempfile

import pytest

from pyspark.sql import functions as F

from sievekit.sources.ris import read_ris, write_ris

EXPORT = """TY  - JOUR
T1  - Helping out in the neighbourhood: a trial
JF  - Journal of Made-up Studies
A1  - Berg, Anna
A1  - Dahl, Ola
A1  - Lund, Per
KW  - volunteering
KW  - schools
United Kingdom (England)
PY  - 2016
DA  - 2016/11//
AB  - First line of the abstract.
second line continues it.
VL  - 12
IS  - 3, 1
SP  - 101
EP  - 110
DO  - https://doi.org/10.1000/XYZ.1
U1  - 1001
U2  - 77
N1  - note text
AV  - online
ER  -

TY  - RPRT
T1  - An empty-abstract report
A1  - Holm, K
PY  - 2003
DA  - 2003///
AB  -
U1  - 1002
ER  -
"""

OTHER = """TY  - CHAP
AU  - Vik, T.
AU  - Sand, R.
TI  - Detention and mental health
BT  - Collected essays
PY  - 2019
ED  - Editor, E.
M3  - Doctoral thesis
ER  -
TY  - GEN
TI  - Without identifier
PY  - 2001
ER  -"""


def _write(dirpath, name, text):
    p = os.path.join(dirpath, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_read_two_dialects(spark):
    d = tempfile.mkdtemp(prefix="ris-")
    a = _write(d, "export file.ris", EXPORT)  # space in the name
    b = _write(d, "other.ris", OTHER)
    df = read_ris(spark, [a, b])
    rows = {r["title"]: r for r in df.collect()}
    assert len(rows) == 4
    r1 = rows["Helping out in the neighbourhood: a trial"]
    assert r1["type"] == "JOUR" and r1["eppi_id"] == "1001" and r1["other_id"] == "77"
    assert r1["author"] == ["Berg, Anna", "Dahl, Ola", "Lund, Per"]
    assert r1["keywords"] == ["volunteering", "schools\nUnited Kingdom (England)"]
    assert r1["abstract"] == "First line of the abstract.\nsecond line continues it."
    assert r1["year"] == 2016 and r1["issue"] == "3, 1" and r1["journal"] == "Journal of Made-up Studies"
    assert r1["extra"] == {"AV": ["online"]}
    r2 = rows["An empty-abstract report"]
    assert r2["abstract"] == "" and r2["year"] == 2003
    r3 = rows["Detention and mental health"]
    assert r3["author"] == ["Vik, T.", "Sand, R."] and r3["secondary_title"] == "Collected essays"
    assert r3["eppi_id"] is None and r3["extra"] == {"ED": ["Editor, E."], "M3": ["Doctoral thesis"]}
    assert rows["Without identifier"]["eppi_id"] is None
    # input order: file order, then record order in the file
    order = [r["title"] for r in df.orderBy("ordinal").collect()]
    assert order[:2] == ["Helping out in the neighbourhood: a trial", "An empty-abstract report"]
    assert order[2:] == ["Detention and mental health", "Without identifier"]


def test_labels_attach_constants(spark):
    d = tempfile.mkdtemp(prefix="ris-")
    a = _write(d, "incl.ris", EXPORT)
    b = _write(d, "excl.ris", OTHER)
    df = read_ris(spark, [a, b], labels={"incl.ris": {"cite_label": "included", "human_code": 1},
                                         "excl.ris": {"cite_label": "excluded", "human_code": 0}})
    got = sorted((r["cite_label"], r["human_code"]) for r in df.collect())
    assert got == [("excluded", 0), ("excluded", 0), ("included", 1), ("included", 1)]


def test_order_kept_across_splits(spark):
    d = tempfile.mkdtemp(prefix="ris-")
    recs = "".join(f"TY  - JOUR\nT1  - Title {i:04d}\nU1  - {i}\nAB  - {'x' * 200}\nER  - \n\n" for i in range(400))
    p = _write(d, "big.ris", recs)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = read_ris(spark, p)
        rows = df.orderBy("ordinal").select("eppi_id").collect()
        assert [int(r[0]) for r in rows] == list(range(400))
        assert df.select("ordinal").distinct().count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_write_read_round_trip(spark):
    d = tempfile.mkdtemp(prefix="ris-")
    src = read_ris(spark, _write(d, "a.ris", EXPORT + OTHER))
    out = os.path.join(d, "out")
    write_ris(src, out)
    back = read_ris(spark, out)
    cols = ["type", "title", "author", "keywords", "abstract", "year", "eppi_id", "extra", "secondary_title"]
    a = sorted(tuple(str(r[c]) for c in cols) for r in src.select(*cols).collect())
    b = sorted(tuple(str(r[c]) for c in cols) for r in back.select(*cols).collect())
    assert a == b
    assert [r[0] for r in back.orderBy("ordinal").select("title").collect()] == \
        [r[0] for r in src.orderBy("ordinal").select("title").collect()]


def test_blank_abstract_filter_out(spark):
    from sievekit.functions.scalars import blanks_to_null
    from sievekit.operators.filters import filter_out

    d = tempfile.mkdtemp(prefix="ris-")
    df = blanks_to_null(read_ris(spark, _write(d, "a.ris", EXPORT + OTHER)), ["abstract", "title"])
    kept = filter_out(df, F.col("abstract").isNull())
    assert kept.count() == 1


def test_dedup_citation_keys(spark):
    from sievekit.operators.dedup import dedup

    d = tempfile.mkdtemp(prefix="ris-")
    a = _write(d, "a.ris", EXPORT)
    b = _write(d, "b.ris", OTHER + "\n" + EXPORT.replace("DO  - https://doi.org/10.1000/XYZ.1", "DO  - 10.1000/xyz.1")
                                         .replace("Helping out", "Helping  out"))
    recs = read_ris(spark, [a, b]).withColumn("abstract", F.nullif("abstract", F.lit("")))
    out = dedup(recs, id_col="ordinal")
    sizes = sorted((r["title"], r["n_members"]) for r in out["unique"].collect())
    # same DOI (with/without resolver) and same title+year+first author (empty abstract) merge
    assert ("An empty-abstract report", 2) in sizes
    assert sum(n for _, n in sizes) == 6 and len(sizes) == 4


def test_labels_do_not_reach_names_with_the_same_end(spark):
    d = tempfile.mkdtemp(prefix="ris-")
    paths = [_write(d, n, f"TY  - JOUR\nT1  - {n}\nER  - \n") for n in ("incl.ris", "asylum_incl.ris")]
    os.mkdir(os.path.join(d, "more"))
    paths.append(_write(os.path.join(d, "more"), "incl.ris", "TY  - JOUR\nT1  - deep\nER  - \n"))
    df = read_ris(spark, paths, labels={paths[0]: {"cite_label": "a"}, paths[1]: {"cite_label": "b"},
                                        os.path.join(d, "more"): {"cite_label": "c"}})
    assert [(r["title"], r["cite_label"]) for r in df.orderBy("ordinal").collect()] == [
        ("incl.ris", "a"), ("asylum_incl.ris", "b"), ("deep", "c")]


def test_no_value_is_lost(spark):
    d = tempfile.mkdtemp(prefix="ris-")
    text = ("TY  -JOUR\nT1  - One\nUR  - u1\nUR  - u2\nN1  - n1\nN1  - n2\nDA  - 2020/01/02\nY1  - 2019//\n"
            "PY  - 2020/05//\nJF  - Full\nJO  - Short\nU1  - 7\nER  - \n")
    r = read_ris(spark, _write(d, "a.ris", text)).first()
    assert (r["type"], r["url"], r["notes"], r["date"], r["year"], r["journal"]) == (
        "JOUR", "u1", "n1", "2020/01/02", 2020, "Full")
    assert r["extra"] == {"UR": ["u2"], "N1": ["n2"], "Y1": ["2019//"], "PY": ["2020/05//"], "JO": ["Short"]}


def test_lines_that_look_like_tags_survive(spark):
    d = tempfile.mkdtemp(prefix="ris-")
    odd = "first\nER  - not the end\n AB  - indented\nTY  - JOUR\nplain"
    src = spark.createDataFrame([(1, "5", "JOUR", odd), (2, "6", "JOUR", "x")],
                                "ordinal long, eppi_id string, type string, abstract string")
    out = os.path.join(d, "out")
    write_ris(src, out)
    back = [(r["eppi_id"], r["abstract"]) for r in read_ris(spark, out).orderBy("ordinal").collect()]
    assert back == [("5", odd), ("6", "x")]
    with pytest.raises(ValueError):
        write_ris(src.withColumn("human_code", F.lit(1)), out)
