"""Adjudication report: write, read back, sections and block order."""

import glob
import os
import tempfile

from sievekit.sources.report import read_report, write_report


def _decisions(spark):
    rows = [
        (11, 1, "T one", "Abstract one", "A) yes\nB) no\nTherefore exclude.", 0, 1, "m-1", "2026-06-04"),
        (12, 2, "T two", "Abstract two", "fine", 1, 0, "m-1", "2026-06-04"),
        (13, 3, "T three", "Abstract three", "ok", 0, 0, "m-1", "2026-06-04"),
        (14, 4, "T four", "Abstract four", "ok", 1, 1, "m-1", "2026-06-04"),
        (15, 5, "T five", "Abstract five", "ok", 0, 1, "m-1", "2026-06-04"),
        (16, 6, "T six", "Abstract six", "no code", 1, None, "m-1", "2026-06-04"),
    ]
    return spark.createDataFrame(rows, "eppi_id long, ordinal long, title string, abstract string, answer string, "
                                       "decision_binary int, human_code int, model string, run_date string")


def test_report_round_trip(spark):
    d = tempfile.mkdtemp(prefix="rep-")
    path = os.path.join(d, "report")
    write_report(_decisions(spark), path)
    back = {r["study_id"]: r for r in read_report(spark, path).collect()}
    assert set(back) == {"11", "12", "13", "14", "15"}  # uncoded row not reported
    assert back["11"]["section"] == "False exclusion" and back["12"]["section"] == "False inclusion"
    assert back["14"]["section"] == "Agreements" and back["13"]["section"] == "Agreements"
    assert back["11"]["answer"] == "A) yes\nB) no\nTherefore exclude."
    assert back["11"]["title"] == "T one" and back["11"]["abstract"] == "Abstract one"
    assert str(back["11"]["run_date"]) == "2026-06-04" and back["11"]["model"] == "m-1"


def test_report_text_order(spark):
    d = tempfile.mkdtemp(prefix="rep-")
    path = os.path.join(d, "report")
    write_report(_decisions(spark), path)
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(os.path.join(path, "part-*"))))
    ids = [line.split(": ")[1].rstrip(":*") for line in text.splitlines() if line.startswith("**STUDY-ID")]
    # false exclusions (ordinal order), false inclusion, agreements 1/1 then 0/0
    assert ids == ["11", "15", "12", "14", "13"]
    assert text.index("##### **False exclusion**") < text.index("**STUDY-ID: 11:**")
    assert text.index("#### **Agreements**") < text.index("**STUDY-ID: 14:**")


def test_missing_values_and_ids_with_blanks(spark):
    rows = [(1, 10**17 + 1, None, "NA", "x", 1, 1), ("a b", 10**17, "\\NA", None, "\\\\NA", 1, 1), (None, 10**17 + 2, "t", "a", "y", 0, 0)]
    rows = [(None if r[0] is None else str(r[0]), *r[1:], None, "2026-06-04") for r in rows]
    df = spark.createDataFrame(rows, "eppi_id string, ordinal long, title string, abstract string, answer string, "
                                     "decision_binary int, human_code int, model string, run_date string")
    path = os.path.join(tempfile.mkdtemp(prefix="rep-"), "report")
    write_report(df, path)
    back = {r["study_id"]: (r["title"], r["abstract"], r["answer"], r["model"]) for r in read_report(spark, path).collect()}
    assert back == {"1": (None, "NA", "x", None), "a b": ("\\NA", None, "\\\\NA", None), None: ("t", "a", "y", None)}
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(os.path.join(path, "part-*"))))
    assert text.index("STUDY-ID: a b") < text.index("STUDY-ID: 1:")  # ordinals beyond the range of doubles
