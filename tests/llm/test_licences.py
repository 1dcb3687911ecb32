import re

from sievekit.llm.licences import TEMPLATES, scan_licences, scan_units
from tests.llm.cases import LOWER, SCHEMA, documents, frame


def words(t):
    return re.sub(r"[\W_]+", " ", t.translate(LOWER)).split()


def grams(t):
    w = words(t)
    return set(zip(w, w[1:], strict=False))


def brute(rows):
    hits = set()
    for r in rows:
        t = r[1] or ""
        units = [t, *re.split(r"\n[ \t\r]*\n", t), *t.split("\n")]
        w = words(t)
        for name, body in TEMPLATES.items():
            b, n = grams(body), len(words(body))
            runs = [" ".join(w[i:i + n]) for i in range(len(w) - 1) if (w[i], w[i + 1]) in b]
            for a in map(grams, units + runs):
                if a and 2 * len(a & b) >= 0.8 * (len(a) + len(b)):
                    hits.add((r[0], name, round(2 * len(a & b) / (len(a) + len(b)), 6)))
    return hits


def test_units_are_those_of_plain_comparison(spark):
    rows = documents()
    notes = [(900, "Some words.\nReleased under the MIT license!\nMore words."), (901, TEMPLATES["MIT/text"] + "\n\nx y z"),
             (902, TEMPLATES["GPL-3.0/notice"].replace("hope that it", "hope it").replace(". ", ".\n")),
             (903, "Licensed under CC BY-NC 4.0."), (904, "Licensed under CC BY 4.0\nLicensed under CC BY-NC 4.0"),
             (905, "released under license of none")]
    rows += [(k, t, *rows[0][2:]) for k, t in notes]
    got = {(r["id"], r["template"], round(r["score"], 6)) for r in scan_units(frame(spark, rows)).collect()}
    assert got == brute(rows)
    found = {r["doc_id"]: r for r in scan_licences(frame(spark, rows)).collect()}
    assert found[900]["licence"] == "MIT" and found[901]["template"] == "MIT/text" and found[902]["licence"] == "GPL-3.0"
    assert found[904]["licences"] == "CC-BY-4.0,CC-BY-NC-4.0" and found[905]["licence"] is None
    assert scan_licences(frame(spark, rows)).count() == len(rows)


def test_notices_that_no_paragraph_or_line_isolates(spark):
    apache = TEMPLATES["Apache-2.0/notice"].split(". ")
    code = " ".join(f"def f{k} return x{k}" for k in range(80))
    texts = ["\n\n".join([". ".join(apache[:1]), ". ".join(apache[1:2]), ". ".join(apache[2:])]) + "\n\n" + code,
             TEMPLATES["Apache-2.0/notice"] + " " + code, "This dataset is released under the MIT License.",
             code + " Released under\nthe MIT\n\nLicense " + code, code]
    rows = [(k, t, "en", "s", 1, 5, 6, 7, 8, 9, 10, True) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["licence"] for r in scan_licences(frame(spark, rows)).collect()}
    assert got == {0: "Apache-2.0", 1: "Apache-2.0", 2: "MIT", 3: "MIT", 4: None}


def test_empty(spark):
    assert scan_licences(spark.createDataFrame([], SCHEMA)).count() == 0
