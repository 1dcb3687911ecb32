import random

import pytest

from sievekit.llm import ngram_join
from sievekit.llm.ngram_join import jaccard_components
from tests.llm.cases import LOWER, SCHEMA, WORD, documents, frame, prose


def brute(rows):
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOWER))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    key = lambda x: -1 if x is None else x
    return sorted((key(r[0]), len(sets[i]), key(least.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows))


def got(df):
    key = lambda x: -1 if x is None else x
    return sorted((key(r["doc_id"]), r["n_shingles"], key(r["component_id"])) for r in df.collect())


def test_awkward_rows(spark):
    rows = documents()
    assert got(jaccard_components(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_passages_and_chains(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "FRAGMENT_TOKENS", 400)  # many fragments
    rng = random.Random(seed)
    passage, base = prose(rng, 60), prose(rng, 80).split(" ")
    texts = [passage + prose(rng, rng.randint(3, 80)) for _ in range(50)]
    for _ in range(60):  # a drifting chain of near copies: the ends do not link
        base[rng.randrange(len(base))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(base))
    rows = [(k, t, "", "", 0, 1, 1, 1, 1, 1, 1, False) for k, t in enumerate(texts)]
    assert got(jaccard_components(frame(spark, rows))) == brute(rows)


def test_empty_table_and_no_words(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, None), (3, " "), (4, "")]
    df = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(df) == [(3, 0, 3), (4, 0, 4), (5, 0, 5)]


def test_words_that_mirror_themselves_stay_apart(spark):
    """A Thue-Morse word and its complement collide under any polynomial hash modulo 2^64."""
    bits = [bin(k).count("1") % 2 for k in range(1 << 14)]
    texts = ["".join("ab"[b ^ flip] for b in bits[:n]) for n in (1 << 10, 1 << 12, 1 << 14) for flip in (0, 1)]
    rows = [(k, t) for k, t in enumerate(texts + ["x " + t for t in texts])]
    out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {k: k for k, _ in rows}
