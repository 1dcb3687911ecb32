"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random
import re

WORDS = [a + b for a in ("ka", "lo", "mi", "ren", "tu", "sha", "é", "Ñ") for b in ("n", "ra", "st", "pe", "ö", "X", "do", "i")]
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Clashes with names that operators use inside.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, row long, words long, "
          "n long, copies long, cls long, kept boolean")


def prose(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]))
        out.append("\n" if k % 17 == 16 else rng.choice([" ", " ", " ", "  ", "\t"]))
    return "".join(out)


def documents(seed: int = 3, n: int = 90, long_words: int = 6000) -> list[tuple]:
    """Prose, exact and near copies, nulls, empty and blank texts, a long text, repeated rows, null ids."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randint(1, 160)) for _ in range(n)]
    for k in range(0, n, 6):  # near copies: one word changed
        w = texts[k].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    base = prose(rng, 120).split(" ")
    for _ in range(12):  # a group of near copies
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [t.replace(" ", " \t") for t in texts[:8]] + [texts[9]] * 6
    texts += [None, None, "", "", " \n\t ", "one", "One", "one two three four", prose(rng, long_words)]
    texts += ["Wher. " * 60, "ab\n" * 30 + "cd e\n \n", "x" * 5000, "a b c " * 3 + "d " * 60]
    rows = [(k * 3 + 1, t, "en", f"s{k % 4 if k % 3 else 0}", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id here " * 20, None, None, None), (None, None, None, None, None),
             (10**12 + 7, texts[5], None, None, 5)]
    rng.shuffle(rows)
    return [(*r, 5, 6, 7, 8, 9, 10, True) for r in rows]


def frame(spark, rows: list[tuple], parts: int = 5):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)
