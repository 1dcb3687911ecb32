import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sievekit.llm.prefix_trie import EMPTY_SHA, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, q long, lo long, c long, pos long, name string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            dig = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), dig, role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, who in members.items():
        worth = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += worth
            leaves[node[:d]] += kids[node] == 0
    return sorted(
        (who[0], len(node), members[node[:-1]][0] if node else None, len(who), kids[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()) for node, who in members.items())


def awkward():
    rng = random.Random(5)
    word = ["a", "b", "ü", "", None, "long text " * 50]
    rows = []
    for c in range(120):
        copy = [(t, rng.choice(["user", "assistant", None, ""]), rng.choice(word)) for t in range(rng.randint(1, 14))]
        if c % 4 == 0:  # the hot conversation and its prefixes
            copy = [(t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(rng.choice([3, 9, 12]))]
        rows += [(c * 3 - 60, *t) for t in copy]
    deep = [(t, "user", f"d{t % 7}") for t in range(300)]
    for c in (1000, 1001, 1002, 1003):  # long shared prefixes, branching late
        rows += [(c, t, r, x if t < 40 * (c - 990) else f"{x} {c}") for t, r, x in deep]
    rows += [(1004, None, "user", "null turn"), (1004, None, "user", "null turn"), (1004, 0, "user", "x"), (1004, 0, "user", "w")]
    rows += [(None, 0, "user", "nobody"), (10**12, 0, "user", None), (77, 0, "user\n", "y"), (77, 0, "user", "\ny")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_against_brute_force(spark, parts):
    rows = awkward()
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], SCHEMA).repartition(parts)
    got = sorted(tuple(r) for r in prefix_trie(frame).collect())
    assert got == brute(rows)


def test_small_tables(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(7, 0, "user", "only")]  # too few turns of its own beyond the first h: turnless
    frame = spark.createDataFrame(one, "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in prefix_trie(frame).collect()] == brute(one)
    assert brute(one)[0][-1] != EMPTY_SHA
    with pytest.raises(ValueError):
        prefix_trie(spark.range(1))
