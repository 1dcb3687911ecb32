import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sievekit.llm.chat_format import DEFAULT, Template, format_chats, formatted, loss_text, read_chat, turn_segments

SCHEMA = "conv_id long, turn long, role string, text string, id long, pos long, state string, segments string"
NASTY = ["\\", "\\\\", "<", "</turn>", "</turn>\n", "</tur", "<\\/turn>", "###", "####", "#####", "##", "#", ": ", ":", ":\\ ",
         "### user: ", "\n", "", "x", "\\n", "$1", "é", "😀", "\\### Assistant: </turn> ok"]


def awkward():
    rng = random.Random(2)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", None, "", "as: sist", "Assistant", "###", "</turn>\n"])
            rows.append((c, t if c % 5 else 0, role, "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 8)))))
    rows += [(100, 0, "user", None), (100, 1, "assistant", "y " * 200_000), (101, None, "assistant", "first"), (101, 0, "user", "b"),
             (None, 0, "user", "nobody"), (None, 1, "assistant", "nothing"), (102, 0, "user", "same"), (102, 0, "user", "same")]
    good = ["system", "user", "assistant", "tool", "assistant", "user", "assistant"]
    rows += [(200, t, r, f"t{t}") for t, r in enumerate(good)] + [(201, t, r, "") for t, r in enumerate(good[:2])]
    rng.shuffle(rows)
    return rows


def chats(rows):
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(ts)] for c, ts in out.items()}


@pytest.mark.parametrize("parts", [1, 6])
def test_round_trip_and_loss(spark, parts):
    rows = awkward()
    frame = spark.createDataFrame([(*r, 1, 2, "s", "g") for r in rows], SCHEMA).repartition(parts)
    seg = F.col("segments")
    out = format_chats(frame).withColumn("chat", formatted(seg)).withColumn("learnt", loss_text(seg))
    got = {r["conv_id"]: r for r in out.withColumn("back", read_chat(F.col("chat"))).collect()}
    want = chats(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c]["back"]] == turns
        assert got[c]["n_turns"] == len(turns) and len(got[c]["segments"]) == 3 * len(turns)
        assert got[c]["learnt"] == "".join(x for r, x in turns if r == "assistant")
        body = [s["text"] for s in got[c]["segments"][1::3]]
        assert not any("###" in b or "</turn>" in b for b in body)
        assert got[c]["chat"].count("</turn>\n") == len(turns)
        state, bad = "start", None
        for i, (role, _) in enumerate(turns):
            if bad is None and role not in DEFAULT.follow.get(state, ()):
                bad = i
            state = role if role in ("system", "user", "assistant", "tool") else "other"
        bad = len(turns) if bad is None and state not in DEFAULT.final else bad
        assert (got[c]["valid"], got[c]["first_bad_turn"]) == (bad is None, bad)


def test_other_template(spark):
    t = Template(head="<|im|>", after_role="<|sep|>", end="<|end|>", control=("<|im|>", "<|sep|>", "<|end|>"),
                 follow={"start": ("human",), "human": ("bot", "other"), "bot": ("human",)}, final=("bot", "human"),
                 loss=("bot",))
    text = "a<|end|>b\\<|im|><|sep|>"
    frame = spark.createDataFrame([(1, 0, "human", text), (1, 1, "bot", text)], "conv_id long, turn long, role string, text string")
    row = format_chats(frame, t).withColumn("chat", formatted(F.col("segments"))).withColumn(
        "back", read_chat(F.col("chat"), t)).first()
    assert [tuple(x) for x in row["back"]] == [("human", text), ("bot", text)] and row["valid"]
    assert hashlib.sha256(row["chat"].encode()).hexdigest() and row["chat"].startswith("<|im|>human<|sep|>a<\\|end|>b\\\\")


def test_empty_and_native_plan(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chats(empty).count() == 0
    plan = turn_segments(empty)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
