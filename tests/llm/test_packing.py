import re
import zlib

import numpy as np
import pytest

from sievekit.llm.packing import pack
from sievekit.llm.tokens import PieceEncoder, encoder, vocabulary_path
from tests.llm.cases import documents, frame

ODD = ["", " ", "a   b\x85 c d \x1c!x\x1c\n\n y  ", "it's  don't\t\tI'll <|endoftext|> z", "É́ e ́a ǅ İstanbul ΟΔΟΣ.",
       "x   y 　z", "\n\n\n", "tab\t\tend \t", "日本語 テキスト  。", "1234 56,78 9"]


def whole(vocabulary, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(vocabulary))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_by_piece_are_those_of_whole_texts(vocabulary):
    texts = ODD + [r[1] for r in documents(5, 40)]
    want = whole(vocabulary, texts)
    for e in (PieceEncoder(vocabulary), encoder(vocabulary)):
        assert [x.tolist() for x in e.ids(texts)] == want


@pytest.mark.parametrize("run", [" ", "\n"])
def test_long_white_space_runs(monkeypatch, run):
    texts = ["a " + run * 2_000_000 + "b c", run * 2_000_000, "x" + run * 150_000]
    want = whole("byte_bpe_50k.json", texts)
    e = encoder("byte_bpe_50k.json")
    assert [x.tolist() for x in e.ids(texts)] == want
    monkeypatch.setattr(e, "_LONG_SPACE", re.compile("(?!)"))  # tiktoken itself refuses the text
    assert [x.tolist() for x in e.ids(texts)] == want


def check_pack(rows, pieces, length):
    ids = whole("byte_bpe_50k.json", [r[1] for r in rows])
    want = sorted((-1 if r[0] is None else r[0], tuple([*x, 1])) for r, x in zip(rows, ids, strict=True))
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append(p)
        assert zlib.crc32(np.array(p["ids"], "<u4")) == p["ids_crc32"] and len(p["ids"]) == p["length"] > 0
    assert sorted(by) == list(range(len(by)))
    stream = []
    for s in sorted(by):
        run = sorted(by[s], key=lambda p: p["offset"])
        at = 0
        for p in run:
            assert p["offset"] == at
            at += p["length"]
            stream.append(p)
        assert at == length or s == len(by) - 1
        pad = run[0]["padded_length"]
        assert pad == (at if at & (at - 1) == 0 else length)
    # the concatenation is the documents one after the other, each whole
    got, k = [], 0
    while k < len(stream):
        first, ids_, left = stream[k], [], stream[k]["doc_tokens"]
        while left:
            p = stream[k]
            assert p["doc_id"] == first["doc_id"] and p["start"] == len(ids_)
            ids_ += p["ids"]
            left -= p["length"]
            k += 1
        got.append((-1 if first["doc_id"] is None else first["doc_id"], tuple(ids_)))
    assert sorted(got) == want


def test_pack_covers_every_id_once(spark):
    rows = documents()
    for length in (2048, 64):
        check_pack(rows, pack(frame(spark, rows), length=length).collect(), length)


def test_pack_empty(spark):
    out = pack(frame(spark, [], 1))
    assert out.count() == 0 and out.columns[:7] == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
