import zlib

import numpy as np
import pytest

from sievekit.llm.range_coder import decode_blocks, encode_blocks
from sievekit.llm.token_files import CorruptRecord, decode_record, encode_record, read_token_files, write_token_files
from sievekit.session import scratch_dir
from tests.llm.cases import SCHEMA, documents, frame
from tests.llm.test_packing import whole


@pytest.mark.parametrize("kind", ["noise", "runs", "cycle", "edges"])
def test_blocks_round_trip(kind):
    rng = np.random.default_rng(4)
    sizes = np.array([900, 900, 512, 40, 1, 1])
    rows = np.zeros((6, 900), np.uint16)
    for k, n in enumerate(sizes):
        rows[k, :n] = {"noise": rng.integers(0, 65536, n), "runs": np.repeat(rng.integers(0, 9, n), 30)[:n],
                       "cycle": np.arange(n) % 7, "edges": rng.choice([0, 1, 65535, 256, 255], n)}[kind]
    packed = encode_blocks(rows, sizes)
    back = decode_blocks(packed, sizes)
    assert all((back[k, :n] == rows[k, :n]).all() for k, n in enumerate(sizes))
    alone = encode_blocks(rows[2:3], sizes[2:3])  # a block does not depend on its neighbours
    assert alone[0] == packed[2]
    if kind == "cycle":
        assert len(packed[0]) < 900 / 4


def test_record_round_trip_and_checksums():
    rng = np.random.default_rng(5)
    ids = [rng.integers(0, 49408, n).astype(np.uint32) for n in (3, 1, 5000, 0, 1024)]
    names = [None, 5, -7, 2**60, 9]
    data = encode_record(names, ids)
    docs, back = decode_record(data)
    assert docs == names and all((a == b).all() for a, b in zip(ids, back, strict=True))
    for at in (3, 40, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(CorruptRecord):
            decode_record(bytes(bad))
    with pytest.raises(ValueError):
        encode_record([1], [np.array([70000], np.uint32)])


def test_files_hold_all_documents_in_order(spark):
    rows = documents()
    path = scratch_dir(spark, "token-files")
    write_token_files(frame(spark, rows), path)
    got = read_token_files(spark, path).orderBy("start").collect()
    ids = whole("word_bpe_49k.json", [r[1] for r in rows])
    want = sorted((-1 if r[0] is None else r[0], [*x, 1]) for r, x in zip(rows, ids, strict=True))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in got) == want
    assert [r["doc_id"] is not None and r["doc_id"] for r in got] == sorted(r["doc_id"] is not None and r["doc_id"] for r in got)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4"))
        at += r["n_tokens"]


def test_empty(spark):
    path = scratch_dir(spark, "token-files")
    write_token_files(spark.createDataFrame([], SCHEMA), path)
    assert read_token_files(spark, path).count() == 0
