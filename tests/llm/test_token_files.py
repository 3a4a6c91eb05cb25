"""Token files against the tokenizer itself, and Elias-Fano numbers against plain lists."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tabloom.llm import common, queries, token_files

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = [
    "a", "b", "'s", "'t", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "　", ",", ".", "!", "1", "23", "é", "日本",
    "\U0001f642", "\0", "<|endoftext|>", "<|", "'", "ſ", " a", " .", ", x", ".\nB",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BYTES)


def expected(rows, tokenizer):
    """doc_id, start, n_tokens and checksum of (doc_id, text) rows; rows of equal or null ids come in any order."""
    ids = [[*e.ids, 0] for e in tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    return sorted((i is not None, i or 0, len(x), zlib.crc32(np.array(x, "<u4"))) for (i, _), x in zip(rows, ids))


def gapless(got):
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("count,most", [(0, 0), (1, 0), (1, 2**63), (5, 3), (300, 300), (1000, 10**6), (3000, 100), (2000, 2**62), (513, 0)])
def test_elias_fano(count, most):
    values = np.sort(np.random.default_rng(count).integers(0, most + 1, count, dtype=np.uint64))
    data = token_files.EliasFano.encode(values)
    read = token_files.EliasFano(memoryview(data))
    assert (read.values() == values).all() and read.values().dtype == np.uint64
    assert [read.select(k) for k in range(count)] == values.tolist()
    with pytest.raises(IndexError):
        read.select(count)
    if count:
        room = np.log2(max(1, int(values[-1]) / count))
        assert 8 * len(data) <= count * (room + 3.2) + 8 * 32


def test_ids_are_those_of_the_library(tokenizer):
    rng, tokens = random.Random(1), token_files.ByteIds(BYTES)
    tokens.LINES = 5
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(20000)]
    want = [np.array(e.ids, "<u2").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert tokens.ids(texts) == want
    assert [x for k in range(0, 20000, 37) for x in tokens.ids(texts[k : k + 37])] == want
    other, plain = token_files.ByteIds(WORDS), Tokenizer.from_file(WORDS)
    assert not other.apart and other.ids(["Some, text"])[0] == np.array(plain.encode("Some, text", add_special_tokens=False).ids, "<u2").tobytes()


def test_query_on_a_table(spark, tokenizer):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_token_files"](spark, SF).collect()
    assert sorted((True, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected(rows, tokenizer)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(i for i, _ in rows)
    gapless(got)


def test_nulls_repeats_long_texts_and_many_segments(spark, tokenizer):
    texts = [None, "", " \n", "short text.", "long " * 3000 + "end", "Zeile, zwei.\nDrei  vier <|endoftext|>", "日本語 テキスト"]
    rows = [(k - 3, t, "x", 1) for k, t in enumerate(texts * 5)]
    rows += [(5, texts[3], "x", 1)] * 3 + [(None, t, None, None) for t in texts] * 4 + [(2**62, "far", "x", 1), (-(2**62), "first", "x", 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, start string, part int").repartition(3)
    path = common.shared_path(spark, "many")
    token_files.write_corpus(documents, BYTES, path, segment_ids=2000, part_bytes=5000)
    got = token_files.read_corpus(spark, path).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == expected([r[:2] for r in rows], tokenizer)
    gapless(got)
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert in_order == sorted(in_order, key=lambda i: (i is not None, i or 0)) and in_order[0] is None
    # the joined form of the segment table gives the same
    assert sorted(map(repr, token_files.read_corpus(spark, path, broadcast_segments=0).collect())) == sorted(map(repr, got))
    files = [token_files.Segment(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(files) > 5 and sum(map(len, files)) == len(rows)
    by_crc = {r.ids_crc32 for r in got}
    for s in files:  # single documents through select
        for k in range(len(s)):
            assert zlib.crc32(s.ids(k).astype("<u4")) in by_crc and s.ids(k)[-1] == 0
        assert [s.doc_id(k) for k in range(len(s))] == sorted([s.doc_id(k) for k in range(len(s))], key=lambda i: (i is not None, i or 0))
    with pytest.raises(ValueError, match="no whole segment"):
        token_files.Segment(spark.read.format("binaryFile").load(path).first().content[:-50])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    assert token_files.round_trip(empty, BYTES).collect() == []


def test_batches_are_cut_into_few_rows_and_none_is_lost():
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(k, k + n))}) for k, n in ((0, 1), (1, 0), (1, 2000), (2001, 512))]
    cut = list(token_files.slices(batches))
    assert max(map(len, cut)) <= 512 and [i for b in cut for i in b.column("doc_id").to_pylist()] == list(range(2513))
