"""Encoders, token store, token counts and packing against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from plain import clashing, ordered, texts
from tokenizers import Tokenizer

from fleetplan.llm import packing, pretokens, token_counts, token_store
from fleetplan.llm.queries import tokenizer

BYTES, WORDS, PIECES = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json"), tokenizer("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "\n", "a", "  a  b ", "it's don't 's x'S I'LL we're'foo''s 12's", "\n\n x\n's  'll", "tab\tx \n  y\r\n",
    "naïve ÉCOLE ß × ½ “q” 日本", "<|endoftext|> a<|startoftext|>", "a▁b", "́é", "a\x1cb\x00c", "İI ſ K", " \n\nA", "<s> </s><0x41>", "x" * 3000,
]


def samples(n=800):
    rng = random.Random(4)
    parts = ["a", "B", "é", "É", " ", "  ", "\n", "'", "s", "ll", "1", "22", ".", "!", "\t", "re", "'t", "don't", "Wort"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def library(path):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: model.encode(text or "")
    tool = Tokenizer.from_file(path)
    return lambda text: tool.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kind,path", [(pretokens.ByteLevelEncoder, BYTES), (pretokens.WordEncoder, WORDS), (pretokens.PieceEncoder, PIECES)])
@pytest.mark.parametrize("table", [100_000, 30])
def test_encoders(kind, path, table):
    own, one = kind(path, table=table), library(path)
    rows = samples(800 if table > 100 else 150)
    counts, ids = [], []
    for _, _, n, flat in own.encode(pa.array(rows)):
        counts += n.tolist()
        if flat is not None:
            ids += flat.tolist()
    expected = [one(x) for x in rows]
    assert counts == list(map(len, expected))
    assert not own.with_ids or ids == [i for x in expected for i in x]


def documents(spark, extra=()):
    rows = [(i - 5, t) for i, t in enumerate(samples(120))] + texts(3, 20) + [(3, "again"), (3, "again"), (None, "no key"), *extra]
    return rows, clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)


def test_count_tokens(spark):
    rows, docs = documents(spark)
    one = library(PIECES)
    expected = [(k, len((t or "").encode()), len(one(t)), len(one(t)) > 20) for k, t in rows]
    assert ordered(token_counts.count_tokens(docs, PIECES, limit=20).collect()) == ordered(expected)
    assert ordered(token_counts.count_tokens(docs, PIECES, limit=20, entries=3).collect()) == ordered(expected)
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


@pytest.mark.parametrize("shard_bytes", [12 << 20, 500])
def test_token_store(spark, shard_bytes):
    rows, docs = documents(spark)
    one = library(BYTES)
    manifest = token_store.write_tokens(docs, BYTES, end=0, shard_bytes=shard_bytes)
    got = token_store.read_tokens(manifest).collect()
    raw = lambda t: np.array([*one(t), 0], "<u4").tobytes()
    assert ordered((r.doc_id, bytes(r.ids)) for r in got) == ordered((k, raw(t)) for k, t in rows)
    got.sort(key=lambda r: r.start)
    at = 0
    for before, r in zip([None, *got], got):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        assert before is None or before.doc_id is None or before.doc_id <= r.doc_id
        at += r.n_tokens
    asked = spark.createDataFrame([(3,), (0,), (999_999,), (None,), (-5,), (3,)], "doc_id long")
    found = token_store.lookup_tokens(manifest, asked).collect()
    assert ordered((r.doc_id, bytes(r.ids)) for r in found) == ordered((k, raw(t)) for k, t in rows if k in (3, 0, -5))
    assert token_store.read_tokens(token_store.write_tokens(docs.limit(0), BYTES, end=0)).count() == 0


def test_shards_of_one_key_stay_small(spark):
    text = "the same words in every row " * 200
    docs = spark.createDataFrame([(7, text)] * 300 + [(None, text)] * 300, "doc_id long, text string").repartition(3)
    manifest = token_store.write_tokens(docs, BYTES, end=0, shard_bytes=300_000)
    files = manifest.collect()
    assert max(r.n_documents for r in files) <= 300_000 // len(text) and sum(r.n_documents for r in files) == 600
    got = token_store.read_tokens(manifest).collect()
    assert len(got) == 600 and len({bytes(r.ids) for r in got}) == 1
    assert token_store.lookup_tokens(manifest, docs.select("doc_id")).count() == 300


def test_perfect_hash():
    for n in (0, 1, 2, 1000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 60, n, np.uint64))
        assert sorted(token_store.PerfectHash.build(keys).slots(keys)) == list(range(len(keys)))


@pytest.mark.parametrize("length", [2048, 64])
def test_pack(spark, length):
    rows, docs = documents(spark, [(1000 + i, "word " * (i % 90)) for i in range(150)])
    one = library(WORDS)
    pieces = [r.asDict() for r in packing.pack(docs, WORDS, end=1, length=length).collect()]
    by_text = sorted(np.array([*one(t), 1], "<u4").tobytes() for _, t in rows)
    sequences = {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        sequences.setdefault(p["sequence_id"], []).append(p)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length
    sizes = [sum(p["length"] for p in parts) for parts in sequences.values()]
    assert sum(s < length for s in sizes) <= 1
    own = {}
    for p in pieces:
        own.setdefault(p["doc_id"], []).append(p)
    count = {k: sum(1 for key, _ in rows if key == k) for k, _ in rows}
    alone = {k: b"".join(bytes(p["ids"]) for p in sorted(v, key=lambda p: p["start"])) for k, v in own.items() if count[k] == 1}
    assert alone == {k: np.array([*one(t), 1], "<u4").tobytes() for k, t in rows if count[k] == 1}
    assert sum(map(len, by_text)) == sum(len(p["ids"]) for p in pieces)
    assert packing.pack(docs.limit(0), WORDS, end=1).count() == 0


def test_repeats_stay_within_the_histogram():
    rng = np.random.default_rng(2)
    for histogram in (rng.integers(0, 50, 256), np.eye(256, dtype=int)[100] * 1000, np.zeros(256, int)):
        sets = packing.patterns(histogram, 256)
        used = np.zeros(256, int)
        for parts, n in zip(sets, packing.repeats(histogram, sets)):
            assert sum(parts) == 256
            for part in parts[parts > 0]:
                used[part] += n
        assert (used[1:] <= histogram[1:]).all()


def test_crc_is_of_the_ids(spark):
    from pyspark.sql import functions as F

    ids = np.array([1, 70_000], "<u4").tobytes()
    assert spark.createDataFrame([(ids,)], "x binary").select(F.crc32("x")).first()[0] == zlib.crc32(ids)
