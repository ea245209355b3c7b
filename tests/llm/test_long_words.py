"""Long words that differ in every byte but have equal polynomials modulo a power of two."""

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fleetplan.llm import jaccard, pretokens, substrings, texts
from fleetplan.llm.queries import tokenizer


def twins(n):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate({97: "b", 98: "a"})


@pytest.mark.parametrize("n", [64, 65, 1024, 2048, 4096])
def test_hashes_differ(n):
    data = np.frombuffer("".join(twins(n)).encode(), np.uint8)
    one, other = texts.word_hashes(texts.BYTE_VALUES[data], np.array([0, n]), np.array([n, 2 * n]))
    assert one != other


@pytest.mark.parametrize("kind, name", [(pretokens.ByteLevelEncoder, "byte_bpe_50k.json"), (pretokens.WordEncoder, "word_bpe_49k.json"), (pretokens.PieceEncoder, "piece_bpe_32k.model")])
def test_encoders(kind, name):
    rows = [w for n in (65, 1024, 2048) for w in twins(n)]
    path = tokenizer(name)
    if name.endswith(".model"):
        expected = sentencepiece.SentencePieceProcessor(model_file=path).encode(rows)
    else:
        expected = [x.ids for x in Tokenizer.from_file(path).encode_batch(rows, add_special_tokens=False)]
    found = list(kind(path).encode(pa.array(rows)))
    assert [n for block in found for n in block[2].tolist()] == list(map(len, expected))
    if kind.with_ids:
        assert [i for block in found for i in block[3].tolist()] == [i for ids in expected for i in ids]


def test_passages_and_shingles(spark):
    one, other = twins(1024)
    rest = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{other} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 13}
    short = spark.createDataFrame([(1, one), (2, other), (3, one.upper())], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in jaccard.similar_documents(short).collect()} == {1: 1, 2: 2, 3: 1}
