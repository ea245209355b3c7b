"""Decontamination, similarity join and passages against plain versions, on troublesome rows."""

import pytest
from plain import classes, clashing, decontaminated, ordered, texts, without_repeats

from pyspark.sql import functions as F

from fleetplan.llm import components, decontaminate, jaccard, substrings
from fleetplan.llm.automaton import remove_known

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clashing(spark.createDataFrame(rows, DOCS)).repartition(5).cache()


ITEMS = [
    (1, " ".join(f"w{i}" for i in range(5))),
    (2, "a a a a a a a a a a a a"),
    (3, None),
    (4, ""),
    (5, "changed"),
    (6, "A, a. a a a a a a a a"),
    (10, "changed"),
    (None, "b b b b b b b b b b b"),
]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_decontaminate(spark, docs, rows, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_ROWS", broadcast)
    long_item = (7, rows[0][1].upper())
    items = [*ITEMS[:-1], long_item, (8, rows[3][1])]
    benchmark = clashing(spark.createDataFrame(items, "item_id long, text string"))
    found = decontaminate.decontaminate(docs, benchmark)
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found.collect()]
    assert ordered(got) == ordered(decontaminated(rows, items))
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in found.collect())
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert ordered((r.doc_id, r.text) for r in clean.collect()) == ordered(x for x, y in zip(rows, decontaminated(rows, items)) if not y[4])


def test_decontaminate_empty(spark, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, none).collect())
    assert decontaminate.clean_documents(docs, none).count() == len(rows)
    assert decontaminate.decontaminate(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("blocks", [(1000, 256), (4, 3)])
def test_similar_documents(docs, rows, blocks, monkeypatch):
    monkeypatch.setattr(jaccard, "SIGNATURE_BLOCK", blocks[0])
    monkeypatch.setattr(jaccard, "SET_BLOCK", blocks[1])
    if blocks[0] < 1000:
        monkeypatch.setattr(jaccard, "MAX_BROADCAST_IDS", 0)
    expected = [(key, *found) for (key, _), found in zip(rows, classes(rows))]
    assert ordered(jaccard.similar_documents(docs).collect()) == ordered(expected)


def test_one_of_each_class(docs, rows):
    stays = jaccard.one_of_each_class(docs)
    assert stays.columns == docs.columns
    got = ordered((r.doc_id, r.text) for r in stays.collect())
    expected = {x for x, c in zip(rows, classes(rows)) if x[0] == c[0]}
    assert got == ordered(expected)
    assert jaccard.one_of_each_class(docs.limit(0)).count() == 0


def test_prefix_is_shortened_to_the_recall():
    assert jaccard.prefix_depth(0.8, 0.5) == jaccard.DEPTH
    assert jaccard.prefix_depth(0.8, 0.99999) == 5
    assert jaccard.prefix_depth(0.5, 0.99999) < jaccard.prefix_depth(0.8, 0.99999)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (105, 100), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 105: 100}


@pytest.mark.parametrize("sizes", [(8 << 20, 3_000_000), (2_000, 100)])
def test_remove_repeats(docs, rows, sizes):
    found = substrings.remove_repeats(docs, chunk_bytes=sizes[0], part_windows=sizes[1])
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()]
    assert ordered(got) == ordered(without_repeats(rows))


def test_remove_repeats_deals_bytes(spark, monkeypatch):
    """Many rows of one key, a run of long documents, and rows without a key or text make no large chunk."""
    passage = lambda i: " ".join(f"p{i}w{j}" for j in range(15))
    rows = [(i, f"{passage(i % 40)} {passage(1000 + i)}") for i in range(200)]
    rows += [(77, f"{passage(i % 60)} own {i}") for i in range(200)] + [(77, passage(3))] * 100
    rows += [(500 + i, " ".join(passage(i * 3 + j) for j in range(40))) for i in range(30)]
    rows += [(None, passage(5))] * 200 + [(None, None)] * 100 + [(None, "")] * 100
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    # a chunk of more than this fails in its task
    most, whole = 3 * 20_000, substrings._sorted

    def checked(table):
        assert sum(len(x or "") + 64 for x in table.column("text").to_pylist()) <= most
        return whole(table)

    monkeypatch.setattr(substrings, "_sorted", checked)
    for part_windows in (100, 2_000_000):
        found = substrings.remove_repeats(docs, chunk_bytes=20_000, part_windows=part_windows)
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()]
        assert ordered(got) == ordered(without_repeats(rows))


def test_without_repeats(docs, rows):
    found = substrings.without_repeats(docs)
    assert found.columns == docs.columns
    expected = [(k, kept if n else text) for (k, text), (_, _, n, kept) in zip(rows, without_repeats(rows)) if not n or kept]
    assert ordered((r.doc_id, r.text) for r in found.collect()) == ordered(expected)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_messages_keep_hashes():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, top in ((1, 1 << 62), (5, 1 << 62), (50_000, 1 << 63), (3, 10)):
        hashes = np.unique(rng.integers(0, top, n, np.uint64))
        assert (substrings.unpack(substrings.pack(hashes)) == hashes).all()


def test_suffix_automata(spark, docs, rows, monkeypatch):
    from fleetplan.llm import automaton

    monkeypatch.setattr(automaton, "SHARD_WORDS", 60)
    reference = [r for r in rows if r[0] is not None and r[0] % 2 == 0][:12]
    windows = {tuple(w[i : i + 5]) for w in (plain_words(t) for _, t in reference) for i in range(len(w) - 4)}
    got = remove_known(docs, spark.createDataFrame(reference, DOCS), length=5).collect()
    expected = []
    for key, text in rows:
        w = plain_words(text)
        gone = {j for i in range(len(w) - 4) if tuple(w[i : i + 5]) in windows for j in range(i, i + 5)}
        expected.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert ordered(got) == ordered(expected)
    monkeypatch.setattr(automaton, "MAX_WORDS", 10)
    with pytest.raises(ValueError):
        remove_known(docs, spark.createDataFrame(reference, DOCS))


def plain_words(text):
    return (text or "").split()


def near_pairs(swaps, pairs=120):
    """Pairs of texts of 200 words that differ in some words, each of which changes five shingles."""
    out = []
    for p in range(pairs):
        words = [f"p{p}w{i}" for i in range(200)]
        other = [w if i % (200 // swaps) != 7 else f"x{w}" for i, w in enumerate(words)]
        out += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(other))]
    return out


@pytest.mark.parametrize("swaps, depths", [(1, [6]), (4, [6, 5])])
def test_forest_shortens_where_the_data_ask(spark, swaps, depths, monkeypatch):
    """Pairs far above the threshold are found by whole strings; pairs at it ask for a shorter prefix. None is lost."""
    seen = []
    compared = jaccard._compared
    monkeypatch.setattr(jaccard, "_compared", lambda *args: seen.append(args[3]) or compared(*args))
    rows = near_pairs(swaps)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_documents(docs).collect()}
    assert seen == depths
    assert found == {key: (key - key % 2, 1) for key, _ in rows}


def test_forest_estimate_counts_each_pair_once(spark):
    """The sum over all meetings of a pair is one, in however many trees it meets."""
    rows = near_pairs(1, 50)
    sets = jaccard._sketches(spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "id AS tag"))
    sets = sets.withColumn("node", F.col("id"))
    below, nodes = jaccard._level(jaccard._forest(sets), 6)
    every = below.join(below.groupBy("bucket").count().where("count > 1").withColumnRenamed("count", "members"), "bucket")
    met = jaccard._compared(sets, every, 0.8, 6)
    total = met.agg(F.sum("found").alias("found"), F.sum("like").alias("like")).first()
    assert abs(total["found"] - 50) < 1e-6 and 50 <= total["like"] < 50.01
    assert nodes.count() <= 50
