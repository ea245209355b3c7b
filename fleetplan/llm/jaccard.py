"""Similarity join of texts by word n-grams: a forest of MinHash strings, then exact verification.

1. A text becomes the set of its shingles (five words; A-Z lower-cased, punctuation dropped; a text of one to
   four words is one shingle). Texts with equal sets are one class, represented once.
2. A set's signature is cut into trees, each a string of MinHash digits. The strings of a tree are stored in their
   order: a trie, whose nodes of a depth are the runs of equal prefixes. Sets that share a whole string meet first.
3. Sets that meet are compared by whole signatures, which drops nearly all chance meetings without
   dropping a pair at the threshold (5 standard deviations are allowed). Pairs that pass are links, and tell how
   many links there are like them: one of similarity s is found at depth d with chance 1 - (1 - s^d)^trees. While the
   share found is below the target, the matched prefix is shortened by one digit, and trie nodes that have grown
   by that are compared too. Links join sets into groups.
4. Inside a group all pairs are verified on their full shingle sets.

A group that is too large for a task is dealt into blocks, and each pair of blocks is compared in a task of its own; only
links of a spanning forest and counts leave a task, never all pairs. Copies cost nothing beyond their count.

Null or odd input: texts without words are similar to nothing and are a class of their own; repeated
rows are copies of each other; ids may repeat or be null (a class takes the smallest id that is not null); texts are read to
their end; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetplan.llm.components import cells, components, roots, sorted_groups
from fleetplan.llm.texts import ALNUM, LOWER_VALUES, blocks, short_batches, span_hashes, word_hashes, words
from fleetplan.session import stage

#: Words of a shingle, and the least Jaccard similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Trees of the forest, digits of a tree's label, and the least share of links at the threshold to be found.
TREES, DEPTH, RECALL = 32, 6, 0.99999
#: Sets of one block: two blocks at most meet in a task.
SIGNATURE_BLOCK, SET_BLOCK = 1000, 256
#: Up to this many ids are broadcast to fetch texts (16 MB); beyond that a shuffle join does it.
MAX_BROADCAST_IDS = 2_000_000

_DIGITS = TREES * DEPTH
_DRAW = np.random.Generator(np.random.PCG64(5))
_XOR = _DRAW.integers(0, 1 << 63, _DIGITS, np.uint64)
_TIMES = _DRAW.integers(0, 1 << 63, _DIGITS, np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_depth(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that finds the target share of the pairs of this similarity, and more of those above: no shorter one is ever needed."""
    while depth > 1 and found_share(similarity, depth, trees) < recall:
        depth -= 1
    return depth


def found_share(similarity, depth: int, trees: int = TREES):
    """The chance that two sets of this similarity share a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shingle_sets(data: np.ndarray, offsets: np.ndarray, length: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted different 64-bit hashes of its shingles."""
    starts, ends, first = words(data, offsets, ALNUM)
    hashed = word_hashes(LOWER_VALUES[data], starts, ends)
    at = np.arange(max(0, len(hashed) - length + 1))
    shingles = span_hashes(hashed, at, at + length)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= length:
            yield np.unique(shingles[a : b - length + 1])
        elif b > a:
            yield span_hashes(hashed[a:b], np.zeros(1, np.int64), np.array([b - a]))
        else:
            yield np.zeros(0, np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """16-bit MinHash digits of a set."""
    least = np.full(_DIGITS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1024):
        part = found[i : i + 1024, None] ^ _XOR
        part *= _TIMES
        np.minimum(least, part.min(0), out=least)
    return (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _sketches(documents: DataFrame) -> DataFrame:
    """(id, tag, set, n, sign) of each row of (id, text, tag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, signs = [], [], []
            for _, _, data, offsets in blocks(batch.column(1)):
                for found in shingle_sets(data, offsets):
                    digests.append(_digest(found))
                    sizes.append(len(found))
                    signs.append(signature(found).tobytes() if len(found) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())],
                names=["id", "tag", "set", "n", "sign"],
            )

    return documents.mapInArrow(run, f"id {documents.schema['id'].dataType.simpleString()}, tag bigint, set binary, n bigint, sign binary")


def _forest(sets: DataFrame) -> DataFrame:
    """Stored: the strings of all trees, (tree, label, node), in order of tree and label."""
    label = f"substring(sign, {2 * DEPTH} * t + 1, {2 * DEPTH})"
    strings = sets.select("node", F.inline(F.expr(f"transform(sequence(0, {TREES - 1}), t -> struct(t AS tree, {label} AS label))")))
    # with the node, so that a label that many sets share is dealt to several tasks
    ordered = strings.select("tree", "label", "node").repartitionByRange("tree", "label", "node")
    return stage(ordered.sortWithinPartitions("tree", "label", "node"), "forest")


def _level(forest: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The sets below each trie node of a depth, (node, bucket), and the different nodes with two or more."""
    below = forest.select("node", F.xxhash64("tree", F.substring("label", 1, 2 * depth)).alias("bucket"))
    nodes = below.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("head"), F.bit_xor(F.xxhash64("node")).alias("who")).where("members > 1")
    # the same sets meet below many nodes: one of those is enough
    return below, nodes.groupBy("members", "head", "who").agg(F.min("bucket").alias("bucket"))


def _candidate_links(sets: DataFrame, similarity: float, recall: float) -> DataFrame:
    """Links (a, b) that join all sets which may be similar into one group."""
    forest = _forest(sets)
    links = None
    for depth in range(DEPTH, prefix_depth(similarity, recall) - 1, -1):
        below, nodes = _level(forest, depth)
        if depth < DEPTH:  # what has not grown since was compared one digit before
            nodes = nodes.join(_level(forest, depth + 1)[1].drop("bucket"), ["members", "head", "who"], "left_anti")
        met = stage(_compared(sets, below.join(nodes.select("bucket", "members"), "bucket"), similarity, depth), f"met-{depth}")
        found = met.where("a IS NOT NULL").select("a", "b")
        links = found if links is None else links.unionByName(found)
        # of all links like those met at this depth, the share that it finds
        seen = met.agg(F.sum("found").alias("found"), F.sum("like").alias("like")).first()
        if seen["like"] and seen["found"] >= recall * seen["like"]:
            break
    return links


def _compared(sets: DataFrame, meetings: DataFrame, similarity: float, depth: int) -> DataFrame:
    """Links (a, b) of sets that meet in (node, bucket, members) and have like signatures. A row without link
    has sums over the pairs of a cell: ``found``, pairs by the share of their meetings that lies there, and ``like``,
    the number of pairs that these stand for."""
    members = cells(meetings, "bucket", "node", "members", SIGNATURE_BLOCK)
    rows = members.select("cell", "side", "node").join(sets.select("node", "n", "sign"), "node").select("cell", "side", "node", "n", "sign")
    # five standard deviations of the share of equal digits below the threshold
    least = similarity - 5 * (similarity * (1 - similarity) / _DIGITS) ** 0.5

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            m = len(group)
            if m < 2:
                continue
            side, node, n = (group.column(i).to_numpy() for i in (1, 2, 3))
            signs = np.frombuffer(b"".join(group.column(4).to_pylist()), np.uint16).reshape(m, _DIGITS)
            linked = np.zeros((m, m), bool)
            found = like = 0.0
            for i in range(m - 1):
                same = signs[i + 1 :] == signs[i]
                equal = same.sum(1)
                near = equal >= least * _DIGITS
                near &= np.minimum(n[i + 1 :], n[i]) >= similarity * np.maximum(n[i + 1 :], n[i]) - 1e-9
                near &= (side[i] < 0) | (side[i + 1 :] != side[i])
                linked[i, i + 1 :] = near
                if near.any():
                    # a pair is met once for each tree in which its prefixes agree
                    met = same[near].reshape(-1, TREES, DEPTH)[:, :, :depth].all(2).sum(1)
                    share = 1 / np.maximum(met, 1)
                    found += share.sum()
                    like += (share / found_share(np.maximum(equal[near] / _DIGITS, similarity), depth)).sum()
            linked |= linked.T
            root = roots(linked)
            tied = np.flatnonzero(root != np.arange(m))
            links = len(tied)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*node[tied].tolist(), None], pa.int64()),
                        pa.array([*node[root[tied]].tolist(), None], pa.int64()),
                        pa.array([0.0] * links + [found]),
                        pa.array([0.0] * links + [like]),
                    ],
                    names=["a", "b", "found", "like"],
                )

    return _by_cell(rows).mapInArrow(compare, "a bigint, b bigint, found double, like double")


def _by_cell(rows: DataFrame) -> DataFrame:
    # by node as well, so that a cell has one order whenever it is computed again
    return rows.repartition("cell").sortWithinPartitions("cell", "node")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common members of each two of the sorted sets."""
    sizes = [len(x) for x in sets]
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    out = np.zeros((len(sets), len(sets)))
    width = max(1, (8 << 20) // len(sets))
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for lo in range(0, len(values), width):
        a, b = np.searchsorted(place, [lo, lo + width])
        part = np.zeros((len(sets), min(width, len(values) - lo)), np.float32)
        part[owner[a:b], place[a:b] - lo] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _verified(documents: DataFrame, sets: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(node, root, links): the set's links by rows, and a link of a spanning forest, from each cell."""
    grouped = groups.join(groups.groupBy("root").agg(F.count("*").alias("members")), "root")
    dealt = cells(grouped, "root", "node", "members", SET_BLOCK).select("cell", "side", "node")
    wanted = stage(groups.select("node").join(sets.select("node", "set", "first", "copies"), "node"), "wanted-sets")
    ids = wanted.select(F.col("first").alias("__first")).distinct()
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    texts = documents.join(ids, F.col("id").eqNullSafe(F.col("__first")), "left_semi")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(1)):
                found = list(shingle_sets(data, offsets))
                yield pa.RecordBatch.from_arrays([pa.array(map(_digest, found), pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["set", "shingles"])

    known = texts.select("id", "text").mapInArrow(expand, "set binary, shingles binary")
    # a set has one row in ``wanted``; ids that repeat can give it twice here
    nodes = wanted.join(known, "set").dropDuplicates(["node"]).select("node", "copies", "shingles")
    rows = dealt.join(nodes, "node").select("cell", "side", "node", "copies", "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            m = len(group)
            if m < 2:
                continue
            side, node, copies = (group.column(i).to_numpy() for i in (1, 2, 3))
            found = [np.frombuffer(x, np.uint64) for x in group.column(4).to_pylist()]
            n = np.array([len(x) for x in found])
            both = overlaps(found)
            linked = both >= similarity * (n[:, None] + n[None, :] - both) - 1e-9
            linked &= (side[:, None] < 0) | (side[:, None] != side[None, :])
            np.fill_diagonal(linked, False)
            root = roots(linked)
            tied = np.flatnonzero(linked.any(1))
            if len(tied):
                links = (linked * copies[None, :]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[root[tied]]), pa.array(links[tied])], names=["node", "root", "links"])

    return _by_cell(rows).mapInArrow(verify, "node bigint, root bigint, links bigint")


def _classes(documents: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(id, tag, set, class_id, class_tag, class_size, n_links) of each row of (id, text); ``tag`` is a hash
    of the text, and id and tag name the row that stands for the class."""
    short_batches(documents.sparkSession)
    rows = stage(_sketches(documents), "sketches")
    # ids that are null come last
    name = F.struct(F.col("id").isNull().alias("none"), "id", "tag")
    sets = rows.where("n > 0").groupBy("set").agg(F.min(name).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sign").alias("sign"))
    sets = stage(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    groups = components(_candidate_links(sets, similarity, recall))
    links = stage(_verified(documents, sets.withColumn("first", F.col("first.id")), groups, similarity), "verified")
    tree = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    classed = sets.select("set", "node", "first", "copies").join(tree, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = classed.groupBy("root").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size"))
    answers = classed.join(classes, "root").select("set", "head", "class_size", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = rows.select("id", "tag", F.when(F.col("n") > 0, F.col("set")).alias("set")).join(answers, "set", "left")
    none = F.col("set").isNull()
    return found.select(
        "id",
        "tag",
        F.when(none, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.when(none, F.col("tag")).otherwise(F.col("head.tag")).alias("class_tag"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def _named(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tag"))


def similar_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row (``key``, class_id, class_size, n_links) for each document.

    A class holds all documents connected by links; ``class_id`` is its smallest key, ``class_size`` its
    rows. ``n_links`` counts the other rows whose similarity to this one reaches the threshold.
    """
    found = _classes(_named(documents, key, text), similarity, recall)
    return found.select(F.col("id").alias(key), "class_id", "class_size", "n_links")


def one_of_each_class(documents: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``documents``, all columns, without those for which a similar one with a smaller key stays.

    Of rows that repeat key and text one stays.
    """
    found = _classes(_named(documents, key, text), similarity, recall)
    heads = found.where(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("tag") == F.col("class_tag")))
    # rows that repeat both have the same answer, so one of them carries it
    heads = heads.select(F.col("id").alias("__id"), F.col("tag").alias("__tag")).distinct()
    tagged = documents.withColumn("__text_tag", F.xxhash64(F.col(text)))
    kept = tagged.join(heads, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__text_tag") == F.col("__tag")))
    return kept.dropDuplicates(["__id", "__tag"]).select(*[F.col(f"`{c}`") for c in documents.columns])
