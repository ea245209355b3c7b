"""Packing of tokenized documents into sequences of fixed length by non-negative least squares.

A document is cut into whole sequences and a remainder. Remainders are packed by patterns, that is, sets of
two or three lengths that fill a sequence exactly. How often each pattern repeats is the non-negative least
squares solution against the histogram of remainders; repeats are rounded, never beyond what the histogram
holds. What is left over is packed greedily, longest first, as one stream that is cut where a sequence is
full, so that only the last sequence can have padding.

The driver sees the histogram (at most ``length`` - 1 numbers) and plans by length; documents find their place
by their rank among the remainders of equal length, counted in two levels so that one very common length is
not one task's work.

Null or odd input: null and empty texts hold the end id alone; repeated rows and rows with null keys are packed
each by itself; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetplan.llm.pretokens import Encoder, WordEncoder, encoder
from fleetplan.llm.texts import short_batches
from fleetplan.session import stage

#: Tokens of a sequence.
LENGTH = 2048
#: The most frequent lengths that are tried as second members of triples.
COMMON = 16
#: Rounds of the least-squares solution.
ROUNDS = 300
#: Rows of one length or of all documents are numbered in groups of about this many.
GROUP_ROWS = 100_000


def patterns(histogram: np.ndarray, length: int = LENGTH, common: int = COMMON) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to ``length``, from lengths that occur."""
    have = np.flatnonzero(histogram > 0)
    have = have[have > 0]
    found = {(int(a), int(length - a), 0) for a in have if a <= length - a and histogram[length - a]}
    top = have[np.argsort(-histogram[have], kind="stable")][:common]
    for b in [*top.tolist(), None]:
        for a in have.tolist():
            parts = sorted((a, a if b is None else b, length - a - (a if b is None else b)))
            if parts[0] > 0 and histogram[parts[0]] and histogram[parts[1]] and histogram[parts[2]]:
                found.add(tuple(reversed(parts)))
    return np.array(sorted(found), np.int64).reshape(-1, 3)


def repeats(histogram: np.ndarray, sets: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """How often each pattern is used: least squares with multiplicative steps, rounded within the histogram."""
    if not len(sets):
        return np.zeros(0, np.int64)
    size = len(histogram)
    target = histogram.astype(float)
    target[0] = 0
    member = sets > 0

    def use(x):  # lengths used by repeats x
        return np.bincount(sets.ravel(), np.where(member, x[:, None], 0).ravel(), minlength=size)

    def gain(v):  # sum of v over each pattern's members
        return np.where(member, v[sets], 0).sum(1)

    x = np.full(len(sets), max(1.0, target.sum() / (2 * len(sets))))
    wanted = gain(target)
    for _ in range(rounds):
        x *= wanted / np.maximum(gain(use(x)), 1e-9)
    left = histogram.astype(np.int64).copy()
    out = np.zeros(len(sets), np.int64)
    for i in np.argsort(-x, kind="stable").tolist():
        parts, times = np.unique(sets[i][member[i]], return_counts=True)
        out[i] = min(int(np.rint(x[i])), int((left[parts] // times).min()))
        left[parts] -= out[i] * times
    return out


def plan(histogram: np.ndarray, length: int = LENGTH) -> tuple[list[tuple], int, int]:
    """Slots by length and the stream's sequences: ([(length, first rank, rank after the last, first sequence,
    offset)], sequences of patterns, ids of the stream). A slot with sequence -1 begins the stream at ``offset``.
    """
    sets = patterns(histogram, length)
    times = repeats(histogram, sets)
    given = np.zeros(len(histogram), np.int64)
    slots, sequences = [], 0
    for parts, n in zip(sets.tolist(), times.tolist()):
        if not n:
            continue
        at = 0
        for part in parts:
            if part:
                slots.append((part, int(given[part]), int(given[part]) + n, sequences, at))
                given[part] += n
                at += part
        sequences += n
    stream = 0
    for part in range(len(histogram) - 1, 0, -1):
        left = int(histogram[part] - given[part])
        if left:
            slots.append((part, int(given[part]), int(histogram[part]), -1, stream))
            stream += left * part
    return slots, sequences, stream


def tokenize(documents: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text", kind: type[Encoder] = WordEncoder) -> DataFrame:
    """A stored table (row, key, n, ids) with ``end`` after each document; ids as little-endian uint16."""
    short_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(kind, path)
        for batch in batches:
            for first, last, n, flat in tool.encode(batch.column(1)):
                ends = np.cumsum(n)
                flat = np.insert(flat, ends, np.uint16(end))
                bounds = np.concatenate([[0], ends + np.arange(1, len(n) + 1)]).tolist()
                ids = pa.array([flat[a:b].tobytes() for a, b in pairwise(bounds)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array((n + 1).astype(np.int64)), ids], names=["key", "n", "ids"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = f"key {rows.schema[0].dataType.simpleString()}, n bigint, ids binary"
    # row ids are unique, and a fact once they are stored
    return stage(rows.mapInArrow(run, kinds).withColumn("row", F.monotonically_increasing_id()), "token-ids")


def place(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, pieces) for a stored table (row, n): pieces are (start, length, sequence_id, offset)."""
    spark = tokens.sparkSession
    rows = tokens.select("row", "n", (F.col("n") % length).alias("rest"), F.floor(F.col("n") / length).alias("whole"))
    counts = rows.groupBy("rest").agg(F.count("*").alias("n"), F.sum("whole").alias("whole")).collect()  # at most ``length`` rows
    histogram = np.zeros(length, np.int64)
    for r in counts:
        histogram[r["rest"]] = r["n"]
    total, wholes = int(histogram.sum()), sum(r["whole"] for r in counts)
    histogram[0] = 0
    slots, sequences, _ = plan(histogram, length)

    groups = total // GROUP_ROWS + 16
    rows = rows.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    sums = rows.groupBy("rest", "group").agg(F.count("*").alias("rows"), F.sum("whole").alias("whole"))
    earlier = Window.partitionBy("rest").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        "rest",
        "group",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rank_base"),
        F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("whole_base"),
    )
    inside = Window.partitionBy("rest", "group").orderBy("row")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.select(
        "row", "n", "rest", "whole", "group", (F.row_number().over(inside) - 1).alias("rank"), F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("wholes")
    )
    by_length: dict[int, list[tuple]] = {}
    for part, *slot in slots:
        by_length.setdefault(part, []).append(tuple(slot))
    # whole sequences of documents with smaller remainders
    sizes = sorted((r["rest"], r["whole"]) for r in counts)
    smaller = accumulate((n for _, n in sizes), initial=0)
    table = spark.createDataFrame(
        [(rest, by_length.get(rest), before) for (rest, _), before in zip(sizes, smaller)],
        "rest long, slots array<struct<first:long,last:long,sequence:long,at:long>>, whole_before long",
    )
    found = ranked.join(bases, ["rest", "group"]).withColumn("rank", F.col("rank") + F.col("rank_base")).join(F.broadcast(table), "rest")
    fits = lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["last"])
    found = found.withColumn("slot", F.get(F.filter("slots", fits), 0))
    start = F.col("whole") * length
    at = F.col("slot.at") + (F.col("rank") - F.col("slot.first")) * F.col("rest")  # in the stream
    first_stream = F.lit(int(wholes) + sequences)
    room = F.least(F.col("rest"), length - at % length)
    piece = lambda a, n, sequence, offset: F.struct(a.alias("start"), n.cast("bigint").alias("length"), sequence.cast("bigint").alias("sequence_id"), offset.cast("bigint").alias("offset"))
    nothing = F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>")
    whole = F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1), lambda i: piece(i * length, F.lit(length), F.col("whole_before") + F.col("whole_base") + F.col("wholes") + i, F.lit(0)))).otherwise(nothing)
    in_pattern = F.array(piece(start, F.col("rest"), F.lit(int(wholes)) + F.col("slot.sequence") + F.col("rank") - F.col("slot.first"), F.col("slot.at")))
    stream_first = piece(start, room, first_stream + F.floor(at / length), at % length)
    stream_second = piece(start + room, F.col("rest") - room, first_stream + F.floor(at / length) + 1, F.lit(0))
    in_stream = F.when(room < F.col("rest"), F.array(stream_first, stream_second)).otherwise(F.array(stream_first))
    rest = F.when(F.col("rest") == 0, nothing).when(F.col("slot.sequence") >= 0, in_pattern).otherwise(in_stream)
    return found.select("row", F.concat(whole, rest).alias("pieces"))


def pack(documents: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text", length: int = LENGTH, kind: type[Encoder] = WordEncoder) -> DataFrame:
    """One row for each piece: (``key``, start, length, doc_tokens, sequence_id, offset, ids).

    ``start`` counts the document's ids before the piece, ``offset`` those before it in its sequence; ``ids``
    is little-endian uint32.
    """
    tokens = tokenize(documents, path, end, key, text, kind)
    joined = tokens.join(place(tokens.select("row", "n"), length), "row").select("key", "n", "ids", F.explode("pieces").alias("piece"))
    cut = joined.select(
        "key",
        F.col("piece.start").alias("start"),
        F.col("piece.length").alias("length"),
        F.col("n").alias("doc_tokens"),
        F.col("piece.sequence_id").alias("sequence_id"),
        F.col("piece.offset").alias("offset"),
        F.expr("substring(ids, int(2 * piece.start + 1), int(2 * piece.length))").alias("ids"),
    )

    names = [key, *cut.columns[1:]]

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(ids, pa.binary())], names=names)

    kinds = ", ".join(f"`{key if f.name == 'key' else f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return cut.mapInArrow(widen, kinds)
