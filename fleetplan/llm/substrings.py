"""Removal of repeated word passages within a corpus.

A window is ``length`` consecutive words of one document. Every word is removed that lies in a window whose
words also start in a document with a smaller key; windows are judged on the input.

Documents are dealt into ranges of consecutive keys, so that a window repeats an earlier document if it is in
an earlier range, or in an earlier document of its own range. A range is one chunk; one of many bytes (long
documents, or many rows of one key) is dealt over several chunks by a hash of text and row, and these also send
the smallest key of each window. Rows without a key have chunks of their own. A chunk holds about twice
``CHUNK_BYTES`` at most, or one longer document. A chunk sends the sorted different 64-bit hashes
of its windows to parts of the hash range, in messages of six bytes a window. A part sorts what all chunks
sent and answers each message with one bit a window: whether a key before the chunk's own has it. A window
that a chunk holds often, or that a third of all documents share, is one hash in each chunk's message.
Removal goes by equality of 64-bit hashes of the windows: among n different windows the expected number of wrong
pairs is n * n / 2^65, about 0.0005 at the 140 million windows of 0.5 GB.

The README says why reference shards are not kept as suffix automata here; ``automaton.py`` has them for
references of bounded size.

Null or odd input: null and empty texts have no words; rows with a null key lose nothing and take nothing from
others; rows with equal keys do not remove each other's words; an empty table gives no rows. Keys are integers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetplan.llm.texts import BYTE_VALUES, blocks, short_batches, span_hashes, window_places, word_hashes, words

#: Words of a window.
LENGTH = 13
#: What a row counts besides its text.
ROW_BYTES = 64
#: Bytes of text of a chunk, and windows that one part receives (about one for each six bytes of text).
CHUNK_BYTES, PART_WINDOWS = 4 << 20, 2_000_000


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("key", "ascending"), ("text", "ascending")]).combine_chunks()


def _windows(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows in order: places of their first words, window hashes, windows' first words, windows of each row."""
    hashes, counts = [np.zeros(0, np.uint64)], []
    for _, _, data, offsets in blocks(table.column("text")):
        starts, ends, first = words(data, offsets)
        hashes.append(word_hashes(BYTE_VALUES[data], starts, ends))
        counts.append(np.diff(first))
    of_words = np.concatenate(hashes)
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    at, n = window_places(first, length)
    return first, span_hashes(of_words, at, at + length), at, n


def _bounds(parts: int) -> np.ndarray:
    """The first hash of each part but the first."""
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def pack(hashes: np.ndarray) -> bytes:
    """Sorted different hashes as steps of six bytes; a first byte tells if they need eight."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    if len(steps) > 1 and int(steps[1:].max()) >> 48:
        return b"\x08" + hashes.tobytes()
    return b"\x06" + hashes[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[0] == 8:
        return np.frombuffer(data, np.uint64, offset=1)
    steps = np.zeros(((len(data) - 9) // 6 + 1, 8), np.uint8)
    steps[1:, :6] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    steps = steps.reshape(-1).view(np.uint64)
    steps[0] = np.frombuffer(data, np.uint64, 1, 1)[0]
    return np.cumsum(steps, dtype=np.uint64)


def _keyed(table: pa.Table, first_windows: np.ndarray) -> np.ndarray:
    """For each window whether its row has a key."""
    return np.repeat(np.asarray(table.column("key").is_valid()), first_windows)


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, part_windows: int = PART_WINDOWS, carry: bool = False) -> DataFrame:
    """One row (``key``, n_words, n_removed, kept, removed) for each document.

    ``kept`` is what is left, words joined by one space; ``removed`` are the runs of removed words as
    (start, end), counted in words of the input. With ``carry`` come ``text``, the input's text, and
    ``row``, its other columns.
    """
    spark = documents.sparkSession
    short_batches(spark)
    others = [F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text]).alias("row")] if carry else []
    rows = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), *others)
    total, n_rows = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    chunks = (int(total or 0) + ROW_BYTES * n_rows) // chunk_bytes + 1
    parts = int(total or 0) // (6 * part_windows) + 1
    cuts = np.zeros(0, np.int64)
    if chunks > 1:
        shares = [i / chunks for i in range(1, chunks)]
        found = rows.agg(F.percentile_approx("key", F.array(*[F.lit(s) for s in shares]), 20 * chunks)).first()[0]
        cuts = np.unique(np.array(found or [], np.int64))
    key_cuts = spark.sparkContext.broadcast(cuts)

    def range_of(keys: pa.Array) -> np.ndarray:
        """Range 0 is of the rows without a key."""
        at = np.searchsorted(key_cuts.value, keys.fill_null(0).to_numpy(), "right") + 1
        return np.where(np.asarray(keys.is_null()), 0, at)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.iinfo(np.int64)
        n = len(key_cuts.value) + 2
        size, least, most = np.zeros(n, np.int64), np.full(n, bounds.max), np.full(n, bounds.min)
        for batch in batches:
            at, keys = range_of(batch.column(0)), batch.column(0).fill_null(0).to_numpy()
            np.add.at(size, at, batch.column(1).to_numpy() + ROW_BYTES)
            np.minimum.at(least, at, keys)
            np.maximum.at(most, at, keys)
        full = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full, size[full], least[full], most[full])], names=["range", "size", "least", "most"])

    sizes = rows.select("key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))
    weighed = sizes.mapInArrow(weigh, "range bigint, size bigint, least bigint, most bigint").groupBy("range")
    weighed = weighed.agg(F.sum("size"), F.min("least"), F.max("most")).collect()  # one row for each range
    split, mixed = np.ones(len(cuts) + 2, np.int64), np.zeros(len(cuts) + 2, bool)
    for at, size, least, most in weighed:
        if size > 2 * chunk_bytes:
            split[at] = -(-size // chunk_bytes)
            mixed[at] = at > 0 and least < most
    # chunks of each range, the first one's number, and whether its chunks share keys that differ
    ranges = spark.sparkContext.broadcast((split, np.cumsum(split) - split, mixed))

    def range_of_chunk(chunk: np.ndarray) -> np.ndarray:
        return np.searchsorted(ranges.value[1], chunk, "right") - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, base, _ = ranges.value
        seen = Counter()
        for batch in batches:
            at = range_of(batch.column(0))
            chunk = base[at]
            for i in np.flatnonzero(split[at] > 1).tolist():
                # by the text and how often the task has met it, so that the order of rows does not matter
                text = zlib.crc32((batch.column(1)[i].as_py() or "").encode())
                mark = (batch.column(0)[i].as_py(), text)
                chunk[i] += zlib.crc32(seen[mark].to_bytes(8, "little"), text) % int(split[at[i]])
                seen[mark] += 1
            yield pa.RecordBatch.from_arrays([pa.array(chunk), *batch.columns], names=["chunk", *batch.schema.names])

    more = f", text string, row {rows.schema['row'].dataType.simpleString()}" if carry else ""
    dealt = rows.mapInArrow(deal, "chunk bigint, key bigint, text string" + more.removeprefix(", text string"))

    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        with_keys = bool(ranges.value[2][range_of_chunk(np.array([chunk]))[0]])
        if with_keys:
            table = _sorted(table)
        _, hashes, _, n = _windows(table, length)
        keyed = _keyed(table, n)
        # rows are in the order of keys where keys are sent, so that a window's first one has its smallest
        if with_keys:
            different, own_first = np.unique(hashes[keyed], return_index=True)
            least = np.repeat(table.column("key").fill_null(0).to_numpy(), n)[keyed][own_first]
        else:
            different = np.unique(hashes[keyed])
        at = [0, *np.searchsorted(different, _bounds(parts)).tolist(), len(different)]
        full = [i for i in range(parts) if at[i + 1] > at[i]]
        return pa.table(
            [
                pa.array(full, pa.int64()),
                pa.array([chunk] * len(full), pa.int64()),
                pa.array([pack(different[at[i] : at[i + 1]]) for i in full], pa.binary()),
                pa.array([least[at[i] : at[i + 1]].tobytes() if with_keys else None for i in full], pa.binary()),
            ],
            names=["part", "chunk", "message", "keys"],
        )

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk").combine_chunks()
        messages = [unpack(x) for x in table.column("message").to_pylist()]
        hashes = np.concatenate(messages)
        own = range_of_chunk(table.column("chunk").to_numpy())
        known = np.zeros(len(hashes), bool)
        if (own[1:] > own[:-1]).all():
            order = np.argsort(hashes, kind="stable")  # equal hashes in the order of ranges
            ordered = hashes[order]
            known[order[1:]] = ordered[1:] == ordered[:-1]
        else:
            sizes = [len(m) for m in messages]
            keys = np.concatenate([np.zeros(n, np.int64) if x is None else np.frombuffer(x, np.int64) for n, x in zip(sizes, table.column("keys").to_pylist())])
            own = np.repeat(own, sizes)
            order = np.lexsort((keys, own, hashes))
            ordered, own, keys = hashes[order], own[order], keys[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = ordered[1:] != ordered[:-1]
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            known[order] = (own != own[head]) | (keys != keys[head])
        ends = np.cumsum([len(m) for m in messages])[:-1]
        replies = [np.packbits(x).tobytes() for x in np.split(known, ends)]
        return pa.table([table.column("chunk"), table.column("part"), pa.array(replies, pa.binary())], names=["chunk", "part", "reply"])

    def resolve(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = _sorted(table)
        first, hashes, at, n = _windows(table, length)
        keyed = _keyed(table, n)
        keys = table.column("key").fill_null(0).to_numpy()
        owner = np.repeat(keys, n)
        different, own_first, place = np.unique(hashes[keyed], return_index=True, return_inverse=True)
        repeated = np.zeros(len(hashes), bool)
        if len(different):
            cut = [0, *np.searchsorted(different, _bounds(parts)).tolist(), len(different)]
            known = np.zeros(len(different), bool)
            for part, reply in zip(replies.column("part").to_pylist(), replies.column("reply").to_pylist()):
                known[cut[part] : cut[part + 1]] = np.unpackbits(np.frombuffer(reply, np.uint8), count=cut[part + 1] - cut[part])
            own = owner[keyed]
            repeated[keyed] = known[place] | (own[own_first][place] < own)
        # how many repeated windows open and close at each word
        depth = np.zeros(first[-1] + 1, np.int64)
        depth[at[repeated]] += 1
        np.subtract.at(depth, at[repeated] + length, 1)
        gone = np.cumsum(depth)[:-1] > 0
        kept, runs, sizes, removed = [], [], [], []
        for i, text in enumerate(table.column("text").to_pylist()):
            a, b = first[i], first[i + 1]
            own = (text or "").encode().split()
            lost = gone[a:b]
            edges = np.flatnonzero(np.diff(lost.astype(np.int8), prepend=0, append=0)).tolist()
            kept.append((b" ".join(compress(own, (~lost).tolist())) if edges else b" ".join(own)).decode())
            runs.append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])])
            sizes.append(b - a)
            removed.append(int(lost.sum()))
        found = [table.column("key"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(runs, spans)]
        return pa.table(found + ([table.column("text"), table.column("row")] if carry else []), names=names)

    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    names = [key, "n_words", "n_removed", "kept", "removed"] + (["text", "row"] if carry else [])
    # of the rows as they are, so that both uses share one exchange of the texts
    messages = dealt.groupBy("chunk").applyInArrow(send, "part bigint, chunk bigint, message binary, keys binary")
    answers = messages.groupBy("part").applyInArrow(answer, "chunk bigint, part bigint, reply binary")
    return (
        dealt.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(resolve, f"`{key}` bigint, n_words bigint, n_removed bigint, kept string, removed array<struct<start:int,end:int>>" + more)
    )


def without_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``documents`` with repeated passages cut out of their texts. A text that loses nothing stays as it is; a
    document of which nothing is left goes."""
    found = remove_repeats(documents, key, text, length, carry=True)
    left = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    columns = [left.alias(text) if c == text else F.col(f"row.`{c}`") for c in documents.columns]
    return found.where((F.col("n_removed") == 0) | (F.col("kept") != "")).select(*columns)
