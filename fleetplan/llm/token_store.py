"""Token ids in binary shard files, with keyed access through a minimal perfect hash.

A shard file holds, little-endian: an 8-byte mark; the length of a JSON head (uint32) and the head (sizes);
the ids of its documents one after the other, as uint16 where the vocabulary allows and else uint32; the
documents' offsets (uint64, one more than documents); their keys (int64) and null flags (uint8); and the
index. The index is a minimal perfect hash of the different keys: bit arrays by level, each with one bit for
every key that has a place of its own there, and for each slot a 32-bit fingerprint of the key and the place
of its first document. A lookup hashes the key, reads one slot, compares the fingerprint and knows the
offset, without a search. Shards follow each other in ascending key order; a manifest names them.

Null or odd input: null texts are empty and hold the end id alone; null keys come first and have no keyed
access; rows with equal keys follow each other by the hash of their text, and a lookup gives all of them.
An empty table gives no shard. Keys are integers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetplan.llm.files import new_folder, read_file, write_file
from fleetplan.llm.pretokens import ByteLevelEncoder, Encoder, encoder
from fleetplan.llm.texts import mix, short_batches
from fleetplan.session import stage

MARK = b"TOKENS01"
#: Bytes of text for one shard, and what a row counts besides its text.
SHARD_BYTES, ROW_BYTES = 12 << 20, 17
#: Places of a level's bit array for each key that is left.
GAMMA = 2.0


class PerfectHash:
    """A minimal perfect hash of different 64-bit keys: each key has a slot below their number."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [int(x.sum()) for x in levels]
        self.base = np.cumsum([0, *ones])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = max(8, int(GAMMA * len(keys)))
            at = cls._places(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot or -1 for a key that was not built in."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = self._places(keys[left], i, len(bits))
            hit = bits[at] == 1
            found[left[hit]] = self.base[i] + self.ranks[i][at[hit]]
            left = left[~hit]
        return found


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """One shard file in memory."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, keys: np.ndarray, nulls: np.ndarray, index: PerfectHash, prints: np.ndarray, first: np.ndarray):
        self.ids, self.offsets, self.keys, self.nulls = ids, offsets, keys, nulls
        self.index, self.prints, self.first = index, prints, first

    @classmethod
    def build(cls, ids: np.ndarray, counts: np.ndarray, keys: np.ndarray, nulls: np.ndarray) -> Shard:
        """``keys`` ascending, those of null flags first."""
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)
        start = int(nulls.sum())
        different, first = np.unique(keys[start:], return_index=True)
        different = different.view(np.uint64)
        index = PerfectHash.build(different)
        slots = index.slots(different)
        prints, place = np.zeros(len(different), np.uint32), np.zeros(len(different), np.uint32)
        prints[slots], place[slots] = _fingerprint(different), first + start
        return cls(ids, offsets, keys, nulls, index, prints, place)

    def parts(self) -> list[bytes]:
        levels = [len(x) for x in self.index.levels]
        head = json.dumps({"width": self.ids.itemsize, "ids": len(self.ids), "documents": len(self.keys), "slots": len(self.prints), "levels": levels}).encode()
        arrays = [self.ids, self.offsets, self.keys, self.nulls, self.prints, self.first, *[np.packbits(x) for x in self.index.levels]]
        return [MARK, np.uint32(len(head)).tobytes(), head, *[x.tobytes() for x in arrays]]

    @classmethod
    def parse(cls, data: bytes) -> Shard:
        if data[:8] != MARK:
            raise ValueError("not a shard file")
        size = int(np.frombuffer(data, "<u4", 1, 8)[0])
        head, at = json.loads(data[12 : 12 + size]), 12 + size

        def take(kind, n):
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        n, slots = head["documents"], head["slots"]
        fields = [take(f"<u{head['width']}", head["ids"]), take("<u8", n + 1), take("<i8", n), take("u1", n)]
        prints, first = take("<u4", slots), take("<u4", slots)
        levels = [np.unpackbits(take("u1", (m + 7) // 8), count=m) for m in head["levels"]]
        return cls(*fields, PerfectHash(levels), prints, first)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of the first document of each key (int64), or -1."""
        if not len(self.prints):
            return np.full(len(keys), -1, np.int64)
        asked = np.ascontiguousarray(keys, np.int64).view(np.uint64)
        slots = self.index.slots(asked)
        known = (slots >= 0) & (self.prints[slots] == _fingerprint(asked))
        return np.where(known, self.first[slots].astype(np.int64), -1)

    def payload(self, place: int) -> np.ndarray:
        return self.ids[int(self.offsets[place]) : int(self.offsets[place + 1])]


def write_tokens(
    documents: DataFrame,
    path: str,
    end: int,
    key: str = "doc_id",
    text: str = "text",
    kind: type[Encoder] = ByteLevelEncoder,
    folder: str | None = None,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write the shards and return the manifest: (shard, folder, file, n_documents, n_ids, first_key, last_key, start).

    ``start`` counts the ids of all shards before.
    """
    spark = documents.sparkSession
    short_batches(spark)
    folder = folder or new_folder(spark, "token-shards")
    total, n_rows = documents.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    # a task's rows mostly fit one shard; ``row`` lets even equal rows go to several tasks
    tasks = (int(total or 0) + ROW_BYTES * n_rows) * 5 // (4 * shard_bytes) + 1
    rows = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    by = [F.asc_nulls_first("key"), "tie", "row"]
    ordered = rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(kind, path)
        ids, counts, keys, nulls, size, n_files = [], [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in (ids, counts, keys, nulls)]
            shard = TaskContext.get().partitionId() << 32 | n_files
            name = write_file(folder, f"shard-{shard >> 32:07d}-{n_files:05d}", Shard.build(*parts).parts())
            real = parts[2][parts[3] == 0]
            ends = [int(real[0]), int(real[-1])] if len(real) else [None, None]
            row = {"shard": [shard], "file": [name], "n_documents": [len(parts[1])], "n_ids": [len(parts[0])], "first_key": ends[:1], "last_key": ends[1:]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int64()), ("file", pa.string()), *[(c, pa.int64()) for c in list(row)[2:]]]))

        for batch in batches:
            column = batch.column(0)
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy()
            for first, last, n, flat in tool.encode(batch.column(1)):
                more = int(sizes[first:last].sum()) + ROW_BYTES * (last - first)
                if counts and size + more > shard_bytes:
                    yield close()
                    ids, counts, keys, nulls, size, n_files = [], [], [], [], 0, n_files + 1
                size += more
                part = column.slice(first, last - first)
                nulls.append(np.asarray(part.is_null(), np.uint8))
                keys.append(part.fill_null(0).to_numpy())
                ids.append(np.insert(flat, np.cumsum(n), np.uint16(end)))
                counts.append(n + 1)
        if counts:
            yield close()

    files = ordered.select("key", "text").mapInArrow(write, "shard bigint, file string, n_documents bigint, n_ids bigint, first_key bigint, last_key bigint")
    files = stage(files, "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return files.select("shard", F.lit(folder).alias("folder"), "file", "n_documents", "n_ids", "first_key", "last_key", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))


def _spread(manifest: DataFrame) -> DataFrame:
    """One shard or a few for each task."""
    n = max(1, manifest.count())
    return manifest.repartition(n, "shard")


def read_tokens(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """All documents of the shards: (``key``, start, n_tokens, ids).

    ``start`` counts the ids of all documents before; ``ids`` is little-endian uint32. Each key is looked up
    in its shard's index.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.parse(read_file(row["folder"], row["file"]))
                n = len(shard.keys)
                place = shard.find(shard.keys)
                # the documents of one key follow its first; null keys have their order alone
                fresh = np.ones(n, bool)
                fresh[1:] = (shard.keys[1:] != shard.keys[:-1]) | (shard.nulls[1:] != shard.nulls[:-1])
                rank = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
                place = np.where(shard.nulls == 1, np.arange(n), place + rank)
                if (place != np.arange(n)).any():
                    raise ValueError(f"{row['file']}: the index does not lead to the documents")
                for lo in range(0, n, 500):
                    at = place[lo : lo + 500]
                    ids = [shard.payload(i).astype("<u4").tobytes() for i in at.tolist()]
                    start = shard.offsets[at].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.keys[lo : lo + 500], mask=shard.nulls[lo : lo + 500] == 1),
                            pa.array(start + row["start"]),
                            pa.array(shard.offsets[at + 1].astype(np.int64) - start),
                            pa.array(ids, pa.binary()),
                        ],
                        names=[key, "start", "n_tokens", "ids"],
                    )

    return _spread(manifest).mapInArrow(read, f"`{key}` bigint, start bigint, n_tokens bigint, ids binary")


def lookup_tokens(manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of the asked keys: (``key``, place, ids). Keys that no shard holds give no row."""
    asked = keys.select(F.col(key).cast("bigint").alias("key")).where(F.col("key").isNotNull()).distinct()
    routed = asked.join(manifest, (F.col("key") >= F.col("first_key")) & (F.col("key") <= F.col("last_key")))
    grouped = routed.select("shard", "folder", "file", "key")

    def find(table: pa.Table) -> pa.Table:
        shard = Shard.parse(read_file(table["folder"][0].as_py(), table["file"][0].as_py()))
        asked = table["key"].to_numpy()
        out = {"key": [], "place": [], "ids": []}
        for k, at in zip(asked.tolist(), shard.find(asked).tolist()):
            while 0 <= at < len(shard.keys) and shard.keys[at] == k and not shard.nulls[at]:
                out["key"].append(k)
                out["place"].append(at)
                out["ids"].append(shard.payload(at).astype("<u4").tobytes())
                at += 1
        return pa.table([pa.array(out["key"], pa.int64()), pa.array(out["place"], pa.int64()), pa.array(out["ids"], pa.binary())], names=[key, "place", "ids"])

    return grouped.groupBy("shard").applyInArrow(find, f"`{key}` bigint, place bigint, ids binary")


