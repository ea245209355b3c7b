"""Token counts by a map-side lookup in two tiers.

Tier one is a compact hash table of the most frequent pre-tokens and their numbers of ids, broadcast once;
its size is a parameter. Tier two is a table in each worker, filled by the library as pre-tokens are missed.
Pre-tokens never cross the network: the frequent ones are found from a bounded summary that each task makes
of all its texts, and a wrong guess there costs time, never a count.

Null or odd input: null and empty texts have no bytes and no tokens; repeated rows are each counted; an empty
table gives no rows; texts that the pre-token bounds do not cover go to the library whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetplan.llm.pretokens import Encoder, PieceEncoder, encoder
from fleetplan.llm.texts import blocks, short_batches

#: Entries of the broadcast table (12 bytes each: 2 MB).
FREQUENT = 1 << 17
#: Pre-tokens that one task tracks while it reads, and reports at its end.
TRACKED, REPORTED = 1 << 15, 1 << 12


def _heaviest(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(hashes) <= n:
        return hashes, counts
    top = np.argpartition(counts, len(counts) - n)[-n:]
    return hashes[top], counts[top]


def frequent_pretokens(documents: DataFrame, path: str, text: str = "text", kind: type[Encoder] = PieceEncoder, entries: int = FREQUENT):
    """Hashes and numbers of ids of about the ``entries`` most frequent pre-tokens of all texts."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(kind, path)
        hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        lengths: dict[int, int] = {}
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                data, starts, ends, found, _ = tool.spans(data, offsets)
                new, firsts, n = np.unique(found, return_index=True, return_counts=True)
                merged, place = np.unique(np.concatenate([hashes, new]), return_inverse=True)
                sums = np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
                hashes, counts = _heaviest(merged, sums, TRACKED)
                # ids of what has become frequent, while its text is at hand
                heavy = set(_heaviest(hashes, counts, REPORTED)[0].tolist())
                want = [(h, i) for h, i in zip(new.tolist(), firsts.tolist()) if h in heavy and h not in lengths]
                parts = tool.encode_spans([tool.span_text(data, starts[i], ends[i]) for _, i in want]) if want else []
                lengths.update((h, len(ids)) for (h, _), ids in zip(want, parts))
        hashes, counts = _heaviest(hashes, counts, REPORTED)
        known = [i for i, h in enumerate(hashes.tolist()) if h in lengths]
        yield pa.RecordBatch.from_pydict(
            {
                "hash": pa.array(hashes[known].view(np.int64)),
                "length": pa.array([lengths[h] for h in hashes[known].tolist()], pa.int32()),
                "n": pa.array(counts[known]),
            }
        )

    summaries = documents.select(text).mapInArrow(summary, "hash bigint, length int, n bigint")
    top = summaries.groupBy("hash", "length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(entries)
    found = top.select("hash", "length").toArrow()  # at most ``entries`` rows
    return found["hash"].to_numpy().view(np.uint64), found["length"].to_numpy()


def count_tokens(
    documents: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 4096,
    kind: type[Encoder] = PieceEncoder,
    entries: int = FREQUENT,
) -> DataFrame:
    """One row (``key``, n_bytes, n_tokens, over_limit) for each document."""
    spark = documents.sparkSession
    short_batches(spark)
    hashes, lengths = frequent_pretokens(documents, path, text, kind, entries)
    known = spark.sparkContext.broadcast((hashes, lengths, uuid.uuid4().hex))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(kind, path, known)
        for batch in batches:
            tokens = [n for _, _, n, _ in tool.encode(batch.column(1))]
            tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens.astype(np.int64))], names=[key, "n_bytes", "n_tokens"])

    rows = documents.select(F.col(key), F.col(text), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    schema = f"`{key}` {rows.schema[0].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
