"""URL rules: a blocked Bloom filter before an exact hash join.

A rule is a (host, path) pair with a verdict. It fits its host and all subdomains where the path of a
URL starts with the rule's path; the longest fitting rule decides (by the length of host and path
together, then by the longer host), and URLs that no rule fits get a default verdict.

Each URL is cut into canonical keys, one for each (host suffix, path prefix) of a shape that some rule
has. A key reads one block of the Bloom filter; only possible hits reach the exact join with the rules.
Everything is a DataFrame expression.

Null or odd input: a URL that is null or holds no ``://`` has an empty host and an empty path, is fitted
by no rule and gets the default verdict. Empty hosts fit no rule. Repeated rows are each judged. Rules
with a null host or path are ignored; of rules with equal host and path, ``block`` counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each listed key, and the 64-bit lanes of one block (one bit is set in each).
BITS_PER_KEY = 16
LANES = 4
#: A filter or list of up to this many rows is offered for broadcasting (at most 64 MB); longer ones are
#: joined by shuffles.
MAX_BROADCAST_ROWS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    rest = F.substring_index(url, "://", 1)
    host = F.regexp_extract(F.substr(url, F.length(rest) + 4), r"^[^/?#]*", 0)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.translate(host, _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.substring_index(url, "://", 1)
    path = F.regexp_extract(F.substr(url, F.length(rest) + 4), r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, path).otherwise("")


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit(" "), path)


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def _lanes(key: Column) -> list[Column]:
    """The bit of each lane that a key sets."""
    bits = F.xxhash64(key, F.lit(1))
    place = lambda i: F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), place(i)) for i in range(LANES)]


def blocked_bloom(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter of the column ``key``: one row (block, lane0, lane1, ...) for each block with bits."""
    marked = keys.select(
        F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block"),
        *[lane.alias(f"lane{i}") for i, lane in enumerate(_lanes(F.col("key")))],
    )
    return marked.groupBy("block").agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])


def possible_hits(keys: DataFrame, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """The rows of ``keys`` whose ``key`` may be listed: all that are, and a few others."""
    probe = keys.withColumn("__block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)))
    renamed = bloom.select(F.col("block").alias("__block"), *[F.col(f"lane{i}").alias(f"__lane{i}") for i in range(LANES)])
    passes = F.lit(True)
    for i, lane in enumerate(_lanes(F.col("key"))):
        passes = passes & (F.col(f"__lane{i}").bitwiseAND(lane) != 0)
    return probe.join(_small(renamed), "__block").where(passes).select(*keys.columns)


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row (``key``, host, path, rule, verdict) for each row of ``pages``.

    ``rules`` has host, path and verdict (``allow`` or ``block``).
    """
    listed = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != ""))
        .groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))  # of allow and block, block is the larger
        .select(
            _key(F.col("host"), F.col("path")).alias("key"),
            F.concat("host", "path").alias("rule"),
            F.struct(F.length("host") + F.length("path"), F.length("host")).alias("rank"),
            "verdict",
            F.size(F.split("host", r"\.")).alias("labels"),
            F.length("path").alias("chars"),
        )
    )
    shapes = listed.select("labels", "chars").distinct().agg(F.collect_set(F.struct("labels", "chars"))).first()[0]
    urls = pages.select(F.col(key).alias("__id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not shapes:
        return urls.select(F.col("__id").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # Equal URLs are judged once; the answer depends on host and path alone.
    judged = urls.where(F.col("host") != "").select("host", "path").distinct()
    shape_list = F.array(*[F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["chars"]).alias("chars")) for s in sorted(shapes)])
    labels = F.size(F.split("host", r"\."))
    keys = (
        judged.withColumn("shape", F.explode(shape_list))
        .where((labels >= F.col("shape.labels")) & (F.length("path") >= F.col("shape.chars")))
        .select(
            "host",
            "path",
            _key(
                F.expr("substring_index(host, '.', -shape.labels)"),
                F.expr("substring(path, 1, shape.chars)"),
            ).alias("key"),
        )
    )
    n_rules = listed.count()
    n_blocks = max(1, n_rules * BITS_PER_KEY // (64 * LANES) + 1)
    hits = possible_hits(keys, blocked_bloom(listed, n_blocks), n_blocks)
    best = (
        hits.join(_small(listed.select("key", "rule", "rank", "verdict")), "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return (
        urls.join(best, ["host", "path"], "left")
        .select(F.col("__id").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )
