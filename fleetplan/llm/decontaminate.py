"""Benchmark decontamination by winnowing, with DataFrame expressions only.

Words are runs of 0-9, a-z and non-ASCII characters after A-Z are lower-cased. A window is ``length``
consecutive words of an item; an item with fewer words, but not none, is one window. A document word is
hit if it lies inside an occurrence of any window.

1. Both sides hash their k-grams of words and take the smallest hash of each run of ``w`` k-grams, where
   k + w - 1 is the window's length. Equal windows have equal smallest hashes, so a document and an item
   that share a window share a fingerprint, wherever it stands. Kept are the places where it changes, and
   at least every ``w``-th place.
2. Kept fingerprints of documents are joined to the items' fingerprints.
3. A hit is extended to the windows that the fingerprint stands for, and each is compared word for word.

Items shorter than a window use k = their length, w = 1. Windows are compared as classes of equal text, so
items or documents that repeat a passage do not multiply each other's hits.

Null or odd input: null and empty texts have no words and no hits; items without words have no windows;
repeated rows each get their row; null ids are kept as they are. An empty benchmark leaves all documents
clean. Only ``key``, ``text`` and the items' two columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetplan.session import stage

#: Words of a window.
LENGTH = 10
#: Words of a hashed k-gram in windows of full length.
GRAM = 6
#: Lists of benchmark fingerprints and windows of up to this many rows are offered for broadcasting (a
#: window holds 10 words: about 100 MB); longer ones are joined by shuffles.
MAX_BROADCAST_ROWS = 1_000_000

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """The words of a text, case as it is."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SEPARATORS), "")


def ascii_lower(word: Column) -> Column:
    """A-Z lower-cased and nothing else; the quick way serves words of ASCII only."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def let(value: Column, body) -> Column:
    """body(value), with ``value`` computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _paired(values: Column, more: Column, by: int, how) -> Column:
    """how(values[i], more[i + by]) for each i that has both."""
    n = F.greatest(F.size(more) - by, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(more, by + 1, n), how)


def neighbours(values: Column, length: int, how) -> Column:
    """``how`` over each ``length`` neighbours of an array, in about log2(length) passes over it."""

    def step(power: Column, parts: int, done: Column | None, covered: int, left: int) -> Column:
        if left & 1:
            whole = power if done is None else _paired(done, power, covered, how)
            if left == 1:
                return whole
            return let(whole, lambda d: double(power, parts, d, covered + parts, left))
        return double(power, parts, done, covered, left)

    def double(power: Column, parts: int, done: Column | None, covered: int, left: int) -> Column:
        return let(_paired(power, power, parts, how), lambda p: step(p, 2 * parts, done, covered, left >> 1))

    return let(values, lambda v: step(v, 1, None, 0, length))


def fingerprints(words: Column, length: int, gram: int) -> Column:
    """The smallest k-gram hash of each window of ``length`` words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = neighbours(hashes, gram, lambda a, b: F.xxhash64(a, b))
    return neighbours(grams, length - gram + 1, lambda a, b: F.least(a, b))


def kept_places(prints: Column, spread: int) -> Column:
    """0-based windows whose fingerprint differs from the one before, and at least every ``spread``-th."""
    places = F.sequence(F.lit(0), F.size(prints) - 1)
    changed = F.filter(places, lambda i: (i % spread == 0) | (F.get(prints, i) != F.get(prints, i - 1)))
    return F.when(F.size(prints) > 0, changed).otherwise(F.array().cast("array<int>"))


def kept_fingerprints(words: Column, length: int, gram: int) -> Column:
    """(i, print) of the kept places of a document."""
    return let(
        fingerprints(words, length, gram),
        lambda prints: F.transform(kept_places(prints, length - gram + 1), lambda i: F.struct(i.alias("i"), F.get(prints, i).alias("print"))),
    )


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each different window of each item: item, ``length``, ``print``, ``window`` (its words)."""
    own = stage(benchmark.select(F.col(item).alias("item"), F.transform(raw_words(F.col(text)), ascii_lower).alias("words")), "item-words")
    sizes = own.select(F.least(F.size("words"), F.lit(length))).distinct().collect()  # at most ``length`` + 1 values
    found = own.select("item", F.lit(0).alias("length"), F.lit(0).cast("bigint").alias("print"), F.col("words").alias("window")).limit(0)
    for n in sorted(r[0] for r in sizes if r[0]):
        part = own.where(F.size("words") == n) if n < length else own.where(F.size("words") >= n)
        k = n if n < length else gram
        part = part.select("item", "words", F.posexplode(fingerprints(F.col("words"), n, k)).alias("i", "print"))
        part = part.select("item", F.lit(n).alias("length"), "print", F.slice("words", F.col("i") + 1, n).alias("window")).distinct()
        found = found.unionByName(part)
    return found


def window_hits(documents: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Occurrences of the windows in the documents: (key, text_hash, start, length, window_id).

    ``windows`` has one row for each class of equal windows: window_id, length, print, window.
    ``text_hash`` tells rows with equal keys and different texts apart.
    """
    lengths = [r[0] for r in windows.select("length").distinct().collect()]  # at most ``length`` values
    found = None
    for n in sorted(lengths):
        k = n if n < length else gram
        spread = n - k + 1
        own = windows.where(F.col("length") == n)
        prints = own.select(F.col("print").alias("__print")).distinct()
        docs = documents.select(
            F.col(key).alias("key"),
            F.xxhash64(F.col(text)).alias("text_hash"),
            F.transform(raw_words(F.col(text)), ascii_lower).alias("words"),
        )
        kept = docs.select("key", "text_hash", "words", F.inline(kept_fingerprints(F.col("words"), n, k)))
        on = F.col("print") == F.col("__print")
        if prints.count() <= MAX_BROADCAST_ROWS:
            seeds = kept.join(F.broadcast(prints), on, "left_semi")
        else:  # fingerprints cross the network without the words, which come back for hits alone
            hit = kept.drop("words").join(prints, on, "left_semi").withColumnsRenamed({"key": "__key", "text_hash": "__hash"})
            seeds = docs.dropDuplicates(["key", "text_hash"]).join(hit, F.col("key").eqNullSafe(F.col("__key")) & (F.col("text_hash") == F.col("__hash")))
        # the words that the hit's windows can touch
        seeds = seeds.select("key", "text_hash", "i", F.slice("words", F.col("i") + 1, n + spread - 1).alias("words"))
        extended = (
            seeds.withColumn("j", F.explode(F.sequence(F.lit(0), F.size("words") - n)))
            .withColumn("window", F.slice("words", F.col("j") + 1, n))
            .select("key", "text_hash", (F.col("i") + F.col("j")).alias("start"), "window")
        )
        part = extended.join(_small(own.select("window", "window_id", "length")), "window").select("key", "text_hash", "start", "length", "window_id")
        found = part if found is None else found.unionByName(part)
    return found.distinct() if found is not None else None


def _item_classes(benchmark: DataFrame, item: str, item_text: str, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Stored: the windows of each item, and the different windows with ids."""
    by_item = stage(item_windows(benchmark, item, item_text, length, gram), "item-windows")
    windows = by_item.select("length", "print", "window").distinct().withColumn("window_id", F.xxhash64("window", F.lit(length)))
    return by_item, stage(windows, "windows")


def clean_documents(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents, all columns, that hold no window of any item."""
    _, windows = _item_classes(benchmark, item, item_text, length, gram)
    hits = window_hits(documents, windows, key, text, length, gram)
    if hits is None:
        return documents
    hit = stage(hits.select(F.col("key").alias("__key"), F.col("text_hash").alias("__hash")).distinct(), "hit-documents")
    return documents.join(_small(hit), documents[key].eqNullSafe(F.col("__key")) & (F.xxhash64(documents[text]) == F.col("__hash")), "left_anti")


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
) -> DataFrame:
    """One row for each document: key, n_words, n_hit (words inside windows), spans (start and end of each
    run of hit words), items (ids of items with occurring windows, sorted as strings), contaminated.
    """
    by_item, windows = _item_classes(benchmark, item, item_text, length, gram)
    counted = documents.select(
        F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), F.size(raw_words(F.col(text))).cast("bigint").alias("n_words")
    )
    span = "array<struct<start:int,end:int>>"
    hits = window_hits(documents, windows, key, text, length, gram)
    if hits is None:
        return counted.select(
            F.col("key").alias(key), "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.array().cast(span).alias("spans"),
            F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"),
        )
    hits = stage(hits, "window-hits")

    same = ["key", "text_hash"]
    before = Window.partitionBy(*same).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    groups = Window.partitionBy(*same).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        hits.select(*same, "start", (F.col("start") + F.col("length")).alias("end"))
        .distinct()
        .withColumn("opens", F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1))
        .withColumn("span", F.sum("opens").over(groups))
        .groupBy(*same, "span")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy(*same)
        .agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )
    items = (
        hits.select(*same, "window_id")
        .distinct()
        .join(_small(by_item.select(F.xxhash64("window", F.lit(length)).alias("window_id"), F.col("item").cast("string").alias("item")).distinct()), "window_id")
        .groupBy(*same)
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    found = _both(spans, items, same)
    found = found.select(F.col("key").alias("__key"), F.col("text_hash").alias("__hash"), "n_hit", "spans", "items")
    return counted.join(found, F.col("key").eqNullSafe(F.col("__key")) & (F.col("text_hash") == F.col("__hash")), "left").select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("spans", F.array().cast(span)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _both(spans: DataFrame, items: DataFrame, same: list[str]) -> DataFrame:
    """Spans and items of one document side by side; a null id equals a null id."""
    right = items.select(*[F.col(c).alias(f"__{c}") for c in same], "items")
    on = F.lit(True)
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return spans.join(right, on, "left").drop(*[f"__{c}" for c in same])
