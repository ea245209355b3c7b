"""Language identification with bit-sliced n-gram filters.

An n-gram is four bytes of lower-cased text, with what is not a letter taken as space and letters in its
middle. The model is one Bloom filter for each language, stored bit-sliced: each place of one table holds a
bit mask over the languages, and the masks of an n-gram's places, and-ed, name all languages that contain it.
With more than 64 languages a place has several 64-bit masks, and the table grows by 8 MB for each 64 languages.
A text is decided by counting for each language the n-grams that carry its bit, less those that a filter as
full as this one would report by chance.

The model is fitted on a bounded sample of labelled rows: about ``SAMPLE`` rows of each language, chosen by a
hash of the key, and the ``GRAMS`` most frequent n-grams of each, less those that are far more typical of another language.

Null or odd input: a null text or one without letters is ``und`` with score 0; a text whose letters give no
n-gram, or none that is known, gets the language with most labelled rows and score 0. Rows without a label are
not learned from. Without any labelled row every text is ``und``. Repeated rows are each judged; texts are read
to their end. Any number of languages is learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetplan.llm.texts import blocks, mix, short_batches

#: Labelled rows of one language that are learned from, about.
SAMPLE = 2000
#: The most frequent n-grams of a language that enter its filter.
GRAMS = 20_000
#: A language's filter leaves out n-grams that are less than this times as frequent in it as in another.
TYPICAL = 0.1
#: Places of the table (a power of two) and places of one n-gram.
PLACES, HASHES = 1 << 20, 2

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all rows as 32-bit values, and the place of each row's first (one more at the end)."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    text = np.full(len(data) + 2 * rows + 3, 32, np.uint8)
    lowered = _LOWER[data]
    if len(data):
        lead = np.zeros(len(data), bool)
        lead[1:] = data[:-1] == 0xC3
        lowered[lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
        text[np.arange(len(data)) + np.repeat(2 * np.arange(rows) + 1, sizes)] = lowered
    n = len(text) - 3
    letter = _LETTER[text]
    kept = np.flatnonzero(letter[1 : n + 1] & letter[2 : n + 2])
    wide = text.astype(np.uint32)
    values = wide[:n] | wide[1 : n + 1] << np.uint32(8) | wide[2 : n + 2] << np.uint32(16) | wide[3 : n + 3] << np.uint32(24)
    return values[kept], np.searchsorted(kept, offsets + 2 * np.arange(rows + 1))


def _places(values: np.ndarray) -> list[np.ndarray]:
    spread = mix(values.astype(np.uint64))
    bits = np.uint64(PLACES.bit_length() - 1)
    return [(spread >> (bits * np.uint64(i)) & np.uint64(PLACES - 1)).astype(np.int64) for i in range(HASHES)]


class Filters:
    """The bit-sliced filters of all languages."""

    def __init__(self, languages: list[str], members: dict[str, np.ndarray]):
        self.languages = languages
        kind = next((k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= n), np.uint64)
        # one row for each 64 languages
        self.table = np.zeros((-(-len(languages) // 64), PLACES), kind)
        full = np.zeros(len(languages))
        for i, language in enumerate(languages):
            at = np.unique(np.concatenate(_places(members[language])))
            self.table[i // 64, at] |= kind(1 << i % 64)
            full[i] = len(at) / PLACES
        self.false_hits = full**HASHES

    def counts(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each row and language, the corrected number of n-grams that the language contains."""
        places, masks = _places(values), None
        total = np.diff(bounds)
        out = np.zeros((len(total), len(self.languages)))
        for i in range(len(self.languages)):
            if i % 64 == 0:
                masks = np.bitwise_and.reduce([self.table[i // 64][at] for at in places])
            sums = np.concatenate([[0], np.cumsum(masks >> masks.dtype.type(i % 64) & masks.dtype.type(1), dtype=np.int64)])
            hits = sums[bounds[1:]] - sums[bounds[:-1]]
            out[:, i] = np.clip((hits - total * self.false_hits[i]) / (1 - self.false_hits[i]), 0, total)
        return out


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, size: int = GRAMS) -> Filters | None:
    """Filters from a bounded sample of the labelled rows; None without any."""
    short_batches(labelled.sparkSession)
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}  # one row for each language
    if not counts:
        return None
    languages = sorted(counts)
    tag_of = {name: i for i, name in enumerate(languages)}
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    # languages of few rows are learned from whole and need no entry
    large = {k: sample / n for k, n in counts.items() if n > sample}
    if large:
        share = F.create_map(*[x for k, n in large.items() for x in (F.lit(k), F.lit(n))])
        labelled = labelled.where(drawn < F.coalesce(F.element_at(share, F.col(lang)), F.lit(1.0)))
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = np.array([tag_of[x] for x in batch.column(0).to_pylist()], np.int64)
            for first, last, data, offsets in blocks(batch.column(1)):
                values, bounds = grams(data, offsets)
                tagged = np.repeat(tags[first:last], np.diff(bounds)) << 32 | values
                found, n = np.unique(tagged, return_counts=True)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(found), "n": pa.array(n.astype(np.int64))})

    sums = rows.mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(F.shiftright("gram", 32)).orderBy(F.desc("n"), "gram")
    top = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("gram", "n").toArrow()  # languages x size rows
    found, n = top["gram"].to_numpy(), top["n"].to_numpy().astype(float)
    own, values = found >> 32, (found & 0xFFFFFFFF).astype(np.uint32)
    rate = n / np.maximum(np.bincount(own, n, len(languages))[own], 1)
    _, at = np.unique(values, return_inverse=True)
    highest = np.zeros(len(values))
    np.maximum.at(highest, at, rate)
    typical = rate >= TYPICAL * highest[at]
    own, values = own[typical], values[typical]
    by_own = np.argsort(own, kind="stable")
    members = dict(zip(languages, np.split(values[by_own], np.searchsorted(own[by_own], np.arange(1, len(languages))))))
    languages.sort(key=lambda k: (-counts[k], k))  # a tie goes to the language with more rows
    return Filters(languages, members)


def held_out(key: Column, folds: int = 5) -> Column:
    """Rows that are never learned from: crc32 of the key as text is a multiple of ``folds`` (or the key is null)."""
    return F.coalesce(F.crc32(key.cast("string")) % folds, F.lit(0)) == 0


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.concatenate([[0], np.cumsum(_LETTER[_LOWER[data]] & (data < 128), dtype=np.int64)])
    high = np.concatenate([[0], np.cumsum(data >= 128, dtype=np.int64)])
    found = np.diff(ascii_letter[offsets]) > 0
    for i in np.flatnonzero(~found & (np.diff(high[offsets]) > 0)).tolist():
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return found


def identify(documents: DataFrame, filters: Filters | None, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``documents`` with two more columns named by ``out``: the language, and the share of the text's n-grams
    that the language explains. Columns that have these names are replaced.
    """
    spark = documents.sparkSession
    short_batches(spark)
    documents = documents.drop(*out)
    if filters is None:
        return documents.withColumns({out[0]: F.lit("und"), out[1]: F.lit(0.0)})
    model = spark.sparkContext.broadcast(filters)
    place = documents.columns.index(text)
    names = documents.columns

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        tags = np.array([*own.languages, "und"], object)
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(place)):
                values, bounds = grams(data, offsets)
                counts = own.counts(values, bounds)
                best = counts.argmax(1)
                hits, total = counts[np.arange(len(best)), best], np.diff(bounds)
                best = np.where(hits > 0, best, 0)
                best = np.where(_has_letter(data, offsets), best, len(own.languages))
                score = np.where(best < len(own.languages), hits / np.maximum(total, 1), 0.0)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tags[best], pa.string()), pa.array(score)], names=[*names, *out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(predict, f"{kinds}, `{out[0]}` string, `{out[1]}` double")


def identify_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Learn from the labelled rows that are not held out, and predict all rows."""
    known = documents.where(~held_out(F.col(key)))
    return identify(documents, fit(known, key, text, lang), text, out)


def known_language(documents: DataFrame, least: float = 0.5, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents in one of the learned languages: not ``und``, and at least this share explained."""
    found = identify_documents(documents, key, text, lang, ("__language", "__explained"))
    return found.where((F.col("__language") != "und") & (F.col("__explained") >= least)).drop("__language", "__explained")
