"""Removal of passages of a bounded reference, by suffix automata that are broadcast.

The reference's texts are dealt into shards of bounded size, each a suffix automaton over its words. The
automata are broadcast, and each document is streamed once through each of them: after every word the automaton's state
tells the longest passage ending there that the shard holds (the matching statistics). Words inside a
passage of at least ``length`` words are removed; equal words in two of the reference's texts that only meet at
their border are no passage.

The automata take about half a kilobyte for each word of the reference and every document visits all of them,
so a reference beyond ``MAX_WORDS`` raises an error: a corpus against itself is ``substrings.remove_repeats``.

Null or odd input: null and empty texts have no words and lose nothing, on both sides; repeated rows are each
answered; an empty reference removes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetplan.llm.texts import short_batches

#: Words of all shards together, and of one.
MAX_WORDS, SHARD_WORDS = 400_000, 100_000


class SuffixAutomaton:
    """All passages of some texts, as an automaton over words."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        """Add one text; passages do not run on from the texts before."""
        last = 0
        for word in words:
            last = self._step(last, word)

    def _step(self, last: int, word: bytes) -> int:
        following = self.next[last].get(word)
        if following is not None and self.length[following] == self.length[last] + 1:
            return following
        state = None
        if following is None:
            state = self._state({}, 0, self.length[last] + 1)
            p = last
            while p != -1 and word not in self.next[p]:
                self.next[p][word] = state
                p = self.link[p]
            if p == -1:
                return state
            following = self.next[p][word]
            if self.length[following] == self.length[p] + 1:
                self.link[state] = following
                return state
        else:
            p = last
        # the state stands for longer passages too: split it
        copy = self._state(dict(self.next[following]), self.link[following], self.length[p] + 1)
        self.link[following] = copy
        while p != -1 and self.next[p].get(word) == following:
            self.next[p][word] = copy
            p = self.link[p]
        if state is None:
            return copy
        self.link[state] = copy
        return state

    def _state(self, following: dict, link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def statistics(self, words: list[bytes]) -> np.ndarray:
        """For each word the length of the longest known passage that ends with it."""
        out = np.zeros(len(words), np.int64)
        state = n = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.next[state]:
                state, n = self.next[state][word], n + 1
            out[i] = n
        return out


def known_words(statistics: np.ndarray, length: int) -> np.ndarray:
    """Words inside a known passage of at least ``length`` words."""
    ends = np.flatnonzero(statistics >= length)
    depth = np.zeros(len(statistics) + 1, np.int64)
    np.add.at(depth, ends - statistics[ends] + 1, 1)
    np.subtract.at(depth, ends + 1, 1)
    return np.cumsum(depth)[:-1] > 0


def remove_known(documents: DataFrame, reference: DataFrame, key: str = "doc_id", text: str = "text", reference_text: str = "text", length: int = 13) -> DataFrame:
    """One row (``key``, n_words, n_removed, kept) for each document."""
    spark = documents.sparkSession
    short_batches(spark)
    total = reference.agg(F.sum(F.regexp_count(reference_text, F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    if total > MAX_WORDS:
        raise ValueError(f"the reference has {total} words; at most {MAX_WORDS} can be broadcast")
    shards, size = [SuffixAutomaton()], 0
    for (value,) in reference.select(reference_text).collect():  # at most MAX_WORDS words
        own = (value or "").encode().split()
        if size + len(own) > SHARD_WORDS and size:
            shards.append(SuffixAutomaton())
            size = 0
        shards[-1].add(own)
        size += len(own)
    automata = [spark.sparkContext.broadcast(x) for x in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for value in batch.column(1).to_pylist():
                own = (value or "").encode().split()
                gone = np.zeros(len(own), bool)
                for automaton in automata:
                    gone |= known_words(automaton.value.statistics(own), length)
                sizes.append(len(own))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, lost in zip(own, gone.tolist()) if not lost).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[key, "n_words", "n_removed", "kept"])

    rows = documents.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string")
