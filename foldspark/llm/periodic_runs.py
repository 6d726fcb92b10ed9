"""Periodic run detection inside documents by seed and extend on diagonals (operator 11).

A run is a maximal stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal) that is at least
``max(min_words, 2 q)`` long.  On the diagonal of lag ``q`` (the pairs of words ``i`` and ``i + q``) it is a stretch of at
least ``max(min_words - q, q)`` equal pairs, so it holds two equal k-grams ``q`` apart for every ``k`` up to that.

1. Words get numbers inside their document; blocks of 2, 4, 8, ... words get numbers from the pair of numbers of their
   halves (exact, no hashes).  Only blocks that occur again in the document are numbered further.
2. Seeds: lags ``k .. 2k - 1`` use k-grams (``k`` = half of ``min_words``, then doubled; the first level takes all lags
   below ``2k``).  Occurrences of a gram at most ``k / 2`` apart are one cluster: they lie in one stretch whose period is
   their distance, so only that distance is a lag of its own.  Between two clusters every lag has one seed pair.
   A cluster meets the three clusters behind it at most, as the next one is over ``2k`` words away.
3. A table holds, for each document and lag, how far its diagonal is covered; a seed before that place is dropped, the
   others are extended to both sides by the block numbers, from large blocks to small ones.
4. Equal stretches with several periods keep the smallest one (the others are its multiples).

Documents are worked on alone, so nothing is shuffled; a task holds some documents of ``task_words`` words together, or
one longer document (about 8 bytes a word and doubling).

Cases: null or empty text has no words and no runs; a null doc_id is kept; rows that repeat doc_id or text are all
answered; an empty table gives an empty result; other columns, also of the same names as the results, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import expand_ranges, slices

#: Fixed value: what separates words (white space of ASCII).
WORD_GAPS = r"[\x20\x09-\x0D]+"


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8."""
    return text.encode().split() if text else []


class _Blocks:
    """Numbers of the blocks of 1, 2, 4, ... words from every position; equal blocks of a document have equal numbers.

    Positions of all documents follow each other.  A block that is alone in its document has a number of its own, as
    has one that would leave the document.
    """

    def __init__(self, first: np.ndarray, limit: np.ndarray):
        self.n = len(first)
        self.levels, self.again = [], []
        self._number(first, np.arange(self.n))
        size = 1
        while self.again[-1].any():
            low, again = self.levels[-1], self.again[-1]
            at = np.flatnonzero(again[:max(0, self.n - size)])
            at = at[again[at + size] & (at + 2 * size <= limit[at])]
            self._number(low[at] * np.int64(2 * self.n + 1) + low[at + size], at)
            size *= 2

    def _number(self, keys: np.ndarray, at: np.ndarray) -> None:
        number = np.arange(self.n, 2 * self.n)     # alone
        again = np.zeros(self.n, dtype=bool)
        if len(at):
            order = np.argsort(keys, kind="stable")
            fresh = np.r_[True, keys[order][1:] != keys[order][:-1]]
            run = np.cumsum(fresh) - 1
            repeated = np.bincount(run)[run] > 1
            number[at[order[repeated]]] = run[repeated]
            again[at[order[repeated]]] = True
        self.levels.append(number)
        self.again.append(again)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, keys) of the k-grams that can occur again: two blocks that cover them."""
        level = k.bit_length() - 1
        if level >= len(self.levels):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        shift, again = k - (1 << level), self.again[level]
        at = np.flatnonzero(again[:max(0, self.n - shift)])
        at = at[again[at + shift]]
        return at, self.levels[level][at] * np.int64(2 * self.n + 1) + self.levels[level][at + shift]

    def extend(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin (first of i's side) and end (behind the last) of the equal stretches around the pairs ``i < j``."""
        end, begin, lag = i.copy(), i.copy(), j - i
        for level in range(len(self.levels) - 1, -1, -1):
            number, size = self.levels[level], 1 << level
            inside = np.minimum(end + lag, self.n - 1)
            end += size * ((end + lag < self.n) & (number[np.minimum(end, self.n - 1)] == number[inside]))
            back = np.maximum(begin - size, 0)
            begin -= size * ((begin >= size) & (number[back] == number[np.minimum(back + lag, self.n - 1)]))
        return begin, end


def _seeds(at: np.ndarray, keys: np.ndarray, k: int, lowest: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, lag) of the seed pairs of one level: lags ``lowest .. 2k - 1``."""
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    same = keys[1:] == keys[:-1]
    gap = at[1:] - at[:-1]
    linked = same & (gap <= k // 2)
    own = np.flatnonzero(linked & (gap >= lowest))
    found = [(at[:-1][own], gap[own])]
    # clusters: first and last position, number of members, distance between them
    heads = np.flatnonzero(np.r_[True, ~linked])
    tails = np.r_[heads[1:], len(at)] - 1
    first, last, members, gram = at[heads], at[tails], tails - heads + 1, keys[heads]
    step = np.where(members > 1, at[np.minimum(heads + 1, len(at) - 1)] - first, 0)
    for ahead in (1, 2, 3):
        a = np.arange(len(heads) - ahead) if len(heads) > ahead else np.empty(0, np.int64)
        b = a + ahead
        near = (gram[a] == gram[b]) & (first[b] - last[a] < 2 * k) & (last[b] - first[a] >= lowest)
        a, b = a[near], b[near]
        stride = np.maximum(step[a], step[b])
        least, most = first[b] - last[a], last[b] - first[a]
        unit = np.maximum(stride, 1)
        low = np.maximum(0, -(-(lowest - least) // unit))
        high = np.where(stride > 0, np.minimum(most, 2 * k - 1) - least, 0) // unit
        count = np.maximum(0, high - low + 1)
        which = np.repeat(np.arange(len(a)), count)
        m = expand_ranges(low, count)                      # the lag is least + m * stride
        back = np.minimum(m, members[a][which] - 1)        # go back in the first cluster, then on in the second
        found.append((last[a][which] - back * stride[which], least[which] + m * stride[which]))
    i, lag = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, lag


def find_runs(numbers: np.ndarray, sizes: np.ndarray, min_words: int = 12) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of all runs of some documents, ordered by document, start and period.

    ``numbers``: a number for every word, documents one after the other, equal inside a document for equal words only
    (the same number may occur in several documents); ``sizes``: words of each document.
    """
    none = np.empty(0, np.int64)
    if not len(numbers):
        return none, none, none, none
    sizes = np.asarray(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(sizes)), sizes)
    blocks = _Blocks(own * np.int64(numbers.max() + 1) + numbers, (starts + sizes)[own])
    k, lowest = max(1, min_words // 2), 1
    i_parts, lag_parts = [none], [none]
    while True:
        at, keys = blocks.grams(k)
        if not len(at):
            break
        i, lag = _seeds(at, keys, k, lowest)
        i_parts.append(i)
        lag_parts.append(lag)
        k, lowest = 2 * k, 2 * k
    i, lag = np.concatenate(i_parts), np.concatenate(lag_parts)
    if not len(i):
        return none, none, none, none
    # one key for each document and lag; seeds in order of their place on the diagonal
    n = np.int64(blocks.n)
    _, diagonal = np.unique(own[i] * (n + 1) + lag, return_inverse=True)
    order = np.argsort(diagonal * (n + 1) + i, kind="stable")
    i, lag, diagonal = i[order], lag[order], diagonal[order]
    places = diagonal * (n + 1) + i
    ends = np.searchsorted(diagonal, np.arange(diagonal[-1] + 1), "right")
    turn = np.r_[0, ends[:-1]]                              # next seed of each diagonal
    live = np.arange(len(turn))
    found = []
    while len(live):
        seed = turn[live]
        begin, end = blocks.extend(i[seed], i[seed] + lag[seed])
        found.append((begin, end, lag[seed]))
        covered = live * (n + 1) + end                      # furthest covered place of the diagonal
        turn[live] = np.searchsorted(places, covered)
        live = live[turn[live] < ends[live]]
    begin, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    length = end + period - begin
    long = length >= np.maximum(min_words, 2 * period)
    begin, length, period = begin[long], length[long], period[long]
    order = np.lexsort((period, length, begin))
    begin, length, period = begin[order], length[order], period[order]
    smallest = np.r_[True, (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])][:len(begin)]
    begin, length, period = begin[smallest], length[smallest], period[smallest]
    order = np.lexsort((period, begin))
    begin, length, period = begin[order], length[order], period[order]
    document = own[begin]
    return document, begin - starts[document], length, period


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """False for every word that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(documents: DataFrame, min_words: int = 12, task_words: int = 1 << 19) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) for every row (operator 11).

    ``runs`` is ordered by start and period; ``collapsed`` is the text's words, joined by single spaces, without those
    that a run holds after its first period.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def answer(ids: list, worded: list[list[bytes]]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        numbers = np.array([known.setdefault(w, len(known)) for words in worded for w in words], np.int64)
        sizes = np.array([len(words) for words in worded], np.int64)
        document, start, length, period = find_runs(numbers, sizes, min_words)
        bounds = np.searchsorted(document, np.arange(len(worded) + 1))
        collapsed = []
        for d, words in enumerate(worded):
            a, b = bounds[d], bounds[d + 1]
            if a < b:
                kept = kept_words(len(words), start[a:b], length[a:b], period[a:b])
                words = [words[i] for i in np.flatnonzero(kept)]
            collapsed.append(b" ".join(words).decode())
        items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)],
                                           fields=list(run_type))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items),
             pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, worded, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split_words(text)
                if held and held + len(words) > task_words:
                    yield answer(ids, worded)
                    ids, worded, held = [], [], 0
                ids.append(doc_id)
                worded.append(words)
                held += len(words)
            if ids:
                yield answer(ids, worded)

    return rows.mapInArrow(scan, "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
                                 "collapsed string")


def plant_periods(documents: DataFrame) -> DataFrame:
    """(doc_id, text): the documents whose hash of doc_id divides by ten get a periodic tail, as the query's contract says.

    Fixed values: h = crc32(doc_id), g = h div 10; with h % 10 = 0 and n > 0 words, word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = documents.select("doc_id", "text", h.alias("h"))
    words = F.array_remove(F.split(F.col("text"), WORD_GAPS), "")
    chosen = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    rows = rows.withColumn("words", F.when(chosen, words)).withColumn("n", F.size("words"))
    g = F.expr("h div 10")
    rows = rows.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    index = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.get(
        F.col("words"), F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(index, " ")).otherwise(F.col("text")).alias("text"))


def _longest(runs: Column) -> Column:
    """The run of greatest length; ties: smallest start, then period."""
    return F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("slow"))))


def run_digests(documents: DataFrame, min_words: int = 12) -> DataFrame:
    """One row per document: the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    found = periodic_runs(documents, min_words).withColumn("best", _longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    length, period = F.col("best.length"), -F.col("best.slow")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
