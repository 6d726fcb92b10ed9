"""Substring deduplication by sliding sentence spans (operator 8).

A text is cut into sentences at line breaks and after ``.``, ``!`` or ``?`` before white space, and a sentence further
after the word of least hash (the last one on ties) of every ``window`` consecutive words in it.  So a cut depends on at
most ``window`` words to either side, and no two cuts are more than ``window`` words apart.  At every unit between
cuts one span starts and one ends: the fewest consecutive units, two at least, with ``span_words`` words or more.  So
every unit of a repeated run of that many words lies in a repeated span.  A span's key is a 64-bit hash of its words,
lower-cased.  Equal keys meet globally; the first place, in the order of (doc_id, text, position),
keeps the passage, and the units under every other place go.

Any ``4 * window + span_words - 3`` words (49 by default) that stand in two texts, at whatever places, hold a span of
both: cuts agree from the ``window``-th word on and up to ``window`` words before the end.

A key costs one row for each place; the first place is aggregated before the shuffle, and a key that is held by very many
texts is an ordinary, splittable join key.

Cases: null text, empty text or null doc_id: no spans; rows that repeat doc_id and text count as one place; rows that
repeat a doc_id with another text are texts of their own, told apart by ``text_id`` (0 where a doc_id has one text);
texts with fewer than ``span_words`` words have no span; very long texts are cut whole, one at a time; an empty table
gives an empty result; other columns, whatever their names, are kept by ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import materialise, mix64, slices, with_text_id

_SPACES = np.array([chr(c).isspace() for c in range(0x3002)])   # no white space lies behind
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n, base)], dtype=np.uint64)


def _lower(text: str) -> str:
    """Lower case, a character for each character whatever stands around it."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[0] for c in text)
    return low.replace("\u03c2", "\u03c3")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def text_spans(texts: list[str], span_words: int = 20, window: int = 8) -> tuple[np.ndarray, ...]:
    """(key, text number, begin, end) of the spans of some texts; begin and end in code points."""
    none = np.empty(0, np.int64)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    joined = "\n".join(texts)
    codes = _codes(joined)
    space = np.r_[True, _SPACES[np.minimum(codes, len(_SPACES) - 1)], True]
    begins, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    n = len(begins)
    if not n:
        return none, none, none, none
    own = np.searchsorted(starts, begins, "right") - 1
    # words: hashes of their characters
    sizes = ends - begins
    inside = ~space[1:-1]
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    power = _powers(_STEP, int(sizes.max()))
    with np.errstate(over="ignore"):
        chars = (_codes(_lower(joined))[inside].astype(np.uint64) + np.uint64(1)) * power[at]
        words = mix64(np.add.reduceat(chars, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))
    # sentence ends, then the words of least hash
    lines = np.r_[0, np.cumsum(codes == 10)]
    marked = np.isin(codes[ends - 1], [ord(c) for c in ".!?"])
    stop = marked | np.r_[lines[begins[1:]] > lines[ends[:-1]], True]
    cut = stop.copy()
    if n >= window:
        sentence = np.cumsum(stop) - stop
        whole = np.flatnonzero(sentence[: n - window + 1] == sentence[window - 1:])
        views = np.lib.stride_tricks.sliding_window_view(words[::-1], window)[::-1]
        cut[whole + window - 1 - views[whole].argmin(axis=1)] = True
    last = np.flatnonzero(cut)
    first = np.r_[0, last[:-1] + 1]
    text, m = own[last], len(last)
    # a unit takes the white space before it inside a sentence, and that after it at the end of one
    final = np.r_[text[1:] != text[:-1], True]
    unit_end = np.where(stop[last], np.r_[begins, 0][last + 1], ends[last])
    unit_end[final] = starts[text[final] + 1] - 1
    unit_begin = np.r_[0, np.where(final[:-1], starts[text[1:]], unit_end[:-1])]
    unit_begin[0] = starts[text[0]]
    unit = np.arange(m)
    to = np.maximum(np.searchsorted(last, first + span_words - 1), unit + 1)
    to[(to >= m) | (text[np.minimum(to, m - 1)] != text)] = -1
    since = np.minimum(np.searchsorted(first, last - span_words + 1, "right") - 1, unit - 1)
    since[(since < 0) | (text[since] != text)] = -1
    ending = (since >= 0) & (to[since] != unit)   # the others are the shortest run from their first unit as well
    i, j = np.r_[unit[to >= 0], since[ending]], np.r_[to[to >= 0], unit[ending]]
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(words * _powers(_STEP, n)[:n])]
        key = mix64((sums[last[j] + 1] - sums[first[i]]) * _powers(_BACK, n)[first[i]]
                    + (last[j] - first[i]).astype(np.uint64))
    return key.view(np.int64), text[i], unit_begin[i] - starts[text[i]], unit_end[j] - starts[text[i]]


def document_spans(documents: DataFrame, span_words: int = 20, window: int = 8) -> DataFrame:
    """(key, doc_id, text_id, begin, size) of every span: sizes are small numbers, which take less disk than ends."""
    rows = documents.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text_id", "text")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts, own, text_id = batch.column(2).to_pylist(), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # some millions of characters at a time, or a single text
            share = np.cumsum([len(t) for t in texts]) // 4_000_000
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(share)) + 1):
                key, text, begin, end = text_spans([texts[i] for i in part], span_words, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(own[part][text], pa.int64()), pa.array(text_id[part][text], pa.int64()),
                     pa.array(begin.astype(np.int32)), pa.array((end - begin).astype(np.int32))],
                    names=["key", "doc_id", "text_id", "begin", "size"])

    return rows.mapInArrow(spans, "key long, doc_id long, text_id long, begin int, size int")


def repeated_spans(documents: DataFrame, span_words: int = 20, window: int = 8) -> DataFrame:
    """The passages that go: (doc_id, text_id, char_start, char_end, first_doc_id, n_spans) (operator 8).

    Overlapping spans of a text are one passage; first_doc_id is the smallest document that keeps a span of it.
    """
    named = with_text_id(documents.select("doc_id", "text")).withColumnRenamed("__text", "text_id")
    return _repeated(named, span_words, window)


def _repeated(documents: DataFrame, span_words: int, window: int) -> DataFrame:
    place = F.struct("doc_id", "text_id", "begin")
    spans = materialise(document_spans(documents, span_words, window), "sentence-spans")
    first = materialise(spans.groupBy("key").agg(F.min(place).alias("f"), F.count("*").alias("places"))
                        .filter("places > 1"), "first-spans")
    # a key of more than a thousandth of all spans is hot: there are under a thousand such, so their places meet the first
    # one by broadcast and are never dealt by key; no key of the other join holds more than that share
    is_hot = F.col("places") * 1000 > spans.count()
    hot = first.filter(is_hot).drop("places")
    found = spans.join(F.broadcast(hot), "key").unionByName(
        spans.join(F.broadcast(hot.select("key")), "key", "left_anti").join(first.filter(~is_hot).drop("places"), "key"))
    again = found.filter(place != F.col("f")).select(
        "doc_id", "text_id", "begin", "size", F.col("f.doc_id").alias("first_doc_id")) \
        .groupBy("doc_id", "text_id", "begin").agg(
            (F.col("begin") + F.max("size")).alias("end"), F.min("first_doc_id").alias("first_doc_id"))
    # overlapping spans of one text: at most its units
    ordered = Window.partitionBy("doc_id", "text_id").orderBy("begin")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    begun = again.withColumn("fresh", F.coalesce(before <= F.col("begin"), F.lit(True)).cast("int"))
    numbered = begun.withColumn("passage", F.sum("fresh").over(ordered))
    return numbered.groupBy("doc_id", "text_id", "passage").agg(
        F.min("begin").alias("char_start"), F.max("end").alias("char_end"),
        F.min("first_doc_id").alias("first_doc_id"), F.count("*").alias("n_spans")).drop("passage")


def remove_repeats(documents: DataFrame, span_words: int = 20, window: int = 8) -> DataFrame:
    """The documents without repeated passages; all columns are kept, and ``n_chars`` follows the text if present."""
    named = with_text_id(documents)
    passages = _repeated(named.select("doc_id", "text", F.col("__text").alias("text_id")), span_words, window)
    by_doc = materialise(passages.groupBy(F.col("doc_id").alias("__doc"), F.col("text_id").alias("__own")).agg(
        F.sort_array(F.collect_list(F.struct("char_start", "char_end"))).alias("__gone")), "passages")
    joined = named.join(by_doc, (F.col("doc_id") == F.col("__doc")) & (F.col("__text") == F.col("__own")), "left")
    # code points kept: the stretches between the passages
    starts = F.concat(F.array(F.lit(0)), F.transform("__gone", lambda g: g["char_end"]))
    ends = F.concat(F.transform("__gone", lambda g: g["char_start"]), F.array(F.length("text")))
    kept = F.zip_with(starts, ends, lambda a, b: F.substr(F.col("text"), a + 1, b - a))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    columns = [text.alias(c) if c == "text" else
               F.when(F.col("__gone").isNull(), F.col(c)).otherwise(F.length(text)).cast(documents.schema[c].dataType)
               .alias(c) if c == "n_chars" else F.col(c) for c in documents.columns]
    return joined.select(*columns)
