"""Language identification by prediction by partial matching (operator 2).

Learning: byte contexts of up to ``order`` bytes are counted for each language on a bounded sample of labelled
documents (``sample`` per language, those with the smallest hash of doc_id; a documented parameter).  The counts
are taken in Spark and only the table of contexts comes to the driver; its size is bounded by the sample.

Statistics are then frozen.  The code length of a byte after a context is exact PPM with escape method C and full
exclusion: the longest known context predicts the byte or escapes to the next shorter one, symbols seen there are
excluded, and below order 0 the rest of the 256 byte values are equally likely.  Because the statistics are frozen, the
code lengths of all (longest context, byte) pairs are worked out once; scoring a text is one table look-up for each byte
and language, and the sums are exact code lengths of the whole text.

The prediction is the language with the shortest code (ties: first in alphabetical order); the score is its
posterior probability under equal priors.  ``bits`` is its mean code length of a byte.

Cases: null text or text without a letter gives ``und`` with score 0; without any labelled document every text is
``und``; documents with a null label are not learned, those with a null doc_id neither; repeated rows are predicted one by one; other columns are
not read for a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import slices

UNKNOWN = "und"
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str) -> bool:
    """Any letter of any script; digits, fractions and superscripts are none."""
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves remainder 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def normalise(text: str) -> bytes:
    return text.lower().encode()


def context_counts(labelled: DataFrame, order: int = 3) -> DataFrame:
    """(lang, gram, n): how often ``order`` bytes and the byte after them occur; the first bytes follow zeros.

    ``gram`` holds the bytes as one number.  Counts of shorter contexts are sums of these.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: dict[str, dict[int, int]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(bytes(order) + normalise(text or ""), np.uint8).astype(np.int64)
                gram = np.zeros(max(0, len(raw) - order), np.int64)
                for i in range(order + 1):
                    gram = (gram << 8) | raw[i:i + len(gram)]
                own = found.setdefault(lang, {})
                for g, n in zip(*(x.tolist() for x in np.unique(gram, return_counts=True)), strict=True):
                    own[g] = own.get(g, 0) + n
            for lang, own in found.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own)), pa.array(list(own), pa.int64()),
                     pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = labelled.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen context trees of all languages as one table of code lengths.

    symbol   256 -> class of a byte; class 0 is every byte not seen in the sample
    state    class, class, class -> row of ``cost``: the longest context that any language knows
    cost     row, class, language -> bits
    """

    def __init__(self, languages: list[str], symbol: np.ndarray, state: np.ndarray, cost: np.ndarray, order: int):
        self.languages, self.symbol, self.state, self.cost, self.order = languages, symbol, state, cost, order

    @classmethod
    def fit(cls, rows: dict[str, tuple[np.ndarray, np.ndarray]], order: int = 3) -> Model:
        """rows: language -> (grams, counts)."""
        languages = sorted(rows)
        if not languages:
            return cls([], np.zeros(256, np.int32), np.zeros(1, np.int32), np.zeros((1, 1, 0), np.float32), order)
        grams = np.concatenate([rows[x][0] for x in languages] or [np.empty(0, np.int64)])
        seen = np.unique(np.r_[0, *(((grams >> (8 * i)) & 255) for i in range(order + 1))]).astype(np.int64)
        symbol = np.zeros(256, np.int64)
        symbol[seen] = np.arange(1, len(seen) + 1)
        size = len(seen) + 1
        counts = []
        for lang in languages:
            gram, n = rows[lang]
            parts = [symbol[(gram >> (8 * i)) & 255] for i in range(order, -1, -1)]   # oldest byte first
            by_order = []
            for k in range(order, -1, -1):   # context of k bytes
                context = np.zeros(len(gram), np.int64)
                for part in parts[order - k:order]:
                    context = context * size + part
                key, at = np.unique(context * size + parts[order], return_inverse=True)
                by_order.append((key // size, key % size, np.bincount(at, weights=n)))
            counts.append(by_order)
        # one row for each context of the full order that some language knows, then all contexts one byte shorter
        longest = np.unique(np.concatenate([c[0][0] for c in counts] or [np.empty(0, np.int64)]))
        shorter = np.arange(size ** (order - 1))
        state = np.full((size, size ** (order - 1)), 0, np.int32)
        state[:] = len(longest) + shorter
        state = state.reshape(-1)
        state[longest] = np.arange(len(longest))
        known = np.unique(np.concatenate([c[1][0] for c in counts] or [np.empty(0, np.int64)]))
        # contexts one byte shorter that nobody knows share the row of the next shorter context
        row_of = np.empty(len(shorter), np.int64)
        tail = shorter % (size ** max(0, order - 2))
        base = len(longest) + len(known)
        row_of[:] = base + tail
        row_of[known] = len(longest) + np.arange(len(known))
        fallback = state >= len(longest)
        state[fallback] = row_of[state[fallback] - len(longest)]
        contexts = [(order, longest), (order - 1, known), (order - 2, np.arange(size ** max(0, order - 2)))]
        cost = np.concatenate([
            np.stack([_code_lengths(k, which, by_order, order, size) for by_order in counts], axis=-1)
            for k, which in contexts]).astype(np.float32)
        return cls(languages, symbol.astype(np.int32), state.astype(np.int32), cost, order)

    def bits(self, texts: list[bytes], window: int = 1 << 19) -> np.ndarray:
        """Code length of every text under every language; whole texts, in windows of bounded size."""
        out = np.zeros((len(texts), len(self.languages)))
        size = int(self.symbol.max()) + 1
        first = np.full(self.order, self.symbol[0], np.int32)
        parts, owners, held = [], [], 0

        def add() -> None:
            raw = np.concatenate(parts)
            spans = np.array([len(p) for p in parts])
            # positions of the bytes that are coded: all but the context in front of each part
            starts = np.cumsum(spans) - spans
            coded = np.ones(len(raw), bool)
            for i in range(self.order):
                coded[starts + i] = False
            at = np.flatnonzero(coded)
            context = np.zeros(len(at), np.int64)
            for i in range(self.order, 0, -1):
                context = context * size + raw[at - i]
            lengths = spans - self.order
            cost = self.cost[self.state[context], raw[at]].astype(np.float64)
            sums = np.add.reduceat(cost, np.cumsum(lengths) - lengths, axis=0)
            np.add.at(out, owners, sums)

        for i, text in enumerate(texts):
            codes = np.concatenate([first, self.symbol[np.frombuffer(text, np.uint8)]])
            for begin in range(0, len(codes) - self.order, window):
                parts.append(codes[begin:begin + window + self.order])
                owners.append(i)
                held += len(parts[-1])
                if held >= window:
                    add()
                    parts, owners, held = [], [], 0
        if parts:
            add()
        return out


def _code_lengths(k: int, contexts: np.ndarray, by_order: list, order: int, size: int) -> np.ndarray:
    """Bits of every symbol after every context of ``k`` symbols, for one language: (contexts, size)."""
    n = len(contexts)
    out = np.empty((n, size))
    for begin in range(0, n, 4096):
        block = contexts[begin:begin + 4096]
        chance = np.zeros((len(block), size))
        escape = np.ones(len(block))
        open_ = np.ones((len(block), size), bool)
        for shorter in range(k, -1, -1):
            keys, symbols, counts = by_order[order - shorter]
            context = block % (size ** shorter)
            seen = np.zeros((len(block), size))
            first, last = np.searchsorted(keys, context, "left"), np.searchsorted(keys, context, "right")
            length = last - first
            rows = np.repeat(np.arange(len(block)), length)
            at = np.arange(length.sum()) + np.repeat(first - (np.cumsum(length) - length), length)
            seen[rows, symbols[at]] = counts[at]
            seen *= open_
            distinct = (seen > 0).sum(axis=1)
            total = seen.sum(axis=1) + distinct
            usable = total > 0
            share = np.where(usable, escape / np.where(usable, total, 1), 0)
            chance += share[:, None] * seen
            escape = np.where(usable, escape * distinct / np.where(usable, total, 1), escape)
            open_ &= seen == 0
        # below order 0: all byte values not seen yet are equally likely; class 0 stands for 257 - size of them
        width = np.ones(size)
        width[0] = max(1, 257 - size)
        left = np.maximum((open_ * width).sum(axis=1), 1)
        chance += open_ * (escape / left)[:, None]
        out[begin:begin + 4096] = -np.log2(np.maximum(chance, 1e-300))
    return out


def learn(documents: DataFrame, order: int = 3, sample: int = 200, trainable: Column | None = None) -> Model:
    """Fit on at most ``sample`` labelled documents of each language: those with the smallest hash of doc_id."""
    rows = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if trainable is not None:
        rows = rows.filter(trainable)
    order_by = Window.partitionBy("lang").orderBy("h", "doc_id")
    # a limit by rank: each task keeps ``sample`` ids of a language before the shuffle
    chosen = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("r", F.row_number().over(order_by)) \
        .filter(F.col("r") <= sample).select("doc_id").distinct()
    labelled = rows.join(F.broadcast(chosen), "doc_id", "left_semi")  # ``sample`` ids of a language at most
    counted = context_counts(labelled, order).toArrow()
    by_lang: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    langs = np.array(counted["lang"].to_pylist(), dtype=object)
    for lang in sorted(set(langs.tolist())):
        own = langs == lang
        by_lang[lang] = (counted["gram"].to_numpy()[own], counted["n"].to_numpy()[own])
    return Model.fit(by_lang, order)


def predict(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` plus (lang_pred string, score double, bits double)."""
    keep = ["doc_id"] if keep is None else keep
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema.fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, 256):
            texts = [t if t is not None and has_letter(t) else None for t in batch.column(batch.num_columns - 1).to_pylist()]
            clear = [normalise(t) for t in texts if t is not None]
            names, chance, mean = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if own.languages and clear:
                bits = own.bits(clear)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                at = [i for i, t in enumerate(texts) if t is not None]
                chance[at] = 1.0 / np.exp2(-(bits - least[:, None])).sum(axis=1)
                mean[at] = least / np.array([len(t) for t in clear])
                for i, b in zip(at, best.tolist(), strict=True):
                    names[i] = own.languages[b]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names), pa.array(chance), pa.array(mean)],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "bits"])

    return documents.select(*keep, F.col("text").alias("__text")).mapInArrow(
        score, schema + ", lang_pred string, score double, bits double")


def identify(documents: DataFrame, order: int = 3, sample: int = 200) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits) of every document (operator 2)."""
    model = learn(documents, order, sample, ~held_out())
    found = predict(documents, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits")


def keep_identified(documents: DataFrame, order: int = 3, sample: int = 200, most_bits: float = 7.0) -> DataFrame:
    """Documents with a language: ``und`` goes, and what no learned language codes in under ``most_bits`` a byte."""
    model = learn(documents, order, sample, ~held_out())
    # own names while scoring: the table may have columns called as the result
    plain = [f"__c{i}" for i in range(len(documents.columns))]
    renamed = documents.toDF(*plain).withColumn("text", F.col(plain[documents.columns.index("text")]))
    found = predict(renamed, model, keep=plain)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("bits") < most_bits)).select(*plain) \
        .toDF(*documents.columns)
