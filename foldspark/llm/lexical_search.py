"""Ranked lexical search by MaxScore with bounds on pairs of terms (operator 13).

A document's score for an item is the sum of the impacts of the item's terms: ``weight * ((10^9 tf) div (1000 tf + 20 m))``
with integer weights from document frequencies and ``m`` from the document's length (all in ``impacts`` and ``weights``).

1. Items are taken in blocks of bounded text, so the terms of a block are bounded and can go to every task.
2. ``build_shards``: one scan of the documents writes an inverted index of those terms, one row per shard; a shard is closed
   when it holds ``shard_postings`` postings.  Frequencies and lengths are counted over all documents.
3. ``impact_shards``: postings become impacts with their maximum per term.  The terms of an item are paired from the
   heaviest on; for every pair the list of documents that hold both is stored with its impacts and the pair's joint
   maximum: the most that both terms together give any document of the shard.  It is far below the sum of the two maxima
   where the terms rarely meet.  The best sums seen on the heaviest terms are written too: the k-th largest of them over
   all shards is a score that the k-th result reaches at least.
4. ``search_shard``: units (pairs, a last term may be alone) are ordered by weight.  The lightest units whose summed joint
   maxima stay below the threshold cannot lift a document into the result: their lists are not opened for themselves.
   The documents of the other units get their sums; going down, a document leaves as soon as its sum and the bound of
   the units that are left stay below the threshold, and the lists are looked up for those that remain only.
5. The shards' results, ``k`` an item at most and none below the threshold, are ranked by item.

Nothing is dropped that could rank: bounds are exact integers and equal scores stay until the end.

Cases: null text and texts without terms count nowhere; rows with a null doc_id take no part; rows that repeat a doc_id are
documents of their own; an item without terms, or whose terms no document holds, has no rows; a null item_id is an item;
items that repeat are answered each; empty tables give an empty result; very long texts are read whole; other columns,
also of the same names as the results, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import materialise, slices
from foldspark.llm.license_scan import lower_words

INDEX_SCHEMA = ("shard long, n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms array<int>, "
                "counts array<int>, docs array<int>, tfs array<int>")
IMPACT_SCHEMA = ("shard long, doc_ids array<long>, terms array<int>, counts array<int>, docs array<int>, impacts array<long>, "
                 "pairs array<int>, pair_counts array<int>, pair_docs array<int>, pair_impacts array<long>, "
                 "joint_max array<long>, seed_items array<int>, seeds array<long>")


class Item(NamedTuple):
    item_id: int | None
    terms: list[bytes]


def item_blocks(benchmark: DataFrame, block_bytes: int = 4 << 20) -> Iterator[list[Item]]:
    """The items in blocks of at most ``block_bytes`` of terms (or one item); one block is held at a time."""
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        item = Item(row["item_id"], sorted(set(lower_words((row["text"] or "").encode()))))
        size = sum(map(len, item.terms))
        if block and held + size > block_bytes:
            yield block
            block, held = [], 0
        block.append(item)
        held += size
    if block:
        yield block


def build_shards(documents: DataFrame, terms: list[bytes], shard_postings: int = 1 << 20) -> DataFrame:
    """The inverted index of ``terms`` (numbered by position), one row per shard.

    ``n_docs`` and ``n_terms`` count all documents with a term, whichever; the other columns hold those with one of the
    index.  Postings stand by term, then document; ``counts`` is their number for each of ``terms``.
    """
    shared = documents.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    rows = documents.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = shared.value
        shard = TaskContext.get().partitionId() << 33
        n_docs = n_terms = held = 0
        ids, lengths, found, tfs = [], [], [], []

        def close() -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
            term = np.concatenate([np.empty(0, np.int64), *found])
            order = np.argsort(term, kind="stable")
            used, counts = np.unique(term, return_counts=True)
            lists = [(ids, pa.int64()), (lengths, pa.int64()), (used, pa.int32()), (counts, pa.int32()),
                     (owner[order], pa.int32()), (np.concatenate([np.empty(0, np.int64), *tfs])[order], pa.int32())]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], pa.int64()) for x in (shard, n_docs, n_terms)]
                + [pa.array([np.asarray(x)], pa.list_(t)) for x, t in lists],
                names=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = lower_words(text)
                n_docs += bool(words)
                n_terms += len(words)
                own = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
                term, tf = np.unique(own[own >= 0], return_counts=True)
                if len(term):
                    ids.append(doc_id)
                    lengths.append(len(words))
                    found.append(term)
                    tfs.append(tf)
                    held += len(term)
                if held >= shard_postings:
                    yield close()
                    shard, n_docs, n_terms, held = shard + 1, 0, 0, 0
                    ids, lengths, found, tfs = [], [], [], []
        if n_docs:
            yield close()

    return rows.mapInArrow(scan, INDEX_SCHEMA)


class Plan(NamedTuple):
    """What a block asks for: term weights, and for every item its units of one or two terms, lightest first."""

    n_docs: int
    n_terms: int
    weights: np.ndarray
    pairs: list[tuple[int, int]]
    units: list[list[tuple[int, int, int]]]     # (pair number or -1, term, second term or -1)


def weights(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of every document frequency."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 50 + (50 * length * n_docs) // max(1, n_terms)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def make_plan(items: list[Item], terms: list[bytes], frequency: np.ndarray, n_docs: int, n_terms: int) -> Plan:
    """Pairs are formed from the heaviest term on: rare terms meet least, so their joint maximum saves most."""
    number = {t: i for i, t in enumerate(terms)}
    weight = weights(frequency, n_docs)
    pairs: dict[tuple[int, int], int] = {}
    units = []
    for item in items:
        own = sorted((number[t] for t in item.terms if frequency[number[t]] and weight[number[t]] > 0),
                     key=lambda t: (-weight[t], t))
        made = [(pairs.setdefault((a, b), len(pairs)), a, b) for a, b in zip(own[0::2], own[1::2], strict=False)]
        if len(own) % 2:
            made.append((-1, own[-1], -1))
        units.append(made[::-1])
    return Plan(n_docs, n_terms, weight, list(pairs), units)


class Shard:
    """Impact lists of one shard: by term, and by pair the documents that hold both."""

    def __init__(self, doc_ids, terms, counts, docs, values):
        self.doc_ids, self.values, self.docs = doc_ids, values, docs
        at = np.r_[0, np.cumsum(counts)]
        self.place = {int(t): (int(a), int(b)) for t, a, b in zip(terms, at[:-1], at[1:], strict=True)}
        self.tops = {t: int(values[a:b].max()) for t, (a, b) in self.place.items()}
        self.read = 0            # postings looked at

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.place.get(term, (0, 0))
        return self.docs[a:b], self.values[a:b]

    def add_all(self, sums: np.ndarray, unit: tuple[int, int, int]) -> None:
        """Add the impacts of a unit to all documents that hold its terms."""
        for term in unit[1:]:
            docs, values = self.list(term)
            sums[docs] += values
            self.read += len(docs)

    def add_some(self, sums: np.ndarray, wanted: np.ndarray, unit: tuple[int, int, int]) -> None:
        """Add the impacts of a unit to the documents ``wanted`` (ascending) only."""
        for term in unit[1:]:
            docs, values = self.list(term)
            if len(docs):
                at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
                hit = docs[at] == wanted
                sums[wanted[hit]] += values[at[hit]]
                self.read += len(wanted)


def kth_largest(values: np.ndarray, k: int) -> int:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def seed_scores(shard: Shard, units: list[tuple[int, int, int]], k: int) -> np.ndarray:
    """The ``k`` largest sums over the heaviest units that ``4 k`` documents hold: lower bounds of scores."""
    sums = np.zeros(len(shard.doc_ids), np.int64)
    for unit in reversed(units):
        shard.add_all(sums, unit)
        if np.count_nonzero(sums) >= 4 * k:
            break
    reached = sums[sums > 0]
    return np.sort(reached)[-k:]


def search_shard(shard: Shard, units: list[tuple[int, int, int]], joint: dict[int, int], threshold: int,
                 k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, score) of the documents of a shard that can be among the ``k`` best: score at least ``threshold``."""
    tops = [joint[pair] if pair >= 0 else shard.tops.get(a, 0) for pair, a, _ in units]
    below = np.r_[0, np.cumsum(np.array(tops, np.int64))]      # most that the first units give together
    first = int(np.searchsorted(below[1:], threshold)) if threshold > 0 else 0   # the first ones stay below it together
    sums = np.zeros(len(shard.doc_ids), np.int64)
    for unit in units[first:]:
        shard.add_all(sums, unit)
    wanted = np.flatnonzero(sums)
    for u in range(first, -1, -1):
        # what is known so far may raise the threshold; then documents that cannot reach it go
        threshold = max(threshold, kth_largest(sums[wanted], k))
        wanted = wanted[sums[wanted] + below[u] >= threshold]
        if u:
            shard.add_some(sums, wanted, units[u - 1])
    ids, scores = shard.doc_ids[wanted], sums[wanted]
    keep = scores >= max(threshold, 1)
    ids, scores = ids[keep], scores[keep]
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def _lists(batch: pa.RecordBatch, row: int, names: str) -> list[np.ndarray]:
    return [batch.column(name)[row].values.to_numpy() for name in names.split()]


def impact_shards(index: DataFrame, plan: Plan, k: int) -> DataFrame:
    """Shards with impacts, pair lists with their joint maxima, and seeds of the threshold."""
    shared = index.sparkSession.sparkContext.broadcast(plan)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, terms, counts, docs, tfs = _lists(batch, row, "doc_ids lengths terms counts docs tfs")
                value = impacts(np.repeat(asked.weights[terms], counts), tfs.astype(np.int64), lengths[docs],
                                asked.n_docs, asked.n_terms)
                shard = Shard(ids, terms, counts, docs, value)
                joint, met, both = [], [], []
                for a, b in asked.pairs:
                    (da, va), (db, vb) = shard.list(a), shard.list(b)
                    common, x, y = np.intersect1d(da, db, assume_unique=True, return_indices=True)
                    met.append(common)
                    both.append(va[x] + vb[y])
                    joint.append(max(shard.tops.get(a, 0), shard.tops.get(b, 0), int(both[-1].max()) if len(x) else 0))
                seeds = [seed_scores(shard, units, k) for units in asked.units]
                lists = [(ids, pa.int64()), (terms, pa.int32()), (counts, pa.int32()), (docs, pa.int32()), (value, pa.int64()),
                         (np.flatnonzero([j > 0 for j in joint]), pa.int32()),
                         ([len(m) for m, j in zip(met, joint, strict=True) if j > 0], pa.int32()),
                         (np.concatenate([np.empty(0, np.int32), *met]), pa.int32()),
                         (np.concatenate([np.empty(0, np.int64), *both]), pa.int64()),
                         ([j for j in joint if j > 0], pa.int64()),
                         (np.repeat(np.arange(len(seeds)), [len(s) for s in seeds]), pa.int32()),
                         (np.concatenate([np.empty(0, np.int64), *seeds]), pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("shard").slice(row, 1)] + [pa.array([np.asarray(x)], pa.list_(t)) for x, t in lists],
                    names=[c.split()[0] for c in IMPACT_SCHEMA.split(", ")])

    return index.filter("size(doc_ids) > 0").mapInArrow(scan, IMPACT_SCHEMA)


def thresholds(shards: DataFrame, n_items: int, k: int) -> np.ndarray:
    """For every item of the block the k-th largest seed over all shards, 0 where there are fewer."""
    seeds = shards.select(F.explode(F.arrays_zip("seed_items", "seeds")).alias("s")).select(
        F.col("s.seed_items").alias("item"), F.col("s.seeds").alias("seed"))
    by_item = Window.partitionBy("item").orderBy(F.col("seed").desc())
    ranked = seeds.withColumn("r", F.row_number().over(by_item)).filter(F.col("r") <= k).filter(F.col("r") == k)
    least = np.zeros(n_items, np.int64)
    for row in ranked.collect():     # one row per item of the block
        least[row["item"]] = row["seed"]
    return least


def search_block(documents: DataFrame, items: list[Item], k: int, shard_postings: int) -> DataFrame:
    """(item, item_id, doc_id, score): what the shards find for the items of a block (item: position in the block)."""
    spark = documents.sparkSession
    terms = sorted({t for item in items for t in item.terms})
    index = materialise(build_shards(documents, terms, shard_postings), "lexical-index")
    total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    frequency = np.zeros(len(terms), np.int64)
    counted = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df"))
    for row in counted.collect():    # terms of the block
        frequency[row["terms"]] = row["df"]
    plan = make_plan(items, terms, frequency, total["n"], total["l"])
    shards = materialise(impact_shards(index, plan, k), "lexical-impacts")
    asked = spark.sparkContext.broadcast((plan.units, thresholds(shards, len(items), k), [i.item_id for i in items]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, least, ids = asked.value
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(*_lists(batch, row, "doc_ids terms counts docs impacts"))
                pair, top = _lists(batch, row, "pairs joint_max")
                joint = dict.fromkeys((p for own in units for p, _, _ in own), 0) | dict(zip(pair.tolist(), top.tolist(), strict=True))
                found = [search_shard(shard, own, joint, int(t), k) for own, t in zip(units, least, strict=True)]
                sizes = [len(d) for d, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(len(found)), sizes), pa.int32()),
                     pa.array([i for i, n in zip(ids, sizes, strict=True) for _ in range(n)], pa.int64()),
                     pa.array(np.concatenate([np.empty(0, np.int64), *(d for d, _ in found)])),
                     pa.array(np.concatenate([np.empty(0, np.int64), *(s for _, s in found)]))],
                    names=["item", "item_id", "doc_id", "score"])

    columns = shards.select("doc_ids", "terms", "counts", "docs", "impacts", "pairs", "joint_max")
    return columns.mapInArrow(scan, "item int, item_id long, doc_id long, score long")


def ranked_search(documents: DataFrame, benchmark: DataFrame, k: int = 50, shard_postings: int = 1 << 20,
                  block_bytes: int = 4 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item (operator 13)."""
    best = documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for items in item_blocks(benchmark, block_bytes):
        found = search_block(documents, items, k, shard_postings)
        by_item = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
        ranked = found.withColumn("rank", F.row_number().over(by_item)).filter(F.col("rank") <= k)
        best = best.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return best


ORACLE = r"""
with d as (select row_number() over () as row_no, doc_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
           from documents where doc_id is not null and text is not null),
q as (select row_number() over () as item, item_id,
             unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) as term
      from benchmark),
sized as (select row_no, doc_id, words, len(words) as n from d where len(words) > 0),
total as (select count(*) as n_docs, sum(n)::bigint as n_terms from sized),
postings as (select row_no, doc_id, n, term, count(*) as tf
             from (select row_no, doc_id, n, unnest(words) as term from sized)
             where term in (select term from q) group by row_no, doc_id, n, term),
weighted as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w
             from (select term, count(*) as df from postings group by term), total),
scored as (select q.item, any_value(q.item_id) as item_id, p.row_no, any_value(p.doc_id) as doc_id,
                  sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + (50 * p.n * t.n_docs) // t.n_terms))))::bigint as score
           from q join postings p using (term) join weighted w using (term), total t group by q.item, p.row_no),
ranked as (select *, row_number() over (partition by item order by score desc, doc_id, row_no) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""
