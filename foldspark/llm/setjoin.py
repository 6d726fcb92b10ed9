"""Similarity join of documents on word shingles, heavy-light by set size (operator 9).

Two documents link when the Jaccard similarity of their shingle sets is at least ``numerator / 100``; the result
is one row per document with the size of its set and the smallest doc_id of its connected component.

1. Every text becomes a sorted set of 64-bit shingle hashes.  Documents with equal sets are one class.
2. Keys that linked sets must share.  With the common order "by hash value", two sets that share ``o`` members
   share ``c`` of them within the first ``size - o + c`` of each.  A small set (up to the boundary) emits every
   2-subset of its prefix; a large one emits the members of its prefix as entries of inverted lists, and so do the
   small sets that a large one can reach by size.  The boundary is the size at which the summed cost is least,
   from the histogram of all set sizes.
3. The lists are sorted by key and streamed; keys held by one set vanish.  A set that finds too few shared members
   in its whole prefix cannot link and leaves.  Every shared key names its smallest holder, so the sets to compare
   meet in a cluster per such holder instead of once per key; crowded holders are passed over as far as exactness allows.
4. A cluster is cut by size class and into blocks of bounded bytes; only blocks whose sizes can link are paired.
   A task scans the lists of a block pair: it counts the shared prefix members of each pair against the number that a
   link needs, and keeps one star for each connected set, not all pairs.  Connected candidates are a cluster again;
   now whole sets are compared in the same way, and the overlaps decide exactly.
5. Connected components of the stars by alternating star contraction.

No pair of documents is ever a row; hot keys cost a row per holder; nothing is capped.

Cases: null text, empty text or text without words has no shingles, links with nothing and is its own component;
fewer words than a shingle make the whole sequence one shingle; equal rows are one class; rows with a null doc_id
keep a null component and link with nothing; very long texts are hashed whole, one at a time; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import expand_ranges, materialise, mix64, slices
from foldspark.llm.components import connected_components

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd: has an inverse modulo 2^64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(n, int(_BASE)), _powers(n, pow(int(_BASE), -1, 1 << 64))
        return cls.up, cls.down


def text_shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the runs of ``words`` words of a UTF-8 text (A-Z lower-cased)."""
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    word = np.r_[False, ~_SPACE[raw], False]
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _Powers.upto(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=sums[1:])
        hashed = mix64((sums[ends] - sums[starts]) * down[starts])
        n = min(words, len(hashed))
        run = np.zeros(len(hashed) - n + 1, np.uint64)
        for i in range(n):
            run = run * np.uint64(0xD6E8FEB86659FD93) + hashed[i:i + len(run)]
        return np.unique(mix64(run + np.uint64(n)))


def digest(members: np.ndarray) -> int:
    """A 64-bit digest of a set that does not depend on order."""
    with np.errstate(over="ignore"):
        return int(mix64(members).sum(dtype=np.uint64).view(np.int64))


def least_overlap(size: int, numerator: int = 75) -> int:
    """Fewest shared members of a set with any set it can link with: the smallest partner lies inside it."""
    return -(-numerator * size // 100)


def required_overlap(a: np.ndarray, b: np.ndarray, numerator: int = 75) -> np.ndarray:
    """Fewest shared members for a link of sets of sizes ``a`` and ``b``."""
    return -(-numerator * (a + b) // (100 + numerator))


#: Large sets must share one prefix member, and one more for every so many of their members.
_SHARE = 8


def _shared(size: int) -> int:
    """Prefix members that two large sets must share: grows slowly with the size."""
    return 1 + size // _SHARE


def prefix_length(size: int, shared: int, numerator: int = 75) -> int:
    return min(size, size - least_overlap(size, numerator) + shared)


def choose_boundary(histogram: dict[int, int], numerator: int = 75, list_cost: float = 3.0) -> int:
    """Largest size that enumerates 2-subsets: the one with the least summed cost.

    A subset costs 1 (one key); an inverted-list entry ``list_cost`` (it is read, met and counted).  Small sets that a
    large one can reach pay both.  Sizes over 256 have more subsets than any list entry is worth.
    """
    sizes = sorted(s for s in histogram if s <= 256)
    best, cost = 0, None
    for x in [0, *sizes]:
        total = 0.0
        for s in sizes:
            n, p = histogram[s], prefix_length(s, 2, numerator)
            if s <= x:
                total += n * p * (p - 1) / 2
            if s > x or 100 * s >= numerator * (x + 1):
                total += n * prefix_length(s, _shared(s), numerator) * list_cost
        if cost is None or total < cost:
            best, cost = x, total
    return best


def shingle_sets(documents: DataFrame, words: int = 5, numerator: int = 75) -> DataFrame:
    """(doc_id, row_id, n_shingles, digest_a, digest_b, prefix): sizes, 128-bit digest, the longest prefix needed."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row_id = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            sizes, first, second, prefixes = [], [], [], []
            for text in batch.column(1):
                found = text_shingles(text.as_buffer() if text.is_valid else b"", words)
                sizes.append(len(found))
                first.append(digest(found))
                second.append(digest(found ^ _BASE))
                n = len(found)
                prefixes.append(found[:max(prefix_length(n, _shared(n), numerator),
                                           prefix_length(n, 2, numerator) if n <= 256 else 0)].view(np.int64))
            lengths = np.array([0, *map(len, prefixes)], np.int32)
            values = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(row_id, row_id + len(sizes))), pa.array(sizes, pa.int64()),
                 pa.array(first, pa.int64()), pa.array(second, pa.int64()), prefix],
                names=["doc_id", "row_id", "n_shingles", "digest_a", "digest_b", "prefix"])
            row_id += len(sizes)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(sets, "doc_id long, row_id long, n_shingles long, digest_a long, "
                           "digest_b long, prefix array<long>")


def candidate_keys(classes: DataFrame, boundary: int, numerator: int = 75) -> DataFrame:
    """(key, listed, class_id): 2-subsets of small sets (listed = false), prefix members of the others (true)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "listed", "class_id"]
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            prefix = batch.column(2)
            at, flat = prefix.offsets.to_numpy(), prefix.values.to_numpy().view(np.uint64)
            reach = 100 * sizes >= numerator * (boundary + 1)
            rows = np.flatnonzero(reach)
            n = np.array([prefix_length(int(s), _shared(int(s)), numerator) for s in sizes[rows]], np.int64)
            members = flat[expand_ranges(at[rows], n)]
            yield pa.RecordBatch.from_arrays([pa.array(members.view(np.int64)), pa.array(np.ones(len(members), bool)),
                                              pa.array(np.repeat(ids[rows], n))], names=names)
            subsets, owners = [], []
            for i in np.flatnonzero((sizes <= boundary) & (sizes >= 2)):
                part = flat[at[i]:at[i] + prefix_length(int(sizes[i]), 2, numerator)]
                a, b = np.triu_indices(len(part), 1)
                with np.errstate(over="ignore"):
                    subsets.append(mix64(part[a] * _BASE + part[b]).view(np.int64))
                owners.append(np.full(len(a), ids[i]))
            if subsets:
                found = np.concatenate(subsets)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.zeros(len(found), bool)),
                                                  pa.array(np.concatenate(owners))], names=names)

    return classes.select("class_id", "n_shingles", "prefix").mapInArrow(keys, "key long, listed boolean, class_id long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, hub, class_id, listed) for every key held by two classes or more; hub is the smallest of its holders.

    Rows are sorted by key and streamed: the state is one key, however many documents hold it.
    """
    ordered = keys.repartition("key", "listed").sortWithinPartitions("key", "listed", "class_id")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None   # key, kind and hub of the run that may go on
        told = False                # its hub is out already
        for batch in batches:
            key, listed, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(key):
                continue
            fresh = np.r_[True, (key[1:] != key[:-1]) | (listed[1:] != listed[:-1])]
            goes_on = last is not None and last[0] == key[0] and last[1] == listed[0]
            fresh[0] = not goes_on
            begins = np.flatnonzero(fresh)
            run = np.cumsum(fresh) - 1          # -1: goes on from the batch before
            lengths = np.diff(np.r_[begins, len(key)])
            hubs = doc[begins] if len(begins) else np.empty(0, doc.dtype)
            hub = np.where(run >= 0, hubs[np.maximum(run, 0)], last[2]) if len(begins) and last is not None else (
                hubs[run] if len(begins) else np.full(len(key), last[2]))
            keep = np.where(run >= 0, (lengths > 1)[np.maximum(run, 0)], True) if len(begins) else np.ones(len(key), bool)
            found = [key[keep], hub[keep], doc[keep], listed[keep]]
            if goes_on and not told:
                found = [np.r_[x, y] for x, y in zip((last[0], last[2], last[2], last[1]), found, strict=True)]
            alone = len(begins) > 0 and lengths[-1] == 1
            last, told = (key[-1], listed[-1], hub[-1]), not alone
            found[3] = found[3].astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["key", "hub", "class_id", "listed"])

    return ordered.mapInArrow(runs, "key long, hub long, class_id long, listed boolean")


def overlaps(sides: np.ndarray, members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two blocks and the exact sizes of the intersections of their sets.

    sides: 0 and 1 name the blocks, 2 is a block paired with itself.
    """
    n = len(members)
    left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
    _, code, seen = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(m) for m in members])
    common = seen[code] > 1
    used, code = np.unique(code[common], return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[common][order]
    place, side = np.full(n, -1), np.full(n, -1)
    place[left], side[right] = np.arange(len(left)), np.arange(len(right))
    shared = np.zeros((len(left), len(right)), np.float32)   # exact: counts below 2^24
    step = max(64, (1 << 22) // max(1, n))
    for begin in range(0, len(used), step):
        a, b = np.searchsorted(code, [begin, begin + step])
        width = min(step, len(used) - begin)
        sides_of = []
        for rows, height in ((place, len(left)), (side, len(right))):
            x = np.zeros((height, width), np.float32)
            at = rows[owner[a:b]]
            x[at[at >= 0], code[a:b][at >= 0] - begin] = 1
            sides_of.append(x)
        shared += sides_of[0] @ sides_of[1].T
    return left, right, shared


def stars(ids: np.ndarray, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """One star for each connected set of the links between two blocks."""
    n = len(ids)
    near = np.zeros((n, n), dtype=bool)
    near[np.ix_(left, right)] = linked
    near |= near.T
    near[np.arange(n), np.arange(n)] = False
    edges, free = [], near.any(axis=0)
    while free.any():
        seed = int(np.argmax(free))
        reached = np.zeros(n, dtype=bool)
        reached[seed] = True
        front = np.array([seed])
        while len(front):
            fresh = near[front].any(axis=0) & ~reached
            reached |= fresh
            front = np.flatnonzero(fresh)
        edges += [(int(ids[seed]), int(ids[i])) for i in np.flatnonzero(reached) if i != seed]
        free &= ~reached
    return edges


def block_pairs(members: DataFrame, numerator: int, block_rows: int, block_bytes: int) -> DataFrame:
    """Cut clusters ``members (cluster, class_id, n_shingles)`` and pair what can link by size.

    Sets that can link lie in the same size class or in neighbouring ones (a class spans the ratio of the threshold).
    (cluster, class_id, low, i, next, j, side): the set takes part in the pair of block ``i`` of size class ``low`` and
    block ``j`` of the same (next = 0) or the next class (next = 1).
    """
    ratio = float(np.log(100 / numerator))
    members = members.withColumn("class", F.floor(F.log(F.col("n_shingles").cast("double")) / ratio + 1e-9))
    rows = F.least(F.lit(block_rows), F.greatest(F.lit(16), F.floor(F.lit(block_bytes) / (F.max("n_shingles") * 8))))
    counts = members.groupBy("cluster", "class").agg(F.count("*").alias("n"), F.ceil(F.count("*") / rows).alias("blocks"))

    def neighbour(step: int, name: str) -> DataFrame:
        return counts.select("cluster", (F.col("class") + step).alias("class"), F.col("blocks").alias(name))

    around = counts.join(neighbour(1, "below"), ["cluster", "class"], "left") \
        .join(neighbour(-1, "above"), ["cluster", "class"], "left") \
        .filter("n > 1 or below is not null or above is not null")
    placed = members.join(around, ["cluster", "class"]) \
        .withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")))
    kind = "array<struct<low:bigint,i:bigint,next:int,j:bigint,side:int>>"

    def pairs(count, low, i, step, j, side):
        made = F.transform(F.sequence(F.lit(0).cast("long"), F.col(count) - 1), lambda other: F.struct(
            low.alias("low"), i(other).alias("i"), F.lit(step).alias("next"), j(other).alias("j"),
            side(other).alias("side")))
        return F.when(F.col(count).isNull(), F.array().cast(kind)).otherwise(made.cast(kind))

    own, block = F.col("class"), F.col("block")
    tasks = F.concat(
        pairs("blocks", own, lambda o: F.least(block, o), 0, lambda o: F.greatest(block, o),
              lambda o: F.when(block == o, 2).when(block < o, 0).otherwise(1)),
        pairs("above", own, lambda o: block, 1, lambda o: o, lambda o: F.lit(0)),
        pairs("below", own - 1, lambda o: o, 1, lambda o: block, lambda o: F.lit(1)))
    return placed.select("cluster", "class_id", F.explode(tasks).alias("p")).select("cluster", "class_id", "p.*")


def compare(tasks: DataFrame, sets: DataFrame, rule) -> DataFrame:
    """(a, b): stars of the pairs of each task that satisfy ``rule(left, right, shared)``.

    ``sets`` is (class_id, members, facts): 64-bit members and integers that the rule needs, as binary.
    """
    pair = ["cluster", "low", "i", "next", "j"]
    work = tasks.join(sets, "class_id").repartition(*pair).sortWithinPartitions(*pair, "side", "class_id") \
        .select(*pair, "side", "class_id", "members", "facts")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, members, facts = None, [], [], [], []

        def close() -> list[tuple[int, int]]:
            if len(ids) < 2 or sides[0] == sides[-1] != 2:
                return []
            left, right, shared = overlaps(np.array(sides), members)
            told = np.array(facts, np.int64)
            return stars(np.array(ids), left, right, rule(told[left][:, None], told[right][None], shared))

        for batch in slices(batches):
            edges: list[tuple[int, int]] = []
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for at, (*now, side, class_id) in enumerate(zip(*columns, strict=True)):
                if now != key:
                    edges += close()
                    key, ids, sides, members, facts = now, [], [], [], []
                ids.append(class_id)
                sides.append(side)
                members.append(np.frombuffer(batch.column(7)[at].as_py(), np.uint64))
                facts.append(np.frombuffer(batch.column(8)[at].as_py(), np.int64))
            yield _edge_batch(edges)
        yield _edge_batch(close())

    return work.mapInArrow(runs, "a long, b long").distinct()


def _candidate_rule(numerator: int):
    """Pairs that share as many prefix members as a link needs.  Facts: size, prefix length, last prefix member.

    Up to the smaller of the two last prefix members both prefixes are complete, and a link leaves at most the rest of
    the set that ends there outside.
    """

    def rule(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> np.ndarray:
        need = required_overlap(a[..., 0], b[..., 0], numerator)
        rest = np.where(a[..., 2].astype(np.uint64) <= b[..., 2].astype(np.uint64),
                        a[..., 0] - a[..., 1], b[..., 0] - b[..., 1])
        least, most = np.minimum(a[..., 0], b[..., 0]), np.maximum(a[..., 0], b[..., 0])
        return (shared >= np.maximum(1, need - rest)) & (100 * least >= numerator * most)

    return rule


def _link_rule(numerator: int):
    def rule(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return shared >= required_overlap(a[..., 0], b[..., 0], numerator)

    return rule


def candidate_clusters(classes: DataFrame, numerator: int, block_bytes: int, block_rows: int,
                       list_cost: float) -> DataFrame:
    """(class_id, cluster): sets that can link with another one, connected by what can link."""
    histogram = {r["n_shingles"]: r["n"] for r in classes.filter("n_shingles <= 256").groupBy("n_shingles")
                 .agg(F.count("*").alias("n")).collect()}   # 256 rows at most
    boundary = choose_boundary(histogram, numerator, list_cost)
    met = materialise(shared_keys(candidate_keys(classes, boundary, numerator)), "shared-keys")
    # what a set shares: at most its prefix.  A set that shares less than the smaller partner's prefix guarantees goes
    probes = met.filter("listed").groupBy("class_id").agg(F.collect_list("key").alias("keys"),
                                                          F.collect_list("hub").alias("hubs"))
    need = F.lit(1) + F.floor(F.ceil(F.col("n_shingles") * numerator / 100) / _SHARE)
    probes = probes.join(classes.select("class_id", "n_shingles"), "class_id").filter(F.size("keys") >= need)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.column(1).offsets.to_numpy()
            keys, hubs = batch.column(1).values.to_numpy(), batch.column(2).values.to_numpy()
            sizes, members, facts, heads, shares = batch.column(3).to_pylist(), [], [], [], []
            for size, a, b, top in zip(sizes, at[:-1], at[1:], batch.column(4).to_pylist(), strict=True):
                members.append(np.unique(keys[a:b]).tobytes())
                facts.append(np.array([size, prefix_length(size, _shared(size), numerator), top], np.int64).tobytes())
                head, share = np.unique(hubs[a:b], return_counts=True)
                heads.append(head)
                shares.append(share)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(heads, pa.list_(pa.int64())),
                 pa.array(shares, pa.list_(pa.int64())), pa.array(members, pa.binary()), pa.array(facts, pa.binary())],
                names=["class_id", "n_shingles", "hubs", "shares", "members", "facts"])

    # the last prefix member: prefixes ascend as unsigned numbers, and the list-prefix may be shorter than the one stored
    size = F.col("n_shingles")
    length = F.least(size, size - F.ceil(size * numerator / 100) + 1 + F.floor(size / _SHARE)).cast("int")
    tops = classes.select("class_id", F.element_at("prefix", length).alias("top"))
    probes = probes.join(tops, "class_id").select("class_id", "keys", "hubs", "n_shingles", "top")
    probes = materialise(probes.mapInArrow(
        pack, "class_id long, n_shingles long, hubs array<long>, shares array<long>, members binary, facts binary"),
        "probes")
    # a second prefix: linked sets share ``need`` keys, so they meet among all but ``need - 1`` keys of each in any common
    # order; the order is by how many sets a hub draws, so the crowded hubs are left out first
    drawn = probes.select("class_id", "n_shingles", F.explode(F.arrays_zip("hubs", "shares")).alias("h")) \
        .select("class_id", "n_shingles", F.col("h.hubs").alias("cluster"), F.col("h.shares").alias("share"))
    crowd = drawn.groupBy("cluster").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    of_set = Window.partitionBy("class_id")
    ordered = of_set.orderBy("crowd", "cluster").rowsBetween(Window.unboundedPreceding, -1)
    members = drawn.join(crowd, "cluster").withColumn("before", F.coalesce(F.sum("share").over(ordered), F.lit(0))) \
        .withColumn("all", F.sum("share").over(of_set)).filter(F.col("before") <= F.col("all") - need) \
        .select("cluster", "class_id", "n_shingles")
    members = materialise(members, "members")
    met_lists = compare(block_pairs(members, numerator, block_rows, block_bytes),
                        probes.select("class_id", "members", "facts"), _candidate_rule(numerator))
    met_subsets = met.filter("not listed and hub <> class_id").select(
        F.col("class_id").alias("a"), F.col("hub").alias("b")).distinct()
    found = connected_components(met_lists.unionByName(met_subsets))
    return found.select(F.col("node").alias("class_id"), F.col("component").alias("cluster"))


def links(classes: DataFrame, documents: DataFrame, words: int = 5, numerator: int = 75,
          block_bytes: int = 4 << 20, block_rows: int = 1024, list_cost: float = 3.0) -> DataFrame:
    """(a, b): links between classes that connect exactly what all links connect."""
    clusters = candidate_clusters(classes, numerator, block_bytes, block_rows, list_cost)
    members = materialise(clusters.join(classes.select("class_id", "n_shingles", "holder", "digest_a"), "class_id"),
                          "clusters")
    texts = documents.select(F.col("doc_id").cast("long").alias("holder"), F.col("text").cast("binary").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [text_shingles(t.as_buffer() if t.is_valid else b"", words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([digest(f) for f in found], pa.int64()),
                 pa.array([f.tobytes() for f in found], pa.binary()),
                 pa.array([np.array([len(f)], np.int64).tobytes() for f in found], pa.binary())],
                names=["holder", "digest_a", "members", "facts"])

    # the same plan at every size: the texts are dealt by document, the list of documents is never broadcast
    sets = texts.hint("merge").join(members.select("holder").distinct().hint("merge"), "holder", "left_semi") \
        .mapInArrow(hashed, "holder long, digest_a long, members binary, facts binary") \
        .join(members.select("class_id", "holder", "digest_a"), ["holder", "digest_a"]) \
        .dropDuplicates(["class_id"]).select("class_id", "members", "facts")
    tasks = block_pairs(members.select("cluster", "class_id", "n_shingles"), numerator, block_rows, block_bytes)
    return compare(tasks, sets, _link_rule(numerator))


def _edge_batch(edges: list[tuple]) -> pa.RecordBatch:
    columns = zip(*edges, strict=True) if edges else [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def jaccard_components(documents: DataFrame, words: int = 5, numerator: int = 75, **parameters) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id) (operator 9)."""
    sets = materialise(shingle_sets(documents, words, numerator), "shingle-sets")
    usable = sets.filter("n_shingles > 0 and doc_id is not null")
    digests = ["digest_a", "digest_b", "n_shingles"]
    # equal sets are one class, named by its smallest row and represented by that row's document
    classes = usable.groupBy(digests).agg(F.min(F.struct("row_id", "doc_id")).alias("r")) \
        .select(*digests, F.col("r.row_id").alias("class_id"), F.col("r.doc_id").alias("holder"))
    classes = materialise(classes, "classes")
    member = usable.select("doc_id", *digests).join(classes.drop("holder"), digests).select("doc_id", "class_id")
    member = materialise(member, "members-of-classes")
    prefixes = usable.select(F.col("row_id").alias("class_id"), "prefix")
    found = links(classes.join(prefixes, "class_id"), documents, words, numerator, **parameters)
    # a doc_id that is repeated with other texts ties their classes together
    tied = member.groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("top")) \
        .filter("b <> top").select("doc_id", "b")
    tied = member.join(tied, "doc_id").select(F.col("class_id").alias("a"), "b")
    component = connected_components(found.unionByName(tied))
    placed = member.join(component, F.col("class_id") == F.col("node"), "left") \
        .select("doc_id", F.coalesce("component", "class_id").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    result = placed.join(smallest, "component").select("doc_id", "component_id").distinct()
    return sets.select("doc_id", "n_shingles").join(result, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
