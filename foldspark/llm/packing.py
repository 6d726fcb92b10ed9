"""Bound-certified best-fit packing (operator 4).

Documents become pieces of at most ``capacity`` tokens (only longer documents are cut).  Full pieces are sequences
of their own.  The other pieces are dealt by hash to groups of bounded size; a group is packed by best-fit
decreasing and its number of sequences is compared with a lower bound from dual-feasible functions.  A group that
meets its bound is certified and final.  In a group with a gap the fullest sequences stay, and the pieces of the others go
to the next round, where groups are dealt anew, and repacked, until one group is left.

Every round carries only the pieces of not certified groups; a group holds at most ``group_pieces`` pieces on
average, so no task sees the whole table.  The number of rounds is logarithmic.

Cases: null text counts as empty (one piece with the end id alone); repeated rows are packed one by one; null
doc_id stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import materialise, slices
from foldspark.llm.tokens import encoder, tokenizer_path

PIECES = "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long"


def document_pieces(documents: DataFrame, capacity: int = 2048, tokenizer: str | None = None,
                    end_id: int = 0) -> DataFrame:
    """Token pieces of every document: (doc_id, row_id, piece, start, length, ids_crc32)."""
    tokenizer = tokenizer or tokenizer_path()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, width = encoder(tokenizer), end_id.to_bytes(4, "little"), 4 * capacity
        row_id = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(enc.encode(text) + end)
                for piece, at in enumerate(range(0, len(ids), width)):
                    cut = ids[at:at + width]
                    out.append((doc_id, row_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
                row_id += 1
            names, kinds = ["doc_id", "row_id", "piece", "start", "length", "ids_crc32"], [pa.int64()] * 6
            kinds[2] = pa.int32()
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(pieces, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of ``lengths`` needs, by dual-feasible functions.

    For a threshold t at most half the capacity, lengths above ``capacity - t`` count as a whole sequence, lengths
    below t as nothing, others as they are; the sum over the capacity is a bound for each t.  A second family
    counts lengths above half a sequence as ``k - floor(k * (capacity - length) / capacity)`` rounded parts.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    upto, weight = np.cumsum(counts), np.cumsum(counts * sizes)
    t = np.arange(0, capacity // 2 + 1)
    whole = upto[capacity] - upto[capacity - t]
    middle = weight[capacity - t] - np.where(t > 0, weight[np.maximum(t - 1, 0)], 0)
    best = int(np.max(whole + -(-middle // capacity)))
    for k in range(2, 41):
        scaled = sizes * (k + 1)
        parts = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)  # f(x) * k * capacity
        best = max(best, -(-int((parts * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence number of every length: longest first, each into the fullest sequence that still has room."""
    place = np.empty(len(lengths), dtype=np.int64)
    room: list[int] = []                      # sorted distinct free spaces
    bins: dict[int, list[int]] = {}           # free space -> sequences (heap, smallest number first)
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(room, size)
        if at == len(room):
            number, free, n = n, capacity - size, n + 1
        else:
            space = room[at]
            number = heapq.heappop(bins[space])
            if not bins[space]:
                del bins[space]
                room.pop(at)
            free = space - size
        place[i] = number
        if free:
            if free not in bins:
                bins[free] = []
                insort(room, free)
            heapq.heappush(bins[free], number)
    return place


def _pack_group(lengths: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sequence of each piece, whether it is final).  Without a certificate the pieces of the emptiest sequences,
    half of them and two at least, are released."""
    place = best_fit_decreasing(lengths, capacity)
    n = int(place.max()) + 1
    final = np.ones(len(lengths), dtype=bool)
    if not last and n > lower_bound(lengths, capacity):
        used = np.bincount(place, weights=lengths, minlength=n)
        loose = np.argsort(used, kind="stable")[:max(2, n // 2)]
        final = ~np.isin(place, loose[used[loose] < capacity])
    return place, final


def _group_packer(capacity: int, turn: int, last: bool):
    """Grouped function: packs one group and orders its rows by sequence."""

    def pack_group(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("row_id", "ascending"), ("piece", "ascending")])
        place, final = _pack_group(group["length"].to_numpy(), capacity, last)
        order = np.argsort(place, kind="stable")
        group, place, final = group.take(pa.array(order)), place[order], final[order]
        lengths = group["length"].to_numpy()
        before = np.cumsum(lengths) - lengths
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        offset = before - np.repeat(before[first], np.diff(np.r_[first, len(place)]))
        number = 2 * ((turn << 48) + (key[0].as_py() << 24) + place)
        return group.append_column("sequence_id", pa.array(number, pa.int64())) \
            .append_column("offset", pa.array(offset, pa.int64())).append_column("final", pa.array(final))

    return pack_group


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = 50_000) -> DataFrame:
    """Give every piece a sequence and an offset: adds (sequence_id long, offset long).

    ``pieces`` needs (row_id, piece, length), with lengths from 1 to ``capacity``; other columns are kept.
    Sequence numbers are unique, in no order: full pieces get odd ones, packed sequences even ones made of
    round, group and number in the group.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    schema += ", sequence_id long, offset long, final boolean"
    kept = [*pieces.columns, "sequence_id", "offset"]
    pieces = materialise(pieces, "pieces")
    done = [pieces.filter(F.col("length") >= capacity)
            .withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1)
            .withColumn("offset", F.lit(0).cast("long")).select(kept)]
    rest, turn = pieces.filter(F.col("length") < capacity), 0
    while n := rest.count():
        groups = -(-n // group_pieces)

        packer = _group_packer(capacity, turn, last=groups == 1)
        key = F.pmod(F.xxhash64("row_id", "piece", F.lit(turn)), F.lit(groups)).alias("__group")
        packed = materialise(rest.groupBy(key).applyInArrow(packer, schema), f"packed-{turn}")
        done.append(packed.filter("final").select(kept))
        rest = packed.filter("not final").select(pieces.columns)
        turn += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(documents: DataFrame, capacity: int = 2048, **parameters) -> DataFrame:
    """Pieces of ``documents`` with their place: one row per piece (operator 4)."""
    return pack(document_pieces(documents, capacity, **parameters), capacity).drop("row_id")
