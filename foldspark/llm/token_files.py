"""Token ids in a fixed-width bit-packed table with block offsets (operator 1).

Format: a Parquet table, one row per block.  A block holds the ids of whole documents, each in
``ceil(log2(vocabulary))`` bits, most significant bit first, padded to a whole byte.

| column | meaning |
| --- | --- |
| shard, block | position: shards follow the order of doc_id, blocks the order inside a shard |
| first_id | ids of the same shard before this block |
| n_ids, bits | ids in the block and bits of each |
| payload | the packed ids |
| doc_id, doc_start, doc_len | for each document of the block its id, its first id inside the block, its ids |

``shard_offsets`` gives the number of ids before each shard, so ``first_id`` plus that offset addresses any id of
the whole table.  Reading a block is one vectorised unpacking; an id at position ``i`` of a block is bits
``i * bits .. (i + 1) * bits`` of its payload, so single documents are read without touching the rest.

Cases: null text counts as empty (it still gets the end id); documents with a null or repeated doc_id are kept,
nulls first, equal ids ordered by text; a very long text is a block of its own; an empty table gives an empty file; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm.common import shared_path, shuffle_partitions, slices
from foldspark.llm.tokens import encoder, tokenizer_path

BLOCK_SCHEMA = ("shard int, block int, first_id long, n_ids long, bits int, payload binary, "
                "doc_id array<long>, doc_start array<long>, doc_len array<long>")
READ_SCHEMA = "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def id_bits(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive ``bits``-wide big-endian fields, padded with zero bits to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    fields = (ids.astype(np.uint32)[:, None] >> shifts) & np.uint32(1)
    return np.packbits(fields.astype(np.uint8).ravel()).tobytes()


def unpack_bits(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from position ``first``; only the bytes that hold them are looked at."""
    if bits in (8, 16, 32):
        width = bits // 8
        return np.frombuffer(payload, f">u{width}", count, first * width).astype(np.uint32)
    begin, end = first * bits, (first + count) * bits
    raw = np.unpackbits(np.frombuffer(payload, np.uint8)[begin // 8:-(-end // 8)])
    fields = raw[begin % 8:begin % 8 + count * bits].reshape(count, bits).astype(np.uint32)
    return (fields << np.arange(bits - 1, -1, -1, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_token_files(documents: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1,
                      vocabulary: int = 49_408, block_ids: int = 1 << 16) -> None:
    """Encode ``documents (doc_id, text)`` and write them at ``path`` in ascending doc_id order.

    The documents are range-partitioned by doc_id; a partition is a shard and streams its blocks out, so a task
    holds one Arrow batch of texts and one block.  A block ends with the first document that fills it.
    """
    tokenizer = tokenizer or tokenizer_path()
    spark = documents.sparkSession
    bits = id_bits(vocabulary)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(p) // 4 for p in parts], dtype=np.int64)
            packed = pack_bits(np.frombuffer(b"".join(parts), "<u4"), bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([held], pa.int64()), pa.array([bits], pa.int32()), pa.array([packed], pa.binary()),
                 pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([np.cumsum(lengths) - lengths], pa.list_(pa.int64())),
                 pa.array([lengths], pa.list_(pa.int64()))],
                names=["shard", "block", "first_id", "n_ids", "bits", "payload", "doc_id", "doc_start", "doc_len"])

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                parts.append(enc.encode(text) + end)
                held += len(parts[-1]) // 4
                if held >= block_ids:
                    yield flush()
                    block, before = block + 1, before + held
                    doc_ids, parts, held = [], [], 0
        if parts:
            yield flush()

    rows.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


def shard_offsets(files: DataFrame) -> DataFrame:
    """(shard, offset): ids in all shards before; one row per shard, made from one row per shard."""
    spark = files.sparkSession
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # rows: partitions
    offsets, before = [], 0
    for row in totals:
        offsets.append((row["shard"], before))
        before += row["n"]
    return spark.createDataFrame(offsets, "shard int, offset long")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Unpack every block: (doc_id, start, n_tokens, ids_crc32) per document."""
    files = spark.read.parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_bits(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
                raw = memoryview(ids.tobytes())
                starts, lengths = row["doc_start"], row["doc_len"]
                crc = [zlib.crc32(raw[4 * s:4 * (s + n)]) for s, n in zip(starts, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(crc), row["shard"], np.int32)), pa.array(row["doc_id"], pa.int64()),
                     pa.array(np.array(starts, np.int64) + row["first_id"]), pa.array(lengths, pa.int64()),
                     pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    columns = files.select("shard", "first_id", "n_ids", "bits", "payload", "doc_id", "doc_start", "doc_len")
    read = columns.mapInArrow(documents, READ_SCHEMA)
    located = read.join(F.broadcast(shard_offsets(files)), "shard")  # one small row per shard
    return located.select("doc_id", (F.col("local_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_files(documents: DataFrame, path: str | None = None, **parameters) -> DataFrame:
    """Write the table, then read it back (operator 1)."""
    spark = documents.sparkSession
    path = path or shared_path(spark, "token-files")
    write_token_files(documents, path, **parameters)
    return read_token_files(spark, path)
