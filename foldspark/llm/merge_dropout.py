"""SentencePiece merge encoding with seeded merge-dropout, and its decoding (operator 3).

A text is cut before every run of spaces; no piece of a merge vocabulary spans such a cut (checked when the model is
loaded), so the parts are segmented one by one.  The agenda of a part holds its adjacent pairs whose union is a piece, best score
first, leftmost on ties.  A pair taken from the agenda is merged unless a keyed hash of (seed, variant, part, position,
union) falls below the dropout rate; a skipped pair is offered again only when a neighbour changes.  What is left
are pieces; a character without a piece falls back to its UTF-8 bytes.

The variant of a document is a hash of the seed and its doc_id, modulo ``variants``: the same seed gives the same ids
on any cluster, and equal words differ between documents.  A worker remembers segmentations of words it has met.  Rate 0
is the model's own segmentation (equal to the sentencepiece library's, see tests).

Decoding joins pieces and bytes and gives back every text exactly: U+2581, the library's mark for a space, is written as
bytes when it stands in a text, and the space put in front of a text is removed again.

Cases: null text gives null ids and null text back; empty text gives no ids; very long texts are encoded whole; null doc_id is a variant as any other; repeated rows are
encoded alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import slices

SPACE = "▁"
_PARTS = re.compile(r" *[^ ]+| +")
_MASK = (1 << 64) - 1
#: Segmentations kept by a worker; beyond it parts are segmented each time they occur, same result.
MAX_PARTS = 1_200_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def skipped(key: int, position: int, order: int, limit: int) -> bool:
    """Whether the keyed hash of a candidate (its position in the part and its piece) falls below the limit."""
    h = ((key ^ (position * 0x9E3779B97F4A7C15)) + order * 0xD6E8FEB86659FD93) & _MASK
    h = ((h ^ (h >> 32)) * 0xBF58476D1CE4E5B9) & _MASK
    return (h >> 32) < limit


class MergeModel:
    """Vocabulary of a merge model: pieces, scores, byte pieces."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if library.is_byte(i)}
        self.raw = {i: bytes([b]) for b, i in self.byte.items()}
        special = [i for i in range(len(self.piece)) if library.is_control(i) or library.is_unknown(i)]
        self.special = set(special)
        # piece -> order of merging (higher scores first); number of a piece by its order
        pieces = [i for i in range(len(self.piece)) if i not in self.special and i not in self.raw]
        pieces.sort(key=lambda i: (-library.get_score(i), i))
        self.rank = {self.piece[i]: order for order, i in enumerate(pieces)}
        self.number = pieces
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece spans the cut before a space")

    def _merge_short(self, symbols: list[str], key: int, dropout: float) -> list[str]:
        """The agenda as a plain list of the adjacent pairs: the least order is looked up each time."""
        get, none, limit = self.rank.get, len(self.number), int(dropout * (1 << 32))
        agenda = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        at = list(range(len(symbols)))
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            if limit:   # as in ``skipped``, without the call
                h = ((key ^ (at[i] * 0x9E3779B97F4A7C15)) + best * 0xD6E8FEB86659FD93) & _MASK
                if (((h ^ (h >> 32)) * 0xBF58476D1CE4E5B9) & _MASK) >> 32 < limit:
                    agenda[i] = none
                    continue
            symbols[i] += symbols.pop(i + 1)
            del agenda[i], at[i + 1]
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], none)
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], none)
        return symbols

    def _merge_long(self, symbols: list[str], key: int, dropout: float) -> list[str]:
        """The agenda as a heap; same result."""
        get, n, limit = self.rank.get, len(symbols), int(dropout * (1 << 32))
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            union = symbols[i] + symbols[j]
            order = get(union)
            if order is not None:
                heapq.heappush(agenda, (order, i, j, union))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            order, i, j, union = heapq.heappop(agenda)
            if after[i] != j or not symbols[i] or symbols[i] + symbols[j] != union:
                continue
            if limit and skipped(key, i, order, limit):
                continue
            symbols[i], symbols[j] = union, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i], i)
            if after[i] >= 0:
                offer(i, after[i])
        return symbols

    def segment(self, part: str, key: int, dropout: float) -> list[int]:
        """Ids of one part; ``part`` writes spaces as U+2581 and holds U+2581 itself as U+0000 U+2581."""
        symbols: list[str] = []
        chars = iter(part)
        for c in chars:
            symbols.append(c + next(chars) if c == "\0" else c)
        symbols = self._merge_short(symbols, key, dropout) if len(symbols) <= 32 else \
            self._merge_long(symbols, key, dropout)
        ids: list[int] = []
        for s in symbols:
            if s:
                found = self.rank.get(s)
                if found is not None:
                    ids.append(self.number[found])
                else:
                    ids.extend(self.byte[b] for b in s.lstrip("\0").encode() or b"\0")
        return ids


class _Parts(dict):
    """Part without the space in front of it -> its ids, for one variant; remembers a bounded number."""

    def __init__(self, model: MergeModel, dropout: float, seed: int, variant: int, most: int):
        super().__init__()
        self.model, self.dropout, self.most = model, dropout, most
        self.start, self.salt = seed & 0xFFFFFFFF, variant * 0xC2B2AE3D27D4EB4F

    def part(self, part: str) -> bytes:
        marked = part
        if "\0" in part or SPACE in part:
            marked = part.replace("\0", "\0\0").replace(SPACE, "\0" + SPACE)
        key = (zlib.crc32(part.encode(), self.start) * 0x9E3779B1 + self.salt) & _MASK
        ids = self.model.segment(marked.replace(" ", SPACE), key, self.dropout)
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.part(" " + word)
        if len(self) < self.most:
            self[word] = ids
        return ids


class Encoder:
    """Segments texts; remembers the ids of words, for each variant."""

    def __init__(self, path: str, dropout: float, seed: int, variants: int):
        self.model, self.seed, self.variants = MergeModel(path), seed, variants
        self.known = [_Parts(self.model, dropout, seed, v, MAX_PARTS // variants) for v in range(variants)]

    def variant(self, doc_id: int | None) -> int:
        return zlib.crc32(f"{self.seed}|{doc_id}".encode()) % self.variants

    def ids(self, text: str, variant: int) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; the text gets a space in front, as the model expects."""
        if not text:
            return b""
        known = self.known[variant]
        if "  " in text or text[0] == " " or text[-1] == " ":   # runs of spaces are parts with their word
            return b"".join(map(known.part, _PARTS.findall(" " + text)))
        return b"".join(map(known.__getitem__, text.split(" ")))


class Decoder:
    def __init__(self, model: MergeModel):
        self.shown = [b"" if i in model.special else model.raw[i] if i in model.raw
                      else p.replace(SPACE, " ").encode() for i, p in enumerate(model.piece)]

    def text(self, ids: bytes) -> str:
        raw = b"".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1:].decode() if raw else ""


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(*parameters) -> Encoder:
    if parameters not in _ENCODERS:
        _ENCODERS[parameters] = Encoder(*parameters)
    return _ENCODERS[parameters]


def encode(documents: DataFrame, dropout: float = 0.1, seed: int = 42, variants: int = 4,
           model: str | None = None) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers."""
    parameters = (model or model_path(), dropout, seed, variants)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(*parameters)
        for batch in slices(batches):
            found = [None if t is None else own.ids(t, own.variant(d))
                     for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of ``encoded (doc_id, ids)``."""
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(MergeModel(path))
        for batch in slices(batches):
            found = [None if i is None else own.text(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, dropout: float = 0.1, seed: int = 42, variants: int = 4,
               model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text_sha256): digests of the ids and of the text decoded from them (operator 3)."""
    path = model or model_path()
    encoded = encode(documents, dropout, seed, variants, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(MergeModel(path))
        for batch in slices(batches):
            ids = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if i is None else len(i) // 4 for i in ids], pa.int64()),
                 pa.array([None if i is None else zlib.crc32(i) for i in ids], pa.int64()),
                 pa.array([None if i is None else own.text(i) for i in ids], pa.string())],
                names=["doc_id", "n_tokens", "ids_crc32", "text"])

    read = encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, text string")
    return read.select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))
