"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Lengths in (C/(j+1), C/j] form class j, of which exactly j pieces fill a bin. A document's full sequences are cut off
first; its rest is cut at reciprocals of the capacity, largest first, so that pieces lie just below their class's upper
end and the bins of a class are almost full; where a class wastes little, and where a cut would leave less than LEAST
tokens, the rest stays whole. Every worker fills the bins of every class on its own, with no shuffle; the
pieces that are left when its rows end, fewer than j of class j, go into its last bins first fit, longest first.

Null text is the empty text: one piece with only the closing id. Repeated rows are packed as often as they occur, and
rows without an id or with a shared one like all others. A very long text makes as many pieces as it needs. Pieces of one
length go to bins in the order of rows. Extra columns are not read, whatever their names. An empty table gives an empty
table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, lean, narrow, pieces
from .tokens import default_path, encoder

CAPACITY, CLOSING_ID = 1024, 0
#: A piece stays whole if its class's bin then wastes at most this share.
WASTE = 1 / 32
#: A cut leaves so many tokens at least.
LEAST = 24


def cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        j = capacity // rest
        # the largest reciprocal that is not above what is left
        part = capacity // (j + 1)
        if capacity - j * rest <= WASTE * capacity or rest - part < LEAST:
            part = rest
        out.append(part)
        rest -= part
    return out


class Bins:
    """The open bins of one worker."""

    def __init__(self, first_id: int, capacity: int) -> None:
        self.next_id, self.capacity, self.open = first_id, capacity, {}

    def _close(self, bin_: list[tuple]) -> Iterator[tuple]:
        at = 0
        for piece in bin_:
            yield (*piece, self.next_id, at)
            at += piece[2]
        self.next_id += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        """piece: (doc_id, start, length, ...); yields a whole bin when it is full."""
        j = self.capacity // piece[2]
        bin_ = self.open.setdefault(j, [])
        bin_.append(piece)
        if len(bin_) == j:
            del self.open[j]
            yield from self._close(bin_)

    def rest(self) -> Iterator[tuple]:
        left = sorted((p for b in self.open.values() for p in b), key=lambda p: -p[2])
        bins: list[list] = []
        room: list[int] = []
        for p in left:
            k = next((i for i, r in enumerate(room) if r >= p[2]), len(bins))
            if k == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[k].append(p)
            room[k] -= p[2]
        for b in bins:
            yield from self._close(b)


_COLUMNS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
_PLACE = [("sequence_id", pa.int64()), ("offset", pa.int64())]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, closing_id: int = CLOSING_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds its ids."""
    path = tokenizer or default_path()
    extra = [("ids", pa.binary())] if with_ids else []
    schema = pa.schema([*_COLUMNS, *extra, *_PLACE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, close = encoder(path).encode, closing_id.to_bytes(4, "little")
        context = TaskContext.get()
        bins = Bins((context.partitionId() if context else 0) << 36, capacity)
        for b in pieces(batches):
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + close
                total, at = len(ids) // 4, 0
                for n in cuts(total, capacity):
                    part = ids[4 * at : 4 * (at + n)]
                    rows.extend(bins.add((i, at, n, zlib.crc32(part), total, *((part,) if with_ids else ()))))
                    at += n
            if rows:
                yield batch_of(schema, [*zip(*rows, strict=True)])
        encoder(path).rest()
        if rows := list(bins.rest()):
            yield batch_of(schema, [*zip(*rows, strict=True)])

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return narrow(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(lean(run), kinds)


def fill(packed: DataFrame) -> DataFrame:
    """(sequence_id, pieces, tokens): how full each sequence is."""
    return packed.groupBy("sequence_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("tokens"))
