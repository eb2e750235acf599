"""Blocks of rows, written once and bucketed by their number, and numbers that travel in little room.

A row's place (block, pos) is its hidden key: it is the same in every later read, whatever ids, nulls or repeated rows the
table holds. What a block needs from elsewhere comes to it by its number; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import partitions, scratch, scratch_table, writing
from .common import PIECE_BYTES, batch_of, col, lean

#: A block closes at so many bytes, all columns counted, or rows.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 1 << 14
_SLICE = 1 << 18


def _blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def rows(blob) -> pa.Table:
    """The rows of a block; blob is a binary scalar."""
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def buckets(spark) -> int:
    """Of tables by block: a third of a shuffle's partitions, for their rows are large and each bucket is a file."""
    return max(8, partitions(spark) // 3)


def bucket_of(number: int, n: int) -> int:
    """Where Spark puts a long number: its 32-bit Murmur hash with seed 42, modulo n."""
    low32 = 0xFFFFFFFF
    turn = lambda x, k: (x << k | x >> 32 - k) & low32
    h = 42
    for word in (number & low32, number >> 32 & low32):
        h ^= turn(word * 0xCC9E2D51 & low32, 15) * 0x1B873593 & low32
        h = (turn(h, 13) * 5 + 0xE6546B64) & low32
    h ^= 8
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & low32
    return (h - (h >> 31 << 32)) % n


def _saved(df: DataFrame, large: bool = True) -> DataFrame:
    """df as a table that is bucketed by block; tables of one session meet by block without a shuffle."""
    spark = df.sparkSession
    name, path = scratch_table(spark), scratch(spark)
    with writing(spark, large):
        df.write.bucketBy(buckets(spark), "block").option("path", path).option("compression", "uncompressed").saveAsTable(name)
    out = spark.read.table(name)
    out.cut_path = path
    return out


def dealt(df: DataFrame) -> DataFrame:
    """df's rows where the blocks' buckets are; blocks that meet them do not move."""
    return df.repartition(buckets(df.sparkSession), "block")


def gathered(df: DataFrame, name: str, *columns) -> DataFrame:
    """(block, name): the columns of df's rows as one array for each block, where the blocks are."""
    return dealt(df).groupBy("block").agg(F.collect_list(F.struct(*columns)).alias(name))


def by_block(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """The same, kept beside the blocks."""
    return _saved(gathered(df, name, *columns))


def store(docs: DataFrame, text_col: str, rest: bool = True, **own: tuple[str, str]) -> DataFrame:
    """(block, ids, size, blob): `_text`, the columns `own` (name, type) under an underscore, and the rest of the row if
    `rest`, packed where they are read. ids are those of `id`, size is the bytes of the texts."""
    kept = [col(name).cast(kind).alias(f"_{alias}") for alias, (name, kind) in own.items()]
    others = [F.struct(*(col(c) for c in docs.columns if c != text_col)).alias("_rest")] if rest else []
    packed = docs.select(col(text_col).cast("string").alias("_text"), *kept, *others)
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("size", pa.int64()), ("blob", pa.binary())])
    n = buckets(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        number = task << 32
        held, size, count = [], 0, 0

        def following(number: int) -> int:
            """The next number in the task's one bucket, so that it writes one file."""
            while bucket_of(number, n) != task % n:
                number += 1
            return number

        number = following(number)

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            return batch_of(schema, [[number], [t.column("_id").to_pylist()], [pc.sum(pc.binary_length(t.column("_text"))).as_py() or 0], [_blob(t)]])

        for b in batches:
            step = max(1, min(512, b.num_rows * _SLICE // max(1, b.nbytes)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                held.append(part)
                size += part.nbytes
                count += part.num_rows
                if size >= BLOCK_BYTES or count > BLOCK_ROWS - 512:
                    yield out()
                    held, size, count, number = [], 0, 0, following(number + 1)
        if held:
            yield out()

    return _saved(packed.mapInArrow(lean(run), "block long, ids array<long>, size long, blob binary"), False)


def taken(blocks: DataFrame, places: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The rows of docs at the places (block, pos), with all their columns, without a shuffle of rows; with a column n, as
    often as it says."""
    often = F.col("n") if "n" in places.columns else F.lit(1)
    per = gathered(places, "keep", "pos", often.cast("long").alias("n"))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, keep in zip(b.column("blob"), b.column("keep").to_pylist(), strict=True):
                t = rows(blob).take(pa.array(sorted(k["pos"] for k in keep), pa.int64()))
                n = np.array([k["n"] for k in sorted(keep, key=lambda k: k["pos"])])
                rest = t.column("_rest").combine_chunks()
                rest = rest.combine_chunks() if isinstance(rest, pa.ChunkedArray) else rest
                flat = dict(zip((f.name for f in rest.type), rest.flatten(), strict=True)) | {text_col: t.column("_text").combine_chunks()}
                t = pa.table([flat[c] for c in names], names=names)
                if (n == 1).all():
                    yield from t.to_batches(1024)
                else:
                    again = np.repeat(np.arange(len(n)), n)
                    for at in range(0, len(again), 1024):
                        yield from t.take(pa.array(again[at : at + 1024])).combine_chunks().to_batches()

    return blocks.select("block", "blob").join(per.hint("shuffle_hash"), "block").select("blob", "keep").mapInArrow(lean(run), docs.schema)


def pieces(texts: list[str | None], budget: int = PIECE_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) with about `budget` characters each; one longer text makes a piece of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 16
        if size and size + n > budget:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += n
    if texts:
        yield begin, texts[begin:]


def shards_for(blocks: DataFrame, text_bytes: int) -> int:
    """So many shards that each one answers for about `text_bytes` of text, and two for each partition at least."""
    total = blocks.agg(F.sum("size")).first()[0] or 0
    return max(2 * partitions(blocks.sparkSession), -(-total // text_bytes))


# --- numbers ------------------------------------------------------------------------------------------------------


def squeeze(x: np.ndarray) -> bytes:
    """An array's bytes by significance, compressed: high bytes of small numbers take no room."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(blob: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def squeeze_ascending(x: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers, as differences."""
    return squeeze(np.diff(x, prepend=np.uint64(0)))


def expand_ascending(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, np.uint64), dtype=np.uint64)


def squeeze_counts(x: np.ndarray) -> bytes:
    """Counts, most of them 0, 1 or 2: two bits for each, and what is above 2 by itself."""
    code = np.minimum(x, 3).astype(np.uint8)
    bits = np.unpackbits(code[:, None], axis=1)[:, 6:]
    low = zstandard.ZstdCompressor(level=3).compress(np.packbits(bits.T).tobytes())
    return len(x).to_bytes(8, "little") + len(low).to_bytes(8, "little") + low + squeeze(x[code == 3].astype(np.uint64))


def expand_counts(blob: bytes) -> np.ndarray:
    """The counts, as 32-bit numbers if they fit."""
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[16 : 16 + size]), np.uint8), count=2 * n).reshape(2, n)
    more = expand(blob[16 + size :], np.uint64)
    out = (bits[0] << 1 | bits[1]).astype(np.uint64 if more.size and more.max() >= 1 << 32 else np.uint32)
    out[out == 3] = more
    return out


def range_shard(x: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Shards of hashes of so many bits by ranges, so that ascending hashes lie by shard."""
    return ((x >> np.uint64(bits - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
