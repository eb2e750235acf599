"""Sharding by extendible hashing, in DataFrame operations only.

A document's key is 60 bits of the MD5 of its id. The directory is indexed by key prefixes; it starts as one bucket, and
only a bucket above the byte limit splits on another bit, until every bucket fits or holds a single key. The splits
of eight bits are found in one pass: sums per eight-bit cell are added up along the prefixes, and the first prefix that
fits is the bucket. Only documents in cells that are still too large take part in the next pass.

Rows with one key (an id that occurs more than once) cannot be told apart by more bits: such a bucket, if too large, is
cut into pages of equal row counts that fit the limit, by size and then as they are counted. A single document above the
limit is a shard of its own. Null text counts 0 bytes, a null id is a key like any other. Extra columns are not read,
whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running
from ..runtime import cut
from .common import narrow

KEY_BITS, STEP = 60, 8
MAX_BYTES = 1 << 20


def key_of(id_: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("null")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def _prefix(key: Column, bits: int, depth: Column) -> Column:
    """The first `depth` bits of a number of `bits` bits."""
    return F.call_function("shiftright", key, F.lit(bits) - depth)


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, bytes, bucket, local_depth, shard_bytes, page): bucket is the key prefix of local_depth bits."""
    sized = cut(narrow(docs, doc_id=(id_col, "long"), text=(text_col, "string")).select("doc_id", key_of(F.col("doc_id")).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")))
    done, rows, low = [], sized, 0
    sums = (F.sum("bytes").alias("bytes"), F.min("first").alias("first"), F.max("last").alias("last"))
    fits = (F.col("bytes") <= max_bytes) | (F.col("first") == F.col("last"))
    while True:
        high = min(low + STEP, KEY_BITS)
        cell = F.call_function("shiftright", F.col("key"), F.lit(KEY_BITS - high))
        cells = cut(rows.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last")))
        depths = F.explode(F.sequence(F.lit(low + (low > 0)), F.lit(high))).alias("depth")
        levels = cells.select("*", depths).groupBy("depth", _prefix(F.col("cell"), high, F.col("depth")).alias("prefix")).agg(*sums).filter(fits)
        paths = cells.select("cell", depths).withColumn("prefix", _prefix(F.col("cell"), high, F.col("depth")))
        first = paths.join(levels, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", F.col("bytes").alias("shard_bytes"))).alias("b"))
        known = cut(cells.select("cell").join(first, "cell", "left"))
        keyed = rows.withColumn("cell", cell)
        done.append(keyed.join(known.filter("b is not null"), "cell").select("doc_id", "key", "bytes", F.col("b.prefix").alias("bucket"), F.col("b.depth").cast("int").alias("local_depth"), "b.shard_bytes"))
        open_ = known.filter("b is null").select("cell")
        if high == KEY_BITS or open_.isEmpty():
            break
        rows, low = keyed.join(open_, "cell", "left_semi").drop("cell"), high
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    columns = ("doc_id", "bytes", "bucket", "local_depth", "shard_bytes", "page")
    small = out.filter(F.col("shard_bytes") <= max_bytes).withColumn("page", F.lit(0).cast("long")).select(*columns)
    large = out.filter(F.col("shard_bytes") > max_bytes)
    return small if large.isEmpty() else small.unionByName(_pages(large, max_bytes).select(*columns))


def _pages(rows: DataFrame, max_bytes: int, block: int = 4096) -> DataFrame:
    """Rows of one key are alike but for their size: count them by size, number them, and lay the numbers out again."""
    same = rows.groupBy("key", "doc_id", "bytes", "bucket", "local_depth", "shard_bytes").agg(F.count("*").alias("n"))
    most = rows.groupBy("key").agg(F.max("bytes").alias("most"))
    per_page = F.greatest(F.lit(1).cast("long"), F.expr(f"{max_bytes}L div greatest(most, 1L)"))
    counted = running(same, ("key",), "bytes", "before", "n").join(most, "key").withColumn("per_page", per_page)
    blocks = counted.withColumn("from", F.explode(F.expr(f"sequence(0L, n - 1, {block}L)"))).repartition("key", "bytes", "from")
    numbered = blocks.withColumn("i", F.explode(F.expr(f"sequence(from, least(from + {block - 1}L, n - 1))")))
    return numbered.withColumn("page", F.floor((F.col("before") + F.col("i")) / F.col("per_page")).cast("long"))


def directory(assigned: DataFrame) -> DataFrame:
    """(bucket, local_depth, page, documents, bytes): one row per shard."""
    return assigned.groupBy("bucket", "local_depth", "page").agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key,
         CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes FROM documents),
path AS (SELECT d.*, CAST(depth AS INTEGER) AS depth, key >> (60 - depth) AS prefix FROM d, range(0, 61) AS r(depth)),
size AS (SELECT depth, prefix, sum(bytes) AS b, min(key) AS lo, max(key) AS hi FROM path GROUP BY 1, 2),
first AS (
  SELECT p.doc_id, p.bytes, min(p.depth) AS local_depth FROM path p JOIN size s USING (depth, prefix)
  WHERE s.b <= {MAX_BYTES} OR s.lo = s.hi GROUP BY 1, 2)
SELECT f.doc_id, f.bytes, p.prefix AS bucket, f.local_depth, CAST(s.b AS BIGINT) AS shard_bytes, CAST(0 AS BIGINT) AS page
FROM first f JOIN path p ON p.doc_id = f.doc_id AND p.depth = f.local_depth
JOIN size s ON s.depth = p.depth AND s.prefix = p.prefix
"""
