"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same copy probability, its source's target over its source's size. The
whole part is taken as copies; the fractional parts are rounded by the pivotal method, measured in words: two
fractional documents are paired and mass moves at random from one to the other, without bias and without a change of
their sum, until one is 0 or 1. Documents are dealt to buckets of bounded size by a hash of their id; each bucket leaves
at most one fractional document, and these residuals meet bucket group by bucket group in a reduction tree. The one
that is left at a source's root is taken in part (`root="part"`), so that the source meets its target to a word, or
rounded at random (`root="round"`).

Rows of one id, source and size are interchangeable: they are one entry of the rounding with the sum of their
probabilities, and its copies are dealt evenly to them. So a repeated id, or rows without an id, fill no bucket. Sources
may be many: their ranks and targets are computed where they are.

Null text has size 0; a null source is a source of its own and comes last. A document of size 0 takes 0 words. Texts of
any length are counted whole. Results of `mix` depend on ids, sizes, sources and the seed only, so reruns agree on any
partitioning. `mix` does not look at other columns, `repeat` keeps them. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, partitions
from . import blocks as blocked
from .common import batch_of, lean, narrow, pieces

WEIGHTS, TOTAL_SHARE, CAP = (3, 1, 2), 1.5, 2.0
BUCKET_ROWS, FAN_IN = 16384, 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def count_words(texts: pa.Array) -> np.ndarray:
    """Runs of bytes other than ASCII white space in each text; null: 0."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.int64)
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = (offsets - offsets[0]).astype(np.int64)
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = ends[:-1][ends[:-1] < len(data)]
    begins[edge] = word[edge]  # a text begins anew
    total = np.concatenate(([0], np.cumsum(begins)))
    counts = total[ends[1:]] - total[ends[:-1]]
    counts[np.asarray(texts.is_null())] = 0
    return counts


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size) with size in words."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, budget=8 << 20):
            yield batch_of(schema, [b.column("doc_id"), b.column("source"), count_words(b.column("text"))])

    return narrow(docs, doc_id=(id_col, "long"), source=(source_col, "string"), text=(text_col, "string")).mapInArrow(lean(run), "doc_id long, source string, size long")


def targets(totals: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Target words of each source: shares by weight, capped, the excess shared again until none is above."""
    names = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(totals.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in names if s in open_)
        full = [s for s in names if s in open_ and unit * weight[s] >= cap * totals[s]]
        if not full:
            return out | {s: unit * weight[s] for s in names if s in open_}
        for s in full:
            out[s] = cap * totals[s]
            left = max(0.0, left - out[s])
            open_.discard(s)
    return out


def planned(per: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, cap: float = CAP) -> DataFrame:
    """(source, words, rows, target) of sources (source, words, rows): `targets` without a driver's list of sources."""
    order = F.col("source").asc_nulls_last()
    dealt = cut(per.repartitionByRange(partitions(per.sparkSession), order).withColumn("part", F.spark_partition_id()))
    ranks, before = [], 0
    for r in sorted(dealt.groupBy("part").agg(F.count("*").alias("n")).collect()):
        ranks += [F.lit(r["part"]), F.lit(before)]
        before += r["n"]
    if not ranks:
        return dealt.select("source", "words", "rows", F.lit(0.0).alias("target"))
    place = F.create_map(*ranks)[F.col("part")] + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    table = cut(dealt.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int"))))
    most = F.col("words") * cap
    whole = share * (table.agg(F.sum("words")).first()[0] or 0)
    unit = -1.0
    while True:  # sources whose cap is below their share are full, and what is left is shared by the others
        full = most <= F.col("weight") * F.lit(unit)
        got, open_ = table.agg(F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if not open_:
            break
        now = max(0.0, whole - got) / open_
        if now <= unit:
            break
        unit = now
    return table.select("source", "words", "rows", F.least(most, F.col("weight") * F.lit(unit)).alias("target"))


_MASK = (1 << 64) - 1


def _uniform(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) from two ids (the finaliser of splitmix64)."""
    x = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ seed * 0x165667B19E3779F9) & _MASK
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> shift) * factor & _MASK
    return x / 2**64


def pivot(ids: list, weights: list, probs: list, seed: int) -> list[float]:
    """Pivotal rounding in the given order: all but at most one of the results are 0 or 1; the sum of weight x
    probability stays."""
    out, held = list(probs), -1
    for j, (p, w) in enumerate(zip(probs, weights, strict=True)):
        if w <= 0:
            out[j] = 0.0
        elif 0.0 < p < 1.0:
            if held < 0:
                held = j
                continue
            i, wi, pi = held, weights[held], out[held]
            up, down = min((1 - pi) * wi, p * w), min(pi * wi, (1 - p) * w)
            if _uniform(ids[i] or 0, ids[j] or 0, seed) * (up + down) < down:
                done = (1 - pi) * wi <= p * w
                out[i], out[j] = (1.0, p - up / w) if done else (pi + up / wi, 0.0)
            else:
                done = pi * wi <= (1 - p) * w
                out[i], out[j] = (0.0, p + down / w) if done else (pi - down / wi, 1.0)
            for k in (i, j):
                if out[k] < 1e-12 or out[k] > 1 - 1e-12:
                    out[k] = float(round(out[k]))
            held = next((k for k in (i, j) if 0.0 < out[k] < 1.0), -1)
    return out


_STATE = "doc_id long, source string, size long, n long, source_size long, target double, whole long, prob double, buckets long, bucket long"
_STATE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("n", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("whole", pa.int64()), ("prob", pa.float64()), ("buckets", pa.int64()), ("bucket", pa.int64())])
#: Rows of one entry that are made from one row at a time.
DEALT = 4096


def _rounded(sized: DataFrame, seed: int, root: str, bucket_rows: int, fan_in: int) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, copies, part) of each entry of n rows (doc_id, source, size): the
    copies of all its rows, and words of one more."""
    entries = cut(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    per = entries.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count("*").alias("rows"))
    ratio = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    table = planned(per).select(F.col("source").alias("s"), F.col("words").alias("source_size"), "target", ratio.alias("ratio"), F.ceil(F.col("rows") / bucket_rows).alias("buckets"))
    table = cut(table)
    most = table.agg(F.max("buckets")).first()[0] or 1
    mass = F.col("n") * F.col("ratio")
    state = entries.join(table, F.col("source").eqNullSafe(F.col("s"))).withColumn("whole", F.floor(mass)).withColumn("prob", mass - F.col("whole"))
    state = state.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "size"), F.col("buckets"))).select(*_STATE_SCHEMA.names)

    def rounds(level: int):
        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by([("size", "descending"), ("doc_id", "ascending")])
            probs = pivot(t.column("doc_id").to_pylist(), t.column("size").to_pylist(), t.column("prob").to_pylist(), seed * 64 + level)
            return t.set_column(t.schema.get_field_index("prob"), "prob", pa.array(probs, pa.float64())).select(_STATE_SCHEMA.names).cast(_STATE_SCHEMA)

        return run

    settled, level = [], 0
    while True:
        state = cut(state.groupBy("source", "bucket").applyInArrow(rounds(level), _STATE))
        if most == 1:
            settled.append(state)
            break
        open_ = (F.col("prob") > 0) & (F.col("prob") < 1)
        settled.append(state.filter(~open_))
        most, level = -(-most // fan_in), level + 1
        state = state.filter(open_).withColumn("bucket", F.floor(F.col("bucket") / fan_in))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    p = F.col("prob")
    whole = F.when(F.col("size") == 0, F.col("whole")).otherwise(F.col("whole") + F.floor(p))
    part = F.when((p > 0) & (p < 1), F.round(p * F.col("size")).cast("long")).otherwise(F.lit(0).cast("long"))
    if root == "round":
        draw = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "source"), F.lit(1 << 20)) / float(1 << 20)
        whole, part = whole + F.when((p > 0) & (p < 1) & (draw < p), 1).otherwise(0), F.lit(0).cast("long")
    return out.select("doc_id", "source", "size", "n", "source_size", "target", whole.cast("long").alias("all_copies"), part.alias("part"))


def _share(at: Column) -> Column:
    """Copies of the row with this number in its entry; the first one has fewest."""
    upto = lambda k: F.floor(k * F.col("all_copies") / F.col("n"))
    return (upto(at + 1) - upto(at)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, root: str = "part", bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): what the mix takes of each document.

    copies are the whole ones; taken = copies x size, plus a part of one document of each source if root="part".
    """
    entries = _rounded(sizes(docs, id_col, text_col, source_col), seed, root, bucket_rows, fan_in)
    one = entries.filter("n = 1").withColumn("at", F.lit(0).cast("long"))
    many = entries.filter("n > 1").withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / DEALT)))).repartition(partitions(docs.sparkSession), "doc_id", "source", "size", "page")
    last = F.least(F.col("n"), (F.col("page") + 1) * DEALT) - 1
    rows = one.unionByName(many.withColumn("at", F.explode(F.sequence(F.col("page") * DEALT, last))).drop("page"))
    rows = rows.withColumn("copies", _share(F.col("at")))
    taken = F.col("copies") * F.col("size") + F.when(F.col("at") == 0, F.col("part")).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", taken.cast("long").alias("taken"))


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns. Rows lie in blocks and are known by their
    place; the rows of one id, source and size are numbered block by block."""
    table = blocked.store(docs, text_col, id=(id_col, "long"), source=(source_col, "string"))
    schema = pa.schema([("block", pa.int64()), ("pos", pa.int32()), ("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("blob"), strict=True):
                t = blocked.rows(blob)
                size = np.concatenate([np.zeros(0, np.int64), *(count_words(c) for c in t.column("_text").chunks)])
                yield batch_of(schema, [np.full(len(t), block), np.arange(len(t), dtype=np.int32), t.column("_id").combine_chunks(), t.column("_source").combine_chunks(), size])

    sized = cut(table.select("block", "blob").mapInArrow(lean(run), "block long, pos int, doc_id long, source string, size long"))
    names = ("doc_id", "source", "size")
    entries = cut(_rounded(sized.select(*names), seed, "round", BUCKET_ROWS, FAN_IN).select(*names, "n", "all_copies"))
    mine = [F.col(f"e.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names]
    one = sized.alias("r").join(entries.filter("n = 1").alias("e"), mine).select("block", "pos", F.col("all_copies").alias("n"))
    many = entries.filter("n > 1")
    # the number of a row: those of its entry in earlier blocks, then those before it in its own
    held = sized.alias("r").join(many.alias("e"), mine).select("block", "pos", *(F.col(f"e.{c}") for c in names), "n", "all_copies")
    earlier = Window.partitionBy(*names).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy(*names, "block").agg(F.count("*").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0)))
    own = [F.col(f"o.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*names, "block")]
    within = F.row_number().over(Window.partitionBy(*names, "block").orderBy("pos"))
    numbered = held.withColumn("within", within).alias("h").join(offsets.alias("o"), own).select("h.block", "pos", "n", "all_copies", (F.col("before") + F.col("within") - 1).alias("at"))
    several = numbered.select("block", "pos", _share(F.col("at")).alias("n"))
    return blocked.taken(table, one.unionByName(several).filter("n > 0"), docs, text_col)
