"""Vector code compression: product codes whose codebooks come from Lloyd's rounds with Hamerly's bounds.

Components become whole numbers floor(SCALE * x). Every vector is cut into PARTS equal parts, and each part position has a
codebook of ENTRIES entries: at first those of the least vec_ids. A round finds each part's nearest entry (squared
Euclidean distance, ties to the lower index) and replaces entries by the floor of their parts' means.

Beside each part stand two numbers that are written with it from round to round: a bound from above on the distance to its
entry and one from below on the distance to any other. Entries that move loosen them. While the upper bound is strictly
below the lower one, or below half the distance from its entry to the nearest other entry, the part stays where it is;
otherwise the upper bound is made exact, and if that does not help all entries are compared, in whole numbers. Bounds are
rounded outward and a bound that is merely equal decides nothing, so ties are always settled by a full comparison.

Vectors lie in blocks of a few thousand, which a round reads and writes in place: no vector is shuffled. A task sums its
parts by entry; what meets from all tasks are ENTRIES sums for each part position. Codebooks (ENTRIES vectors) go out with
the tasks. Sums of labels are joined by label, those of the few labels with many rows by broadcast.

Rows whose vector is null or has a component that is null or not finite are left out. So are those of another length than
the least vec_id's vector; that length must be a multiple of PARTS. Rows with a null vec_id are coded like all others, but
come last in the order, and rows of one vec_id are ordered by their components. Fewer vectors than ENTRIES make smaller
codebooks. Null labels are one label. Components of about 2**28 / sqrt(length) and more, whose distances would not fit a
long number, are an error. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, discard, partitions
from .common import batch_of, lean, narrow

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block.
BLOCK = 2048
#: Part of a bound by which it is widened, far above the error of the arithmetic.
_SLACK = 1e-9


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + _SLACK)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter((x * (1 - _SLACK)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


class Codebook:
    """The entries of one part position, and what the bounds need to know of them."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None) -> None:
        self.entries, k = entries, len(entries)
        self.squares = (entries * entries).sum(1)
        between = self._squared(entries, self.squares, entries, self.squares).astype(np.float64)
        np.fill_diagonal(between, np.inf)
        self.half = _down(np.sqrt(between.min(1)) / 2)
        moved = np.zeros(k) if before is None else np.sqrt(((entries - before) ** 2).sum(1).astype(np.float64))
        self.moved = moved * (1 + _SLACK)
        # how far any entry but the own one has moved
        self.others = np.full(k, self.moved.max())
        far = int(self.moved.argmax())
        self.others[far] = np.delete(self.moved, far).max(initial=0.0)

    @staticmethod
    def _squared(x: np.ndarray, xx: np.ndarray, c: np.ndarray, cc: np.ndarray) -> np.ndarray:
        """Squared distances. Whole numbers that double precision holds exactly may be multiplied by it."""
        most = max(1, int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
        dot = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if x.shape[1] * most * most < 1 << 51 else x @ c.T
        return xx[:, None] - 2 * dot + cc[None, :]

    def exact(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return ((x - self.entries[owner]) ** 2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each part, its squared distance and the least one of the other entries."""
        d = self._squared(x, (x * x).sum(1), self.entries, self.squares)
        owner, rows = d.argmin(1), np.arange(len(x))
        first = d[rows, owner].astype(np.float64)
        d[rows, owner] = np.iinfo(np.int64).max
        second = d.min(1).astype(np.float64) if d.shape[1] > 1 else np.full(len(x), np.inf)
        return owner, first, second

    def assign(self, x: np.ndarray, owner: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Owners and bounds, in place, under these entries; how many parts met all of them."""
        upper[:] = _up(upper + self.moved[owner])
        lower[:] = _down(np.maximum(lower - self.others[owner], 0.0))
        open_ = np.flatnonzero(~(upper < np.maximum(lower, self.half[owner])))
        upper[open_] = _up(np.sqrt(self.exact(x[open_], owner[open_]).astype(np.float64)))
        open_ = open_[~(upper[open_] < np.maximum(lower[open_], self.half[owner[open_]]))]
        if len(open_):
            owner[open_], first, second = self.nearest(x[open_])
            upper[open_], lower[open_] = _up(np.sqrt(first)), _down(np.sqrt(second))
        return len(open_)


def cut_parts(x: np.ndarray) -> np.ndarray:
    """(position, vector, component) of vectors in rows."""
    return np.ascontiguousarray(x.reshape(len(x), PARTS, -1).transpose(1, 0, 2))


class Block:
    """Some vectors with their parts' owners and bounds."""

    def __init__(self, ids: pa.Array, labels: pa.Array, x: np.ndarray) -> None:
        shape = (PARTS, len(x))
        self.ids, self.labels, self.x = ids, labels, cut_parts(x)
        # no bound yet: nothing is known to stay
        self.owner, self.upper, self.lower = np.zeros(shape, np.int64), np.full(shape, np.inf, np.float32), np.zeros(shape, np.float32)

    @classmethod
    def read(cls, b: pa.RecordBatch, row: int) -> Block:
        block = cls.__new__(cls)
        block.ids, block.labels = b.column("ids")[row].values, b.column("labels")[row].values
        shape = (PARTS, len(block.ids))
        kind = np.int32 if b.column("narrow")[row].as_py() else np.int64
        of = lambda c, kind: np.frombuffer(b.column(c)[row].as_buffer(), kind)
        block.x = of("vectors", kind).reshape(*shape, -1).astype(np.int64)
        block.owner = of("owners", np.uint8).reshape(shape).astype(np.int64)
        block.upper, block.lower = (of(c, np.float32).reshape(shape).copy() for c in ("upper", "lower"))
        return block

    def row(self) -> tuple:
        small = bool(np.abs(self.x).max(initial=0) < 1 << 31)
        return (self.ids.to_pylist(), self.labels.to_pylist(), small, (self.x.astype(np.int32) if small else self.x).tobytes(), self.owner.astype(np.uint8).tobytes(), self.upper.tobytes(), self.lower.tobytes())

    def assign(self, books: list[Codebook]) -> int:
        return sum(book.assign(x, o, u, v) for book, x, o, u, v in zip(books, self.x, self.owner, self.upper, self.lower, strict=True))


_STATE = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("narrow", pa.bool_()), *((c, pa.binary()) for c in ("vectors", "owners", "upper", "lower")), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_STATE_SQL = "ids array<long>, labels array<long>, narrow boolean, vectors binary, owners binary, upper binary, lower binary, part int, entry int, n long, sums array<long>"


def whole_numbers(b: pa.RecordBatch, dim: int) -> np.ndarray:
    """Vectors in rows, as whole numbers."""
    x = np.floor(SCALE * b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
    if np.abs(x).max(initial=0) > isqrt((1 << 60) // max(1, dim)) // 2:
        raise ValueError("a component is too large for distances in long numbers")
    return x.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[Block]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            yield Block(part.column("vec_id"), part.column("label"), whole_numbers(part, dim))


def _kept_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for row in range(b.num_rows):
            yield Block.read(b, row)


def _round(rows: DataFrame, blocks, books: list[Codebook]) -> DataFrame:
    """The blocks after a round's assignment, and each task's sums by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = books[0].entries.shape
        n, sums = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k, width), np.int64)
        for block in blocks(batches):
            block.assign(books)
            for p in range(PARTS):
                order = np.argsort(block.owner[p], kind="stable")
                own = block.owner[p][order]
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                n[p] += np.bincount(own, minlength=k)
                sums[p][own[first]] += np.add.reduceat(block.x[p][order], first, axis=0)
            yield batch_of(_STATE, [[v] for v in (*block.row(), None, None, None, None)])
        if n.any():
            p, e = np.nonzero(n)
            none = [pa.nulls(len(p), f.type) for f in list(_STATE)[:7]]
            yield batch_of(_STATE, [*none, p, e, n[p, e], list(sums[p, e])])

    return cut(rows.mapInArrow(lean(run), _STATE_SQL))


def _moved(state: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries after a round: floors of means; those without parts stay."""
    width = entries.shape[2]
    sums = state.filter("sums is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    out = entries.copy()
    for r in sums.collect():  # ENTRIES rows for each part position at most
        out[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return out


_CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])


def _coded(state: DataFrame, books: list[Codebook]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _kept_blocks(batches):
            block.assign(books)
            error = sum(book.exact(x, o) for book, x, o in zip(books, block.x, block.owner, strict=True))
            codes = block.owner.T.astype(np.uint8).tobytes().hex()
            yield batch_of(_CODED, [block.ids, block.labels, [codes[i : i + 2 * PARTS] for i in range(0, len(codes), 2 * PARTS)], error])

    return cut(state.filter("vectors is not null").mapInArrow(lean(run), "vec_id long, label long, code string, error long"))


def _with_label_errors(rows: DataFrame) -> DataFrame:
    """Adds label_error. Labels that have more than their share of the rows are at most as many as there are partitions:
    they are broadcast; the rest are joined by label."""
    n = partitions(rows.sparkSession)
    sums = cut(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    share = (sums.agg(F.sum("n")).first()[0] or 0) // n
    own = sums.withColumnRenamed("label", "own")
    same = F.col("label").eqNullSafe(F.col("own"))
    hot, cold = own.filter(F.col("n") > share).drop("n"), own.filter(F.col("n") <= share).drop("n")
    met = rows.join(F.broadcast(hot), same, "left").drop("own")
    rest = met.filter("label_error is null").drop("label_error").join(cold, same).drop("own")
    return met.filter("label_error is not null").unionByName(rest)


def first_entries(kept: DataFrame) -> np.ndarray:
    """(position, entry, component) of the least vec_ids' vectors."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    return cut_parts(np.floor(SCALE * np.array([r[0] for r in rows], np.float64)).astype(np.int64))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of every vector that is coded, and the codebooks (position, entry,
    component)."""
    rows = narrow(vectors, vec_id=(id_col, "long"), vector=(vector_col, "array<double>"), label=(label_col, "long"))
    kept = rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    least = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector")).first()
    if least is None:
        return kept.sparkSession.createDataFrame([], "vec_id long, label long, code string, error long, label_error long"), np.zeros((PARTS, 0, 0), np.int64)
    dim = least[0]
    if dim % PARTS or not dim:
        raise ValueError(f"vectors of {dim} components can't be cut into {PARTS} equal parts")
    kept = kept.filter(F.size("vector") == dim)
    entries = first_entries(kept)
    before, state = None, None
    for _ in range(rounds):
        books = [Codebook(e, None if before is None else b) for e, b in zip(entries, entries if before is None else before, strict=True)]
        after = _round(kept, lambda batches: _blocks(batches, dim), books) if state is None else _round(state.filter("vectors is not null"), _kept_blocks, books)
        if state is not None:
            discard(state)
        state, before = after, entries
        entries = _moved(state, entries)
    coded = _coded(state, [Codebook(e, b) for e, b in zip(entries, before, strict=True)])
    discard(state)
    return _with_label_errors(coded), entries


def checksum(entries: np.ndarray) -> str:
    """Of all entries' components by position, entry and component, as decimal numbers between commas."""
    return hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest()


def digests(vectors: DataFrame) -> DataFrame:
    coded, entries = compress(vectors)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(checksum(entries)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Plain rounds, each part against all entries."""
    ctes = [
        "k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT r, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS x FROM k, (SELECT unnest(range(4)) AS part))",
        "c0 AS MATERIALIZED (SELECT part, r - 1 AS e, x AS c FROM p WHERE r <= 256)",
    ]
    nearest = "SELECT r, part, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': e}}) AS best FROM p JOIN c{} USING (part) GROUP BY r, part"
    for i in range(ROUNDS):
        ctes.append(f"a{i} AS MATERIALIZED ({nearest.format(i)})")
        mean = f"SELECT part, e, list(m ORDER BY i) AS c FROM (SELECT part, best.e AS e, i, floor(sum(x[i + 1]) / count(*)) AS m FROM p JOIN a{i} USING (r, part), (SELECT unnest(range((SELECT max(len(x)) FROM p))) AS i) GROUP BY part, best.e, i) GROUP BY part, e"
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN ({mean}) n USING (part, e))")
    return (
        "WITH " + ",\n".join(ctes) + f",\nlast AS ({nearest.format(ROUNDS)}),\n"
        "row_ AS (SELECT r, string_agg(format('{:02x}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM last GROUP BY r)\n"
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,\n"
        f"  (SELECT sha256(string_agg(CAST(CAST(u AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, i)) FROM (SELECT part, e, unnest(c) AS u, unnest(range(len(c))) AS i FROM c{ROUNDS})) AS codebooks_sha256\n"
        "FROM k JOIN row_ USING (r)"
    )


ORACLE = _oracle()
