"""Near duplicates by MinHash: many universal hash minima, bands, signatures, full sets, and components of links.

A document's set holds the hashes of its distinct shingles of three words. Equal sets are one node, known by a 128-bit
hash, whatever the number of rows that have them. Each node has BANDS * ROWS minima of strongly universal functions
(a x + b) mod 2**64 of its shingles; nodes that agree in all minima of a band share a bucket. Two sets with a Jaccard
similarity of 0.85 miss each other in all bands with a probability of 3e-6, and differ in more than LEAST of the minima of
their signatures with one of 3e-7.

No pairs of a bucket are listed. First each node takes one partner, the least member of a bucket, of the buckets the one
that it meets most often; if the signatures allow it, the full sets decide. Components of these links (large stars and
small stars) settle nearly all buckets. Buckets that still hold members of different components are then searched: the
members outside of the component of the bucket's least one are compared with all others of another component, signature
by signature and then by parity sketch, which bounds the difference of two sets from below, in chunks of CHUNK members. Of
what passes, full sets decide first on as many pairs of a chunk as would make
its components one, the most similar first; then the buckets are searched again, and all pairs that pass and are still of
different components are decided. Two members are compared in the first of the buckets that they share. A hot bucket is a
sum, a join that adaptive execution splits, and its chunks.

Nothing is capped. Null and empty texts have empty sets and are linked with nothing: their component is their own id.
Fewer than three words are one shingle. Texts of any length are one set. Nodes are sets, so repeated rows and ids and
missing ids are fine: a component's id is the least doc_id of its rows, null where none has one. Columns other than id and
text are not looked at. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, discard, partitions
from . import blocks as blocked
from .blocks import expand_ascending, pieces, squeeze_ascending
from .common import batch_of, lean
from .components import components
from .jaccard import folded, shingle_sets, sketch

WORDS = 3
BANDS, ROWS = 40, 8
#: Minima that two signatures share at least to be worth a look at the sets: five standard deviations below 0.85.
LEAST = 240
#: Members of a bucket that are held together.
CHUNK = 1024
#: Shingles whose minima are taken at a time, so that they stay in a core's cache.
_TOGETHER = 1 << 14
_DRAWN = np.random.default_rng(20_250_613).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)


def linked(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Do sets of these sizes that share so many shingles link?"""
    return 100 * shared >= 85 * (a + b - shared)


def may_link(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Can sets of these sizes link at all?"""
    return 100 * np.minimum(a, b) >= 85 * np.maximum(a, b)


def most_apart(a: int, b: int) -> int:
    """Shingles that only one of two linked sets of these sizes has, at most."""
    return a + b + 2 * (-85 * (a + b) // 185)


def differ(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ: no more than there are shingles that only one of the sets has."""
    size = min(a.shape[1], b.shape[1])
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The minima (32 bits) of sets, none of them empty, in rows."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    group = np.cumsum(sizes) // _TOGETHER
    for part in np.split(np.arange(len(sets)), np.flatnonzero(np.diff(group)) + 1):
        if not len(part):
            continue
        x = np.concatenate([sets[i] for i in part.tolist()]) >> np.uint64(32)
        starts = np.cumsum(sizes[part]) - sizes[part]
        h = np.empty_like(x)
        with np.errstate(over="ignore"):
            for k, (a, b) in enumerate(_DRAWN.T):
                np.multiply(x, a, out=h)
                h += b
                out[part, k] = np.minimum.reduceat(h, starts) >> np.uint64(32)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """A 64-bit number for each band's minima, and the band."""
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(m), BANDS)).copy()
        for k in range(ROWS):
            h ^= m[:, k::ROWS]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


# --- rows and their signatures ------------------------------------------------------------------------------------

_MADE = pa.schema([("block", pa.int64()), ("pos", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("bands", pa.binary()), ("signature", pa.binary()), ("sketch", pa.binary())])
_MADE_SQL = "block long, pos int, doc_id long, n long, key binary, bands binary, signature binary, sketch binary"


def _made(table: DataFrame) -> DataFrame:
    """A row for each document: its place, the size and key of its set, and, for the first row of a block that has the
    set, its bands, its signature (the low byte of each minimum) and its parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("blob"), strict=True):
                t = blocked.rows(blob)
                ids, seen = t.column("_id").combine_chunks(), set()
                for begin, part in pieces(t.column("_text").to_pylist()):
                    sets = shingle_sets(part, WORDS)
                    keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                    new = {k: i for i, k in reversed([*enumerate(keys)]) if k and k not in seen}
                    seen.update(new)
                    first = sorted(new.values())
                    m = minima([sets[i] for i in first])
                    bands, low = band_keys(m), m.astype(np.uint8)
                    bands_of = {i: r.tobytes() for i, r in zip(first, bands, strict=True)}
                    low_of = {i: r.tobytes() for i, r in zip(first, low, strict=True)}
                    sketch_of = {i: sketch(sets[i]) for i in first}
                    n = range(len(part))
                    yield batch_of(_MADE, [[block] * len(part), np.arange(begin, begin + len(part), dtype=np.int32), ids.slice(begin, len(part)), [len(s) for s in sets], keys, [bands_of.get(i) for i in n], [low_of.get(i) for i in n], [sketch_of.get(i) for i in n]])

    return table.select("block", "blob").mapInArrow(lean(run), _MADE_SQL)


def _buckets(nodes: DataFrame) -> DataFrame:
    """(band, key): every node in its buckets."""
    schema = pa.schema([("band", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                bands = np.frombuffer(b"".join(part.column("bands").to_pylist()), np.int64)
                yield batch_of(schema, [bands, part.column("key").take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))])

    return nodes.select("key", "bands").mapInArrow(lean(run), "band long, key binary")


# --- full sets ----------------------------------------------------------------------------------------------------


def _sets(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, shingles) of nodes (key, best): read again where their best row lies."""
    schema = pa.schema([("key", pa.binary()), ("shingles", pa.binary())])
    wanted = blocked.gathered(nodes.select("best.block", "best.pos", "key"), "wanted", "pos", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, asked in zip(b.column("blob"), b.column("wanted").to_pylist(), strict=True):
                asked.sort(key=lambda w: w["pos"])
                texts = blocked.rows(blob).column("_text").take(pa.array([w["pos"] for w in asked])).to_pylist()
                for begin, part in pieces(texts, 1 << 20):
                    yield batch_of(schema, [[w["key"] for w in asked[begin : begin + len(part)]], [squeeze_ascending(s) for s in shingle_sets(part, WORDS)]])

    return table.select("block", "blob").join(wanted.hint("shuffle_hash"), "block").select("blob", "wanted").mapInArrow(lean(run), "key binary, shingles binary")


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow a link."""
    side = lambda c: nodes.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("signature").alias(f"of_{c}"))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("of_a", "of_b"))
            ok = ((x == y).sum(1) >= LEAST) & may_link(b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
            if ok.any():
                yield batch_of(schema, [b.column(c).filter(pa.array(ok)) for c in ("a", "b")])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "of_a", "of_b").mapInArrow(lean(run), "a binary, b binary")


def _confirmed(table: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets link."""
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = cut(_sets(table, nodes.select("key", "best").join(wanted, "key")))
    side = lambda c: sets.select(F.col("key").alias(c), F.col("shingles").alias(f"of_{c}"))
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, b_set = None, None
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != now:
                    now, b_set = b, expand_ascending(y)
                x = expand_ascending(x)
                at = np.searchsorted(b_set, x)
                at[at == len(b_set)] = 0
                if linked(int((b_set[at] == x).sum()), len(x), len(b_set)):
                    out.append((a, b))
            if out:
                yield batch_of(schema, [*zip(*out, strict=True)])

    out = cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(lean(run), "u binary, v binary"))
    discard(sets)
    return out


# --- buckets of several components --------------------------------------------------------------------------------


def _rooted(rows: DataFrame, roots: DataFrame, key: str = "key", name: str = "comp") -> DataFrame:
    return rows.join(roots.select(F.col("u").alias(key), F.col("root").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))


_APART = pa.schema([("a", pa.binary()), ("b", pa.binary())])


class _Held:
    """Members of a bucket that are asked: keys, components, sizes, bands, signatures and sketches."""

    def __init__(self, rows: list[tuple], number: dict[bytes, int]) -> None:
        self.minor = np.array([r[0] for r in rows], bool)
        self.keys = [r[1] for r in rows]
        self.comp = np.array([number.setdefault(r[2], len(number)) for r in rows], np.int64)
        self.n = np.array([r[3] for r in rows], np.int64)
        self.bands = np.frombuffer(b"".join(r[4] for r in rows), np.int64).reshape(-1, BANDS)
        self.signatures = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(-1, BANDS * ROWS)
        self.sketches = [np.frombuffer(r[6], np.uint64)[None] for r in rows]
        self.high = np.array([int.from_bytes(k[:8], "big") for k in self.keys], np.uint64)

    def partners(self, other: _Held, k: int, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Members that may link with member k of `other`, which is of another component; how many minima they share. Of
        the buckets that two members share the first one counts; two members outside of the main component ask each other,
        and the greater key's question counts."""
        at = np.flatnonzero((self.comp != other.comp[k]) & (~self.minor | (self.high <= other.high[k])) & may_link(self.n, other.n[k]))
        at = at[other.bands[k][(self.bands[at] == other.bands[k]).argmax(1)] == band]
        same = (self.signatures[at] == other.signatures[k]).sum(1)
        ok = same >= LEAST
        at, same = at[ok], same[ok]
        ok = np.fromiter((differ(self.sketches[i], other.sketches[k]) <= most_apart(int(self.n[i]), int(other.n[k])) for i in at.tolist()), bool, len(at))
        return at[ok], same[ok]


def _apart(members: DataFrame, nodes: DataFrame, roots: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and whose signatures and sizes allow a link. forest: of a
    bucket's chunk only as many as would make its components one, the most similar ones first."""
    rooted = cut(_rooted(members, roots))
    mixed = rooted.groupBy("band").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.max(F.when(F.col("key") == F.col("centre"), F.col("comp"))).alias("main")).filter("least <> most")
    rows = rooted.join(mixed.select("band", "main"), "band").join(nodes.select("key", "n", "bands", "signature", "sketch"), "key")
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("key"), chunks).cast("int")
    minor = F.col("comp") != F.col("main")
    columns = ("key", "comp", "n", "bands", "signature", "sketch")
    held = rows.select("band", own.alias("chunk"), F.lit(0).alias("kind"), minor.alias("minor"), *columns)
    asking = rows.filter(minor).select("band", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(1).alias("kind"), F.lit(True).alias("minor"), *columns)

    def search(band: int, own: list[tuple], asked: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        members = _Held(own, number)
        joined: dict[int, int] = {}

        def top(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        for rows in asked:
            others = _Held(rows, number)
            met = [members.partners(others, k, band) for k in range(len(rows))]
            for least in range(LEAST + LEAST // 5, LEAST - 1, -LEAST // 20) if forest else (LEAST,):
                out = []
                for k, key in enumerate(others.keys):
                    at, same = met[k]
                    for i in at[np.argsort(-same, kind="stable")][: int((same >= least).sum())].tolist():
                        if forest:
                            x, y = top(int(members.comp[i])), top(int(others.comp[k]))
                            if x == y:
                                continue
                            joined[x] = y
                        out.append((min(key, members.keys[i]), max(key, members.keys[i])))
                if out:
                    yield batch_of(_APART, [*zip(*out, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((x[:2], x[2], x[3:]) for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(10)), strict=True))
        row = next(rows, None)
        while row is not None:
            now, own = row[0], []
            while row is not None and row[0] == now and row[1] == 0:
                own.append(row[2])
                row = next(rows, None)

            def asked() -> Iterator[list[tuple]]:
                nonlocal row
                while row is not None and row[0] == now:  # noqa: B023
                    some = []
                    while row is not None and row[0] == now and len(some) < CHUNK:  # noqa: B023
                        some.append(row[2])
                        row = next(rows, None)
                    yield some

            yield from search(now[0], own, asked())

    dealt = held.unionByName(asking).repartition(partitions(nodes.sparkSession), "band", "chunk").sortWithinPartitions("band", "chunk", "kind")
    out = cut(dealt.mapInArrow(lean(run), "a binary, b binary"))
    discard(rooted)
    return out


class _Linked:
    """blocks: the rows; base: (block, pos, doc_id, n, key) of every row; nodes: (key, comp, least, best) of every set,
    where best is the place of a row that has it: of those with the least id the first."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, rest: bool) -> None:
        self.blocks = table = blocked.store(docs, text_col, rest, id=(id_col, "long"))
        made = cut(_made(table))
        self.base = made.select("block", "pos", "doc_id", "n", "key")
        place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "block", "pos")
        own = made.filter("key is not null").groupBy("key")
        nodes = cut(own.agg(F.min("doc_id").alias("least"), F.min(place).alias("best"), F.first("n").alias("n"), F.max("bands").alias("bands"), F.max("signature").alias("signature"), F.max("sketch").alias("sketch")))
        buckets = _buckets(nodes)
        shared = buckets.groupBy("band").agg(F.min("key").alias("centre"), F.count("*").alias("members")).filter("members > 1")
        members = cut(buckets.join(shared, "band"))
        # one partner for each node: of the centres of its buckets the one of most of them
        often = members.filter("key <> centre").groupBy("key", "centre").agg(F.count("*").alias("times"))
        stars = often.groupBy("key").agg(F.max_by("centre", F.struct("times", "centre")).alias("b")).withColumnRenamed("key", "a")
        links = _confirmed(table, nodes, cut(_alike(stars, nodes)))
        roots = components(links)
        # then links that make components one, and last whatever is still apart and may link
        some = _apart(members, nodes, roots, True)
        if not some.isEmpty():
            links = cut(links.unionByName(_confirmed(table, nodes, some)))
            roots = components(links)
            rest_ = cut(_apart(members, nodes, roots, False).join(some, ["a", "b"], "left_anti"))
            if not rest_.isEmpty():
                more = _confirmed(table, nodes, rest_)
                if not more.isEmpty():
                    roots = components(links.unionByName(more))
            discard(rest_)
        discard(members, some)
        self.nodes = cut(_rooted(nodes.select("key", "least", "best"), roots))
        discard(nodes)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; kept: its id is its component's, or both have none."""
    found = _Linked(docs, id_col, text_col, False)
    ids = found.nodes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = found.nodes.join(ids, "comp").select("key", "component_id")
    has = found.base.filter("key is not null").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = found.base.filter("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return has.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each component: of those with the least id the first in the order of blocks; rows with an
    empty set stay."""
    found = _Linked(docs, id_col, text_col, True)
    best = found.nodes.groupBy("comp").agg(F.min("best").alias("best")).select("best.block", "best.pos")
    return blocked.taken(found.blocks, best.unionByName(found.base.filter("key is null").select("block", "pos")), docs, text_col)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN ['short ' || array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
link AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM s
  UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = s.doc_id
"""
