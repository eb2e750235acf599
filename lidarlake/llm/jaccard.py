"""N-gram Jaccard join by T-occurrence search.

A document's set holds the hashes of its distinct shingles of five words. Equal sets are one node. Two sets of sizes a
and b have a Jaccard similarity of 0.75 or more exactly if they share T = ceil(3 (a + b) / 7) shingles.

Rows lie in blocks, and a row is known by its place in them, so that rows without an id and rows that share one are like
all others. Blocks ask shards how many sets hold each of their shingles; shards answer with the doublings of that number.
It is the order in which a set's rare shingles come first, and tells which shingles no other set has.

Candidates come from prefix lists, losslessly: two linked sets share a shingle within the first a - ceil(3 a / 4) + 1 of
the larger and the first b - ceil(6 b / 7) + 1 of the smaller; shingles of one set only need no list. Each list links its
members to its least one (a star, not all pairs). Components of these settle most lists; in those that still hold members
of different components, pairs across components are compared where the list is. Every candidate pair has to pass the
bounds of sizes and positions and a bound by parity sketches: each shingle flips one bit of its set's sketch, so sketches
differ in no more bits than the sets do in shingles. No link is lost by any of these.

Components of the candidate pairs are groups that hold every link. Their sets, and no others, are sent once to the
group's chunks, where each is searched by DivideSkip: the inverted lists of a chunk's members are indexed once; a query's
short lists are merged by a heap, its long ones are probed by binary search, and those that occur T times or more stay.
All links are found there, and so the number of links of each document and the components. A set of a group of k chunks
travels k times.

Nothing is capped: df, lists, groups and searches take all rows. Null and empty texts have empty sets and link with
nothing; their component is their own id. Fewer than five words are one shingle. Texts of any length are one set.
Repeated rows and ids are fine: nodes are sets; a component's id is the least doc_id of its rows, null where none has
one. Columns other than id and text are not looked at. Empty tables stay empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, discard, partitions
from . import blocks as blocked
from . import tokens64
from .blocks import expand, expand_ascending, pieces, range_shard, squeeze, squeeze_ascending
from .common import batch_of, lean
from .components import components

WORDS = 5
#: Bits of a shingle's hash by which sets are counted; more sets than there are only make lists longer.
BITS = 48
#: Text bytes that a shard counts shingles of.
SHARD_BYTES = 16 << 20
#: Shingles of the members of one chunk of a group.
CHUNK = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)


def need(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """Shared shingles that sets of these sizes need to link."""
    return -(-3 * (a + b) // 7)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sets of shingle hashes of texts, ascending."""
    codes, counts = tokens64.words(texts, lower=True)
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(codes) - words + 1), np.uint64)
        for k in range(words):
            h = (h ^ codes[k : k + len(h)]) * _P
            h ^= h >> np.uint64(31)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            s = np.sort(h[at : at + n - words + 1])
            out.append(s[tokens64.firsts(s)])
        else:  # the whole sequence as one, apart from shingles
            out.append(np.array([xxhash.xxh3_64_intdigest(codes[at : at + n].tobytes(), seed=n)] if n else [], np.uint64))
        at += n
    return out


class _Block:
    """A block's rows, their keys (none for an empty set), and its distinct sets with the rows that hold them first."""

    def __init__(self, blob) -> None:
        t = blocked.rows(blob)
        self.ids, self.texts = t.column("_id").to_pylist(), t.column("_text").to_pylist()
        self.keys: list[bytes | None] = []
        self.sizes: list[int] = []
        self.sets: dict[bytes, np.ndarray] = {}
        self.first: dict[bytes, int] = {}
        for begin, part in pieces(self.texts):
            for i, s in enumerate(shingle_sets(part), begin):
                k = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                self.keys.append(k)
                self.sizes.append(len(s))
                if k and k not in self.sets:
                    self.sets[k], self.first[k] = s, i

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct shingles' counted bits, ascending, how many of the block's distinct sets hold each, and where each
        shingle of these sets stands."""
        every = np.concatenate([np.zeros(0, np.uint64), *self.sets.values()]) >> np.uint64(64 - BITS) << np.uint64(64 - BITS)
        g, _, n, back = tokens64.places(every)
        return g >> np.uint64(64 - BITS), n, back


# --- how many sets hold a shingle ---------------------------------------------------------------------------------

_ASK = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("levels", pa.binary())])


def _levels(table: DataFrame, shards: int) -> DataFrame:
    """(block, answers): for each block and shard, the doublings of the number of sets that hold each shingle."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("blob"), strict=True):
                g, n, _ = _Block(blob).distinct()
                at = np.searchsorted(range_shard(g, shards, BITS), np.arange(shards + 1))
                n = n.astype(np.uint32)
                out = [(s, block, squeeze_ascending(g[i:j]), squeeze(n[i:j])) for s, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if i < j]
                if out:
                    yield batch_of(_ASK, [*zip(*out, strict=True)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            keys = [expand_ascending(k) for _, k, _ in held]
            sizes = np.fromiter(map(len, keys), np.int64, len(keys))
            _, _, _, back = tokens64.places(np.concatenate(keys) << np.uint64(64 - BITS))
            back = back.astype(np.int32)
            keys.clear()
            times = np.bincount(back, np.concatenate([expand(n, np.uint32) for _, _, n in held]))
            levels = np.frexp(times)[1].astype(np.uint8) - np.uint8(1)
            parts = np.split(levels[back], np.cumsum(sizes)[:-1])
            return batch_of(_ANSWER, [[block for block, _, _ in held], [now] * len(held), [squeeze(p) for p in parts]])

        for b in batches:
            for shard, *row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if shard != now and held:
                    yield out()
                    held = []
                now = shard
                held.append(row)
        if held:
            yield out()

    asked = table.select("block", "blob").mapInArrow(lean(ask), "shard int, block long, keys binary, counts binary")
    dealt = asked.repartition(partitions(table.sparkSession), "shard").sortWithinPartitions("shard")
    answers = dealt.mapInArrow(lean(count), "block long, shard int, levels binary")
    return blocked.gathered(answers, "answers", "shard", "levels")


# --- sketches -----------------------------------------------------------------------------------------------------


def sketch(s: np.ndarray) -> bytes:
    """Parity of the set's shingles by bit; the bits are a power of two, two for each shingle at least."""
    m = max(64, 1 << int(2 * len(s) - 1).bit_length())
    bit = (s * _P) >> np.uint64(64 - m.bit_length() + 1)
    odd = np.bincount(bit.astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def folded(a: np.ndarray, size: int) -> np.ndarray:
    """Sketches (in rows, as 64-bit words) as they were with fewer bits: a bit of the lesser sketch is the parity of those
    of the greater one that share its high bits."""
    while a.shape[1] > size:
        bits = np.unpackbits(a.view(np.uint8), axis=1)
        bits = bits[:, ::2] ^ bits[:, 1::2]
        a = np.packbits(bits, axis=1).view(np.uint64)
    return a


def may_link(a: bytes, na: int, b: bytes, nb: int) -> bool:
    x, y = np.frombuffer(a, np.uint64)[None], np.frombuffer(b, np.uint64)[None]
    size = min(x.shape[1], y.shape[1])
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= na + nb - 2 * need(na, nb)


# --- prefix lists -------------------------------------------------------------------------------------------------

_MADE = pa.schema(
    [("block", pa.int64()), ("pos", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sketch", pa.binary()), ("empty", pa.int64())]
    + [("shard", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary()), ("docs", pa.binary()), ("at", pa.binary())]
)
_MADE_SQL = "block long, pos int, doc_id long, n long, key binary, sketch binary, empty long, shard int, keys binary, sizes binary, hashes binary, docs binary, at binary"


def _made(table: DataFrame, levels: DataFrame, shards: int) -> DataFrame:
    """A row for each document: its place, the size and key of its set, a hash of its text where that is empty, and the
    sketch of a set that has prefix entries. And rows of prefix entries by shard: the sets' keys, sizes and mean levels,
    then (hash, set, position)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob, got in zip(b.column("block").to_pylist(), b.column("blob"), b.column("answers").to_pylist(), strict=True):
                held = _Block(blob)
                _, _, back = held.distinct()
                level = np.concatenate([np.zeros(0, np.uint8), *(expand(a["levels"], np.uint8) for a in sorted(got or (), key=lambda a: a["shard"]))])
                level, begin = level[back], 0
                heads, places, names, sizes, means, sketches = [], [], [], [], [], {}
                for k, s in held.sets.items():
                    own = level[begin : begin + len(s)]
                    begin += len(s)
                    by = np.argsort(own, kind="stable")[: len(s) - -(-3 * len(s) // 4) + 1]
                    shared = np.flatnonzero(own[by])
                    if len(shared):
                        heads.append(s[by[shared]])
                        places.append(shared)
                        names.append(k)
                        sizes.append(len(s))
                        means.append(min(255, int(16 * own.mean())))
                        sketches[held.first[k]] = sketch(s)
                n = len(held.keys)
                hash_of = [None if k else xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass") if t is not None else b"", seed=t is None) >> 1 for k, t in zip(held.keys, held.texts, strict=True)]
                none = [pa.nulls(n, f.type) for f in list(_MADE)[7:]]
                yield batch_of(_MADE, [np.full(n, block), np.arange(n, dtype=np.int32), held.ids, held.sizes, held.keys, [sketches.get(i) for i in range(n)], hash_of, *none])
                if names:
                    yield entries(heads, places, names, sizes, means)

    def entries(heads: list, places: list, names: list, sizes: list, means: list) -> pa.RecordBatch:
        h, at = np.concatenate(heads), np.concatenate(places)
        docs = np.repeat(np.arange(len(heads)), [len(x) for x in heads])
        by = np.argsort(h, kind="stable")
        cuts = np.searchsorted(range_shard(h[by], shards, 64), np.arange(shards + 1))
        keys = np.frombuffer(b"".join(names), "V16")
        packed = np.array(sizes, np.uint64) | np.array(means, np.uint64) << np.uint64(56)
        out = []
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            part = by[cuts[s] : cuts[s + 1]]
            own, back = np.unique(docs[part], return_inverse=True)
            out.append((s, keys[own].tobytes(), squeeze(packed[own]), squeeze_ascending(h[part]), squeeze(back.astype(np.uint16)), squeeze(at[part].astype(np.uint32))))
        return batch_of(_MADE, [pa.nulls(len(out), f.type) for f in list(_MADE)[:7]] + [*zip(*out, strict=True)])

    return table.select("block", "blob").join(blocked.dealt(levels).hint("shuffle_hash"), "block", "left").select("block", "blob", "answers").mapInArrow(lean(run), _MADE_SQL)


def _compatible(na: np.ndarray, ia: np.ndarray, nb: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """May sets of sizes na, nb link if the first shingle they share is at positions ia, ib of their orders?"""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    at_small = np.where(na < nb, ia, np.where(na > nb, ib, np.minimum(ia, ib)))
    indexed = at_small < small - -(-6 * small // 7) + 1
    return indexed & (4 * small >= 3 * large) & (1 + np.minimum(na - ia - 1, nb - ib - 1) >= need(na, nb))


_FOUND = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("shard", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("lists", pa.binary()), ("docs", pa.binary()), ("at", pa.binary())])
_FOUND_SQL = "a binary, b binary, shard int, keys binary, sizes binary, lists binary, docs binary, at binary"


def _lists(entries: DataFrame) -> DataFrame:
    """Of each shard: star pairs (a, b), and one row with its lists of three or more members."""

    def shard_rows(shard: int, held: list) -> Iterator[pa.RecordBatch]:
        place: dict[bytes, int] = {}
        sizes: list[int] = []
        h, d, at = [], [], []
        for keys, n, hashes, docs, pos in held:
            local, n = [], expand(n, np.uint64).tolist()
            for i, k in enumerate(keys[j : j + 16] for j in range(0, len(keys), 16)):
                if k not in place:
                    place[k] = len(place)
                    sizes.append(n[i])
                local.append(place[k])
            h.append(expand_ascending(hashes))
            d.append(np.array(local, np.int64)[expand(docs, np.uint16)])
            at.append(expand(pos, np.uint32).astype(np.int64))
        names, packed = list(place), np.array(sizes, np.uint64)
        n, often = (packed & np.uint64((1 << 56) - 1)).astype(np.int64), (packed >> np.uint64(56)).astype(np.int64)
        # The centre of a list's star is the set whose shingles most sets hold: of a group of edited copies the one with
        # fewest edits. Then keys decide, so that the stars of many lists have one centre.
        both = np.array(names, "V16").view([("hi", ">u8"), ("lo", ">u8")])
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort((both["lo"], both["hi"], -often))] = np.arange(len(names))
        h, d, at = map(np.concatenate, (h, d, at))
        by = np.lexsort((rank[d], h))
        h, d, at = h[by], d[by], at[by]
        once = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
        h, d, at = h[once], d[once], at[once]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        counts = np.diff(np.append(starts, len(h)))
        centre = np.repeat(starts, counts)
        member = np.arange(len(h)) != centre
        a, b = centre[member], np.flatnonzero(member)
        ok = _compatible(n[d[a]], at[a], n[d[b]], at[b])
        pairs = np.unique(np.stack((d[a[ok]], d[b[ok]]), 1), axis=0)
        for k in range(0, len(pairs), 20_000):
            part = pairs[k : k + 20_000].tolist()
            none = pa.nulls(len(part), pa.binary())
            yield batch_of(_FOUND, [[min(names[x], names[y]) for x, y in part], [max(names[x], names[y]) for x, y in part], pa.nulls(len(part), pa.int32()), none, none, none, none, none])
        many = np.repeat(counts >= 3, counts)
        if many.any():
            own, back = np.unique(d[many], return_inverse=True)
            lists = np.repeat(np.arange(len(counts)), counts)[many]
            yield batch_of(_FOUND, [[None], [None], [shard], [b"".join(names[i] for i in own)], [squeeze(n[own])], [squeeze(lists.astype(np.uint32))], [squeeze(back.astype(np.uint32))], [squeeze(at[many].astype(np.uint32))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for shard, *row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if shard != now and held:
                    yield from shard_rows(now, held)
                    held = []
                now = shard
                held.append(row)
        if held:
            yield from shard_rows(now, held)

    return entries.repartition(partitions(entries.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(lean(run), _FOUND_SQL)


_KEYED = pa.schema([("shard", pa.int32()), ("i", pa.int32()), ("key", pa.binary())])


def _members(held: DataFrame) -> DataFrame:
    """(shard, i, key) of the members of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, k in zip(b.column("shard").to_pylist(), b.column("keys").to_pylist(), strict=True):
                n = len(k) // 16
                for at in range(0, n, 10_000):
                    part = range(at, min(n, at + 10_000))
                    yield batch_of(_KEYED, [[shard] * len(part), list(part), [k[16 * i : 16 * i + 16] for i in part]])

    return held.select("shard", "keys").mapInArrow(lean(run), "shard int, i int, key binary")


_LIST_COLUMNS = ("keys", "sizes", "lists", "docs", "at")
_LISTS = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in _LIST_COLUMNS), ("comps", pa.binary())])
_LISTS_SQL = "shard int, keys binary, sizes binary, lists binary, docs binary, at binary, comps binary"


def _beside(known: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows (shard, i, value) of known before the lists of their shard."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    own = [c for c in lists.columns if c != "shard"]
    both = known.select("shard", F.lit(0).alias("kind"), "i", "value", *(none(c, "binary") for c in own)).unionByName(lists.select("shard", F.lit(1).alias("kind"), none("i", "int"), none("value", "binary"), *own))
    return both.repartition(partitions(lists.sparkSession), "shard").sortWithinPartitions("shard", "kind").select("shard", "i", "value", *own)


def _mixed(found: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists that hold sets of different components, with the components as numbers."""
    held = found.filter("shard is not null")
    known = _members(held).join(roots.select(F.col("u").alias("key"), F.col("root").alias("value")), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of = None, {}
        for b in batches:
            for shard, i, root, *row in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                if shard != now:
                    now, of = shard, {}
                if i is not None:
                    of[i] = root
                    continue
                keys, n, lists, d, at = row[0], *(expand(x, np.uint64 if k == 0 else np.uint32).astype(np.int64) for k, x in enumerate(row[1:]))
                number: dict[bytes, int] = {}
                comp = np.array([number.setdefault(of.get(k, keys[16 * k : 16 * k + 16]), len(number)) for k in range(len(keys) // 16)], np.int64)
                starts = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
                counts = np.diff(np.append(starts, len(lists)))
                mixed = np.repeat(np.minimum.reduceat(comp[d], starts) != np.maximum.reduceat(comp[d], starts), counts)
                if mixed.any():
                    own, back = np.unique(d[mixed], return_inverse=True)
                    names = np.frombuffer(keys, "V16")[own].tobytes()
                    yield batch_of(_LISTS, [[shard], [names], [squeeze(n[own])], [squeeze(lists[mixed].astype(np.uint32))], [squeeze(back.astype(np.uint32))], [squeeze(at[mixed].astype(np.uint32))], [squeeze(comp[own].astype(np.uint32))]])

    return _beside(known, held.select("shard", *_LIST_COLUMNS)).mapInArrow(lean(run), _LISTS_SQL)


_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _across(mixed: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) across components from mixed lists that pass all bounds; they are compared where the list is."""
    known = _members(mixed).join(sketches.select("key", F.col("sketch").alias("value")), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of = None, {}
        for b in batches:
            for shard, i, value, *row in zip(*(b.column(k).to_pylist() for k in range(9)), strict=True):
                if shard != now:
                    now, of = shard, {}
                if i is not None:
                    of[i] = value
                    continue
                keys, n, lists, d, at, comp = row[0], *(expand(x, np.uint64 if k == 0 else np.uint32).astype(np.int64) for k, x in enumerate(row[1:]))
                names = [keys[j : j + 16] for j in range(0, len(keys), 16)]
                seen: set[tuple[int, int]] = set()
                for part in np.split(np.arange(len(lists)), np.flatnonzero(np.diff(lists)) + 1):
                    m, p = d[part], at[part]
                    own = comp[m]
                    # every pair across components has a member outside the list's largest one
                    for k in np.flatnonzero(own != np.bincount(own).argmax()).tolist():
                        for x in m[np.flatnonzero((own != own[k]) & _compatible(n[m[k]], p[k], n[m], p))].tolist():
                            pair = (min(x, int(m[k])), max(x, int(m[k])))
                            if pair not in seen and may_link(of[pair[0]], int(n[pair[0]]), of[pair[1]], int(n[pair[1]])):
                                seen.add(pair)
                if seen:
                    yield batch_of(_PAIR, [[min(names[x], names[y]) for x, y in seen], [max(names[x], names[y]) for x, y in seen]])

    return _beside(known, mixed).mapInArrow(lean(run), "a binary, b binary")


def _passing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sketches allow a link."""
    side = lambda c: sketches.select(F.col("key").alias(c), F.col("sketch").alias(f"{c}_sketch"), F.col("n").alias(f"{c}_n"))
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [(u, v) for u, v, x, nx, y, ny in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True) if may_link(x, nx, y, ny)]
            if ok:
                yield batch_of(schema, [*zip(*ok, strict=True)])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_sketch", "a_n", "b_sketch", "b_n").mapInArrow(lean(run), "u binary, v binary")


# --- verification -------------------------------------------------------------------------------------------------


class Index:
    """Inverted lists of some sets, made once and searched by many."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        values = np.concatenate([np.zeros(0, np.uint64), *sets])
        by = np.argsort(values, kind="stable")  # members stay ascending inside a list
        values, self.members = values[by], np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[by]
        starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))[: len(values)]
        self.values, self.starts = values[starts], np.append(starts, len(values))

    def _all(self, lists: np.ndarray) -> np.ndarray:
        """The members of some lists, one list after the other."""
        begin, end = self.starts[lists], self.starts[lists + 1]
        n = end - begin
        return self.members[np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)]

    def search(self, query: np.ndarray) -> np.ndarray:
        """Which sets share enough shingles with the query, by DivideSkip."""
        if not len(self.values) or not len(query):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, query), len(self.values) - 1)
        lists = at[self.values[at] == query]
        least = need(len(query), self.sizes)
        t = int(least.min())
        if len(lists) < t:
            return np.zeros(0, np.int64)
        size = self.starts[lists + 1] - self.starts[lists]
        lists = lists[np.argsort(size, kind="stable")]
        n_long = min(t - 1, int(t / (0.0085 * np.log2(max(2, size.max())) + 1)))
        short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        merged = self._all(short)
        if len(merged) <= 256:
            cuts = np.cumsum(self.starts[short + 1] - self.starts[short])[:-1]
            merged = np.fromiter(heapq.merge(*(x.tolist() for x in np.split(merged, cuts))), np.int64, len(merged))
        else:  # the same by a merge sort of the lists' runs
            merged = np.sort(merged, kind="stable").astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        found, n = merged[first], np.diff(np.append(first, len(merged)))
        ok = n >= least[found] - n_long
        found, n = found[ok], n[ok]
        if not len(found) or not n_long:
            return found[n >= least[found]]
        total = int((self.starts[long_ + 1] - self.starts[long_]).sum())
        if len(found) * np.log2(2 + total / n_long) * 8 >= total:  # so many are left that the lists are read as they are
            n = n + np.bincount(self._all(long_), minlength=len(self.sizes))[found]
            return found[n >= least[found]]
        for left, x in enumerate(long_.tolist()):
            own = self.members[self.starts[x] : self.starts[x + 1]]
            k = np.minimum(np.searchsorted(own, found), len(own) - 1)
            n = n + (own[k] == found)
            ok = n + (n_long - 1 - left) >= least[found]
            if not ok.all():
                found, n = found[ok], n[ok]
                if not len(found):
                    break
        return found


def divide_skip(query: np.ndarray, candidates: list[np.ndarray]) -> list[int]:
    """Which candidate sets share enough shingles with the query."""
    return Index(candidates).search(query).tolist()


_SENT = pa.schema([("root", pa.binary()), ("salt", pa.int32()), ("kind", pa.int32()), ("key", pa.binary()), ("hashes", pa.binary()), ("times", pa.int64())])
_LINK = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("n", pa.int64())])


def _links(table: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (u, v, null) whose components are those of all links, and (u, null, n): the links that a set has in a chunk."""
    placed = nodes.join(groups.withColumnRenamed("u", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    many = placed.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("weight")).filter("members > 1")
    dealt = placed.join(many, "root").select("best.block", "best.pos", "key", "root", "times", F.ceil(F.col("weight") / CHUNK).cast("int").alias("chunks"))
    wanted = blocked.gathered(dealt, "wanted", "pos", "key", "root", "times", "chunks")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, asked in zip(b.column("blob"), b.column("wanted").to_pylist(), strict=True):
                texts = blocked.rows(blob).column("_text")
                asked.sort(key=lambda w: w["pos"])
                own = texts.take(pa.array([w["pos"] for w in asked])).to_pylist()
                out, size = [], 0
                for begin, part in pieces(own):
                    for w, s in zip(asked[begin:], shingle_sets(part), strict=False):
                        home = int.from_bytes(w["key"][:4], "little") % w["chunks"]
                        hashes = s.tobytes()
                        for k in range(w["chunks"]):
                            out.append((w["root"], k, int(k != home), w["key"], hashes, w["times"]))
                            size += len(hashes)
                            if size > 8 << 20:
                                yield batch_of(_SENT, [*zip(*out, strict=True)])
                                out, size = [], 0
                if out:
                    yield batch_of(_SENT, [*zip(*out, strict=True)])

    def chunk(names: list, sets: list, times: list, others: Iterator) -> Iterator[pa.RecordBatch]:
        index, weight = Index(sets), np.array(times, np.int64)
        comp = np.arange(len(sets))
        counts = []
        for i, s in enumerate(sets):
            found = index.search(s)
            counts.append(int(weight[found].sum() - weight[i]))
            own = comp[found]
            if (own != own[0]).any():
                comp[np.isin(comp, own)] = own.min()
        edge = np.flatnonzero(comp != np.arange(len(sets))).tolist()
        if edge:
            yield batch_of(_LINK, [[names[i] for i in edge], [names[comp[i]] for i in edge], pa.nulls(len(edge), pa.int64())])
        yield batch_of(_LINK, [names, pa.nulls(len(names), pa.binary()), counts])
        us, vs, ns = [], [], []
        for key, s in others:
            if len(found := index.search(s)):
                own = np.unique(comp[found]).tolist()
                us += [key] * (len(own) + 1)
                vs += [*(names[c] for c in own), None]
                ns += [*([None] * len(own)), int(weight[found].sum())]
                if len(us) > 10_000:
                    yield batch_of(_LINK, [us, vs, ns])
                    us, vs, ns = [], [], []
        if us:
            yield batch_of(_LINK, [us, vs, ns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((x[:2], *x[2:]) for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True))
        row = next(rows, None)
        while row is not None:
            now, names, sets, times = row[0], [], [], []
            while row is not None and row[0] == now and row[1] == 0:
                names.append(row[2])
                sets.append(np.frombuffer(row[3], np.uint64))
                times.append(row[4])
                row = next(rows, None)

            def others() -> Iterator[tuple[bytes, np.ndarray]]:
                nonlocal row
                while row is not None and row[0] == now:  # noqa: B023
                    yield row[2], np.frombuffer(row[3], np.uint64)
                    row = next(rows, None)

            if names:
                yield from chunk(names, sets, times, others())
            else:  # a chunk without members
                for _ in others():
                    pass

    sent = table.select("block", "blob").join(wanted.hint("shuffle_hash"), "block").select("blob", "wanted").mapInArrow(lean(send), "root binary, salt int, kind int, key binary, hashes binary, times long")
    return sent.repartition(partitions(table.sparkSession), "root", "salt").sortWithinPartitions("root", "salt", "kind").mapInArrow(lean(run), "u binary, v binary, n long")


class _Linked:
    """blocks: the rows; base: (block, pos, doc_id, n, key, empty) of every row; nodes: (key, root, least, times, best,
    n_links) of every set, where best is the place of a row that has the set: of those with the least id the first."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, rest: bool) -> None:
        self.blocks = table = blocked.store(docs, text_col, rest, id=(id_col, "long"))
        shards = blocked.shards_for(table, SHARD_BYTES)
        levels = cut(_levels(table, shards))
        made = cut(_made(table, levels, shards))
        discard(levels)
        self.base = base = made.filter("shard is null").select("block", "pos", "doc_id", "n", "key", "empty")
        own = made.filter("shard is null and key is not null").groupBy("key")
        place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "block", "pos")
        nodes = cut(own.agg(F.min("doc_id").alias("least"), F.count("*").alias("times"), F.min(place).alias("best"), F.first("n").alias("n"), F.max("sketch").alias("sketch")))
        sketches = nodes.filter("sketch is not null").select("key", "n", "sketch")
        found = cut(_lists(made.filter("shard is not null").select("shard", "keys", "sizes", "hashes", "docs", "at")))
        pairs = cut(_passing(found.filter("shard is null").select("a", "b").distinct(), sketches))
        roots = components(pairs)
        mixed = cut(_mixed(found, roots))
        if not mixed.isEmpty():
            more = _across(mixed, sketches).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
            roots = components(pairs.unionByName(more))
        links = cut(_links(table, nodes, roots))
        discard(found, mixed, pairs)
        exact = components(links.filter("v is not null").select("u", "v"))
        counts = links.filter("v is null").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("links"))
        rooted = nodes.join(exact.withColumnRenamed("u", "key"), "key", "left").join(counts, "key", "left")
        self.nodes = cut(rooted.select("key", F.coalesce("root", "key").alias("root"), "least", "best", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row: n_links counts the other rows whose sets link with its
    own."""
    found = _Linked(docs, id_col, text_col, False)
    ids = found.nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = found.nodes.join(ids, "root").select("key", "component_id", "n_links")
    has = found.base.filter("key is not null").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    none = found.base.filter("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return has.unionByName(none)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each component: the one with the least id, if any has one. Rows with an empty set stay,
    but for repeated ones (of the same id and text)."""
    found = _Linked(docs, id_col, text_col, True)
    best = found.nodes.groupBy("root").agg(F.min("best").alias("best")).select("best.block", "best.pos")
    empty = found.base.filter("key is null")
    once = empty.filter("doc_id is not null").groupBy("doc_id", "empty").agg(F.min(F.struct("block", "pos")).alias("best")).select("best.block", "best.pos")
    places = best.unionByName(once).unionByName(empty.filter("doc_id is null").select("block", "pos"))
    return blocked.taken(found.blocks, places, docs, text_col)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN ['short ' || array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
often AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
r AS (SELECT e.* FROM e JOIN often USING (x)),
link AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM r a JOIN r b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 175 * count(*) >= 75 * (a.n + b.n)),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM s
  UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = s.doc_id
"""

#: The same with the number of other documents that a document links with.
ORACLE_LINKS = f"""SELECT c.*, coalesce(d.n_links, 0) AS n_links FROM ({ORACLE}) c LEFT JOIN (
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN ['short ' || array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
link AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 175 * count(*) >= 75 * (a.n + b.n))
SELECT u, count(*) AS n_links FROM link GROUP BY u) d ON d.u = c.doc_id
"""
