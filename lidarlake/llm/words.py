"""The word part of the quality classifier: interpolated modified Kneser-Ney over word trigrams of trusted text.

What it gathers grows with the corpus: all distinct word trigrams of training text, without a cap. A word that is rare or
unknown backs off to the byte model's probability of its bytes. Everything about a bigram lives where its hash does: the
words seen before it (with counts: its trigrams, and its continuation count) and the words seen after it (its weight as a
context). Blocks ask for their bigrams and the words before them, telling how often training text holds each and what
follows there; shards answer with whole numbers. Ranges of the hash are worked off one after the other (PASSES), so that
only one range's requests are on disk at a time; every range covers all documents. Of each trained bigram the first block
that holds it gives its continuation count to its two words, which live in shards of words in the same way. Blocks then
have all numbers of their n-grams and compute probabilities; nothing of the model is broadcast but its discounts.

Hashes: words and bigrams are known by BITS bits, a word beside a bigram by NEAR bits. Those that share a hash share their
counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import partitions, tidy
from . import blocks as blocked
from . import tokens64
from .blocks import expand, expand_ascending, expand_counts, pieces, range_shard, squeeze, squeeze_ascending, squeeze_counts
from .common import batch_of, lean

#: Bytes of a passage, and between the beginnings of two passages of a text.
PASSAGE, STEP = 512, 64
BITS, NEAR = 48, 32
PASSES = 5


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a + np.uint64(0xA0761D6478BD642F)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h ^= b
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
    return h


def bigram(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _mix(b, c) >> np.uint64(64 - BITS)


def near(w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (w * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - NEAR)


#: The context of a text's first word.
START = bigram(np.zeros(1, np.uint64), np.zeros(1, np.uint64))[0]


class Tokens:
    """A block's words c with the two before them, b and (if deep) a, 0 before a text, as hashes of BITS bits that are not
    0; the bigrams `own` of b and c; the words of each text."""

    def __init__(self, texts: list[str | None], deep: bool = True) -> None:
        parts = [tokens64.words(part) for _, part in pieces(texts)]
        none = np.zeros(0, np.uint64)
        self.c = np.concatenate([none, *(h for h, _ in parts)]) >> np.uint64(64 - BITS) | np.uint64(1)
        self.counts = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
        starts = (np.cumsum(self.counts) - self.counts)[self.counts > 0]
        self.first = np.zeros(len(self.c), bool)
        self.first[starts] = True
        b = self._before(self.c)
        if deep:
            self.a = self._before(b)
        self.own = bigram(b, self.c)

    def _before(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        out[1:] = x[:-1]
        out[self.first] = 0
        return out

    def contexts(self) -> np.ndarray:
        """The bigrams of a and b: those of the words before."""
        out = self._before(self.own)
        out[self.first] = START
        return out


class Asked:
    """What a block's texts ask for in a range of bigrams.

    keys: bigrams, ascending; before: (bigram's place, word before, trained count) in this order; after: (bigram's place,
    word after, count) of training text. place: where each of the block's words has its bigram among the keys, trigram:
    where its trigram stands in `before` (of words in the range). start: the place of START, or -1."""

    def __init__(self, t: Tokens, fit: np.ndarray, inside) -> None:
        trained = np.repeat(fit, t.counts)
        at = np.flatnonzero(inside(t.own))
        at = at if len(at) < len(t.own) else slice(None)  # all of them: no copies
        k, w, n, self.trigram = self._distinct(t.own[at], near(t.a[at]), trained[at])
        at = np.flatnonzero(trained)
        if len(at):
            context = t.contexts()[at]
            some = inside(context)
            rk, rw, rn, _ = self._distinct(context[some], near(t.c[at[some]]), None)
        else:
            rk, rw, rn = (np.zeros(0, kind) for kind in (np.uint64, np.uint64, np.uint32))
        first = tokens64.firsts(k)
        self.keys, place = k[first], np.cumsum(first) - 1
        self.start = -1
        if inside(np.full(1, START)).any():
            self.start = int(np.searchsorted(self.keys, START))
            if self.start == len(self.keys) or self.keys[self.start] != START:
                self.keys = np.insert(self.keys, self.start, START)
                place += place >= self.start
        self.before = place, w, n
        self.after = np.searchsorted(self.keys, rk), rw, rn
        self.place = place[self.trigram]

    @staticmethod
    def _distinct(k: np.ndarray, w: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Distinct (k, w), by k and then by their hash, with their sums of weights; and where each pair stands."""
        first, n, back = tokens64.places(_mix(k, w))[1:]
        n = (n if weight is None else np.bincount(back, weight, len(first))).astype(np.uint32)
        k, w = k[first], w[first]
        by = tokens64.by_hash(k << np.uint64(64 - BITS))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        return k[by], w[by], n[by], rank[back]


_ASK = pa.schema([("part", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("keys", "before_n", "before", "before_t", "after_n", "after", "after_t"))])
_ASK_SQL = "part int, block long, keys binary, before_n binary, before binary, before_t binary, after_n binary, after binary, after_t binary"
_TOLD = pa.schema([("block", pa.int64()), ("part", pa.int32()), *((c, pa.binary()) for c in ("numbers", "owner", "trigrams")), ("stats", pa.list_(pa.int64()))])
_TOLD_SQL = "block long, part int, numbers binary, owner binary, trigrams binary, stats array<long>"


def _levels_of(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def pack(figures: np.ndarray) -> bytes:
    """Numbers of bigrams or words in five rows: continuations, weight as a context, and how many words follow once, twice,
    more often. Most have as many that follow once as continuations, and no weight beyond 1, 2 and 3 for each of those."""
    n, total, once, twice, more = figures.astype(np.int64)
    apart = once - n
    return squeeze_counts(np.concatenate((n, apart << 1 ^ apart >> 63, twice, more, total - once - 2 * twice - 3 * more)))


def unpack(blob: bytes) -> np.ndarray:
    n, apart, twice, more, beyond = expand_counts(blob).astype(np.int64).reshape(5, -1)
    once = n + (apart >> 1 ^ -(apart & 1))
    out = np.stack((n, beyond + once + 2 * twice + 3 * more, once, twice, more))
    return out.astype(np.uint32 if not out.size or out.max() < 1 << 32 else np.uint64)


def _told(part: int, held: list) -> pa.RecordBatch:
    """The answers of one shard, and how many of its trained trigrams and bigrams have the counts 1 to 4."""
    keys = [expand_ascending(r[1]) for r in held]
    sizes = [len(x) for x in keys]
    known, _, _, back = tokens64.places(np.concatenate(keys) << np.uint64(64 - BITS))
    known >>= np.uint64(64 - BITS)
    backs = np.split(back, np.cumsum(sizes)[:-1])
    asks = [expand_counts(r[2]) for r in held]

    def beside(n: list, w: int, t: int) -> tuple[np.ndarray, ...]:
        place = np.concatenate([np.repeat(b, x) for b, x in zip(backs, n, strict=True)])
        counts = np.concatenate([expand_counts(r[t]) for r in held]).astype(np.int64)
        _, first, _, inverse = tokens64.places(_mix(known[place], np.concatenate([expand(r[w], np.uint64) for r in held])))
        return place, counts, place[first], np.bincount(inverse, counts, len(first)).astype(np.int64), inverse

    place, counts, own, trigrams, inverse = beside(asks, 3, 4)
    continued = np.bincount(own[trigrams > 0], minlength=len(known))
    # the first block that holds a trained bigram is its owner
    trained = np.flatnonzero(counts > 0)
    row_of = np.repeat(np.arange(len(held)), [int(x.sum()) for x in asks])
    owner_row = np.full(len(known), -1)
    backwards = trained[::-1]
    owner_row[place[backwards]] = row_of[backwards]
    _, _, after, times, _ = beside([expand_counts(r[5]) for r in held], 6, 7)
    figures = [continued, np.bincount(after, times, len(known)), *(np.bincount(after[m], minlength=len(known)) for m in (times == 1, times == 2, times >= 3))]
    figures = np.stack(figures)
    # of bigrams that training text does not have, nothing but that is told
    ends = np.cumsum([int(x.sum()) for x in asks])[:-1]
    seen, asked = np.split(continued[place] > 0, ends), np.split(trigrams[inverse], ends)
    rows = [(r[0], part, pack(figures[:, b]), np.packbits(owner_row[b][continued[b] > 0] == i).tobytes(), squeeze_counts(x[s]), None) for i, (r, b, x, s) in enumerate(zip(held, backs, asked, seen, strict=True))]
    rows.append((None, part, None, None, None, _levels_of(trigrams) + _levels_of(continued)))
    return batch_of(_TOLD, [*zip(*rows, strict=True)])


def _grouped(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """make(part, rows) for the rows of each part; the first column is the part."""
    now, held = None, []
    for b in batches:
        for part, *row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            if part != now and held:
                yield make(now, held)
                held = []
            now = part
            held.append(row)
    if held:
        yield make(now, held)


def bigrams(table: DataFrame, marks: DataFrame) -> tuple[list[DataFrame], list[int]]:
    """For each range of bigrams (block, told), told an array of (part, numbers, owner, trigrams); and the stats."""
    spark = table.sparkSession
    shards = blocked.shards_for(table, PASSES * (16 << 20))

    stats = [0] * 8

    def one(number: int) -> DataFrame:
        begin, end = number * shards, (number + 1) * shards

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard = lambda k: range_shard(k, PASSES * shards, BITS)
            inside = lambda k: shard(k) // shards == number
            for b in batches:
                for block, blob, fit in zip(b.column("block").to_pylist(), b.column("blob"), b.column("fit").to_pylist(), strict=True):
                    tokens = Tokens(blocked.rows(blob).column("_text").to_pylist())
                    trained = np.zeros(len(tokens.counts), bool)
                    trained[fit or []] = True
                    a = Asked(tokens, trained, inside)
                    cuts = np.searchsorted(shard(a.keys), np.arange(begin, end + 1))
                    sides = []
                    for place, w, n in (a.before, a.after):
                        per = np.bincount(place, minlength=len(a.keys))
                        sides.append((per, w, n, np.searchsorted(place, cuts)))
                    rows = []
                    for s in np.flatnonzero(np.diff(cuts)).tolist():
                        i, j = cuts[s], cuts[s + 1]
                        blobs = [x for per, w, n, c in sides for x in (squeeze_counts(per[i:j]), squeeze(w[c[s] : c[s + 1]]), squeeze_counts(n[c[s] : c[s + 1]]))]
                        rows.append((begin + s, block, squeeze_ascending(a.keys[i:j]), *blobs))
                    if rows:
                        yield batch_of(_ASK, [*zip(*rows, strict=True)])

        asked = table.select("block", "blob").join(blocked.dealt(marks).hint("shuffle_hash"), "block", "left").select("block", "blob", "fit").mapInArrow(lean(ask), _ASK_SQL)
        dealt = asked.repartition(partitions(spark), "part").sortWithinPartitions("part", "block")
        out = blocked.by_block(dealt.mapInArrow(lean(lambda batches: _grouped(batches, _told)), _TOLD_SQL), f"told{number}", "part", "numbers", "owner", "trigrams", "stats")
        stats[:] = map(sum, zip(stats, sums(out, f"told{number}", 8), strict=True))
        tidy(spark)
        return out

    return [one(k) for k in range(PASSES)], stats


def joined(table: DataFrame, told: list[DataFrame]) -> DataFrame:
    """(block, told) of every block, told being the answers of all ranges."""
    out = table.select("block")
    for t in told:
        out = out.join(t.hint("shuffle_hash"), "block", "left")
    none = F.array().cast(told[0].schema["told0"].dataType)
    return out.select("block", F.concat(*(F.coalesce(f"told{k}", none) for k in range(len(told)))).alias("told"))


def with_blobs(table: DataFrame, beside: DataFrame) -> DataFrame:
    """The blocks with what is beside them: joined last, so that the large rows pass through one join only."""
    return table.select("block", "blob").join(beside.hint("shuffle_hash"), "block", "left")


def numbers_of(answers: list) -> np.ndarray:
    return np.concatenate([np.zeros((5, 0), np.uint32), *(unpack(a["numbers"]) for a in answers)], 1)


def by_part(answers: list | None) -> list:
    return sorted(answers or (), key=lambda a: a["part"])


# --- words --------------------------------------------------------------------------------------------------------

_WORD = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("given", pa.binary())])
_SPOKEN = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("numbers", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _everything(k: np.ndarray) -> np.ndarray:
    return np.ones(len(k), bool)


def distinct(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The block's words and the zero before a text, ascending, and where each of its words stands."""
    known, _, _, back = tokens64.places(tokens.c << np.uint64(64 - BITS))
    return np.concatenate((np.zeros(1, np.uint64), known >> np.uint64(64 - BITS))), back + 1


def unigrams(table: DataFrame, told: list[DataFrame]) -> tuple[DataFrame, list[int]]:
    """(block, spoken), an array of (part, numbers): for each block's words how many words they follow, and, as contexts,
    their weight and how many bigrams of one, two, more continuations they begin; and the stats."""
    spark = table.sparkSession
    shards = blocked.shards_for(table, 64 << 20)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob, told in zip(b.column("block").to_pylist(), b.column("blob"), b.column("told"), strict=True):
                told = by_part(told.as_py())
                some = [unpack(a["numbers"])[0] for a in told]
                continued = np.concatenate([np.zeros(0, np.uint32), *some])
                owner = np.zeros(len(continued), bool)
                owner[continued > 0] = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(a["owner"], np.uint8), count=np.count_nonzero(x)) for a, x in zip(told, some, strict=True))])
                del some
                tokens = Tokens(blocked.rows(blob).column("_text").to_pylist(), deep=False)
                del told
                known, word = distinct(tokens)
                keys, first, _, _ = tokens64.places(tokens.own << np.uint64(64 - BITS))
                # START is no bigram of two words; without it the keys are those of the answers
                start = np.searchsorted(keys, START << np.uint64(64 - BITS))
                extra = int(not (start < len(keys) and keys[start] == START << np.uint64(64 - BITS)))
                at = np.arange(len(keys)) + (np.arange(len(keys)) >= start) * extra
                own = np.flatnonzero(owner[at])
                n = continued[at[own]]
                end = word[first[own]]
                begin = np.where(tokens.first[first[own]], 0, word[first[own] - 1])
                given = np.zeros((5, len(known)), np.uint64)
                given[0] = np.bincount(end, minlength=len(known))
                given[1] = np.bincount(begin, n, len(known))
                for r, m in ((2, n == 1), (3, n == 2), (4, n >= 3)):
                    given[r] = np.bincount(begin[m], minlength=len(known))
                cuts = np.searchsorted(range_shard(known, shards, BITS), np.arange(shards + 1))
                rows = [(s, block, squeeze_ascending(known[i:j]), pack(given[:, i:j])) for s, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if i < j]
                yield batch_of(_WORD, [*zip(*rows, strict=True)])

    def spoken(part: int, held: list) -> pa.RecordBatch:
        keys = [expand_ascending(r[1]) for r in held]
        known, _, _, back = tokens64.places(np.concatenate(keys) << np.uint64(64 - BITS))
        given = np.concatenate([unpack(r[2]) for r in held], 1)
        sums = np.stack([np.bincount(back, row, len(known)) for row in given]).astype(np.uint64)
        rows = [(r[0], part, pack(sums[:, b]), None) for r, b in zip(held, np.split(back, np.cumsum([len(k) for k in keys])[:-1]), strict=True)]
        rows.append((None, part, None, [*_levels_of(sums[0]), int((sums[0] > 0).sum()), int(sums[0].sum())]))
        return batch_of(_SPOKEN, [*zip(*rows, strict=True)])

    asked = with_blobs(table, joined(table, told)).select("block", "blob", "told").mapInArrow(lean(ask), "part int, block long, words binary, given binary")
    dealt = asked.repartition(partitions(spark), "part").sortWithinPartitions("part", "block")
    out = blocked.by_block(dealt.mapInArrow(lean(lambda batches: _grouped(batches, spoken)), "block long, part int, numbers binary, stats array<long>"), "spoken", "part", "numbers", "stats")
    return out, sums(out, "spoken", 6)


def sums(told: DataFrame, name: str, n: int) -> list[int]:
    """The stats of all shards together; they come without a block."""
    row = told.filter("block is null").select(F.explode(name).alias("x")).agg(*(F.sum(F.col("x.stats")[i]) for i in range(n))).first()
    return [x or 0 for x in row]


class Model:
    """Discounts of trigrams, bigrams and words, and the weight and back-off mass of the empty context."""

    def __init__(self, bigram_stats: list[int], word_stats: list[int], discounts) -> None:
        self.d3, self.d2, self.d1 = discounts(*bigram_stats[:4]), discounts(*bigram_stats[4:]), discounts(*word_stats[:4])
        n1, n2, _, _, different, self.total = word_stats
        self.mass = n1 * self.d1[0] + n2 * self.d1[1] + (different - n1 - n2) * self.d1[2]


def mixture(model: Model, texts: list[str | None], told: list, spoken: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of a block's words the probability a + b x its spelling's; and the words of each text."""
    tokens = Tokens(texts)
    if not len(tokens.c):
        return np.zeros(0), np.ones(0), tokens.counts
    word = distinct(tokens)[1].astype(np.int32)
    del tokens.c  # what is left asks for its bigrams only
    asked = Asked(tokens, np.zeros(len(tokens.counts), bool), _everything)
    told = by_part(told)
    bigrams_, unigrams_ = numbers_of(told), numbers_of(by_part(spoken))
    trigrams = np.zeros(len(asked.before[0]), np.int64)
    trigrams[bigrams_[0, asked.before[0]] > 0] = np.concatenate([np.zeros(0, np.uint32), *(expand_counts(a["trigrams"]) for a in told)])
    m, first, counts = model, tokens.first, tokens.counts
    place, trigram, start = asked.place, asked.trigram, asked.start
    del tokens, asked
    a, b = np.zeros(len(word)), np.ones(len(word))
    _add(a, b, unigrams_[0, word], m.d1, np.full(len(word), float(m.total)), np.full(len(word), m.mass))
    before = np.where(first, 0, np.concatenate(([0], word[:-1])))
    _add(a, b, bigrams_[0, place], m.d2, unigrams_[1, before], _mass(unigrams_, before, m.d2))
    context = np.where(first, start, np.concatenate(([0], place[:-1])))
    _add(a, b, trigrams[trigram], m.d3, bigrams_[1, context], _mass(bigrams_, context, m.d3))
    return a, b, counts


def log_probabilities(a: np.ndarray, b: np.ndarray, spelling: np.ndarray) -> np.ndarray:
    """spelling: the byte model's log-probabilities. A word that training text has nowhere has nothing but its spelling,
    however unlikely that is."""
    with np.errstate(divide="ignore", under="ignore"):
        return np.where(a > 0, np.log(a + b * np.exp(spelling)), np.log(b) + spelling)


def losses(texts: list[str | None], size: np.ndarray, byte_logp: np.ndarray, word_logp) -> tuple[list, list]:
    """Each text's mean loss a byte under the word model, and that of its worst passage. Bytes outside of words (spaces
    beyond the first) have the byte model's loss; a word's loss is spread over its bytes and the space that follows it.

    word_logp(spelling) gives the words' log-probabilities; size are the texts' bytes."""
    data, _ = tokens64.joined(texts)
    begins, ends = tokens64.spans(data)
    # places in the texts' bytes, without the space after each text
    text = np.repeat(np.arange(len(size)), np.diff(np.searchsorted(begins, np.append(0, np.cumsum(size + 1)))))
    begins, ends = begins - text, ends - text
    ends = ends + (ends < np.cumsum(size)[text])
    each = byte_logp.astype(np.float64)
    if len(begins):
        total = np.concatenate(([0.0], np.cumsum(each)))
        p = word_logp(total[ends] - total[begins])
        n = ends - begins
        # bytes outside of words and bytes of words by turns
        turns = np.empty(2 * len(n) + 1, np.int64)
        turns[1::2] = n
        turns[::2] = np.append(begins, len(each)) - np.append(0, ends)
        each[np.repeat(np.arange(len(turns)) % 2 == 1, turns)] = np.repeat(p / n, n)
    total = np.concatenate(([0.0], np.cumsum(each)))
    means, worst, end = [], [], 0
    for n in size.tolist():
        begin, end = end, end + n
        means.append((total[begin] - total[end]) / n if n else None)
        if n > PASSAGE:
            i = np.append(np.arange(begin, end - PASSAGE, STEP), end - PASSAGE)
            worst.append(float((total[i] - total[i + PASSAGE]).max()) / PASSAGE)
        else:
            worst.append(means[-1])
    return means, worst


def _mass(figures: np.ndarray, at: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return (figures[2] * d[0] + figures[3] * d[1] + figures[4] * d[2])[at]


def _add(a: np.ndarray, b: np.ndarray, n: np.ndarray, d: tuple[float, float, float], total: np.ndarray, mass: np.ndarray) -> None:
    """One order more, in place: counts n of the n-grams, weight and back-off mass of their contexts. A context that was
    not seen leaves the order below."""
    own = np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)], 0.0)
    seen = total > 0
    share = np.divide(mass, total, out=np.ones(len(a)), where=seen)
    a *= share
    b *= share
    a += np.divide(own, total, out=np.zeros(len(a)), where=seen)
