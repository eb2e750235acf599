"""Periodic runs of words by Karp, Miller and Rosenberg's names of power-of-two windows.

A run is a stretch of words with smallest period q and length of at least max(LEAST, TIMES * q) that no neighbouring word
extends with that period. Level 0 names words, level k + 1 names pairs of level k: windows of 2**k words are equal exactly
if their names are, so no fingerprint can be wrong. The longest common extension of two places comes from descending
levels. A run of period q has w[i] = w[i + q] over a stretch that holds a whole block of a grid whose step is half the
shortest such stretch; blocks whose names differ at distance q are no candidates, all others are extended both ways.
Stretches that are found for a multiple of their period are the same stretch, and the least period stays.

Most texts end at level 4: any run repeats a window of 16 words inside its text, and that is asked of many texts at once.

Null and empty texts have no words and no runs. Texts of any length are taken whole; a text's names take 4 bytes a word
and level. Among equally strong runs the one with the least start, then period, is the strongest. Rows are judged by
themselves: repeated rows, repeated and null ids are fine. Columns other than id and text are not read. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, col, lean, narrow, pieces

LEAST, TIMES = 24, 3
#: Words of the windows by which texts without runs are told: half of what a run repeats at least is longer.
PROBE = 4
#: Highest level; longer extensions take several steps of it.
TOP = 12
#: Grid blocks that are compared at a time.
BLOCKS = 1 << 20


def ranked(key: np.ndarray) -> np.ndarray:
    """Equal keys, equal numbers from 0 on. Places ride in the low bits of a plain sort where there is room."""
    n = len(key)
    if not n:
        return np.zeros(0, np.int32)
    bits = n.bit_length()
    if int(key.max()) >> (63 - bits):
        return np.unique(key, return_inverse=True)[1].astype(np.int32)
    s = key << bits
    s |= np.arange(n)
    s.sort()
    order = s & ((1 << bits) - 1)
    s >>= bits
    out = np.empty(n, np.int32)
    out[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])), dtype=np.int32)
    return out


def doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names of windows twice as wide, from those of windows of `width` words."""
    if len(names) <= width:
        return np.zeros(0, np.int32)
    return ranked(names[:-width].astype(np.int64) * (int(names.max()) + 1) + names[width:])


class Names:
    """The names of a text's windows by level, as far up as any window occurs twice."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n, self.levels = len(codes), [ranked(codes.astype(np.int64))]
        while len(self.levels) <= TOP:
            more = doubled(self.levels[-1], 1 << (len(self.levels) - 1))
            if not len(more) or int(more.max()) + 1 == len(more):
                break
            self.levels.append(more)

    def equal(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Are the windows of 2**k words at i and j whole and equal?"""
        names = self.levels[k]
        ok = (i >= 0) & (j < len(names))
        at = np.flatnonzero(ok)
        ok[at] = names[i[at]] == names[j[at]]
        return ok

    def extension(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """How many words from i and j on (i < j), or before them, are the same."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            width = 1 << k
            left = np.arange(len(i))
            while len(left):
                shift = -out[left] - width if back else out[left]
                left = left[self.equal(k, i[left] + shift, j[left] + shift)]
                out[left] += width
                if k < len(self.levels) - 1:  # below the highest level one step is all there can be
                    break
        return out


def runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    n = len(codes)
    if n < LEAST:
        return []
    names = Names(codes)
    q = np.arange(1, n // TIMES + 1)
    step = (np.maximum(LEAST, TIMES * q) - q) // 2
    level = np.frexp(step)[1] - 1
    # where no window of a level occurs twice, no block of that width does
    known = level < len(names.levels) if len(names.levels) <= TOP else np.ones(len(q), bool)
    level = np.minimum(level, len(names.levels) - 1)
    count = np.where(known, np.maximum(0, (n - q - (1 << level)) // step + 1), 0)
    found: dict[tuple[int, int], int] = {}
    inside_end, inside_period = np.zeros(n, np.int64), np.ones(n, np.int64)
    total = np.cumsum(count)
    begin = 0
    while begin < len(q):
        # doublings of the period, so that multiples of periods that were found need no extension
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, min(2 * begin + 1, int(np.searchsorted(total, base + BLOCKS, "right")), len(q)))
        part = slice(begin, end)
        period = np.repeat(q[part], count[part])
        i = (np.arange(len(period)) - np.repeat(total[part] - count[part] - base, count[part])) * np.repeat(step[part], count[part])
        at_level = np.repeat(level[part], count[part])
        begin = end
        keep = (i + period >= inside_end[i]) | (period % inside_period[i] != 0)
        i, period, at_level = i[keep], period[keep], at_level[keep]
        same = np.zeros(len(i), bool)
        for k in np.unique(at_level).tolist():
            at = np.flatnonzero(at_level == k)
            same[at] = names.equal(k, i[at], i[at] + period[at])
        i, period = i[same], period[same]
        if not len(i):
            continue
        start = i - names.extension(i, i + period, True)
        stop = i + period + names.extension(i, i + period, False)
        long = stop - start >= np.maximum(LEAST, TIMES * period)
        for s, e, p in np.unique(np.stack((start[long], stop[long], period[long]), 1), axis=0).tolist():
            if found.setdefault((s, e), p) >= p:
                found[s, e] = p
                inside_end[s:e], inside_period[s:e] = e, p
    return sorted((s, e - s, p) for (s, e), p in found.items())


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those of no run, and each run's first period but for words that another run drops."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def coded(words: list[list[bytes]]) -> np.ndarray:
    """The words of all texts as numbers; after each text a number that is no word's and no other text's."""
    seen: dict[bytes, int] = {}
    number = seen.setdefault
    codes: list[int] = []
    for i, ws in enumerate(words):
        codes += [number(w, len(seen)) for w in ws]
        codes.append(-1 - i)
    return np.array(codes, np.int64) + len(words)


def may_run(words: list[list[bytes]], codes: np.ndarray) -> np.ndarray:
    """Which texts hold some window of 2**PROBE words twice: texts without one have no run."""
    counts = np.fromiter(map(len, words), np.int64, len(words)) + 1
    text = np.repeat(np.arange(len(words)), counts)
    names = ranked(codes)
    for k in range(PROBE):
        names = doubled(names, 1 << k)
    order = np.argsort(names, kind="stable")
    s, t = names[order], text[order]
    out = np.zeros(len(words), bool)
    out[t[1:][(s[1:] == s[:-1]) & (t[1:] == t[:-1])]] = True
    return out


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("strongest", _RUN), ("collapsed", pa.string())])
_SQL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, collapsed string"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed) of every row; collapsed is the text with each run brought down to
    its first period, words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in b.column("text").to_pylist()]
            codes = coded(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            rows = []
            for ws, end, may in zip(words, ends.tolist(), may_run(words, codes).tolist(), strict=True):
                got = runs(codes[end - 1 - len(ws) : end - 1]) if may else []
                stay = ws if not got else [ws[i] for i in np.flatnonzero(kept(len(ws), got)).tolist()]
                dicts = [dict(zip(("start", "length", "period"), r, strict=True)) for r in got]
                best = strongest(got)
                rows.append((len(ws), dicts, None if best is None else dict(zip(("start", "length", "period"), best, strict=True)), b" ".join(stay).decode("utf-8", "surrogatepass")))
            yield batch_of(_SCHEMA, [b.column("doc_id"), *zip(*rows, strict=True)])

    return narrow(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(lean(run), _SQL)


def rehearsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): one document in ten, by the checksum of its id, repeats a stretch of its own words to its end, so
    that there are runs to find at any size of the table. A document without an id stays as it is."""
    h = F.crc32(F.col("id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        g = F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(places, lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # bound once by an array of one element, since the words are asked for at many places
    some = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeated(ws)).otherwise(F.col("text")))[0]
    plain = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    return plain.select(F.col("id").alias("doc_id"), F.when((h % 10 == 0) & F.col("text").isNotNull(), some).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of the rows of `find`: counts, the strongest run and checksums of all runs and of the collapsed text."""
    best, line = F.col("strongest"), lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    ratio = F.call_function("div", F.lit(1000) * best["length"], best["period"])
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), ratio.alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


ORACLE = r"""
WITH bits AS (SELECT list(c ORDER BY b) AS t FROM (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b))),
d AS (
  SELECT row_number() OVER () AS r, doc_id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, s: xor(c >> 8, t[1 + (xor(c, s) & 255)]))) AS h,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS o
  FROM documents, bits),
g AS (SELECT *, len(o) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
w AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE o END AS ws
  FROM a),
win AS (SELECT r, unnest(range(n - 15)) AS i, unnest(list_transform(range(n - 15), lambda i: array_to_string(ws[i + 1 : i + 16], ' '))) AS x FROM w WHERE n >= 24),
cand AS (SELECT DISTINCT x.r, y.i - x.i AS q FROM win x JOIN win y ON x.r = y.r AND x.x = y.x AND x.i < y.i),
same AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle
  FROM (SELECT cand.r, q, unnest(list_filter(range(n - q), lambda i: ws[i + 1] = ws[i + 1 + q])) AS i FROM cand JOIN w USING (r) WHERE 3 * q <= n)),
long AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM same GROUP BY r, q, isle HAVING count(*) + q >= greatest(24, 3 * q)),
run AS (SELECT r, s AS start, len AS length, min(q) AS period FROM long GROUP BY r, s, len),
per AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_min({'start': start, 'length': length, 'period': period}, {'e': -(length::DOUBLE / period), 'start': start, 'period': period}) AS best
  FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
stay AS (
  SELECT w.r, string_agg(u.v, ' ' ORDER BY u.i) AS text FROM w, (SELECT w.r, unnest(range(n)) AS i, unnest(ws) AS v FROM w) u
  WHERE u.r = w.r AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = u.r AND gone.i = u.i) GROUP BY w.r)
SELECT w.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
  CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(stay.text, '')) AS collapsed_sha256
FROM w LEFT JOIN per USING (r) LEFT JOIN stay USING (r)
"""
