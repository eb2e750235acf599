"""Quality rules by repetition coverage.

Words are runs of bytes other than ASCII white space. Rolling hashes (64 bit) of the windows of every n-gram length come
from one array of running sums of a polynomial over the words' codes, in numpy; windows whose hash occurs twice or more in a text mark their words, and the coverage
is the share of the words' characters that is marked, first occurrences included. The coverage of lines counts the later
copies of a line only, as the base count of duplicate lines does: what stays if they go is whole. Windows of repeated 8 words that the base rules count are compared
exactly, by ranks of pairs that double in length, so no hash collision can change them. Lines are compared as text.

Null text has no words: all counts are 0 and the base rules fail it. Repeated rows are judged alike, whatever their ids;
of several rules that fail the first one in their order is told, and a share that equals its limit passes. An empty table
gives an empty table. Texts of any length are taken whole. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, lean, narrow, pieces

#: Largest share of characters inside duplicated n-grams, by n (public web-text filtering thresholds).
MAX_COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters inside duplicated lines.
MAX_LINE_COVERAGE = 0.20
#: Largest share of symbol characters among word characters.
MAX_SYMBOLS = 0.10
BASE_WORDS, BASE_WINDOW, BASE_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def word_codes(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse; remembered."""
    if not _POWERS or len(_POWERS[0]) < n:
        size, out = max(1 << 16, 1 << int(n).bit_length()), []
        for base in (_FACTOR, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def running(codes: np.ndarray) -> np.ndarray:
    """Running sums of the polynomial over the words' codes, each spread over 64 bits first."""
    with np.errstate(over="ignore"):
        x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * _powers(len(x))[0], out=out[1:])
    return out


def rolling_hashes(sums: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n words, from the running sums of the text."""
    with np.errstate(over="ignore"):
        h = sums[n:] - sums[:-n] if len(sums) > n else np.zeros(0, np.uint64)
        return h * _powers(len(h))[1]


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    if len(values) < 2:
        return np.zeros(len(values), bool)
    order = np.argsort(values, kind="stable")
    v = values[order]
    same = v[1:] == v[:-1]
    out = np.zeros(len(v), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def exact_windows(codes: np.ndarray) -> np.ndarray:
    """Numbers of the windows of 8 words: equal windows, equal numbers."""
    level = codes
    for step in (1, 2, 4):
        if len(level) <= step:
            return np.zeros(0, np.int64)
        pairs = level[:-step] * (level.max() + 1) + level[step:]
        level = np.unique(pairs, return_inverse=True)[1]
    return level


def covered(marks: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Words inside marked windows of n words."""
    edge = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(marks)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def may_repeat(words: list[list[bytes]], n: int) -> np.ndarray:
    """Of many texts at once: which have two windows of n words with one hash. Equal windows always do."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    text = np.repeat(np.arange(len(words)), counts)
    h = rolling_hashes(running(word_codes([w for ws in words for w in ws])), n)
    inside = text[: len(h)] == text[n - 1 :] if len(h) else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        h = (h[inside] + text[: len(inside)][inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * _FACTOR
    at = text[: len(inside)][inside]
    out = np.zeros(len(words), bool)
    out[at[repeated(h)]] = True
    return out


def measures(text: str | None, words: list[bytes] | None = None, longer: bool = True) -> tuple[int, int, int, int, int, list[float], float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, coverage by n of MAX_COVERAGE, line coverage.

    longer=False: it is known that no window of the least length repeats.
    """
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split() if words is None else words
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = Counter(line for line in data.split(b"\n") if line.split())
    dup_lines = lines.total() - len(lines)
    line_chars = sum((k - 1) * len(b"".join(line.split()).decode("utf-8", "surrogatepass")) for line, k in lines.items() if k > 1)
    n_repeat, cover = 0, []
    if longer and words:
        lengths = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
        codes = word_codes(words)
        if len(words) >= BASE_WINDOW:
            n_repeat = int(covered(repeated(exact_windows(codes)), BASE_WINDOW, len(words)).sum())
        sums = running(codes)
        for n in MAX_COVERAGE:
            marks = repeated(rolling_hashes(sums, n))
            if not marks.any():  # then no longer window repeats either
                break
            cover.append(float(lengths[covered(marks, n, len(words))].sum()) / chars)
    cover += [0.0] * (len(MAX_COVERAGE) - len(cover))
    return len(words), chars, symbols, dup_lines, n_repeat, cover, line_chars / chars if chars else 0.0


def verdict(n_words: int, chars: int, symbols: int, n_repeat: int, cover: list[float], line_cover: float) -> tuple[bool, bool, str]:
    """base_failed, kept, and the first rule that failed."""
    failed = n_words < BASE_WORDS or 100 * n_repeat > BASE_PERCENT * n_words
    if failed:
        return True, False, "base"
    if line_cover > MAX_LINE_COVERAGE:
        return False, False, "line_coverage"
    for (n, most), c in zip(MAX_COVERAGE.items(), cover, strict=True):
        if c > most:
            return False, False, f"coverage_{n}"
    if symbols > MAX_SYMBOLS * chars:
        return False, False, "symbols"
    return False, True, ""


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rule string, line_coverage double, " + ", ".join(f"coverage_{n} double" for n in MAX_COVERAGE)
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rule", pa.string()), ("line_coverage", pa.float64()), *((f"coverage_{n}", pa.float64()) for n in MAX_COVERAGE)])


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts, the coverages, and whether the rules keep it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            texts = b.column("text").to_pylist()
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
            for t, ws, longer in zip(texts, words, may_repeat(words, min(MAX_COVERAGE)).tolist(), strict=True):
                n, chars, symbols, lines, repeats, cover, line_cover = measures(t, ws, longer)
                rows.append((n, chars, symbols, lines, repeats, *verdict(n, chars, symbols, repeats, cover, line_cover), line_cover, *cover))
            yield batch_of(_SCHEMA, [b.column("doc_id"), *zip(*rows, strict=True)])

    return narrow(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(lean(run), _OUT)
