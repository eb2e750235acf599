"""Vector codes, periodic runs and MinHash components against plain versions; texts that would take quadratic time."""

import hashlib
import itertools
import math
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarlake.llm import media, minhash, periodic, pii, secret_scan, vector_codes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", 1, "x", "y") for i, t in enumerate(texts)], SCHEMA)


# --- vector codes


def plain_codes(rows, rounds=vector_codes.ROUNDS):
    """(code, error) by id, label sums and final codebooks, in whole numbers of Python."""
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // 4
    parts = [[v[p * w : p * w + w] for p in range(4)] for _, _, v in kept]
    books = [[parts[i][p] for i in range(min(256, len(kept)))] for p in range(4)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            owned = {}
            for v in parts:
                owned.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(owned[e]) for c in zip(*owned[e])] if e in owned else old for e, old in enumerate(books[p])]
    last = [[nearest(v[p], books[p]) for p in range(4)] for v in parts]
    out = [(i, lab, "".join(f"{e:02x}" for _, e in row), sum(d for d, _ in row)) for (i, lab, _), row in zip(kept, last)]
    sums = {}
    for _, lab, _, e in out:
        sums[lab] = sums.get(lab, 0) + e
    return sorted((repr((i, lab, c, e, sums[lab])) for i, lab, c, e in out)), ",".join(str(x) for b in books for c in b for x in c)


def vectors(n, seed, dim=8):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(20)]
    near = lambda: [float(np.float32(x + r.gauss(0, 0.05))) for x in r.choice(centres)]
    return [(i, near(), r.choice([None, 1, 1, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 3, 256, 700])
def test_codes_equal_plain_rounds(spark, n):
    rows = vectors(n, n)
    if n == 700:  # repeated rows, ties, ids and labels that are missing or shared, bad vectors
        rows += [(5, rows[7][1], 2), *rows[:9], (None, rows[3][1], None), (None, rows[3][1], 1), (9999, None, 1), (9998, [0.0] * 7 + [None], 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] * 8, 1), (-5, [0.5] * 8, 1), (-6, [0.5] * 8, 1)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, own long, vector long").repartition(5)
    got, entries = vector_codes.compress(df)
    want, numbers = plain_codes(rows)
    assert sorted(repr(tuple(r)) for r in got.select("vec_id", "label", "code", "error", "label_error").collect()) == want
    assert vector_codes.checksum(entries) == hashlib.sha256(numbers.encode()).hexdigest()


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.digests(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.digests(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.digests(spark.createDataFrame([(1, [1.0] * 6, 1)], schema))
    other = spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1), (3, [], 1)], schema)
    assert [r["vec_id"] for r in vector_codes.digests(other).collect()] == [1]


def test_bounds_save_full_scans_and_keep_ties():
    r = np.random.default_rng(1)
    x = (r.normal(size=(40, 8)) * 1024).astype(np.int64)[r.integers(0, 40, 4000)] + r.integers(-30, 30, (4000, 8))
    block = vector_codes.Block(None, None, x)
    entries = vector_codes.cut_parts(x[:256])
    before, scans = None, []
    for _ in range(4):
        books = [vector_codes.Codebook(e, None if before is None else b) for e, b in zip(entries, entries if before is None else before, strict=True)]
        scans.append(block.assign(books))
        for p, book in enumerate(books):
            d = ((block.x[p][:, None, :] - book.entries[None]) ** 2).sum(2)
            assert (block.owner[p] == d.argmin(1)).all()
            rows = np.arange(len(d))
            own = np.sqrt(d[rows, block.owner[p]])
            d[rows, block.owner[p]] = 1 << 60
            assert (block.upper[p] >= own).all() and (block.lower[p] <= np.sqrt(d.min(1))).all()
        before = entries
        entries = np.stack([np.stack([block.x[p][block.owner[p] == e].sum(0) // n if (n := int((block.owner[p] == e).sum())) else entries[p][e] for e in range(256)]) for p in range(4)])
    assert scans[-1] < scans[0] / 3


# --- periodic runs


def plain_runs(ws):
    found = {}
    for q in range(1, len(ws) // 3 + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def woven(r, n):
    ws = []
    while len(ws) < n:
        if r.random() < 0.5 and ws:
            base = ws[-r.randrange(1, min(len(ws), 30) + 1) :]
            ws += [base[i % len(base)] for i in range(r.randrange(1, 60))]
        else:
            ws.append("w%d" % r.randrange(r.choice([1, 2, 3, 30])))
    return ws


def test_runs_equal_brute_force():
    r = random.Random(3)
    for _ in range(400):
        ws = woven(r, r.randrange(0, 140))
        words = [[w.encode() for w in ws], [w.encode() for w in reversed(ws)], []]
        codes = periodic.coded(words)
        want = plain_runs(ws)
        assert periodic.runs(codes[: len(ws)]) == want
        may = periodic.may_run(words, codes)
        assert (may[0] or not want) and not may[2]


def planted(i, text):
    ws = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g, n = h // 10, len(ws)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[j] if j < a else ws[a + (j - a) % p] for j in range(n)]
    return ws


def test_run_digests(spark):
    r = random.Random(5)
    texts = ["", None, " ", "a", "x " * 30_000, "\x85 b\t\x0bc\n" * 30, "漢 字 " * 20, *(" ".join(woven(r, r.randrange(0, 300))) for _ in range(120)), *(" ".join("v%d" % r.randrange(5000) for _ in range(r.randrange(1, 400))) for _ in range(120))]
    ids = [None if k == 9 else k // 2 if k % 7 == 0 else k * 31 - 50 for k in range(len(texts))]
    got = sorted(tuple((x is None, x) for x in row) for row in periodic.digests(periodic.find(periodic.rehearsed(docs(spark, texts, ids)))).collect())
    want = []
    for i, t in zip(ids, texts, strict=True):
        ws = planted(i, t)
        found = plain_runs(ws) if len(ws) < 2000 else [(0, len(ws), 1)]
        best = periodic.strongest(found)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        text = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        row = (i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
        want.append(tuple((x is None, x) for x in row))
    assert got == sorted(want)
    assert any(row[1][1] for row in want)
    assert periodic.find(docs(spark, [])).count() == 0


def test_long_periodic_texts_take_seconds():
    began = time.time()
    assert periodic.runs(np.zeros(500_000, np.int64)) == [(0, 500_000, 1)]
    assert periodic.runs(np.arange(500_000) % 777) == [(0, 500_000, 777)]
    assert time.time() - began < 20


# --- MinHash


def plain_components(texts, ids):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        ws = (t or "").translate(low).encode().split()
        sets.append(frozenset([tuple(ws)]) if 0 < len(ws) < 3 else frozenset(tuple(ws[i : i + 3]) for i in range(len(ws) - 2)))
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            root[top(i)] = top(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    out = []
    for i, k in enumerate(ids):
        c = least.get(top(i)) if sets[i] else k
        out.append(repr((k, len(sets[i]), c, k == c)))
    return sorted(out)


def edited(r, ws, k):
    ws = list(ws)
    for _ in range(k):
        ws[r.randrange(len(ws))] = "e%d" % r.randrange(10**9)
    return ws


def test_components_equal_brute_force(spark):
    r = random.Random(11)
    texts = ["", None, "a", "A", "a b", "b a", "A B", "a b c", "x " * 5000, "X " * 400]
    for _ in range(12):  # groups of edited copies, some at the limit
        base = ["w%d" % r.randrange(3000) for _ in range(r.choice([8, 40, 200]))]
        texts += [" ".join(edited(r, base, r.randrange(0, 1 + len(base) // 40))) for _ in range(r.randrange(1, 15))]
    chain = ["c%d" % k for k in range(300)]
    for k in range(25):  # each links to the next ones only
        texts.append(" ".join(chain[5 * k : 5 * k + 150]))
    shared = " ".join("s%d" % k for k in range(60))
    texts += [shared + " " + " ".join("u%d" % r.randrange(10**6) for _ in range(60)) for _ in range(60)]  # much in common, no link
    texts += texts[20:30]
    ids = [None if k % 17 == 0 else k if k % 13 else 5 for k in range(len(texts))]
    got = minhash.dedup(docs(spark, texts, ids))
    assert sorted(repr(tuple(x)) for x in got.collect()) == plain_components(texts, ids)


def test_one_bucket_of_many_sets_in_chunks(spark, monkeypatch):
    """Members of a hot bucket are searched in several chunks, outside of its main component too."""
    r = random.Random(2)
    base = ["w%d" % k for k in range(200)]
    hubs = [edited(r, base, 9) for _ in range(6)]
    texts = [" ".join(edited(r, h, 3)) for h in hubs for _ in range(25)]
    monkeypatch.setattr(minhash, "CHUNK", 16)
    ids = list(range(len(texts)))
    assert sorted(repr(tuple(x)) for x in minhash.dedup(docs(spark, texts, ids)).collect()) == plain_components(texts, ids)


def test_minhash_keeps_one_row_of_each_component(spark):
    base = " ".join("w%d" % k for k in range(100))
    texts = [base, base.upper(), base + " more", "other words here", "", None, base]
    kept = minhash.keep_one(docs(spark, texts, [4, 3, 9, 3, 1, 1, None]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.filter("text <> ''").collect()) == [(3, base.upper()), (3, "other words here")]
    assert kept.columns == docs(spark, []).columns and kept.count() == 4
    assert minhash.dedup(docs(spark, [])).count() == 0


def test_sketches_bound_links():
    r = np.random.default_rng(5)
    for a, b in ((1, 1), (100, 118), (117, 100), (1000, 900), (40, 34)):
        least = -(-85 * (a + b) // 185)
        assert minhash.most_apart(a, b) == a + b - 2 * least
        for shared in (min(a, b, least), max(0, least - 1)):
            pool = r.integers(0, 1 << 64, a + b - shared, np.uint64)
            x, y = (np.frombuffer(minhash.sketch(v), np.uint64)[None] for v in (pool[:a], pool[a - shared :]))
            assert minhash.differ(x, y) <= a + b - 2 * shared
            assert minhash.linked(shared, a, b) == (a + b - 2 * shared <= minhash.most_apart(a, b))


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    pool = r.integers(0, 1 << 64, 1300, np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[150:1150])
    m = minhash.minima([a, b, a])
    assert (m[0] == m[2]).all() and abs((m[0] == m[1]).mean() - 850 / 1150) < 0.1
    x = [int(v) >> 32 for v in a]
    for k in (0, 77, minhash.BANDS * minhash.ROWS - 1):
        p, q = (int(v) for v in minhash._DRAWN[:, k])
        assert int(m[0, k]) == min((p * v + q) % (1 << 64) for v in x) >> 32
    keys = minhash.band_keys(m)
    assert (keys[0] == keys[2]).all() and len(set(keys[0].tolist())) == minhash.BANDS


@pytest.mark.parametrize("name,oracle", [("op11_hamerly_codes", vector_codes.ORACLE), ("op12_periodic_runs", periodic.ORACLE), ("op13_minhash_components", minhash.ORACLE)])
def test_same_rows_as_sql(spark, sf_dir, name, oracle):
    from lidarlake.llm.queries import QUERIES

    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir), db.sql(oracle)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = lambda columns, values: sorted(repr([v[columns.index(c)] for c in order]) for v in values)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


# --- long texts of one anchor or prefix


@pytest.mark.parametrize("unit", ["ssn", "ssn ", "passport no ", "a@", "1 ", "iban", "+1(", "://a:b@"])
def test_dense_anchors_take_seconds(unit):
    began = time.time()
    pii.find(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 20


def test_dense_secrets_take_seconds(spark):
    secrets = " ".join(f"token={k:020d}" for k in range(20_000))
    texts = ["eyJ" * 340_000, "-eyJ" * 250_000, "eyJa.eyJb.c" + " eyJa.eyJb.c" * 10, secrets]
    rows = docs(spark, texts)
    began = time.time()
    got = {r["doc_id"]: r for r in secret_scan.summaries(rows).collect()}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(rows).collect()}
    assert time.time() - began < 60
    assert got[0]["spans"] == got[1]["spans"] == "" and got[3]["n_assign"] == 20_000
    assert clean[3] == " ".join(["[SECRET]"] * 20_000) and clean[0] == texts[0]


def test_redaction_by_pages(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "PAGE", 3)
    key = "AKIA" + "A" * 12
    texts = [f"é token={key} 🙂 " * n + tail for n in range(9) for tail in ("", "end", f"password: {'0af' * 12}")]
    want = []
    for t in texts:
        spans = [tuple(map(int, x.split(":")[1:])) for x in next(iter(secret_scan.summaries(docs(spark, [t])).collect()))["spans"].split(",") if x]
        out, at = "", 0
        for s, e in spans:
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        want.append(out + t[at:])
    got = [r["text"] for r in secret_scan.redact(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == want and any("[SECRET]" in t for t in got)


def test_streams_that_cannot_be_read(spark):
    good = media.mux(b"hello" * 20)
    rows = [(1, b""), (2, None), (3, good[1:]), (4, b"\x00" * 188), (5, good)]
    got = {r["doc_id"]: r for r in media.decode(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert all(got[k]["error"] and got[k]["payload"] is None for k in (1, 3, 4))
    assert got[2]["error"] is None and got[2]["payload"] is None
    assert got[5]["error"] is None and bytes(got[5]["payload"]) == b"hello" * 20
