"""Operators over all documents against brute force: the n-gram model, the Jaccard join, and the pipeline."""

import glob
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarlake import runtime
from lidarlake.llm import components, jaccard, quality, secret_scan, tokens64

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "extra", "k") for i, t, lang in rows], SCHEMA)


# --- quality


def kneser_ney(texts, order=quality.ORDER):
    """p(n-gram) by plain recursion over counts in memory."""

    def grams(t):
        b = bytes(order - 1) + t.encode()
        return [b[i : i + order] for i in range(len(b) - order + 1)]

    counts = {order: Counter(g for t in texts for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, totals, masses = {}, {}, {}
    for k, c in counts.items():
        of = Counter(c.values())
        discounts[k] = quality.discounts(*(of[i] for i in (1, 2, 3, 4)))
        totals[k], masses[k] = Counter(), Counter()
        for g, n in c.items():
            totals[k][g[:-1]] += n
            masses[k][g[:-1]] += discounts[k][min(n, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        k, low = len(g), p(g[1:])
        if not totals[k][g[:-1]]:
            return low
        n = counts[k][g]
        return ((n - discounts[k][min(n, 3) - 1] if n else 0) + masses[k][g[:-1]] * low) / totals[k][g[:-1]]

    def loss(t):
        return sum(loss.each(t)) / len(t.encode())

    loss.each = lambda t: [-math.log(p(g)) for g in grams(t)]
    return loss


def test_losses_are_those_of_a_plain_model(spark):
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "délta", "of", "the"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))), "en" if i % 3 else None) for i in range(120)]
    rows += [(200, None, "en"), (201, "", "fr"), (202, "§§ ## !! %% zz" * 4, "en"), (203, "zz " * 20_000, "fr"), (204, "漢字", "en"), (None, "alpha beta", None), (5, rows[5][1], "en")]
    trusted = spark.createDataFrame([(i,) for i in range(100)], "doc_id long")
    got = quality.classify(frame(spark, rows), trusted).collect()
    assert len(got) == len(rows)
    calibrates = {r[0] for r in trusted.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality.CALIBRATE))).collect() if r[1] == 0}
    loss = kneser_ney([t for i, t, _ in rows if i is not None and i < 100 and i not in calibrates])
    text = {i: t for i, t, _ in rows}
    for r in got:
        t = text[r["doc_id"]]
        if t:
            assert r["loss"] == pytest.approx(loss(t), rel=1e-5), t[:40]
        else:
            assert r["loss"] is None and not r["kept"]
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not kept[202] and not kept[203] and sum(kept[i] for i in range(100)) >= 95


def word_kneser_ney(texts, spelling):
    """Loss of a text's words by plain counts; spelling(text, begin, end) is the log-probability of a span of bytes."""

    def grams(t):
        w = [b"", b"", *t.encode().split()]
        return [tuple(w[i : i + 3]) for i in range(len(w) - 2)]

    counts = {3: Counter(g for t in texts for g in grams(t))}
    for k in (2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, totals, masses = {}, {}, {}
    for k, c in counts.items():
        of = Counter(c.values())
        discounts[k] = quality.discounts(*(of[i] for i in (1, 2, 3, 4)))
        totals[k], masses[k] = Counter(), Counter()
        for g, n in c.items():
            totals[k][g[:-1]] += n
            masses[k][g[:-1]] += discounts[k][min(n, 3) - 1]

    def p(g, base):
        if not g:
            return base
        k, low = len(g), p(g[1:], base)
        if not totals[k][g[:-1]]:
            return low
        n = counts[k][g]
        return ((n - discounts[k][min(n, 3) - 1] if n else 0) + masses[k][g[:-1]] * low) / totals[k][g[:-1]]

    def loss(t):
        return sum(x for _, x in loss.spans(t)) / len(t.encode())

    loss.spans = lambda t: [(m.span(), -math.log(p(g, math.exp(spelling(t, *m.span()))))) for g, m in zip(grams(t), re.finditer(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]?", t.encode()), strict=True)]
    return loss


def test_word_losses_are_those_of_a_plain_model(spark):
    rnd = random.Random(4)
    words = ["alphabet", "betatron", "gammaray", "déltawing", "of", "the"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))), "en") for i in range(80)] + [(90, "unknown alphabet wordings of gammaray", "en"), (91, "", "en")]
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    calibrates = {r[0] for r in trusted.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality.CALIBRATE))).collect() if r[1] == 0}
    fit = [t for i, t, _ in rows if i < 60 and i not in calibrates]
    byte = kneser_ney(fit)
    prefix = lambda t, n: -byte(t.encode()[:n].decode(errors="surrogateescape")) * n if n else 0.0
    loss = word_kneser_ney(fit, lambda t, begin, end: prefix(t, end) - prefix(t, begin))
    text = {i: t for i, t, _ in rows}
    for r in quality.classify(frame(spark, rows), trusted).collect():
        if text[r["doc_id"]]:
            assert r["word_loss"] == pytest.approx(loss(text[r["doc_id"]]), rel=1e-4)
        else:
            assert r["word_loss"] is None and not r["kept"]


def test_one_bad_passage_is_seen(spark):
    rnd = random.Random(5)
    words = ["alphabet", "betatron", "gammaray", "deltawing", "epsilon", "of", "the"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, text(rnd.randint(3000, 4000)), "en") for i in range(60)]
    rows += [(100, text(1800) + " " + "".join(rnd.choice("qzxjkv0123#%") for _ in range(70)) + " " + text(1800), "en"), (101, text(3600), "en")]
    got = {r["doc_id"]: r for r in quality.classify(frame(spark, rows), spark.createDataFrame([(i,) for i in range(60)], "doc_id long")).collect()}
    assert got[100]["loss"] <= got[100]["threshold"] and not got[100]["kept"] and got[101]["kept"]


def test_kept_rows_have_all_columns(spark):
    rows = [(i, f"plain words number {i}", "en") for i in range(50)] + [(99, "@@@@ ==== ~~~~ ^^^^", "en")]
    d = frame(spark, rows)
    out = quality.Judged(d, d.filter("doc_id < 50").select("doc_id")).keep()
    assert out.schema.names == d.schema.names and 99 not in {r["doc_id"] for r in out.collect()} and out.count() >= 45
    everything = quality.Judged(d, d.filter("false").select("doc_id")).keep()
    assert everything.count() == 51
    assert quality.classify(d.limit(0), d.select("doc_id")).count() == 0


def test_hashes_of_words_and_their_places():
    texts = ["a bc  abc\t", None, "", " ", "Abc ABC abc", "é " + "x" * 400 + " X" + "x" * 399, "漢字\u2003漢字"]
    for lower in (False, True):
        want = [(t or "").encode().lower().split() if lower else (t or "").encode().split() for t in texts]
        h, n = tokens64.words(texts, lower)
        assert n.tolist() == [len(w) for w in want]
        of: dict = {}
        assert all(of.setdefault(w, x) == x for w, x in zip([w for ws in want for w in ws], h.tolist(), strict=True)) and len(set(of.values())) == len(of)
    h = np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64)[np.random.default_rng(2).integers(0, 5000, 20_000)]
    known, first, n, back = tokens64.places(h)
    want = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    assert all((x == y).all() for x, y in zip((known, first, back, n), want, strict=True))
    near = h >> np.uint64(40)  # hashes that differ in low bits only
    assert (tokens64.by_hash(near) == np.argsort(near, kind="stable")).all()


def test_quality_of_labelled_documents(spark, sf_dir):
    d, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.classify(d, quality.trusted_ids(labels)).join(labels, "doc_id").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1 and r["toxic"] == 0], [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.2 * len(bad)


# --- Jaccard


def brute(rows):
    sets = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for k, (i, _, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], i)
    return Counter((i, len(s), least[find(k)]) for k, ((i, _, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage, rows = [word() for _ in range(60)], []
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(5, 120))]
        for _ in range(rnd.randint(1, 14)):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 18))):
                t[rnd.randrange(len(t))] = word()
            rows.append(" ".join(t[: rnd.randint(max(5, len(t) - 8), len(t))]))
        rows.append(" ".join(base[:20] + passage))
        rows.append(" ".join(passage + base[:10]))
    rows += [rows[0], rows[0].upper(), "a b", "A B", "a b c", "", None, " ", "x " * 5000, "x " * 5000 + "y", "a b c d e"]
    rnd.shuffle(rows)
    return [(i, t, "en") for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,chunk", [(1, 1 << 18), (2, 1 << 18), (3, 200)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = near_copies(seed)
    got = jaccard.join(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f g h i j k l", "en"), (1, "a b c d e f g h i j k l", "en"), (1, "other words", "en"), (None, "a b c d e f g h i j k l", "en"), (2, "a b c d e f g h i j k l", "en"), (3, None, "en")]
    d = frame(spark, rows)
    got = jaccard.join(d)
    assert got.count() == 6 and got.filter("doc_id = 2").first()["component_id"] == 1
    kept = jaccard.keep_one(d)
    assert kept.columns == d.columns and Counter(r["doc_id"] for r in kept.collect()) == {1: 2, 3: 1}  # "other words" is no copy, the row without an id is
    assert jaccard.join(d.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [1 << 18, 300])
def test_links_are_those_of_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = near_copies(6)
    base = [f"w{k}" for k in range(80)]
    rows += [(1000 + i, " ".join([*base[:i], f"new{i}", *base[i + 1 :]]), "en") for i in range(0, 80, 4)] + [(2000, " ".join(base), "en"), (2000, " ".join(base), "en"), (2001, " ".join(base), "en")]
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    want = Counter((i, sum(100 * len(s & o) >= 75 * len(s | o) for k, o in enumerate(sets) if k != at and o) if s else 0) for at, ((i, _, _), s) in enumerate(zip(rows, sets, strict=True)))
    got = jaccard.join(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_links"]) for r in got) == want


def test_no_component_vanishes(spark):
    a, b, c = ("a b c d e f g h i j k l", "m n o p q r s t u v w x", "other words of no one else")
    rows = [(5, a, "en"), (3, a.upper(), "en"), (5, b, "en"), (5, b, "en"), (5, c, "en"), (7, b, "en"), (8, None, "en"), (8, None, "en"), (5, "", "en")]
    kept = jaccard.keep_one(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == {(3, a.upper()): 1, (5, b): 1, (5, c): 1, (8, None): 1, (5, ""): 1}
    hot = [(1, " ".join(f"w{i}x{k}" for k in range(8)), "en") for i in range(40)]
    assert jaccard.keep_one(frame(spark, hot)).count() == 40


def test_rows_without_an_id_link_and_bridge(spark):
    base = [f"w{k}" for k in range(100)]
    text = lambda n: " ".join([*base[n:], *(f"new{k}" for k in range(n))])
    # 0 and 24 do not link, 12 links with both: it bridges them, although only a row without an id has it
    rows = [(4, text(0), "en"), (None, text(12), "en"), (9, text(24), "en"), (None, text(12), "en"), (None, "quite another text of six words", "en")]
    got = Counter((r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard.join(frame(spark, rows)).collect())
    assert got == {(4, 4, 2): 1, (9, 4, 2): 1, (None, 4, 3): 2, (None, None, 0): 1}
    assert Counter(r["text"] for r in jaccard.keep_one(frame(spark, rows)).collect()) == {text(0): 1, rows[4][1]: 1}


def test_many_rows_of_no_id_or_one(spark):
    d = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), "id") for k in range(7))).alias("text"))
    assert jaccard.keep_one(d).count() == 10_000
    assert jaccard.keep_one(d.withColumn("doc_id", F.lit(7).cast("long"))).count() == 10_000
    assert jaccard.keep_one(d.withColumn("text", F.lit("one text of five words"))).count() == 1


def test_a_list_of_many_components(spark):
    # all share a long passage and link with nothing: their lists are mixed
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join([*passage, *(f"own{i}x{k}" for k in range(16))]), "en") for i in range(60)]
    got = jaccard.join(frame(spark, rows)).collect()
    assert all(r["component_id"] == r["doc_id"] and r["n_links"] == 0 for r in got) and len(got) == 60


def test_sketches_bound_the_difference():
    rnd = np.random.default_rng(3)
    for _ in range(100):
        a = np.unique(rnd.integers(0, 2**63, rnd.integers(1, 300)).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((rnd.choice(a, max(1, int(len(a) * rnd.uniform(0.7, 1))), replace=False), rnd.integers(0, 2**63, rnd.integers(0, 40)).astype(np.uint64))))
        if len(np.intersect1d(a, b)) >= jaccard.need(len(a), len(b)):
            assert jaccard.may_link(jaccard.sketch(a), len(a), jaccard.sketch(b), len(b))


def test_divide_skip_counts_right():
    rnd = np.random.default_rng(0)
    for _ in range(60):
        query = np.unique(rnd.integers(0, 400, rnd.integers(1, 200)).astype(np.uint64))
        sets = [np.unique(np.concatenate((rnd.choice(query, int(len(query) * rnd.uniform(0.5, 1))), rnd.integers(0, 900, rnd.integers(0, 30)).astype(np.uint64)))) for _ in range(rnd.integers(1, 20))]
        want = [i for i, s in enumerate(sets) if len(np.intersect1d(query, s)) >= jaccard.need(len(query), len(s))]
        assert sorted(jaccard.divide_skip(query, sets)) == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (50, 49)]
    got = {r["u"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[k] == 100 for k in range(101, 130)) and got[50] == 49
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("name", ["op5_trigram_secrets", "op6_jaccard_components", "op7_extendible_shards"])
def test_queries_are_those_of_their_sql(spark, sf_dir, name):
    import os

    import duckdb

    from lidarlake.llm import queries

    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    got, want = queries.QUERIES[name](spark, sf_dir), db.sql(queries.ORACLES[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall())


# --- pipeline


def test_pipeline_stages_take_effect(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "packing"]
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = source
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        before, d = d, stage(spark, d, sf_dir).cache()
        assert d.columns == source.columns
        if k == 0:
            assert 0.6 * before.count() < d.count() < before.count()
        if k == 1:
            comp = {r["doc_id"]: r["component_id"] for r in jaccard.join(before).collect()}
            assert sorted(r["doc_id"] for r in d.collect()) == sorted(set(comp.values()))
        if k == 2:
            assert d.count() == before.count() and secret_scan.summaries(d).filter("n_hex + n_access + n_assign > 0").count() == 0
            assert d.filter(F.length("text") != F.col("n_chars")).count() == 0
        if k == 3:
            sizes = lambda x: sum(len(r["text"].split()) for r in x.collect())
            assert sizes(d) == pytest.approx(1.5 * sizes(before), rel=0.1)
    assert pipeline.STAGES[-1][1](spark, d, sf_dir).select("sequence_id").distinct().count() > 10


def plain_quality(rows, trusted, calibrates):
    """Which rows (doc_id, text, lang, ...) the classifier keeps, by models in memory."""
    fit = [r[1] for r in rows if r[0] in trusted and r[0] not in calibrates and r[1]]
    byte = kneser_ney(fit)
    each = {t: byte.each(t) for t in {r[1] for r in rows if r[1]}}
    word = word_kneser_ney(fit, lambda t, a, b: -sum(each[t][a:b]))
    figures = {}
    for t, losses in each.items():
        spread = list(losses)
        for (a, b), x in word.spans(t):
            spread[a:b] = [x / (b - a)] * (b - a)
        n = len(spread)
        begins = [*range(0, n - 512, 64), n - 512] if n > 512 else [0]
        figures[t] = (sum(losses) / n, sum(spread) / n, max(sum(spread[i : i + 512]) for i in begins) / min(n, 512))
    sample = [(r[2], figures[r[1]]) for r in rows if r[0] in calibrates and r[1]]

    def threshold(lang, k):
        own = sorted(f[k] for x, f in sample if x == lang) or sorted(f[k] for _, f in sample)
        return own[math.ceil(quality.QUANTILE * len(own)) - 1] + quality.MARGIN if own else math.inf

    return [bool(r[1]) and all(figures[r[1]][k] <= threshold(r[2], k) + 1e-9 for k in range(3)) for r in rows]


def plain_redaction(text):
    if text is None:
        return None
    spans = sorted((m.start(), k, m.end()) for k, (_, e, g, n) in enumerate(secret_scan.RULES) for m in re.finditer(e, text) if len(m[g]) >= n)
    out, at = "", 0
    for begin, _, end in spans:
        if begin >= at:
            out += text[at:begin] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline_is_that_of_plain_python(spark, tmp_path):
    from .test_text_operators import plain_entries

    pipeline = pytest.importorskip("corpus_pipeline")
    from lidarlake.llm import packing, tokens

    rnd = random.Random(12)
    vocabulary = ["alphabet", "betatron", "gammaray", "deltawing", "épsilon", "of", "the", "and", "zetapotential", "etalon"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    rows = [(i, text(30 + i) + " password=abcdefgh1234" * (i % 5 == 1), rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", None])) for i in range(90)]
    rows += [(100 + i, " ".join([*rows[i][1].split()[:-1], "changed"]), "en", "a") for i in range(0, 30, 3)]  # near copies
    rows += [(200, text(150) + " password=abcdefgh1234 " + text(3), "en", "b"), (201, "qzx kjv 0123 #%& " * 30, "en", "a"), (202, None, "en", "a"), (203, "", None, None)]
    rows += [(None, rows[5][1], "en", "a"), (None, text(161), "fr", "b"), (7, text(173), "en", "a"), (204, text(180) + " " + " ".join("".join(rnd.choice("qzxjkv0123#%") for _ in range(40)) for _ in range(10)), "en", "b")]
    trusted = [i for i in range(90) if i % 9]
    schema = "doc_id long, text string, lang string, source string, n_chars int, row string, block string, kind int"
    spark.createDataFrame([(i, t, lang, s, len(t or ""), "r", "b", 1) for i, t, lang, s in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in trusted] + [(201, 0, 0), (88, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = {i for i in trusted if i != 88}
    calibrates = {r[0] for r in spark.createDataFrame([(i,) for i in sorted(good)], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality.CALIBRATE))).collect() if r[1] == 0}

    kept = [r for r, ok in zip(rows, plain_quality(rows, good, calibrates), strict=True) if ok]
    assert 201 not in {r[0] for r in kept} and 204 not in {r[0] for r in kept} and len(kept) > 70
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (r[1].lower().split() for r in kept)]
    root = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root = [root[b] if x == root[a] else x for x in root]
    groups = defaultdict(list)
    for k, r in enumerate(kept):
        groups[root[k]].append(r)
    distinct = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    clean = [(i, plain_redaction(t), lang, s) for i, t, lang, s in distinct]
    assert any("[SECRET]" in r[1] for r in clean)
    draws = {(r[0], r[1]): r[2] / 2**20 for r in spark.createDataFrame([(r[0], r[3]) for r in clean], "doc_id long, source string").select("doc_id", "source", F.pmod(F.xxhash64(F.lit(1), "doc_id", "source"), F.lit(1 << 20))).collect()}
    taken = Counter()
    of = {(i, s, len(t.split())): t for i, t, _, s in clean}
    assert len(of) == len(clean)
    for (i, s, size), n, copies, p in plain_entries([(i, s, t) for i, t, _, s in clean]):
        assert n == 1
        taken[i, of[i, s, size]] += int(copies) + (1 if p == 1 or 0 < p < 1 and draws[i, s] < p else 0)
    encoder = tokens.encoder(tokens.default_path())
    want = Counter()
    for (i, t), n in taken.items():
        ids, at = encoder.encode(t) + bytes(4), 0
        for length in packing.cuts(len(ids) // 4):
            want[i, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), len(ids) // 4] += n
            at += length
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == +want
    ends = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= packing.CAPACITY


def test_pipeline_leaves_its_last_input_only(spark, sf_dir):
    import corpus_pipeline
    from lidarlake import runtime

    runtime.release(spark)
    before = {d.name for d in spark.catalog.listDatabases()}, len(spark.catalog.listTables())
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0
    kept = [p for p in runtime.PATHS if os.path.exists(p.removeprefix("file:"))]
    assert len(kept) == 1 and not runtime.TABLES
    assert ({d.name for d in spark.catalog.listDatabases()}, len(spark.catalog.listTables())) == before
    runtime.release(spark)
    assert not os.path.exists(kept[0].removeprefix("file:"))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_blocks_are_bounded_in_rows_and_bytes(spark):
    from lidarlake.llm import blocks

    numbers = [0, 1, 7 << 32, (7 << 32) + 5, 2**62 + 11, 123456789]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", F.pmod(F.hash("n"), F.lit(17)).alias("b")).collect()
    assert all(blocks.bucket_of(r["n"], 17) == r["b"] for r in got)

    empty = spark.range(100_000).repartition(1).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    held = blocks.store(empty, "text", id=("doc_id", "long")).select(F.size("ids").alias("n")).collect()
    assert sum(r["n"] for r in held) == 100_000 and max(r["n"] for r in held) <= blocks.BLOCK_ROWS
    wide = spark.range(3000).repartition(1).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.repeat(F.lit("w"), 10_000).alias("extra"))
    table = blocks.store(wide, "text", id=("doc_id", "long"))
    assert max(r["n"] for r in table.select(F.size("ids").alias("n")).collect()) < 600
    back = blocks.taken(table, table.select("block", F.posexplode("ids").alias("pos", "i")).filter("i = 17").withColumn("n", F.lit(3)), wide, "text")
    assert [(r["doc_id"], len(r["extra"])) for r in back.collect()] == [(17, 10_000)] * 3


def test_the_driver_keeps_no_garbage(spark, monkeypatch):
    tidied = []
    for module in (quality, quality.words):
        monkeypatch.setattr(module, "tidy", lambda s: tidied.append(s))
    d = frame(spark, [(i, f"some words of text {i} and {i % 7} more", "en") for i in range(120)])
    assert quality.Judged(d, d.select("doc_id")).losses.count() == 120
    assert len(tidied) == quality.words.PASSES + quality.ROUNDS


def test_scoring_keeps_no_counts(spark, monkeypatch):
    rows = [(i, f"some words of text {i} and {i % 7} more", "en") for i in range(120)]
    joined, left = quality.words.joined, []

    def seen(*a):
        left.append([spark.read.parquet(p).columns for p in runtime.PATHS[before:] if os.path.exists(p.removeprefix("file:")) and glob.glob(f"{p.removeprefix('file:')}/*.parquet")])
        return joined(*a)

    before = len(runtime.PATHS)
    monkeypatch.setattr(quality.words, "joined", seen)
    d = frame(spark, rows)
    assert quality.Judged(d, d.select("doc_id")).losses.count() == 120
    # of the byte model nothing but its table is left when blocks are scored
    assert [c for c in left[-1] if "g" in c] == [["g", "logp"]]
