"""Operators on single documents against brute force, with the odd rows each must stand."""

import hashlib
import math
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lidarlake.llm import language_id, media, mixing, packing, pii, repetition, secret_scan, sharding, tokens, tokens64

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, hash string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", sources[i] if sources else "s", 1, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = ["", None, " ", "\n\n", "a", "ß" * 3000, "x " * 40_000, "one two one two", "\x1c \x85 \xa0", "漢字 🙂 a@b.co 🙂", "a b c d e f g h " * 3]


# --- media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 157, 158, 4095, 4096, 4097, 40_000])
def test_stream_round_trip(n):
    data = random.Random(n).randbytes(n)
    s = media.demux(media.mux(data))
    assert s.payload == data and s.continuity_errors == 0
    assert s.pts == [i * media.TICKS for i in range(max(1, -(-n // media.UNIT_BYTES)))] and s.random_access == list(range(0, len(s.pts), media.RAP_EVERY))


def test_damaged_streams_are_told():
    m = bytearray(media.mux(bytes(9000)))
    assert len(m) % 188 == 0
    lost = m[: 188 * 5] + m[188 * 6 :]
    assert media.demux(bytes(lost)).continuity_errors == 1
    m[7] ^= 1
    with pytest.raises(ValueError):
        media.demux(bytes(m))
    with pytest.raises(ValueError):
        media.demux(bytes(m[1:]))


def test_media_digests(spark):
    got = {r["doc_id"]: r for r in media.digests(docs(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.decode(media.encode(docs(spark, ["hello"]))).first()["payload"].rstrip(b"\0") == b"hello"
    assert media.digests(docs(spark, [])).count() == 0


def test_legal_streams_are_read():
    data = random.Random(1).randbytes(20_000)
    m = media.mux(data)
    packets = [m[i : i + 188] for i in range(0, len(m), 188)]
    at = next(i for i, p in enumerate(packets) if i > 6 and p[1] & 0x1F == 1 and p[3] & 0x30 == 0x10)
    empty = packets[at][:1] + bytes((packets[at][1] & 0x1F,)) + packets[at][2:3] + bytes((0x20 | packets[at][3] & 15, 183, 0)) + b"\xff" * 182
    s = media.demux(b"".join([*packets[: at + 1], packets[at], empty, *packets[at + 1 :]]))  # sent twice, then one without payload
    assert s.payload == data and s.continuity_errors == 0
    thrice = media.demux(b"".join([*packets[: at + 1], packets[at], packets[at], *packets[at + 1 :]]))
    assert thrice.continuity_errors == 1
    # a program table of two packets: many descriptors before the streams
    info = b"\x05\xc0" + bytes(192)
    section = media._section(2, media.PROGRAM, struct.pack(">HH", 0xE000 | media.DATA_PID, 0xF000 | len(info)) + info + struct.pack(">BHH", media.PRIVATE_TYPE, 0xE000 | media.DATA_PID, 0xF000))
    first = struct.pack(">BHB", media.SYNC, 0x4000 | media.PMT_PID, 0x10) + b"\0" + section[:183]
    second = (struct.pack(">BHB", media.SYNC, media.PMT_PID, 0x11) + section[183:]).ljust(188, b"\xff")
    small = media.mux(b"x" * 100)
    assert media.demux(small[:188] + first + second + small[376:]).payload == b"x" * 100


def test_streams_of_odd_rows(spark):
    d = docs(spark, ["same", "same", None], ids=[None, 4, 4])
    got = media.digests(d).collect()
    assert len(got) == 3 and len({r["media_sha256"] for r in got if r["n_bytes"]}) == 1
    stored = media.encode(d).unionByName(spark.createDataFrame([(9, 0, None)], "doc_id long, n_bytes long, media binary"))
    back = media.decode(stored).collect()
    assert sum(r["payload"] is None for r in back) == 1 and sum((r["payload"] or b"").startswith(b"same") for r in back) == 2
    assert media.encode(docs(spark, [])).count() == 0 == media.decode(stored.limit(0)).count()


# --- repetition


def brute_coverage(t):
    """Coverage by n and of lines, by windows compared as tuples."""
    words = WORD.findall(t)
    chars, out = sum(map(len, words)), []
    for n in repetition.MAX_COVERAGE:
        c = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        marked = {k for i in range(len(words) - n + 1) if c[tuple(words[i : i + n])] > 1 for k in range(i, i + n)}
        out.append(sum(len(words[k]) for k in marked) / chars if chars else 0.0)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += sum(map(len, WORD.findall(line))) if line in seen else 0
            seen.add(line)
    return out, dup / chars if chars else 0.0


def test_coverages_and_verdicts(spark):
    rnd = random.Random(11)
    texts = list(ODD)
    for _ in range(120):
        words = ["".join(rnd.choice("abcé#") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(5, 40))]
        part = rnd.sample(words, min(len(words), rnd.randint(2, 12)))
        texts.append(" ".join(words + part * rnd.randint(0, 3)) + "\n" + " ".join(words[:4]) + ("\n" + " ".join(words[:4])) * rnd.randint(0, 3))
    for r in repetition.rules(docs(spark, texts)).collect():
        t = texts[r["doc_id"]] or ""
        cover, lines = brute_coverage(t)
        assert [r[f"coverage_{n}"] for n in repetition.MAX_COVERAGE] == pytest.approx(cover) and r["line_coverage"] == pytest.approx(lines)
        words = WORD.findall(t)
        symbols = len(re.findall(r"[#*$%&|<>]", t)) > repetition.MAX_SYMBOLS * sum(map(len, words))
        bad = r["base_failed"] or lines > repetition.MAX_LINE_COVERAGE or symbols or any(c > m for c, m in zip(cover, repetition.MAX_COVERAGE.values(), strict=True))
        assert r["kept"] == (not bad)
    again = repetition.rules(docs(spark, ["a b", "a b", None], ids=[None, 1, 1])).collect()
    assert len(again) == 3 and repetition.rules(docs(spark, [])).count() == 0


def brute_repeats(words):
    c = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({k for i in range(len(words) - 7) if c[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)})


def test_repetition_counts(spark):
    rnd = random.Random(3)
    texts = ODD + [" ".join(rnd.choice("ab cd") for _ in range(rnd.randint(0, 60))) + "\n" * rnd.randint(0, 2) for _ in range(150)]
    texts += ["l i n e\n" * 3 + " \n \n", "# $ a*b <x> |"]
    for r in repetition.rules(docs(spark, texts)).collect():
        t = texts[r["doc_id"]] or ""
        words = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, brute_repeats(words))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t[:60]
        failed = len(words) < 20 or 100 * want[4] > 30 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_coverage_is_that_of_repeated_windows():
    words = "a b c d e x y z a b c d e".split()
    *_, cover, _ = repetition.measures(" ".join(words))
    assert cover[0] == 10 / 13 and cover[1] == 0


# --- personal data


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_anchors_find_what_the_patterns_find():
    rnd = random.Random(5)
    for i in range(20_000):
        t = "".join(rnd.choice("0123456789" * 2 + "..--  ++@@ab(0" if i % 3 else "0123456789 -") for _ in range(rnd.randint(0, 50)))
        assert [x for x in pii.find(t) if x[0] in pii.KINDS[:4]] == base_spans(t), t


def test_more_kinds_and_redaction(spark):
    t = "see https://bob:pw@host/x, IBAN DE89 3704 0044 0532 0130 00; SSN: 123-45-6789 mail a.b@c.de"
    assert {k for k, _, _ in pii.find(t)} == {"url_credentials", "iban", "identifier", "email"}
    assert "a.b@c.de" not in pii.redact(t) and pii.redact(None) is None
    got = {r["doc_id"]: r for r in pii.summaries(docs(spark, [*ODD, t])).collect()}
    assert got[9]["spans"] == "email:5:11" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[len(ODD)]["n_email"] == 1
    assert pii.spans(docs(spark, [t])).count() == 4 and pii.spans(docs(spark, [])).count() == 0


def test_cues_in_any_case_and_filling_words(spark):
    for t, value in (("Tax ID: 123-45-6789", "123-45-6789"), ("License No: 1234567", "1234567"), ("license no 1234567", "1234567"), ("Passport No: X1234567", "X1234567"), ("Account number is 12345678", "12345678"), ("ACCOUNT Number: 12345678", "12345678")):
        assert [t[a:b] for k, a, b in pii.find(t) if k == "identifier"] == [value], t
    t = "paid to DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not to DE89370400440532013001 or XDE89370400440532013000"
    assert [t[a:b] for k, a, b in pii.find(t) if k == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    got = pii.summaries(docs(spark, ["a@b.co", "a@b.co", None], ids=[None, 3, 3])).collect()
    assert sorted(r["n_email"] for r in got) == [0, 1, 1] and pii.summaries(docs(spark, [])).count() == 0


# --- secrets


@pytest.mark.parametrize("kind,expression,group,least", secret_scan.RULES)
def test_trigram_queries_hold_for_every_match(kind, expression, group, least):
    samples = {"assign": ["Password = x", "api_key:'y", "PASSWD=z", "apikey=1", "token:t", "secret=s"], "access": ["AKIAX"], "hex": ["0" * 32], "code_host": ["ghp_" + "a" * 36], "chat": ["xoxb-" + "1" * 10], "maps": ["AIza" + "b" * 35], "web_token": ["eyJa.eyJb.c"], "private_key": ["-----BEGIN RSA PRIVATE KEY-----"]}
    for s in samples[kind]:
        assert re.search(expression, s)
        grams = {s.lower()[i : i + 3] for i in range(len(s) - 2)}
        assert any(a <= grams for a in secret_scan.trigram_query(expression)), s


def test_secret_spans(spark):
    texts = [*ODD, "é Password: abcdefgh token=short", "AKIA" + "B" * 12 + " AKIAX", "f" * 31 + " " + "0a" * 16 + "g", "🙂 secret='" + "ab12" * 10 + "' -----BEGIN RSA PRIVATE KEY-----", "api_key=key=password=1234567890"]
    for r in secret_scan.summaries(docs(spark, texts)).collect():
        t = texts[r["doc_id"]] or ""
        want = sorted((m.start(), k, m.end()) for k, (_, e, g, n) in enumerate(secret_scan.RULES) for m in re.finditer(e, t) if len(m[g]) >= n)
        told = lambda xs: ",".join(f"{secret_scan.RULES[k][0]}:{s}:{e}" for s, k, e in xs)
        assert r["spans"] == told(want)
        assert r["base_sha256"] == hashlib.sha256(told([x for x in want if x[1] < 3]).encode()).hexdigest()
        assert r["n_assign"] == sum(k == 0 for _, k, _ in want)


def test_candidates_reach_texts_either_way(spark, monkeypatch):
    rows = docs(spark, [*ODD, "a token = abcdefghij b", "Token=abcdefghij", "token", None, "xoxb-1234567890"] * 3, ids=[None, 7, *range(14)] * 3)
    told = lambda: sorted((tuple(r) for r in secret_scan.summaries(rows).collect()), key=repr)
    want = told()
    monkeypatch.setattr(secret_scan, "BROADCAST_ROWS", 0)
    assert told() == want and sum(r[1] for r in want) == 6


def test_many_secrets_in_one_text_and_many_rows_without_an_id(spark):
    text = "".join(f"é{'z' * (i % 7)} password={'k' * (8 + i % 5)};" for i in range(3000))
    r = secret_scan.summaries(docs(spark, [text])).first()
    assert r["n_assign"] == 3000 and r["spans"].split(",") == [f"assign:{m.start()}:{m.end()}" for m in re.finditer(secret_scan.RULES[0][1], text)]
    hot = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "token=abcdefghij").otherwise(F.concat(F.lit("plain "), "id")).alias("text"))
    assert secret_scan.summaries(hot).filter("n_assign = 1").count() == 5000


def test_secrets_are_those_of_the_sql(spark):
    import duckdb

    d = docs(spark, [*ODD, "é Password: abcdefgh token=short", "AKIA" + "B" * 12, "0a" * 16 + " 0a", "api_key=key=password=1234567890"])
    documents = d.toPandas()  # noqa: F841
    want = duckdb.sql(secret_scan.ORACLE)
    names = sorted(want.columns)
    assert sorted(repr([r[c] for c in names]) for r in secret_scan.summaries(d).collect()) == sorted(repr([r[want.columns.index(c)] for c in names]) for r in want.fetchall())


def test_redaction_keeps_rows_and_columns(spark):
    d = docs(spark, ["a token = abcdefghij b", None, "clean"], ids=[None, 1, 1])
    got = secret_scan.redact(d)
    assert got.columns == d.columns and sorted(str(r["text"]) for r in got.collect()) == ["None", "a [SECRET] b", "clean"]
    assert secret_scan.redact(docs(spark, [])).count() == 0


# --- sharding


def test_shards_fit_and_split_no_further_than_needed(spark):
    rnd = random.Random(1)
    d = docs(spark, ["x" * rnd.randint(0, 300) for _ in range(400)] + [None, "y" * 5000])
    rows = sharding.shards(d, max_bytes=4000).collect()
    assert len(rows) == 402
    size = Counter()
    for r in rows:
        size[r["local_depth"], r["bucket"], r["page"]] += r["bytes"]
    for r in rows:
        assert size[r["local_depth"], r["bucket"], 0] == r["shard_bytes"] and (r["shard_bytes"] <= 4000 or r["bytes"] == 5000)
    # a bucket's buddy and it would not have fitted together
    for depth, bucket, _ in size:
        if depth and sum(n for (d2, b2, _), n in size.items() if d2 >= depth and b2 >> (d2 - depth) >> 1 == bucket >> 1) <= 4000:
            raise AssertionError((depth, bucket))


def test_one_key_is_cut_into_pages(spark):
    rows = sharding.shards(docs(spark, ["z" * 100] * 50 + ["w" * 10], ids=[7] * 50 + [None]), max_bytes=1000).collect()
    pages = Counter(r["page"] for r in rows if r["doc_id"] == 7)
    assert sorted(pages) == [0, 1, 2, 3, 4] and set(pages.values()) == {10} and len(rows) == 51
    assert sharding.shards(docs(spark, [])).count() == 0
    assert sharding.directory(sharding.shards(docs(spark, ["a", "b"]))).first()["documents"] == 2


# --- mixing


def test_targets_are_shared_by_weight_and_capped():
    t = mixing.targets({"a": 100, "b": 10, None: 50, "c": 1000})
    assert sum(t.values()) == pytest.approx(1.5 * 1160) and t["b"] == 20 and all(t[s] <= 2 * n for s, n in {"a": 100, "b": 10, None: 50, "c": 1000}.items())


def test_word_counts():
    assert mixing.count_words(pa.array([*ODD, "a\tb  c "])).tolist() == [len((t or "").encode().split()) for t in [*ODD, "a\tb  c "]]
    assert mixing.count_words(pa.array(["x", "a b", "c"]).slice(1, 1)).tolist() == [2]


def test_pivot_keeps_the_sum_and_is_unbiased():
    sizes, total = [5, 1, 8, 3, 0, 9], np.zeros(6)
    for seed in range(3000):
        p = mixing.pivot(list(range(6)), sizes, [0.3] * 6, seed)
        assert sum(0 < x < 1 for x in p) <= 1 and sum(x * w for x, w in zip(p, sizes, strict=True)) == pytest.approx(0.3 * sum(sizes))
        total += p
    assert np.allclose(total[[0, 1, 2, 3, 5]] / 3000, 0.3, atol=0.04)


def plain_entries(rows, seed=0):
    """((doc_id, source, size), rows, copies, rest) of rows (doc_id, source, text) with exact numbers, one bucket a source."""
    size = [(i, s, len(WORD.findall(t or ""))) for i, s, t in rows]
    total = Counter()
    for _, s, n in size:
        total[s] += n
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight, goal, open_ = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, {}, set(names)
    while open_:
        unit = (Fraction(3, 2) * sum(total.values()) - sum(goal.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= 2 * total[s]}
        goal |= {s: Fraction(2 * total[s]) for s in full} if full else {s: unit * weight[s] for s in open_}
        open_ = open_ - full if full else set()
    for s in names:
        entries = sorted(Counter(x for x in size if x[1] == s).items(), key=lambda e: (-e[0][2], e[0][0] is None, e[0][0]))
        mass = [goal[s] / total[s] * n if total[s] else Fraction(0) for _, n in entries]
        whole, p, held = [m // 1 for m in mass], [m % 1 for m in mass], None
        for j, ((i, _, w), _) in enumerate(entries):
            if w == 0:
                p[j] = Fraction(0)
            elif 0 < p[j] < 1 and held is None:
                held = j
            elif 0 < p[j] < 1:
                k, wk = held, entries[held][0][2]
                up, down = min((1 - p[k]) * wk, p[j] * w), min(p[k] * wk, (1 - p[j]) * w)
                move = up if mixing._uniform(entries[k][0][0] or 0, i or 0, seed * 64) * float(up + down) < down else -down
                p[k], p[j] = p[k] + move / wk, p[j] - move / w
                held = next((x for x in (k, j) if 0 < p[x] < 1), None)
        for (e, n), c, x in zip(entries, whole, p, strict=True):
            yield e, n, c, x


def plain_mix(rows):
    """(doc_id, source, size, copies, taken) of each row."""
    out = []
    for (i, s, w), n, c, x in plain_entries(rows):
        copies, part = c + (1 if x == 1 else 0), round(float(x) * w) if 0 < x < 1 else 0
        for at in range(n):
            own = (at + 1) * copies // n - at * copies // n
            out.append((i, s, w, int(own), int(own * w + (part if at == 0 else 0))))
    return Counter(out)


def test_mix_is_that_of_exact_numbers(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([i, None, 5]) if i % 3 == 0 else i, rnd.choice(["a", "b", "é", None]), rnd.choice([None, "", "w " * rnd.randint(1, 12)])) for i in range(150)]
    d = docs(spark, [t for *_, t in rows], sources=[s for _, s, _ in rows], ids=[i for i, *_ in rows])
    got = Counter((r["doc_id"], r["source"], r["size"], r["copies"], r["taken"]) for r in mixing.mix(d).collect())
    assert got == plain_mix(rows)
    again = Counter()
    for r in mixing.repeat(d).collect():
        again[r["source"]] += len((r["text"] or "").split())
    goal = Counter()
    for (_, s, _, _, taken), n in plain_mix(rows).items():
        goal[s] += taken * n
    assert all(abs(again[s] - goal[s]) <= 12 for s in goal)


def test_many_rows_of_one_entry(spark):
    # one id, and none, on a third of the rows each; more rows than a block holds
    d = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("two "), "id").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    got = mixing.mix(d).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most"), F.count("*").alias("rows")).collect()
    assert all(abs(r["n"] - r["target"]) <= 1 and r["most"] <= 2 and r["rows"] == 15_000 for r in got)
    assert abs(mixing.repeat(d).count() * 2 - sum(r["target"] for r in got)) <= 4


def test_targets_without_a_list_of_sources(spark):
    rnd = random.Random(3)
    per = {**{f"s{i:03}": rnd.randint(0, 1000) for i in range(300)}, None: 77}
    got = {r["source"]: r["target"] for r in mixing.planned(spark.createDataFrame([(s, n, 1) for s, n in per.items()], "source string, words long, rows long").repartition(5)).collect()}
    assert got.keys() == per.keys() and all(got[s] == pytest.approx(x) for s, x in mixing.targets(per).items())


def test_mix_meets_targets_and_agrees_again(spark):
    rnd = random.Random(2)
    texts = ["w " * rnd.randint(0, 50) for _ in range(600)] + [None]
    d = docs(spark, texts, sources=[rnd.choice(["a", "a", "a", "b", "c", None]) for _ in texts])
    runs = [sorted(map(tuple, mixing.mix(x, bucket_rows=32, fan_in=3).collect()), key=repr) for x in (d, d.repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == 601
    taken, target = Counter(), {}
    for _, source, size, _, goal, copies, n in runs[0]:
        assert copies * size <= n <= 2 * size
        taken[source] += n
        target[source] = goal
    assert all(abs(taken[s] - g) <= 1 for s, g in target.items())
    out = mixing.repeat(d)
    assert out.columns == d.columns and abs(sum(len((r["text"] or "").split()) for r in out.collect()) - sum(target.values())) < 200
    assert mixing.mix(docs(spark, [])).count() == 0


# --- tokens and packing


def test_ids_are_those_of_the_tokenizer():
    e = tokens.Encoder(tokens.default_path())
    rnd = random.Random(0)
    texts = [t for t in ODD if t] + ["it's I'LL 'tis", "²³ ½ a1b2", "<|endoftext|> hi", "a \n b\n\n c ", " a  b"]
    texts += ["".join(rnd.choice("ab1'sté²  \n\t.,$\xa0\x85\x1cÀß漢") for _ in range(rnd.randint(0, 30))) for _ in range(1000)]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t[:50]


def test_pieces_cover_documents_and_fill_sequences(spark):
    rnd = random.Random(4)
    texts = [*ODD, *("".join(rnd.choice("abcdef ") for _ in range(rnd.randint(0, 4000))) for _ in range(300))]
    rows = packing.pack(docs(spark, texts), with_ids=True).collect()
    e = tokens.encoder(tokens.default_path())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
    for i, t in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        assert b"".join(p["ids"] for p in parts) == (e.encode(t) if t else b"") + bytes(4) and parts[0]["doc_tokens"] == sum(p["length"] for p in parts)
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.CAPACITY
    assert sum(r["length"] for r in rows) > 0.95 * packing.CAPACITY * (len(by_seq) - 4)
    assert packing.pack(docs(spark, [])).count() == 0


def test_bins_of_a_class_hold_a_fixed_count():
    bins = packing.Bins(0, 1024)
    out = [x for k in range(10) for x in bins.add((k, 0, 300))]
    assert Counter(x[3] for x in out) == {0: 3, 1: 3, 2: 3} and len(list(bins.rest())) == 1
    for n in range(1, 3000):
        assert sum(packing.cuts(n)) == n
        # a cut leaves no crumb
        assert min(packing.cuts(n)[n // packing.CAPACITY :], default=n) >= min(n % packing.CAPACITY or n, packing.LEAST)


def test_odd_rows_are_packed_as_often_as_they_occur(spark):
    rows = packing.pack(docs(spark, ["hello world", "hello world", None, "x " * 3000], ids=[None, None, 5, 5])).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows if r["doc_id"] is None) == {(None, 0, rows[0]["ids_crc32"] if rows[0]["doc_id"] is None else next(r["ids_crc32"] for r in rows if r["doc_id"] is None)): 2}
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == sum({(r["doc_tokens"]) for r in rows if r["doc_id"] == 5}) and packing.pack(docs(spark, [])).count() == 0


# --- language


def test_gradients_match_differences():
    net = language_id.Network(["a", "b"], 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    words, labels = [b"hello", b"ab", b"xyz"], np.array([0, 1, 1])
    _, g = net.gradients(words, labels)
    for k, at in (("E", (ord("l"), 3)), ("Wf", (2, 30)), ("Ub", (4, 50)), ("bf", (7,)), ("V", (5, 1)), ("Uf", (3, 10))):
        old, losses = net.w[k][at], []
        for step in (2e-3, -2e-3):
            net.w[k][at] = old + step
            losses.append(net.gradients(words, labels)[0])
        net.w[k][at] = old
        assert (losses[0] - losses[1]) / 4e-3 == pytest.approx(g[k][at], rel=2e-2, abs=1e-4)


def test_languages_held_out(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.predict(d, language_id.fit(d)).join(d, "doc_id").collect()
    held = [r for r in got if r["held_out"] and len(r["text"]) > 40]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_odd_texts_are_undetermined(spark):
    net = language_id.Network(["x", "y"])
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs(spark, [None, "", "12 !!", "½ ² Ⅷ", "漢字", "z" * 999]), net).collect()}
    assert [got[i] for i in range(4)] == ["und"] * 4 and got[4] != "und" and got[5] != "und"
    assert language_id.predict(docs(spark, ["a"]), language_id.fit(docs(spark, []))).first()["lang_pred"] == "und"
    assert language_id.predict(docs(spark, []), net).count() == 0


def scalar_distribution(net, text):
    """The mean label distribution of a text's bytes, number by number: every core with its context on either side."""
    w, h = {k: v.astype(float).tolist() for k, v in net.w.items()}, language_id.HIDDEN
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def states(d, data):
        state, out = [0.0] * h, []
        for byte in data:
            e = w["E"][byte]
            a = [sum(x * r[k] for x, r in zip(e, w["W" + d], strict=True)) + w["b" + d][k] for k in range(3 * h)]
            u = lambda s, k: sum(x * r[k] for x, r in zip(s, w["U" + d], strict=True))  # noqa: B023, E731
            z, r = ([sigmoid(a[g * h + k] + u(state, g * h + k)) for k in range(h)] for g in (0, 1))
            rs = [x * y for x, y in zip(r, state, strict=True)]
            n = [math.tanh(a[2 * h + k] + u(rs, 2 * h + k)) for k in range(h)]
            state = [zk * s + (1 - zk) * nk for zk, s, nk in zip(z, state, n, strict=True)]
            out.append(state)
        return out

    data, sums = text.encode(), [0.0] * len(net.labels)
    for begin in range(0, len(data), language_id.CORE):
        end = min(len(data), begin + language_id.CORE)
        start = max(0, begin - language_id.WARM)
        window = data[start : end + language_id.WARM]
        f, b = states("f", window), states("b", window[::-1])[::-1]
        for t in range(begin - start, end - start):
            s = [sum(x * r[k] for x, r in zip(f[t] + b[t], w["V"], strict=True)) + w["c"][k] for k in range(len(sums))]
            s = [math.exp(x - max(s)) for x in s]
            sums = [x + y / sum(s) for x, y in zip(sums, s, strict=True)]
    return [x / len(data) for x in sums]


def test_predictions_are_those_of_a_scalar_network(spark):
    net = language_id.Network(["x", "y", "z"], 3)
    texts = ["a", "über den Wolken", "the cat " * 40, "漢字" * 200, "q" * 257, "two words"]
    for r in language_id.predict(docs(spark, texts), net).collect():
        p = scalar_distribution(net, texts[r["doc_id"]])
        assert r["score"] == pytest.approx(max(p), abs=1e-4) and r["lang_pred"] == net.labels[p.index(max(p))]


def test_the_sample_is_bounded_whatever_the_ids(spark):
    for id_ in (F.lit(None).cast("long"), F.lit(1).cast("long"), F.col("id")):
        d = spark.range(4000).select(id_.alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("lang"))
        got = language_id.sample(d, 50)
        assert {k: len(t) for k, t in got.items()} == {"x": 50, "y": 50}
    copies = spark.range(4000).select("id", F.lit("one text").alias("text"), F.lit("x").alias("lang")).withColumnRenamed("id", "doc_id")
    assert {k: len(t) for k, t in language_id.sample(copies, 50).items()} == {"x": 1}


def test_languages_of_odd_rows(spark):
    net = language_id.Network(["x", "y"], 5)
    d = docs(spark, ["same text", "same text", None], ids=[None, 3, 3])
    got = language_id.predict(d, net).collect()
    assert len(got) == 3 and len({(r["lang_pred"], r["score"]) for r in got if r["lang_pred"] != "und"}) == 1
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)


def test_hashing_words_takes_little_room(monkeypatch):
    text = "a word and others of some length " * 60_000
    monkeypatch.setattr(tokens64, "_POWERS", {})
    tracemalloc.start()
    found, counts = tokens64.words([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.tolist() == [420_000] and peak < 14 * len(text)
    assert (found.reshape(-1, 7) == tokens64.words([text[:33]])[0]).all()


def test_network_reads_as_it_learns(monkeypatch):
    r, net = np.random.default_rng(0), language_id.Network(["a", "b"])
    for d in "fb":
        net.w[f"b{d}"] = net.w[f"b{d}"] + (r.standard_normal(3 * language_id.HIDDEN) * 60).astype(np.float32)
    x, live = r.integers(0, 256, (50, 40)).astype(np.uint8), np.ones((50, 40), bool)
    expected = [net._pass(d, x, live, False)[0] for d in "fb"]
    monkeypatch.setattr(language_id.np, "tanh", None)  # twice as slow as exp; only training takes it
    with np.errstate(all="raise", under="ignore"):
        for d, states in zip("fb", expected, strict=True):
            assert np.abs(net._states(d, x, None) - states).max() < 1e-5


def test_network_reads_no_byte_in_vain_and_takes_no_exp_for_its_gates(monkeypatch):
    net, read, taken = language_id.Network(["a", "b"], 2), [], []
    texts = [b"some words " * 200, b"short", b"x" * 513]
    labels = [net.probabilities([t])[0] for t in texts]
    reader, exp = language_id.Network._reader, np.exp

    def counted(self, d, n):
        step = reader(self, d, n)
        return lambda codes: read.append(len(codes)) or step(codes)

    monkeypatch.setattr(language_id.Network, "_reader", counted)
    monkeypatch.setattr(language_id.np, "exp", lambda x, **k: taken.append(x.size) or exp(x, **k))
    assert np.abs(net.probabilities(texts) - np.array(labels)).max() < 1e-6
    size, cores = sum(map(len, texts)), sum(-(-len(t) // language_id.CORE) for t in texts)
    # a byte is read once in each direction, and so is the context of a core; exp is left for the labels of the cores' bytes
    assert sum(read) <= 2 * (size + cores * 2 * language_id.WARM) and sum(taken) <= 2 * len(net.labels) * language_id.CORE * cores


@pytest.mark.parametrize("most", [1.0, 30.0, 200.0, 3000.0])
def test_gates_by_squares(most):
    t = np.linspace(-most, most, 4001)
    squares = max(language_id.HALVINGS, int(np.ceil(np.log2(most / language_id.FRACTION))))
    x = (t / (6 * 2**squares)).astype(np.float32)
    language_id._logistic(x, np.float32(2), squares, np.empty_like(x))
    assert np.abs(x - (1 - np.tanh(t / 2))).max() < 2e-6 * max(1, 2**squares / 32)


def test_sorting_hashes_takes_little_room():
    h = np.random.default_rng(0).integers(0, 1 << 64, 500_000, np.uint64)
    h[::3] = h[0]
    tracemalloc.start()
    order = tokens64.by_hash(h)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (order == np.argsort(h, kind="stable")).all() and peak < 2.7 * h.nbytes
    assert not len(tokens64.by_hash(h[:0]))
