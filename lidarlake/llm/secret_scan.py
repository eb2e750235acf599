"""Secret scans through a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean trigram query is derived (every match must hold all trigrams of at least
one of its alternatives). The index holds, for each trigram that a query can ask for, the texts that contain it, by a
64-bit hash of the text; it is written to the shared folder. Postings are intersected per text, and only the candidates
of a rule are searched with its expression. A rule whose query is empty (hexadecimal runs have no mandatory trigram)
scans every document. Trigrams are of the lower-cased text, so the index serves rules in either case.

Texts are not shuffled: the list of candidates goes to them by broadcast up to BROADCAST_ROWS texts (about 100 bytes
each). Beyond, rows whose text holds an indexed trigram meet the list by a join on the text's hash, and no others move.

Spans come from the text between matches: split and extract-all give the same cuts, so running lengths are positions.
They are summed by pages of PAGE matches, so that a text with many secrets is not copied for each of them.

Null text is the empty text. Equal texts, and texts with one hash, share one entry of the index, which can only add
candidates; each row is then searched by itself, so ids may be null or repeated. Spans that begin together are in the
order of their kinds. Texts of any length are scanned whole. Empty tables give empty tables; extra columns are kept by
`redact`, whatever their names, and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .common import col, narrow

# Kinds in their order, their expressions, the group that is measured, and its least length. The first
# three are the base rules. A web token begins where no character of one stands before it, so that a long run of such
# characters is read once.
TOKEN = "A-Za-z0-9_-"
LOOK_BEHIND = f"(?<![{TOKEN}])"
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("maps", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("web_token", LOOK_BEHIND + r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
)
BASE = 3
Query = frozenset  # of frozensets of trigrams: any of the alternatives, all of its trigrams
ALL: Query = frozenset({frozenset()})
#: Strings that a part of an expression may stand for, before it counts as unknown.
MOST_STRINGS = 64
#: Texts of the list of candidates that may be broadcast.
BROADCAST_ROWS = 200_000
#: Matches whose positions are summed together.
PAGE = 64


def _simplest(q: Query) -> Query:
    return frozenset(a for a in q if not any(b < a for b in q))


def _both(a: Query, b: Query) -> Query:
    return _simplest(frozenset(x | y for x in a for y in b))


def _of_strings(strings: frozenset) -> Query:
    return _simplest(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _strings_of_class(items: list) -> frozenset | None:
    out: set[str] = set()
    for op, arg in items:
        if op is K.LITERAL:
            out.add(chr(arg).lower())
        elif op is K.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def _analyse(parsed: list) -> tuple[frozenset | None, Query]:
    """The strings that a sequence can match, if they are few, and the query that its matches satisfy."""
    run, query, exact = frozenset({""}), ALL, True
    for op, arg in parsed:
        strings, inner = None, ALL
        if op is K.LITERAL:
            strings = frozenset({chr(arg).lower()})
        elif op is K.IN:
            strings = _strings_of_class(arg)
        elif op is K.SUBPATTERN:
            strings, inner = _analyse(arg[-1])
        elif op is K.BRANCH:
            parts = [_analyse(p) for p in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = frozenset().union(*(s for s, _ in parts))
            inner = _simplest(frozenset().union(*(q for _, q in parts)))
        elif op is K.MAX_REPEAT:
            least, most, body = arg
            s, q = _analyse(body)
            if s is not None and most == 1 and least == 0:
                strings = s | {""}
            elif s is not None and least == most and least <= 8:
                strings = reduce(lambda a, b: frozenset(x + y for x in a for y in b) if len(a) * len(b) <= MOST_STRINGS else frozenset(), [s] * least, frozenset({""})) or None
            inner = q if least else ALL
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in strings)
        else:
            query = _both(query, _of_strings(run))
            query = _both(query, inner)
            run, exact = strings if strings is not None else frozenset({""}), False
    query = _both(query, _of_strings(run))
    return (run if exact else None), query


def trigram_query(expression: str) -> Query:
    """The Boolean trigram query of an expression: any of these sets, all of its trigrams. {{}}: every document."""
    return _analyse(list(_parser.parse(expression)))[1]


def vocabulary(rules: tuple = RULES) -> list[str]:
    return sorted({t for r in rules for a in trigram_query(r[1]) for t in a})


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def index(docs: DataFrame, terms: list[str], text_col: str = "text") -> DataFrame:
    """The inverted index as postings (term, key): which texts, by their hash, contain which of the trigrams."""
    low = docs.select(_key(col(text_col)).alias("key"), F.lower(col(text_col).cast("string")).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(terms))))
    return low.select(F.explode(held).alias("term"), "key")


_WORD = 62


def candidates(postings: DataFrame, terms: list[str], rules: tuple = RULES) -> DataFrame:
    """(key, may): may[i] tells if rule i may match; texts that no indexed rule may match are left out."""
    words = range(-(-len(terms) // _WORD))
    place = {t: (i // _WORD, 1 << i % _WORD) for i, t in enumerate(terms)}
    masks = postings.groupBy("key").agg(*(F.bit_or(F.when(F.floor(F.col("term") / _WORD) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("term"), F.lit(_WORD)))).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words))

    def holds(alternative: frozenset) -> Column:
        need = [sum({b for w2, b in map(place.__getitem__, alternative) if w2 == w}) for w in words]
        return reduce(and_, (F.col(f"m{w}").bitwiseAND(F.lit(n).cast("long")) == F.lit(n).cast("long") for w, n in enumerate(need)), F.lit(True))

    queries = [trigram_query(r[1]) for r in rules]
    may = [F.lit(True) if q == ALL else reduce(or_, map(holds, sorted(q, key=sorted))) for q in queries]
    indexed = [m for m, q in zip(may, queries, strict=True) if q != ALL]
    return masks.filter(reduce(or_, indexed, F.lit(False))).select("key", F.array(*may).alias("may"))


_SPAN = "array<struct<s:int,k:int,e:int>>"


def _spans_of(k: int, text: str) -> Column:
    """Spans of rule k in a text column. Match i begins at the sum of what lies before it: gaps up to it and matches
    before it. These sums are made page by page: first of whole pages, then inside each page."""
    _, expression, group, least = RULES[k]
    e = F.lit(expression)
    whole = F.regexp_extract_all(F.col(text), e, F.lit(0))
    gaps, lengths = F.transform(F.split(F.col(text), expression, -1), F.length), F.transform(whole, F.length)
    measured = lengths if group == 0 else F.transform(F.regexp_extract_all(F.col(text), e, F.lit(group)), F.length)
    t = F.struct(gaps.alias("x"), lengths.alias("m"), measured.alias("g"))

    def plus(t: Column, begin: Column, n: Column, start: Column) -> Column:
        some = F.slice(F.arrays_zip(t["x"].alias("x"), t["m"].alias("m")), begin + 1, n)
        return F.aggregate(some, start, lambda acc, z: acc + z["x"] + z["m"])

    def found(t: Column) -> Column:
        count = F.size(t["m"])
        pages = F.sequence(F.lit(0), F.floor((count - 1) / PAGE).cast("int"))
        sums = F.transform(pages, lambda p: plus(t, p * PAGE, F.least(F.lit(PAGE), count - p * PAGE), F.lit(0)))
        offsets = F.aggregate(sums, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
        placed = F.transform(F.arrays_zip(pages.alias("p"), F.slice(offsets, 1, F.size(pages)).alias("at")), lambda z: page(t, count, z["p"], z["at"]))
        return F.filter(F.flatten(placed), lambda z: z["e"] >= 0)

    def page(t: Column, count: Column, p: Column, at: Column) -> Column:
        here = F.sequence(p * PAGE, F.least((p + 1) * PAGE, count) - 1)
        start = F.struct(at.alias("p"), F.array().cast(_SPAN).alias("a"))

        def step(acc: Column, i: Column) -> Column:
            begin = acc["p"] + F.get(t["x"], i)
            end = begin + F.get(t["m"], i)
            span = F.struct(begin.alias("s"), F.lit(k).alias("k"), F.when(F.get(t["g"], i) >= least, end).otherwise(F.lit(-1)).alias("e"))
            return F.struct(end.alias("p"), F.concat(acc["a"], F.array(span)).cast(_SPAN).alias("a"))

        return F.aggregate(here, start, step, lambda acc: acc["a"])

    # transform over a one-element array binds the three lists once
    return F.get(F.transform(F.array(t), lambda t: F.when(F.size(t["m"]) == 0, F.array().cast(_SPAN)).otherwise(found(t).cast(_SPAN))), F.lit(0))


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs as (row, spans): spans are (s, k, e), start, number of the rule, end, in order."""
    terms = vocabulary()
    postings = cut(index(docs, terms, text_col))
    may = cut(candidates(postings, terms).select(F.col("key").alias("may_key"), "may"))
    text = col(text_col).cast("string")
    rows = docs.select(F.struct(*(col(c) for c in docs.columns)).alias("row"), col(id_col).cast("long").alias("own_id"), F.coalesce(text, F.lit("")).alias("own_text"), _key(text).alias("own_key"))
    same = F.col("own_key") == F.col("may_key")
    if may.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(may), same, "left")
    else:
        indexed = reduce(or_, (F.contains(F.lower("own_text"), F.lit(t)) for t in terms))
        joined = rows.filter(indexed).join(may, same, "left").unionByName(rows.filter(~indexed).withColumn("may_key", F.lit(None).cast("long")).withColumn("may", F.lit(None).cast("array<boolean>")))
    none = F.array().cast(_SPAN)
    per_rule = []
    for k, r in enumerate(RULES):
        if trigram_query(r[1]) == ALL:
            per_rule.append(F.when(F.col("own_text").rlike(r[1]), _spans_of(k, "own_text")).otherwise(none))
        else:
            per_rule.append(F.when(F.coalesce(F.get("may", F.lit(k)), F.lit(False)), _spans_of(k, "own_text")).otherwise(none))
    return joined.select("row", "own_id", "own_text", F.array_sort(F.concat(*per_rule)).alias("spans"))


def _is_kind(k: int) -> Callable[[Column], Column]:
    return lambda x: x["k"] == k


def _told(spans: Column) -> Column:
    kinds = F.array(*(F.lit(r[0]) for r in RULES))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(kinds, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def summaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of base spans, and all spans."""
    found = with_spans(narrow(docs, doc_id=(id_col, "long"), text=(text_col, "string")))
    base = F.filter("spans", lambda x: x["k"] < BASE)
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{RULES[k][0]}") for k in range(BASE)]
    return found.select(F.col("own_id").alias("doc_id"), *counts, F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, every span of the text replaced by a mark; rows without a span are as they were."""
    found = with_spans(docs, id_col, text_col)
    text = F.col("own_text")
    starts = F.sequence(F.lit(1), F.size("spans"), F.lit(PAGE))
    pages = F.transform(starts, lambda p: F.slice("spans", p, F.lit(PAGE)))
    last = lambda page: F.array_max(F.transform(page, lambda x: x["e"]))

    def cleaned(page: Column, begin: Column, end: Column) -> Column:
        """The text from begin to end without the page's spans; only this part of it is copied for them."""

        def step(acc: Column, x: Column, part: Column) -> Column:
            more = F.concat(acc["out"], F.substring(part, acc["at"] - begin + 1, x["s"] - acc["at"]), F.lit(mark))
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

        whole = F.array(F.substring(text, begin + 1, end - begin))
        return F.get(F.transform(whole, lambda part: F.aggregate(page, F.struct(begin.alias("at"), F.lit("").alias("out")), lambda acc, x: step(acc, x, part), lambda acc: acc["out"])), F.lit(0))

    def joined(pages: Column, ends: Column) -> Column:
        before = lambda i: F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(0))
        parts = F.transform(pages, lambda page, i: cleaned(page, before(i), before(i + 1)))
        rest = F.array_max(ends)
        return F.concat(F.array_join(parts, ""), F.substring(text, rest + 1, F.length(text)))

    both = F.array(F.struct(pages.alias("pages"), F.transform(pages, last).alias("ends")))
    clean = F.get(F.transform(both, lambda t: joined(t["pages"], t["ends"])), F.lit(0))
    fields = [F.when(F.size("spans") > 0, clean).otherwise(F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return found.select(*fields)


def _oracle() -> str:
    parts, names = [], []
    for k, (kind, expression, group, least) in enumerate(RULES):
        e = expression.replace("'", "''").replace(r"\x20", " ")
        skip, n = "0", "length(m[i])"
        if e.startswith(LOOK_BEHIND):  # DuckDB has none: the character before a match is taken too and left out of its span
            e, group, skip, n = f"(?:^|[^{TOKEN}])({e.removeprefix(LOOK_BEHIND)})", 1, "length(m[i]) - length(g[i])", "length(g[i])"
        parts.append(f"""
m{k} AS (SELECT rid, string_split_regex(t, '{e}') AS x, regexp_extract_all(t, '{e}', 0) AS m, regexp_extract_all(t, '{e}', {group}) AS g FROM d),
s{k} AS (SELECT rid, {k} AS k, CAST(list_sum(list_transform(x[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i-1], lambda z: length(z))), 0) + {skip} AS BIGINT) AS s,
  {n} AS n FROM (SELECT rid, x, m, g, unnest(range(1, len(m) + 1)) AS i FROM m{k}) WHERE length(g[i]) >= {least})""")
        names.append(f"SELECT rid, '{kind}' AS kind, k, s, s + n AS e FROM s{k}")
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{RULES[k][0]}" for k in range(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),{",".join(parts)},
a AS ({" UNION ALL ".join(names)}),
g AS (SELECT rid, {counts}, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {BASE}), '') AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM a GROUP BY rid)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{RULES[k][0]}, 0) AS BIGINT) AS n_{RULES[k][0]}" for k in range(BASE))},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""


ORACLE = _oracle()
