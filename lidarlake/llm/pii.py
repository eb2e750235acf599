"""Personal data by anchor expansion.

One Aho-Corasick pass over each text, its ASCII letters lowered, finds anchors: at-signs, plus signs and digit pairs,
scheme marks and identifier cues in any case. From each anchor a small deterministic parser walks to both sides, as far
as its alphabet allows, and validates what it has found: email and network addresses, card and account numbers, phone
numbers, credentials in a URL, and identifiers that follow a cue. No pattern is searched over the text.

The base kinds (email, ip, card, phone) follow the leftmost, non-overlapping rule of their patterns; the others add
spans and never take a base span away. Spans that begin together are in the order of their kinds. Null text is the empty
text. Texts of any length are read whole; what a parser reads beyond its span is bounded or read by no other anchor of
its kind, so the time grows with the text. Repeated rows give equal rows, whatever their ids; empty tables
give empty tables; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, lean, narrow, pieces

# The alphabets of the base patterns, and the kinds in their order.
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
LOCAL = frozenset(_ALNUM + "._%+-")
LABEL = frozenset(_ALNUM + "-")
DIGITS = frozenset("0123456789")
PHONE = frozenset(" ().0123456789-")
KINDS = ("email", "ip", "card", "phone", "url_credentials", "iban", "identifier")
CUES = ("ssn", "passport", "account", "iban", "license", "tax id")
FILLERS = ("no", "nr", "num", "number", "id", "is", "was")
# Lengths of account numbers by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 "
    "IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 "
    "SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
_LONGEST = max(map(len, FILLERS))
_IBAN = {x[:2]: int(x[2:]) for x in IBAN_LENGTHS.split()}
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

_AUTOMATON: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    """The anchors; built once per process."""
    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        a.add_word("@", "@")
        a.add_word("://", "/")
        for x in DIGITS:
            a.add_word("+" + x, "+")
            for gap in ("", ".", " ", "-"):
                for y in DIGITS:
                    a.add_word(x + gap + y, "d")
        for cue in CUES:
            a.add_word(cue, "c")
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def run_right(text: str, at: int, alphabet: frozenset, most: int | None = None) -> int:
    """End of the characters of the alphabet from `at` on, or of the first `most` of them."""
    n = len(text) if most is None else min(len(text), at + most)
    while at < n and text[at] in alphabet:
        at += 1
    return at


def run_left(text: str, at: int, alphabet: frozenset, least: int) -> int:
    while at > least and text[at - 1] in alphabet:
        at -= 1
    return at


def domain_end(text: str, at: int) -> int:
    """End of two or more dotted labels that begin at `at`, or -1."""
    end = run_right(text, at, LABEL)
    if end == at:
        return -1
    dots = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end, dots = run_right(text, end + 1, LABEL), dots + 1
    return end if dots else -1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def addresses(text: str, begin: int) -> tuple[list[tuple[int, int]], int]:
    """Network addresses in the dotted chain of numbers that begins at `begin`; the chain's end. Four numbers make one."""
    found, parts, at = [], [], begin
    while True:
        end = run_right(text, at, DIGITS)
        parts.append((at, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
            at = end + 1
        else:
            break
    for k in range(0, len(parts) - 3, 4):
        if all(b - a < 4 or not text[a : b - 3].strip("0") for a, b in parts[k : k + 4]) and all(int(text[max(a, b - 3) : b]) <= 255 for a, b in parts[k : k + 4]):
            found.append((parts[k][0], parts[k + 3][1]))
    return found, end


def card(text: str, begin: int) -> tuple[tuple[int, int] | None, int]:
    """The number whose first digit is at `begin`, single spaces or hyphens inside; its end."""
    at, n = begin + 1, len(text)
    while at < n:
        if text[at] in DIGITS:
            at += 1
        elif text[at] in " -" and at + 1 < n and text[at + 1] in DIGITS:
            at += 2
        else:
            break
    if at - begin > 40:
        return None, at
    digits = text[begin:at].replace(" ", "").replace("-", "")
    return ((begin, at) if 12 <= len(digits) <= 19 and luhn(digits) else None), at


def phone(text: str, begin: int) -> tuple[tuple[int, int] | None, int]:
    """The number after the plus sign at `begin`; where to go on."""
    end = run_right(text, begin + 2, PHONE)
    while end > begin + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= begin + 3:
        return None, begin + 1
    n = sum(x in DIGITS for x in text[begin:end])
    return ((begin, end) if 9 <= n <= 15 else None), end


def credentials(text: str, slashes: int) -> tuple[int, int] | None:
    """scheme://user:password@ around the '://' at `slashes`."""
    begin = run_left(text, slashes, LABEL, 0)
    end = slashes + 3
    while end < len(text) and text[end] not in "/?# \t\n\r\v\f\"'<>@":
        end += 1
    return (begin, end + 1) if begin < slashes and end < len(text) and text[end] == "@" and ":" in text[slashes + 3 : end] else None


def iban(text: str, at: int) -> tuple[int, int] | None:
    """An account number that begins at `at`: as long as its country's are, single spaces inside, right check digits."""
    want = _IBAN.get(text[at : at + 2].upper(), 0)
    end, raw = at, []
    while end < len(text) and len(raw) < want:
        c = text[end]
        if c in LABEL and c != "-":
            raw.append(c.upper())
        elif c != " " or not raw or text[end - 1] == " ":
            return None
        end += 1
    if not want or len(raw) < want or end < len(text) and text[end] in LABEL and text[end] != "-":
        return None
    return (at, end) if int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1 else None


def after_cue(text: str, at: int) -> int:
    """Where a value may begin after a cue: behind separators and filling words such as `number` or `is`."""
    while True:
        while at < len(text) and text[at] in " :=#.":
            at += 1
        end = run_right(text, at, LABEL, _LONGEST + 1)
        if text[at:end].lower() not in FILLERS:
            return at
        at = end


def identifier(text: str, at: int) -> tuple[int, int] | None:
    """A token of 6 to 20 letters, digits and hyphens with 5 digits or more."""
    end = run_right(text, at, LABEL, 21)
    return (at, end) if 6 <= end - at <= 20 and sum(x in DIGITS for x in text[at:end]) >= 5 else None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start and then kind."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    mail_from = dotted_to = number_to = phone_from = 0
    for last, kind in automaton().iter(text.translate(_LOWER)):
        if kind == "@":
            begin, end = run_left(text, last, LOCAL, mail_from), domain_end(text, last + 1)
            if begin < last and end > 0:
                out.append(("email", begin, end))
                mail_from = end
        elif kind == "d":
            at = last - 1 if text[last - 1] in DIGITS else last - 2
            if last >= dotted_to:
                begin = run_left(text, at, DIGITS, 0)
                found, dotted_to = addresses(text, begin)
                out += (("ip", a, b) for a, b in found)
            if text[last - 1] != "." and last >= number_to:
                # the first pair of a number begins it: what stands before would have been a pair too
                found, number_to = card(text, at)
                if found:
                    out.append(("card", *found))
            # two letters and two digits may begin an account number
            if at >= 2 and last == at + 1 and text[at - 2 : at] in _IBAN and (at == 2 or text[at - 3] not in LABEL) and (found := iban(text, at - 2)):
                out.append(("iban", *found))
        elif kind == "+":
            if last - 1 >= phone_from:
                found, phone_from = phone(text, last - 1)
                if found:
                    out.append(("phone", *found))
        elif kind == "/":
            if found := credentials(text, last - 2):
                out.append(("url_credentials", *found))
        else:
            begin = after_cue(text, last + 1)
            if found := iban(text, begin):
                out.append(("iban", *found))
            elif found := identifier(text, begin):
                out.append(("identifier", *found))
    return sorted(set(out), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_BASE = frozenset(KINDS[:4])
_OUT = "doc_id long, kind string, start long, end long, value string"
_SPANS = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string())])


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: doc_id, kind, start, end (code points, end exclusive), value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = [(i, k, s, e, t[s:e]) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for k, s, e in find(t)]
            if rows:
                yield batch_of(_SPANS, [*zip(*rows, strict=True)])

    return narrow(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(lean(run), _OUT)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind; of overlapping spans the union goes."""
    if text is None:
        return None
    out, at = [], 0
    for k, s, e in find(text):
        if s >= at:
            out += (text[at:s], f"[{k.upper()}]")
        at = max(at, e)
    return "".join(out) + text[at:]


def summaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for t in b.column("text").to_pylist():
                found = find(t)
                base = [x for x in found if x[0] in _BASE]
                rows.append((*(sum(x[0] == k for x in base) for k in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            yield batch_of(_DIGEST, [b.column("doc_id"), *zip(*rows, strict=True)])

    return narrow(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(lean(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
