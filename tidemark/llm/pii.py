"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Base kinds (email, ip, card, phone) are always kept once confirmed. The method adds iban
(mod-97), ssn (structure) and secret (keys and tokens: a known prefix, or a long run of letters and
digits that is random enough), each kept if its score, which whole words nearby raise and lower,
reaches `LEAST`. Offsets are code points, end exclusive.

Scale: one pass inside tasks without a shuffle; patterns are written so that no text, however
long, is scanned more than a constant number of times."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A look-behind for a digit keeps a failed run of digits from being tried again at each digit.
# It drops no match: one that starts inside a run would also start at the run's head.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?=\x20?[A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+")
#: Prefixes that public services give their keys (fixed values).
_ISSUED = re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})\Z")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Score of a confirmed match, whole words near it that raise the score, and words that lower it (fixed values).
CONTEXT = {
    "email": (0.8, ("mail", "email", "contact", "write"), ("example",)),
    "ip": (0.6, ("ip", "address", "server", "host"), ("version", "section")),
    "card": (0.7, ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"), ("order", "isbn", "tracking")),
    "phone": (0.7, ("phone", "tel", "call", "mobile", "fax"), ("order", "isbn")),
    "iban": (0.8, ("iban", "bank", "account", "konto", "cuenta", "compte"), ("serial", "part", "tracking")),
    "ssn": (0.4, ("ssn", "social"), ("order", "part")),
    "secret": (0.3, ("token", "key", "apikey", "secret", "password", "passwd", "pwd", "bearer", "auth", "credential", "credentials"), ("sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash")),
}
RAISE, LOWER, NEAR, LEAST = 0.2, 0.4, 40, 0.5
_NEARBY = re.compile(r"[^\W\d_]+[0-9]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def random_enough(s: str) -> bool:
    """Three digits, a letter, and at least 3 bits a character."""
    if sum(map(str.isdigit, s)) < 3 or not any(map(str.isalpha, s)):
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= 3


#: Characters of each country's IBANs, blanks aside (fixed values).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21,
    "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27,
    "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban_end(text: str, start: int) -> int | None:
    """Where the account number at start ends, single blanks between its characters. That of a
    listed country has the country's length; of another one it ends at a blank or where it stops, the
    longest that mod-97 confirms first. Small letters count only unspaced or in groups of four."""
    length = IBAN_LENGTH.get(text[start : start + 2].upper())
    ends, groups, chars, i = [], [0], 0, start
    while i < len(text) and chars < (length or 34):
        if text[i].isascii() and text[i].isalnum():
            chars += 1
            groups[-1] += 1
        elif text[i] == " " and groups[-1]:
            ends.append(i)
            groups.append(0)
        else:
            break
        i += 1
    if groups[-1] and not (i < len(text) and text[i].isascii() and text[i].isalnum()):
        ends.append(i)
    if length:
        regular = len(groups) == 1 or (set(groups[:-1]) == {4} and groups[-1] <= 4)
        ends = ends[-1:] if chars == length and ends[-1:] == [i] else []
    else:
        regular = False
    return next((e for e in reversed(ends) if (regular or text[start:e] == text[start:e].upper()) and mod97(text[start:e])), None)


def _ibans(text: str):
    m = _IBAN.search(text)
    while m:
        end = _iban_end(text, m.start())
        if end:
            yield m.start(), end
        m = _IBAN.search(text, end or m.start() + 4)


def _emails(text: str):
    """Leftmost matches of local@domain: each @ is extended left over local characters, no
    further than the last match, and right over a domain."""
    start = 0
    at = text.find("@")
    while at >= 0:
        left = at
        while left > start and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        start = at + 1
        if m:
            start = m.end()
            yield left, m.end()
        at = text.find("@", start)


def _confirmed(text: str):
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for s, e in _ibans(text):
        yield "iban", s, e
    for m in _SSN.finditer(text):
        area = int(m[0][:3])
        if area not in (0, 666) and area < 900 and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end()
    for m in _SECRET.finditer(text):
        if _ISSUED.match(m[0]) or random_enough(m[0]):
            yield "secret", m.start(), m.end()


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind."""
    found = []
    for kind, s, e in _confirmed(text or ""):
        score, up, down = CONTEXT[kind]
        near = set(_NEARBY.findall((text[max(0, s - NEAR) : s] + " " + text[e : e + NEAR // 2]).lower()))
        score += RAISE * any(w in near for w in up) - LOWER * any(w in near for w in down)
        if kind == "secret" and _ISSUED.match(text, s, e):
            score = max(score, LEAST)
        if kind in BASE or score >= LEAST:
            found.append((kind, s, e, round(min(1.0, max(0.0, score)), 3)))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced
    together, under the kind of the first."""
    if not text:
        return text
    out, at = [], 0
    for kind, s, e, _ in find_spans(text):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_pii(docs: DataFrame) -> DataFrame:
    """docs with pii, an array of (kind, start, end, score) that replaces a column of that name.

    Null and empty texts have no spans, very long ones are taken whole. Rows are judged one by one,
    so repeated rows repeat, and an empty table gives an empty result."""

    @F.arrow_udf(SPANS)
    def spans(text: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find_spans(t)] for part in texts_of(text) for t in part], _SPAN_TYPE)

    return docs.withColumn("pii", spans(F.col("text")))


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets. Nulls stay null; n_chars,
    where there is one, is set to the new length. Long texts, repeated rows and empty tables as in
    find_pii(); other columns stay as they are."""

    @F.arrow_udf("string")
    def redacted(text: pa.Array) -> pa.Array:
        return pa.array([redact(t) for part in texts_of(text) for t in part], pa.string())

    out = docs.withColumn("text", redacted(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
