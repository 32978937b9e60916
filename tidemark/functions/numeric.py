"""Column expressions over numbers, dates and vectors."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, low: float, high: float, whole: bool = False) -> Column:
    """x between low and high, rounded half to even if whole."""
    y = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return F.bround(y, 0) if whole else y


def display_score(p: Column, weak: Column) -> Column:
    """Scores of weak signals fill the upper half of 0 to 1, others the lower; two places."""
    return F.bround(F.when(weak, 0.5 + p / 2).otherwise(p / 2), 2)


def calibration_map(x: Column, spec: str) -> Column:
    """x through a "1:2,2:3" map; values that it lacks stay."""
    pairs = dict(p.split(":") for p in spec.split(",") if p)
    m = F.create_map(*[F.lit(int(v)) for kv in pairs.items() for v in kv])
    return F.coalesce(F.try_element_at(m, x.cast("int")), x.cast("int"))


def age_days(now: datetime, ts: Column) -> Column:
    """Days from ts to now, 0 for later ones, null for null."""
    days = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 8.64e10
    return F.when(days.isNotNull(), F.greatest(F.lit(0.0), days))


#: Named zones of RFC 2822 (fixed values).
ZONES = {"GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def parse_timestamp(text: Column) -> Column:
    """ISO or RFC 2822 text as a timestamp, null if it is neither. RFC dates may lack the day of the
    week or the seconds, and name their zone."""
    formats = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMddHHmmss", "yyyyMMdd")
    bare = F.regexp_replace(F.trim(text), r"^\w{3},\s*", "")
    zone = F.regexp_extract(bare, r"\s([A-Z]{1,3})$", 1)
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), zone)
    bare = F.when(named.isNotNull(), F.concat(F.regexp_replace(bare, "[A-Z]{1,3}$", ""), named)).otherwise(bare)
    rfc = F.try_to_timestamp(F.regexp_replace(bare, r"(\s\d\d:\d\d)(\s)", "$1:00$2"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], rfc)


def partial_date(text: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD as a date, missing parts the first."""
    full = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).otherwise(text)
    return F.try_to_date(full, "yyyy-MM-dd")


def targeted_since(now: datetime, months: int, first_year: int) -> date:
    """Months of 30.44 days before now, not before January 1st of first_year."""
    return max((now - timedelta(days=round(months * 30.44))).date(), date(first_year, 1, 1))


def per_request(cap: int, requests: int, low: int, high: int) -> int:
    return max(low, min(high, -(-cap // max(1, requests))))


def since_of(now: Column, months: Column, first_year: int) -> Column:
    """Column form of targeted_since."""
    return F.greatest(F.date_sub(now, F.round(months * 30.44).cast("int")), F.make_date(F.lit(first_year), F.lit(1), F.lit(1)))


def per_request_of(cap: Column, requests: Column, low: int, high: int) -> Column:
    """Column form of per_request."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.ceil(cap / F.greatest(F.lit(1), requests)))).cast("long")


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of hits out of n; null for n = 0."""
    p, zz = hits / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def rounded(x: Column, digits: int) -> Column:
    """x rounded half away from zero; a negative x that rounds to zero gives -0.0, as in SQL engines
    that round doubles as such (F.round() goes by decimals, which have no such zero)."""
    return F.when(x < 0, -F.round(-x, digits)).otherwise(F.round(x, digits))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine between -1 and 1; 0 for null, zero or vectors of different lengths."""
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))).otherwise(0.0)


def linear(values: Column, weights: Sequence[float], bias: float) -> Column:
    """Weighted sum of an array of values plus bias."""
    return dot(values, F.array(*[F.lit(float(w)) for w in weights])) + bias
