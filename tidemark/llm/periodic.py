"""Periodic runs of words by Lyndon arrays.

A run is a stretch of words with a smallest period, at least `LEAST` words and `TIMES` periods long,
that no neighbouring word extends. Each run that ends before a smaller word than its period goes on
with (or at the end) is found from its Lyndon roots under the order of the words, any other one under
the reversed order. So two Lyndon arrays, over words numbered by first appearance, hold all roots.

The array goes from right to left over next smaller suffixes. Two suffixes are never compared from
their heads: what an earlier comparison has matched is reused.
* The suffix at i and the next candidate nss[j] both follow the suffix at j, whose matches with each
  of them are known. If they differ in length, the shorter one decides; only if they are equal are
  further words read.
* Words read beyond one period, the distance of both suffixes, would repeat an earlier comparison one
  period on, whose length is kept and added.
Neither a suffix structure nor hashes of stretches are used, and no comparison of words but of their
order. Most texts are read a fixed number of times; the worst known, Fibonacci words and nested
repeats, cost one more read of a word for each doubling (20 at 32 000 words). Runs are then extended to the left of their
first root by less than a period.

Every eight words in a row of such a run occur twice at least (it is three periods and 24 words long),
so stretches whose eight words occur once are set aside before. In prose that is nearly all.

Scale: one pass inside tasks without a shuffle. A text takes memory in proportion to its words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, texts_of

#: Words and periods of the shortest run, words of the sieve's stretches.
LEAST, TIMES, SIEVE = 24, 3, 8
FOUND = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes: white space of the contract


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, in the order of their first appearance."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def lyndon(s: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix of s the start of the next smaller one (len(s) if there is none; the empty
    suffix is the smallest) and the length of what both have in common."""
    n = len(s)
    nss, common = [n] * n, [0] * n
    beyond: dict[tuple[int, int], int] = {}  # (i, d): what suffixes i and i + d have in common, if at least d
    same = 0  # what suffixes i and i + 1 have in common
    for i in range(n - 2, -1, -1):
        same = same + 1 if s[i] == s[i + 1] else 0
        j, a = i + 1, same
        while True:
            if j + a == n or s[i + a] > s[j + a]:
                nss[i], common[i] = j, a
                break
            nxt, r = nss[j], common[j]
            if nxt == n:
                break
            if a > r:
                nss[i], common[i] = nxt, r
                break
            d = nxt - i
            if a == r:
                fetched = False
                while True:
                    if a >= d and not fetched:  # suffix i goes on as suffix nxt does
                        fetched = True
                        a = max(a, d + (beyond.get((nxt, d), 0) or (common[nxt] if nss[nxt] == nxt + d else 0)))
                    if nxt + a == n or s[i + a] != s[nxt + a]:
                        break
                    a += 1
            if a >= d:
                beyond[i, d] = a
            j = nxt
        if same:
            beyond[i, 1] = same
    return nss, common


def runs_of_stretch(s: list[int]) -> set[tuple[int, int, int]]:
    """(start, length, period) of every run of s of at least LEAST words and TIMES periods."""
    found = set()
    n = len(s)
    for order in (s, [-x for x in s]):
        nss, common = lyndon(order)
        for i in range(n):
            j, a = nss[i], common[i]
            p = j - i
            if a < p or j == n or (i >= p and nss[i - p] == i and common[i - p] >= p):
                continue  # no root, or not the first one of its run
            start = i
            while start and i - start < p and s[start - 1] == s[start - 1 + p]:
                start -= 1
            length = j + a - start
            if length >= max(LEAST, TIMES * p):
                found.add((start, length, p))
    return found


def suspects(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) whose every eight words in a row occur elsewhere too: no run goes
    beyond one. Sorting pairs names stretches of two, four and eight words exactly."""
    if len(ids) < LEAST:
        return []
    name, count = ids, None
    for width in (1, 2, 4):
        pair = name[:-width] * np.int64(len(ids) + 1) + name[width:]
        _, name, count = np.unique(pair, return_inverse=True, return_counts=True)
    again = np.concatenate(([0], (count[name] > 1).astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(again)).reshape(-1, 2)
    return [(a, b + SIEVE - 1) for a, b in edge.tolist() if b + SIEVE - 1 - a >= LEAST]


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    ids = numbered(words)
    return sorted((a + start, length, p) for a, b in suspects(ids) for start, length, p in runs_of_stretch(ids[a:b].tolist()))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those that a run holds after its first period."""
    if not found:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, p in found:
        drop[start + p] += 1
        drop[start + length] -= 1
    kept = np.cumsum(drop)[:-1] == 0
    return b" ".join(words[i] for i in np.flatnonzero(kept).tolist())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame) -> DataFrame:
    """docs with `runs` (start, length, period; by start, then period) and `collapsed`, the text's
    words joined by blanks without those a run holds after its first period; both replace columns of
    those names.

    Words are what blanks and U+0009 to U+000D separate, numbered from 0. Null and empty texts have
    no runs and an empty `collapsed`. Very long texts are taken whole. Rows are judged one by one, so
    repeated rows repeat, and an empty table gives an empty result."""

    @F.arrow_udf(FOUND)
    def find(text: pa.Array) -> pa.Array:
        all_runs, collapsed = [], []
        for part in texts_of(text):
            for t in part:
                words = words_of(t)
                found = runs(words)
                all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                collapsed.append(collapse(words, found).decode("utf-8", "surrogatepass"))
        return pa.StructArray.from_arrays([pa.array(all_runs, pa.list_(_RUN)), pa.array(collapsed, pa.string())], names=["runs", "collapsed"])

    (found,) = fresh(docs, "found")
    out = docs.withColumn(found, find(F.col("text")))
    return out.withColumns({"runs": F.col(found)["runs"], "collapsed": F.col(found)["collapsed"]}).drop(found)


def planted(docs: DataFrame) -> DataFrame:
    """docs with periodic texts where crc32(doc_id) ends in 0: with h that number, g = floor(h / 10),
    n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), word i >= a becomes word
    a + (i - a) % p. Other texts, and those of a null doc_id, stay as they are."""
    (w,) = fresh(docs, "w")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    n = F.greatest(F.size(w), F.lit(1)).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    period = F.slice(w, (a + 1).cast("int"), p.cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    rest = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), (n - a).cast("int"))
    text = F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), rest), " ")
    chosen = (h % 10 == 0) & (F.size(w) > 0)
    return docs.withColumn(w, F.when(h % 10 == 0, words)).withColumn("text", F.when(chosen, text).otherwise(F.col("text"))).drop(w)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length / period (ties: smallest start, then period)
    with floor(1000 * length / period), and the SHA-256 of all runs and of the collapsed text."""
    # runs of one text: length / period compares exactly as cross products of longs
    def better(x: Column, y: Column) -> Column:
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return (left > right) | ((left == right) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))

    run = "struct<start:bigint,length:bigint,period:bigint>"
    best = F.aggregate("runs", F.lit(None).cast(run), lambda acc, x: F.when(acc.isNull() | better(x, acc), x).otherwise(acc))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")
