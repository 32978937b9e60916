"""Joins that match records by keys, stems, tokens and acronyms, and predicates on what matched."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.functions import text as T
from tidemark.plans.store import cut


def with_children(parents: DataFrame, children: DataFrame, key: str, columns: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """parents with an array of their children's columns, in order; empty without any."""
    packed = children.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("__c")))).alias("__a"))
    listed = F.transform("__a", lambda x: x["__c"])
    return parents.join(packed, F.col(key) == F.col("__k"), "left").withColumn(name, F.coalesce(listed, F.array().cast(f"array<{children.select(F.struct(*columns).alias('c')).schema['c'].dataType.simpleString()}>"))).drop("__k", "__a")


def ordered_lookup(rows: DataFrame, key: str, refs: str, dim: DataFrame, ref: str, value: str) -> DataFrame:
    """key and the values of an array of references, in their order; unknown ones are left out."""
    placed = rows.select(key, F.posexplode(refs).alias("__p", "__r"))
    found = placed.join(dim.select(F.col(ref).alias("__d"), F.col(value).alias("__v")), F.col("__r") == F.col("__d"))
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__v"))), lambda x: x["__v"]).alias("found"))


def best_by_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, words: str, least: int, share: float, length: int = 5, set_limit: int = 20_000) -> DataFrame:
    """left_key, right_key, shared, overlap: for each left row the right row of highest overlap, the
    shared stems over the size of the smaller set, of those with at least `least` shared stems and
    that overlap; ties by more shared stems, then by right_key. Keys are unique.

    Up to set_limit left rows go to every task, which counts shared stems by their postings and gives its
    own best row for each left row; beyond it both sides are joined by a shuffle, with the same result."""
    stems = lambda rows, key: rows.select(F.col(key).alias("k"), T.prefix_stems(F.col(words), length).alias("s")).where((F.size("s") >= least) & F.col("k").isNotNull())
    a, b = stems(left, left_key), stems(right, right_key)
    few = a.limit(set_limit + 1).collect()
    schema = StructType([StructField("l", a.schema["k"].dataType), StructField("r", b.schema["k"].dataType), StructField("shared", LongType()), StructField("overlap", DoubleType())])
    kept = _overlaps_of_few(few, b, least, share, schema) if len(few) <= set_limit else _overlaps_by_shuffle(a, b, least, share)
    best = kept.groupBy("l").agg(F.min(F.struct((-F.col("overlap")).alias("o"), (-F.col("shared")).alias("s"), "r")).alias("m"))
    return best.select(F.col("l").alias(left_key), F.col("m.r").alias(right_key), (-F.col("m.s")).alias("shared"), (-F.col("m.o")).alias("overlap"))


def _overlaps_of_few(items: list, b: DataFrame, least: int, share: float, schema: StructType) -> DataFrame:
    """l, r, shared, overlap: for each item (k, s) the best row of every batch of b (k, s)."""
    names, sizes = [i.k for i in items], np.array([len(i.s) for i in items])
    postings: dict[str, list[int]] = defaultdict(list)
    for at, i in enumerate(items):
        for w in i.s:
            postings[w].append(at)
    found = {w: np.array(at) for w, at in postings.items()}

    def best(batches):
        for batch in batches:
            top: dict[int, tuple] = {}
            for r, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = [found[w] for w in s if w in found]
                if len(held) < least:
                    continue
                shared = np.bincount(np.concatenate(held), minlength=len(names))
                overlap = shared / np.minimum(sizes, len(s))
                for at in np.flatnonzero((shared >= least) & (overlap >= share)):
                    one = (-overlap[at], -shared[at], r)
                    if at not in top or one < top[at]:
                        top[at] = one
            rows = [{"l": names[at], "r": r, "shared": int(-c), "overlap": float(-o)} for at, (o, c, r) in top.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    fields = [(f.name, to_arrow_type(f.dataType)) for f in schema]
    return b.mapInArrow(best, schema)


def _overlaps_by_shuffle(a: DataFrame, b: DataFrame, least: int, share: float) -> DataFrame:
    """l, r, shared, overlap of all pairs of enough overlap. Sets that share `least` stems have their first
    common one among their n - least + 1 rarest ones, so the most frequent stems of a set are never join
    keys; a pair is decided there, and nothing is shuffled after the join."""
    df = b.select(F.explode("s").alias("w")).groupBy("w").agg(F.count("*").alias("df"))

    def keyed(sets: DataFrame, k: str, t: str, p: str) -> DataFrame:
        flat = sets.select("k", F.explode("s").alias("w")).join(df, "w", "left")
        ordered = flat.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"]).alias("o"))
        return ordered.select(F.col("k").alias(k), F.col("o").alias(t), F.posexplode(F.slice("o", F.lit(1), F.size("o") - least + 1)).alias(p, "w"))

    pairs = keyed(a, "l", "x", "i").join(keyed(b, "r", "y", "j"), "w")
    fresh = ~F.arrays_overlap(F.slice("x", F.lit(1), F.col("i")), F.slice("y", F.lit(1), F.col("j")))
    counted = F.transform(F.array(F.size(F.array_intersect("x", "y")).cast("long")), lambda c: F.struct(c.alias("shared"), (c / F.least(F.size("x"), F.size("y"))).alias("overlap")))
    near = F.filter(counted, lambda c: (c["shared"] >= least) & (c["overlap"] >= share))
    return pairs.where(fresh).select("l", "r", F.inline(near).alias("shared", "overlap"))


def _dense(kept: DataFrame, name: str) -> DataFrame:
    """kept, whose partitions don't change, with different numbers from 0 on: integers unless it has too many rows."""
    placed = kept.withColumn("__i", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__i", 33).cast("int"))
    sizes = {r["__p"]: r["n"] for r in placed.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    starts = [0]
    for p in range(max(sizes, default=0)):
        starts.append(starts[-1] + sizes.get(p, 0))
    at = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("__p")) + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, at.cast("int" if sum(sizes.values()) < 1 << 31 else "long")).drop("__i", "__p")


def jaccard_join(rows: DataFrame, key: str, tokens: str, threshold: float) -> DataFrame:
    """a, b, jaccard of pairs of token sets with Jaccard of at least threshold, a < b; keys are unique.

    Prefix filtering: tokens are ordered by document frequency, and two sets that alike have their first
    common token among the n - ceil(threshold * n) + 1 rarest of the larger one and the n - ceil(2 *
    threshold / (1 + threshold) * n) + 1 rarest of the smaller one, so frequent tokens are never join keys
    of sets that have rarer ones. A pair is decided where its first common token meets, if enough tokens
    come after it: it is found once, and nothing is shuffled after the join."""
    sets = rows.select(F.col(key).alias("k"), F.array_distinct(tokens).alias("t")).where(F.size("t") > 0)
    flat = sets.select("k", F.explode("t").alias("w"))
    # tokens go on as numbers, which are shuffled and compared in a fraction of their strings
    df = _dense(cut(flat.groupBy("w").agg(F.count("*").alias("df"))), "id")
    ranked = flat.join(df, "w").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "id"))), lambda x: x["id"]).alias("t"))

    def keyed(share: float, k: str, t: str, p: str) -> DataFrame:
        first = F.slice("t", F.lit(1), F.size("t") - F.ceil(F.size("t") * share - 1e-9).cast("int") + 1)
        return ranked.select(F.col("k").alias(k), F.col("t").alias(t), F.posexplode(first).alias(p, "w"))

    pairs = keyed(2 * threshold / (1 + threshold), "k", "t", "i").join(keyed(threshold, "kb", "tb", "j"), "w")
    n, nb = F.size("t"), F.size("tb")
    smaller = (n < nb) | ((n == nb) & (F.col("k") < F.col("kb")))
    enough = F.least(n - F.col("i"), nb - F.col("j")) >= threshold / (1 + threshold) * (n + nb) - 1e-9
    pairs = pairs.where(smaller & (n >= nb * threshold - 1e-9) & enough)
    fresh = ~F.arrays_overlap(F.slice("t", F.lit(1), F.col("i")), F.slice("tb", F.lit(1), F.col("j")))
    # the common tokens are counted once for each pair: bound by a transform over one element
    of = F.transform(F.array(F.size(F.array_intersect("t", "tb"))), lambda c: c / (n + nb - c))
    near = F.explode(F.filter(of, lambda x: x >= threshold)).alias("jaccard")
    return pairs.where(fresh).select(F.least("k", "kb").alias("a"), F.greatest("k", "kb").alias("b"), near)


def count_holding(docs: DataFrame, text: str, items: DataFrame, key: str, term: str, words: int = 6, set_limit: int = 20_000) -> DataFrame:
    """key, docs: how many documents hold each item's whole term, as words in a row (both normalised).

    Candidates share the term's first min(words, its length) words; they are verified in full. Up to
    set_limit distinct openings are looked up as a literal set inside the scan; beyond it all runs of
    words are joined by a shuffle, with the same result."""
    w = F.split(F.col(term), " ")
    rows = items.select(F.col(key).alias("__i"), F.col(term).alias("__t"), F.least(F.size(w), F.lit(words)).alias("__n"), F.array_join(F.slice(w, 1, words), " ").alias("__g"))
    openings = rows.select("__n", "__g").where("__g IS NOT NULL").distinct()
    heads = openings.limit(set_limit + 1).collect()
    few = len(heads) <= set_limit
    lengths = sorted({h["__n"] for h in heads} if few else {r["__n"] for r in openings.select("__n").distinct().collect()})

    def runs(x: Column, n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.array_join(F.slice(x, i, n), " "))
        own = [h["__g"] for h in heads if h["__n"] == n]
        found = F.filter(grams, lambda g: g.isin(*own)) if few else grams
        return F.when(F.size(x) >= n, found).otherwise(F.array().cast("array<string>"))

    none = F.array().cast("array<string>")
    # the words are bound once by a transform over one element; lambdas would split the text at each word
    found = F.flatten(F.transform(F.array(F.split(F.col(text), " ")), lambda x: F.array_distinct(F.concat(none, *[runs(x, n) for n in lengths]))))
    near = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("__d"), F.explode(found).alias("__h"))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    hits = near.join(rows, F.col("__h") == F.col("__g")).where(F.contains(pad("__d"), pad("__t"))).groupBy("__i").agg(F.count("*").alias("__c"))
    return items.select(key).join(hits, F.col(key) == F.col("__i"), "left").select(key, F.coalesce("__c", F.lit(0)).alias("docs"))


def any_key_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, keys: str, part: int = 8192) -> DataFrame:
    """Distinct (left_key, right_key) whose arrays of keys meet.

    Each row's keys are united first; then a pair is given by the first of the left keys that the right
    row has, so that the pairs, which may be many for a frequent key, are never collected or shuffled."""

    def united(rows: DataFrame, key: str, k: str, name: str) -> DataFrame:
        one = rows.select(F.col(key), F.explode(keys).alias("__k")).where("__k IS NOT NULL")
        return one.groupBy(key).agg(F.array_sort(F.collect_set("__k")).alias(name)).select(key, name, F.explode(name).alias(k))

    a, b = united(left, left_key, "__x", "__a"), united(right, right_key, "__y", "__b")
    # the right rows of a frequent key are dealt in parts, which all its left rows meet
    large = b.groupBy(F.col("__y").alias("__z")).agg(F.ceil(F.count("*") / part).cast("int").alias("__n")).where("__n > 1")
    n = F.coalesce("__n", F.lit(1))
    a = a.join(large, F.col("__x") == F.col("__z"), "left").select(left_key, "__x", "__a", F.explode(F.sequence(F.lit(0), n - 1)).alias("__p"))
    b = b.join(large, F.col("__y") == F.col("__z"), "left").select(right_key, "__y", "__b", F.pmod(F.xxhash64(F.col(right_key).cast("string")), n).cast("int").alias("__q"))
    first = F.get(F.array_intersect("__a", "__b"), F.lit(0)) == F.col("__x")
    return a.join(b, (F.col("__x") == F.col("__y")) & (F.col("__p") == F.col("__q")) & first).select(left_key, right_key)


def acronym_join(docs: DataFrame, key: str, text: str, terms: DataFrame, least: int) -> DataFrame:
    """key, acronym: documents that hold an acronym of terms (acronym, context array) as a whole
    token and at least `least` of its context words."""
    tokens = F.array_distinct(F.regexp_extract_all(T.empty_if_null(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    hit = docs.select(F.col(key).alias("__k"), F.explode(tokens).alias("__t")).join(terms, F.col("__t") == F.col("acronym")).select("__k", "acronym", "context").distinct()
    hit = docs.select(key, T.tokens(text).alias("__w")).join(hit, F.col(key) == F.col("__k"))
    return hit.where(F.size(F.array_intersect("__w", "context")) >= least).select(key, "acronym")


def two_reviewers(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, first, second, agreed (null where one is missing), label where both agree."""
    x, y = a.select(F.col(key).alias("__a"), F.col("label").alias("first")), b.select(F.col(key).alias("__b"), F.col("label").alias("second"))
    both = x.join(y, F.col("__a") == F.col("__b"), "full_outer")
    return both.select(F.coalesce("__a", "__b").alias(key), "first", "second", (F.col("first") == F.col("second")).alias("agreed"), F.when(F.col("first") == F.col("second"), F.col("first")).alias("label"))


def eligible(rows: DataFrame, group: str, day: str, first: Column, last: Column) -> DataFrame:
    """group, eligible: true if a dated row lies in the window, false if all dated ones lie outside,
    null without a dated row."""
    return rows.groupBy(group).agg(F.bool_or(F.col(day).between(first, last)).alias("eligible"))


def stale(rows: DataFrame, group: str, day: str, market: Column, now: Column, days: int) -> DataFrame:
    """group, stale: no row is of the market and the newest is more than `days` old."""
    return rows.groupBy(group).agg((~F.bool_or(market) & (F.date_diff(now, F.max(day)) > days)).alias("stale"))


def rubric_filter(rows: DataFrame, group: str, independent: Column, review: Column) -> DataFrame:
    """group, reason: NO_INDEPENDENT without an independent row, REVIEWS where half or more are
    reviews, null else."""
    return rows.groupBy(group).agg(F.when(~F.bool_or(independent), "NO_INDEPENDENT").when(F.avg(review.cast("double")) >= 0.5, "REVIEWS").alias("reason"))


def acceptable(phrase: Column, generic: Sequence[str], boilerplate: Sequence[str], mature: Sequence[str], least: int = 3, most: int = 60) -> Column:
    """Whether a phrase may name a technology: its length is right, not all words are generic, none
    is boilerplate, it isn't led or ended by a verb form, and no mature term stands in it with
    nothing but generic words beside."""
    holds = lambda w: T.words_within(F.lit(w), phrase)

    def other(than: Sequence[str]) -> Column:
        """Whether a word is none of these: read from the string, as splitting it costs more than the rest."""
        known = [re.escape(w) for w in sorted({*than}) if " " not in w]
        return phrase.rlike(rf"(?:\A| )(?!(?:{'|'.join(known)})(?: |\z))") if known else F.length(phrase) >= 0

    verbish, blocked, aged = F.lit(False), F.lit(False), F.lit(False)
    for ending in ("ing", "ize", "ise"):
        verbish = verbish | phrase.endswith(ending)
    for w in boilerplate:
        if " " not in w:
            blocked = blocked | holds(w)
    for m in mature:
        aged = aged | (holds(m) & ~other([*m.split(" "), *generic]))
    return F.length(phrase).between(least, most) & other(generic) & ~blocked & ~verbish & ~aged


def enrich(archive: DataFrame, fetched: DataFrame, key: str, now: Column, most: int = 5) -> DataFrame:
    """archive (key, title, summary, tokens, attempts) with fetched pages (key, title, summary,
    tokens, ok): a non-empty title replaces, the longer summary stays, tokens are united; a failed
    fetch counts an attempt and is due 30 * 2**n minutes later, at most a day, none after `most`."""
    f = fetched.select(F.col(key).alias("__k"), F.col("title").alias("__t"), F.col("summary").alias("__s"), F.col("tokens").alias("__w"), "ok")
    j = archive.join(f, F.col(key) == F.col("__k"), "left")
    good = F.coalesce("ok", F.lit(False))
    bad = F.col("__k").isNotNull() & ~good
    minutes = F.least(F.lit(1440), (30 * F.pow(F.lit(2.0), F.col("attempts"))).cast("int"))
    longer = good & (F.length(F.coalesce("__s", F.lit(""))) > F.length(F.coalesce("summary", F.lit(""))))
    return j.select(
        key, F.when(good & (F.coalesce("__t", F.lit("")) != ""), F.col("__t")).otherwise(F.col("title")).alias("title"), F.when(longer, F.col("__s")).otherwise(F.col("summary")).alias("summary"),
        F.when(good, F.array_union("tokens", F.coalesce("__w", F.array().cast("array<string>")))).otherwise(F.col("tokens")).alias("tokens"),
        F.when(bad, F.col("attempts") + 1).otherwise(F.col("attempts")).cast("int").alias("attempts"),
        F.when(bad & (F.col("attempts") + 1 < most), F.timestamp_micros(F.unix_micros(now) + minutes.cast("long") * 60_000_000)).alias("retry_at"),
    )


def cache_split(docs: DataFrame, cache: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Documents whose vector is in the cache (key, content_hash, vector) for the text they have
    now, and those to be computed."""
    hashed = docs.withColumn("content_hash", F.sha2(T.empty_if_null(text), 256))
    c = cache.select(F.col(key).alias("__k"), F.col("content_hash").alias("__h"), "vector")
    same = (F.col(key) == F.col("__k")) & (F.col("content_hash") == F.col("__h"))
    return hashed.join(c, same).drop("__k", "__h"), hashed.join(c, same, "left_anti")
