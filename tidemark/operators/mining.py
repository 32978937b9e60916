"""Phrases of titles: n-grams, technology mining, emergence between two periods, keyphrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import phrases as P
from tidemark.functions.text import STOP_WORDS, TERM
from tidemark.plans.store import cut

from . import ranges


def title_of(text: Column) -> Column:
    """First line of a text; what comes after it is not split."""
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)


def ngrams(title: Column, low: int, high: int, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct n-grams of low to high words that neither start nor end with a stop word, never
    across punctuation."""
    segments = F.split(F.lower(title), r"[^\p{L}\p{N}_\s-]+")
    words = F.transform(segments, lambda s: F.regexp_extract_all(s, F.lit(f"({TERM})"), F.lit(1)))

    def grams(ws: Column, n: int) -> Column:
        starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - (n - 1))).otherwise(F.array().cast("array<int>"))
        kept = F.filter(starts, lambda i: ~ws[i - 1].isin(*stop) & ~ws[i + (n - 2)].isin(*stop))
        return F.transform(kept, lambda i: F.array_join(F.slice(ws, i, n), " "))

    def every(ws: Column) -> Column:
        return F.concat(*[grams(ws, n) for n in range(low, high + 1)])

    return F.array_distinct(F.flatten(F.transform(words, every)))


def phrase_table(docs: DataFrame, key: str, source: str, title: Column, low: int = 2, high: int = 2) -> DataFrame:
    """key, source, phrase: one row for each phrase of a document."""
    return docs.select(key, source, F.explode(ngrams(title, low, high)).alias("phrase"))


def mine(phrases: DataFrame, key: str, source: str, total: int, min_docs: int = 2, min_sources: int = 2, max_share: float = 0.33) -> DataFrame:
    """phrase, docs, sources, score of phrases in enough documents and sources but not in too many:
    docs * (1 + (sources - 1) / 2) * log2(words + 1)."""
    words = F.size(F.split("phrase", " "))
    counted = phrases.groupBy("phrase").agg(F.count_distinct(key).alias("docs"), F.count_distinct(source).alias("sources"))
    kept = counted.where((F.col("docs") >= min_docs) & (F.col("sources") >= min_sources) & (F.col("docs") / total <= max_share))
    return kept.withColumn("score", F.col("docs") * (1 + 0.5 * (F.col("sources") - 1)) * F.log2(words + 1.0))


def _key_of(spelling: Column | str) -> Column:
    """phrase_key(), which leaves as it is what doesn't end in s."""
    spelling = F.col(spelling) if isinstance(spelling, str) else spelling
    return F.when(spelling.endswith("s"), P.phrase_key(spelling)).otherwise(spelling)


def _spellings(titles: DataFrame, low: int, high: int, generic_words: Sequence[str]) -> DataFrame:
    """said, own, source, by, n: a row for each phrase of a title as it is spelled (own), and further rows
    by which the sum of `by` over a phrase's spellings is the number of its documents, null keys left out.
    titles has key, source, title and alone (no other row has its key)."""
    grams = ngrams(F.col("title"), low, high)
    if generic_words:
        grams = F.filter(grams, lambda g: ~F.forall(F.split(g, " "), lambda w: w.isin(*generic_words)))
    # alone is tested before the phrases are formed; outer, as Spark else forms them once more to test whether there are any
    lone, rest = (titles.where(w).select("key", "source", grams.alias("grams")) for w in ("alone", "NOT alone"))

    def entry(said: Column, own: bool, by: int) -> Column:
        return F.struct(said.alias("said"), F.lit(own).alias("own"), F.lit(by).alias("by"), F.lit(int(own)).alias("n"))

    # a title that spells a phrase in both numbers has it once
    keys = F.filter(F.transform(F.filter("grams", lambda g: g.endswith("s")), lambda g: F.struct(g.alias("g"), P.phrase_key(g).alias("k"))), lambda x: x["g"] != x["k"])
    moved = lone.select("source", "grams", F.sort_array(F.transform(keys, lambda x: x["k"])).alias("k"))
    again = F.concat(F.array_intersect("k", "grams"), F.filter("k", lambda x, i: (i > 0) & (x == F.get(F.col("k"), i - 1))))
    whole = moved.select("source", F.inline_outer(F.concat(F.transform("grams", lambda g: entry(g, True, 1)), F.transform(again, lambda p: entry(p, False, -1))))).where("said IS NOT NULL")
    # rows that share a key, or have none
    rest = rest.select("key", "source", F.explode_outer("grams").alias("said")).where("said IS NOT NULL").distinct()
    spelled = rest.select("source", entry(F.col("said"), True, 0).alias("e"))
    docs = rest.where("key IS NOT NULL").select("key", _key_of("said").alias("said")).distinct().select(F.lit(None).cast(titles.schema["source"].dataType).alias("source"), entry(F.col("said"), False, 1).alias("e"))
    return whole.unionByName(spelled.unionByName(docs).select("source", "e.*")).select("said", "own", "source", "by", "n")


def mine_technologies(docs: DataFrame, key: str, source: str, title: Column, topics: Sequence[str] = (), generic: Sequence[str] = (), generic_words: Sequence[str] = (), low: int = 2, high: int = 4, min_docs: int = 2, min_sources: int = 2, max_share: float = 0.33) -> DataFrame:
    """phrase, surface, docs, sources, score of the phrases of titles that may name a technology.

    * Titles that are equal but for case and blanks are one piece of evidence, that of the smallest
      key: reprints add neither documents nor sources.
    * Phrases that differ in the number of their last word are one; surface is the most common
      spelling (ties: the first in order).
    * A phrase of generic words only, one of `generic`, and one that is a topic are blocked (in either
      number), as is one that holds a topic of several words or stands inside one.
    * Enough documents and sources, but not too large a share of all titles. Score is
      docs * (1 + (sources - 1) / 2) * log2(words + 1)."""
    one = docs.select(key, source, title.alias("title")).withColumn("folded", F.trim(F.regexp_replace(F.lower("title"), r"(?U)\s+", " "))).where("folded != ''")
    # the grouped minimum combines in the tasks, so a title that a third of all rows share is no hot key
    one = one.groupBy("folded").agg(F.min(F.struct(key, source, "title")).alias("t")).select(f"t.{key}", f"t.{source}", "t.title")
    alone = (F.count("*").over(Window.partitionBy(key, F.when(F.col(key).isNull(), F.col("title")))) == 1) & F.col(key).isNotNull()
    one = cut(one.select(F.col(key).alias("key"), F.col(source).alias("source"), "title", alone.alias("alone")))
    total = one.agg(F.count("*").alias("total"))
    held = _spellings(one, low, high, generic_words).groupBy("said", "own", "source").agg(F.sum("by").alias("by"), F.sum("n").alias("n"))
    held = held.withColumn("phrase", F.when(F.col("own"), _key_of("said")).otherwise(F.col("said")))
    # one exchange by phrase; what stands in too few documents goes before anything else is counted
    of, once = Window.partitionBy("phrase"), Window.partitionBy("phrase", "own", "source").orderBy("said")
    held = held.withColumn("docs", F.sum("by").over(of)).where(F.col("docs") >= min_docs)
    fresh = F.col("own") & F.col("source").isNotNull() & (F.row_number().over(once) == 1)
    held = held.withColumn("fresh", fresh).withColumn("sources", F.count_if("fresh").over(of)).where((F.col("sources") >= min_sources) & F.col("own"))
    named = held.groupBy("phrase", "docs", "sources", "said").agg(F.sum("n").alias("n"))
    counted = named.groupBy("phrase", "docs", "sources").agg(F.min(F.struct((-F.col("n")).alias("o"), "said")).alias("s")).select("phrase", "docs", "sources", F.col("s.said").alias("surface"))
    kept = counted.crossJoin(F.broadcast(total)).where(F.col("docs") / F.col("total") <= max_share)
    topics = [" ".join(t.lower().split()) for t in topics if t.strip()]
    for t in (*generic, *topics):
        kept = kept.where(~F.col("phrase").isin(t) & (F.col("phrase") != P.phrase_key(F.lit(t))))
    for t in topics:
        if " " in t:
            key_ = P.phrase_key(F.lit(t))
            kept = kept.where(~inside(F.col("phrase"), key_) & ~inside(key_, F.col("phrase")))
    n = F.size(F.split("phrase", " "))
    return kept.withColumn("score", F.col("docs") * (1 + 0.5 * (F.col("sources") - 1)) * F.log2(n + 1.0)).select("phrase", "surface", "docs", "sources", "score")


def inside(inner: Column, outer: Column) -> Column:
    """Whether the words of one phrase stand in a row in another (or are it)."""
    return F.contains(F.concat(F.lit(" "), outer, F.lit(" ")), F.concat(F.lit(" "), inner, F.lit(" ")))


def absorb(scored: DataFrame, limit: int) -> DataFrame:
    """scored (phrase, docs, score and others) with pos, the best `limit` phrases in order: best first,
    a phrase whose words stand inside a chosen one that is at least as frequent is left out, and chosen
    phrases inside a new one go. Choosing stops once `limit` are chosen.

    That is decided without reading phrases in turn. A phrase absorbs the phrases inside it that are
    no more frequent, and what it is absorbed by absorbs these too; so when a phrase is reached it is
    chosen unless one that absorbs it came before, and stays until the first one that absorbs it comes.
    Each phrase is joined with its own sub-phrases (a few), ranks and the number chosen are running
    sums over ranges of the order, and the first rank with `limit` chosen ends it."""
    best = [F.col("score").desc(), F.col("phrase")]
    ranked = cut(ranges.running(scored, best, {"rank": F.lit(1)}))
    words, n = F.split("phrase", " "), F.size(F.split("phrase", " "))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.struct(i.alias("i"), k.alias("k")))))
    parts = F.array_distinct(F.transform(F.filter(spans, lambda x: x["k"] < n), lambda x: F.array_join(F.slice(words, x["i"], x["k"]), " ")))
    over = ranked.select(F.explode(parts).alias("__part"), F.col("docs").alias("__docs"), F.col("rank").alias("__by"))
    first = ranked.join(over, (F.col("phrase") == F.col("__part")) & (F.col("docs") <= F.col("__docs"))).groupBy(F.col("phrase").alias("__p")).agg(F.min("__by").alias("__until"))
    alive = ranked.join(first, F.col("phrase") == F.col("__p"), "left").where("__until IS NULL OR __until > rank").drop("__p")
    alive = cut(alive)
    moves = alive.select(F.col("rank").alias("at"), F.lit(1).alias("by")).unionByName(alive.where("__until IS NOT NULL").select(F.col("__until").alias("at"), F.lit(-1).alias("by")))
    held = ranges.running(moves.groupBy("at").agg(F.sum("by").alias("by")), [F.col("at")], {"chosen": F.col("by")})
    stop = held.where(F.col("chosen") >= limit).agg(F.min("at").alias("__stop"))
    shown = alive.crossJoin(F.broadcast(stop)).where("(__stop IS NULL OR rank <= __stop) AND (__until IS NULL OR __until > __stop)")
    top = shown.orderBy("rank").limit(limit)
    return top.withColumn("pos", F.row_number().over(Window.orderBy("rank"))).select(*scored.columns, "pos")


def surface_forms(words: DataFrame, word: Column, surface: str, key: str) -> DataFrame:
    """word, surface, n: the most common spelling of each word, that of the smallest key among equals."""
    counts = words.groupBy(word.alias("word"), surface).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("o"), "first", F.col(surface).alias("surface")))
    return counts.groupBy("word").agg(best.alias("b")).select("word", "b.surface", (-F.col("b.o")).alias("n"))


def two_period_growth(rows: DataFrame, term: str, recent: Column, base: Column, min_recent: int = 3, max_share: float = 0.2, min_growth: float = 1.5, min_base_total: int = 0, per: Column | None = None) -> DataFrame:
    """term, recent, base, growth, score of terms that grew: smoothed rate in the recent period over
    the rate in the base period, score = growth * log2(1 + recent).

    rows has one row for each (document, term); totals count documents (`per`) of each period, or
    rows where no document is named."""
    unit = per if per is not None else F.monotonically_increasing_id()
    marked = rows.withColumn("__r", F.coalesce(recent, F.lit(False))).withColumn("__b", F.coalesce(base, F.lit(False)) & ~F.coalesce(recent, F.lit(False))).withColumn("__u", unit)
    if per is None:
        totals = marked.agg(F.count_if("__r").alias("tr"), F.count_if("__b").alias("tb"))
    else:
        totals = marked.agg(F.count_distinct(F.when(F.col("__r"), F.col("__u"))).alias("tr"), F.count_distinct(F.when(F.col("__b"), F.col("__u"))).alias("tb"))
    counted = marked.groupBy(term).agg(F.count_if("__r").alias("recent"), F.count_if("__b").alias("base")).join(F.broadcast(totals))
    s = 1.0 / F.greatest(F.lit(1), F.col("tr") + F.col("tb"))
    growth = (F.col("recent") / F.col("tr") + s) / (F.when(F.col("tb") > 0, F.col("base") / F.col("tb")).otherwise(0.0) + s)
    kept = counted.where((F.col("tr") > 0) & (F.col("tb") >= min_base_total) & (F.col("recent") >= min_recent) & (F.col("recent") / F.nullif(F.col("tr"), F.lit(0)) <= max_share))
    kept = kept.withColumn("growth", growth).where(F.col("growth") >= min_growth)
    return kept.withColumn("score", F.col("growth") * F.log2(1.0 + F.col("recent"))).select(term, "recent", "base", "growth", "score")


def keyphrases(docs: DataFrame, group: str, title: Column, limit: int = 60) -> DataFrame:
    """group, phrase, n, pos: n-grams of one to three words of a group's titles, most frequent first,
    then longer, then in order."""
    phrases = docs.select(group, F.explode(ngrams(title, 1, 3)).alias("phrase")).where(F.length("phrase") >= 3)
    n = phrases.groupBy(group, "phrase").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), F.size(F.split("phrase", " ")).desc(), "phrase")
    return n.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)


def idf_ranking(docs: DataFrame, key: str, tokens: str, vocabulary: list[str], least: int, limit: int) -> DataFrame:
    """key, matched, score: documents that hold `least` or more vocabulary words, by the sum of
    log((n + 1) / (df + 0.5)) of these."""
    words = docs.select(key, F.explode(F.array_intersect(tokens, F.array(*[F.lit(v) for v in vocabulary]))).alias("word"))
    n = docs.agg(F.count("*").alias("n"))
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    # the vocabulary bounds df, and n is one row
    weighed = words.join(F.broadcast(df), "word").join(F.broadcast(n))
    out = weighed.groupBy(key).agg(F.count("*").alias("matched"), F.sum(F.log((F.col("n") + 1) / (F.col("df") + 0.5))).alias("score"))
    # the order of summing moves the last digits of a score; equal ones must tie
    return out.where(F.col("matched") >= least).orderBy(F.round("score", 9).desc(), key).limit(limit)
