"""Merges, joins, pages, samples and top-k selections of the document store.

Each operator is DataFrame to DataFrame. Keys of merges are hashed by Spark; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far a date's origin is trusted (fixed values).
DATE_RANK = {"api": 3, "page": 3, "rss": 3, "sitemap": 3, "url": 2}


def date_rank(source: Column) -> Column:
    rank = F.lit(1)
    for name, value in DATE_RANK.items():
        rank = F.when(source == name, value).otherwise(rank)
    return rank


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new merged in by url_hash; both have url_hash, title, body, published_at,
    published_source, arrived.

    The longest body brings its title along (the earlier of equal ones); a date is replaced only
    by one of a better origin; the latest arrival is kept. A partial aggregation, so a hot key is
    combined before the shuffle."""
    rows = old.unionByName(new, allowMissingColumns=True)
    text = F.max_by(F.struct("title", "body"), F.struct(F.length(F.coalesce("body", F.lit(""))), -F.unix_micros("arrived")))
    dated = F.when(F.col("published_at").isNotNull(), date_rank(F.col("published_source")))
    day = F.max_by(F.struct("published_at", "published_source"), F.struct(dated, -F.unix_micros("arrived")))
    out = rows.groupBy("url_hash").agg(text.alias("t"), day.alias("d"), F.max("arrived").alias("arrived"), F.count("*").alias("versions"))
    return out.select("url_hash", "t.title", "t.body", "d.published_at", "d.published_source", "arrived", "versions")


def merge_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first by order. Last-write-wins and keep-first merges."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def resolve_two_keys(rows: DataFrame, store: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """rows with the `key` of the stored row of equal `first`, else of equal `second`, else null.
    A null never matches; of several stored rows the smallest key counts."""

    def by(column: str, name: str) -> DataFrame:
        return store.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(f"__{column}")).agg(F.min(key).alias(name))

    out = rows.join(by(first, "__a"), F.col(first) == F.col(f"__{first}"), "left").join(by(second, "__b"), F.col(second) == F.col(f"__{second}"), "left")
    return out.withColumn(key, F.coalesce("__a", "__b")).drop("__a", "__b", f"__{first}", f"__{second}")


def insert_absent(store: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """store and those rows whose keys it lacks, once for each key."""
    return store.unionByName(rows.dropDuplicates(list(keys)).join(store.select(*keys), list(keys), "left_anti"))


def without_recent_link(left: DataFrame, links: DataFrame, key: Sequence[str] | Column) -> DataFrame:
    """Rows of left that no link holds (NOT EXISTS)."""
    return left.join(links, key, "left_anti")


def merge_archive(rows: DataFrame, many: int = 32) -> DataFrame:
    """url, title, summary, published_on, tokens of the versions of each url: longest title and
    summary, earliest known date, union of the tokens.

    Tokens of a url of at most `many` versions are united as arrays where its texts meet; those of a url of
    more versions, one array of which may not fit a task, by a shuffle of distinct tokens. Urls, which may be
    long, are grouped by their SHA-256."""
    named = F.coalesce(F.unhex(F.sha2(F.col("url").cast("string"), 256)), F.lit(b""))
    keyed = rows.withColumn("__k", named)
    large = keyed.groupBy(F.col("__k").alias("__l")).agg(F.count("*").alias("__n")).where(F.col("__n") > many).select("__l")
    marked = keyed.join(large, F.col("__k") == F.col("__l"), "left").withColumn("tokens", F.array_distinct(F.array_compact("tokens")))
    longest = lambda c: F.max_by(F.coalesce(c, F.lit("")), F.struct(F.length(F.coalesce(c, F.lit(""))), F.coalesce(c, F.lit(""))))
    few = F.collect_list(F.when(F.col("__l").isNull(), F.col("tokens")))
    merged = marked.groupBy("__k").agg(F.max("url").alias("url"), longest(F.col("title")).alias("title"), longest(F.col("summary")).alias("summary"), F.min("published_on").alias("published_on"), few.alias("__few"))
    token = marked.where("__l IS NOT NULL").select(F.col("__l").alias("__u"), F.explode("tokens").alias("__t")).distinct()  # each token is collected once
    union = token.groupBy("__u").agg(F.array_sort(F.collect_set("__t")).alias("__many"))
    out = merged.join(union, F.col("__k") == F.col("__u"), "left")
    return out.select("url", "title", "summary", "published_on", F.coalesce("__many", F.array_sort(F.array_distinct(F.flatten("__few")))).alias("tokens"))


def keyset_page(rows: DataFrame, keys: Sequence[tuple[str, object]], size: int) -> DataFrame:
    """The next page after the given key values, in ascending order of the keys."""
    after = F.lit(False)
    for i, (name, value) in enumerate(keys):
        c = F.col(name) > F.lit(value)
        for earlier, v in keys[:i]:
            c = c & (F.col(earlier) == F.lit(v))
        after = after | c
    return rows.where(after).orderBy(*[k for k, _ in keys]).limit(size)


def page_token(*parts: Column) -> Column:
    return F.base64(F.encode(F.concat_ws(":", *parts), "UTF-8"))


def read_page_token(token: Column) -> Column:
    return F.split(F.decode(F.unbase64(token), "UTF-8"), ":")


def first_per_group(rows: DataFrame, group: str, order: Sequence[Column], limit: int) -> DataFrame:
    """At most `limit` rows of each group."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("pos") <= limit)


def hash_sample(rows: DataFrame, key: str, size: int, group: str | None = None) -> DataFrame:
    """`size` rows (of each group) by the MD5 of their key: the same rows every time."""
    coin = F.md5(F.col(key).cast("string"))
    if group is None:
        return rows.orderBy(coin, key).limit(size)
    return first_per_group(rows, group, [coin.asc(), F.col(key).asc()], size)


def top_with_reserve(rows: DataFrame, flagged: Column, order: Sequence[Column], limit: int, reserve: int) -> DataFrame:
    """`limit` rows: first the best flagged ones, at most `reserve`, then the best of the rest. Of
    either kind only the best `limit` leave a task."""
    marked = rows.withColumn("__f", F.coalesce(flagged, F.lit(False)))
    best = marked.where("__f").orderBy(*order).limit(limit)
    best = best.withColumn("reserved", F.row_number().over(Window.orderBy(*order)) <= min(reserve, limit))
    rest = marked.where("NOT __f").orderBy(*order).limit(limit).withColumn("reserved", F.lit(False))
    return best.unionByName(rest).orderBy(F.col("reserved").desc(), *order).limit(limit).drop("__f")


def interleave(rows: DataFrame, channel: str, order: Sequence[Column], quota: int | None = None) -> DataFrame:
    """Rows in turns of their channels, at most `quota` of each: pos numbers them within the
    channel, and (pos, channel) is the order."""
    out = rows.withColumn("pos", F.row_number().over(Window.partitionBy(channel).orderBy(*order)))
    return out.where(F.col("pos") <= quota) if quota else out


def mixed_selection(rows: DataFrame, key: str, score: str, relevance: str, limit: int, share: float) -> DataFrame:
    """`limit` rows without repeats: the best ceil(limit * share) by score, the rest by relevance;
    ties by key. Column picked_by says which."""
    quota = -(-int(limit * share * 1_000_000) // 1_000_000)
    by_score = rows.orderBy(F.col(score).desc_nulls_last(), key).limit(quota).withColumn("picked_by", F.lit("score"))
    rest = rows.join(by_score.select(key), key, "left_anti").orderBy(F.col(relevance).desc_nulls_last(), key).limit(max(0, limit - quota))
    return by_score.unionByName(rest.withColumn("picked_by", F.lit("relevance")))


def exact_dedup(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows kept when each of `keys` in turn keeps the first of equal non-null values."""
    out = rows
    for k in keys:
        first = merge_rows(out.where(F.col(k).isNotNull()), [k], order)
        out = first.unionByName(out.where(F.col(k).isNull()))
    return out


def concept_count(tokens: Column, concepts: Sequence[Sequence[str]]) -> Column:
    """How many concepts have one of their forms among the tokens."""
    total = F.lit(0)
    for forms in concepts:
        total = total + F.arrays_overlap(tokens, F.array(*[F.lit(f) for f in forms])).cast("int")
    return total


def search_archive(rows: DataFrame, concepts: Sequence[Sequence[str]], least: int, limit: int) -> DataFrame:
    """url, tokens rows that hold `least` concepts or more: most concepts first, then newest, url."""
    words = sorted({f for forms in concepts for f in forms})
    hit = rows.where(F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in words]))).withColumn("concepts", concept_count(F.col("tokens"), concepts))
    return hit.where(F.col("concepts") >= least).orderBy(F.col("concepts").desc(), F.col("published_on").desc_nulls_last(), "url").limit(limit)


def compare_rows(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """key, status (only_a, only_b, same, changed) and the fields that differ, of two runs."""
    left = a.select(F.col(key).alias("__ka"), F.struct(*fields).alias("__a"))
    right = b.select(F.col(key).alias("__kb"), F.struct(*fields).alias("__b"))
    types = dict(a.dtypes)

    def differs(f: str) -> Column:
        x, y = F.col(f"__a.{f}"), F.col(f"__b.{f}")
        same = (F.abs(x - y) <= tolerance) if types[f] in ("double", "float") else F.lit(False)
        return ~(x.eqNullSafe(y) | F.coalesce(same, F.lit(False)))

    both = left.join(right, F.col("__ka") == F.col("__kb"), "full_outer")
    changed = F.filter(F.array(*[F.when(differs(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    status = F.when(F.col("__kb").isNull(), "only_a").when(F.col("__ka").isNull(), "only_b").when(F.size(changed) == 0, "same").otherwise("changed")
    return both.select(F.coalesce("__ka", "__kb").alias(key), status.alias("status"), F.when(status == "changed", changed).otherwise(F.array().cast("array<string>")).alias("changed"))
