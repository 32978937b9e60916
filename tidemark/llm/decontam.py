"""Benchmark decontamination with a broadcast set of normalised test n-grams (DataFrame functions only).

The hashes of all benchmark windows form a set that travels with the plan while it holds at most
`set_limit` entries; every window of every document is hashed and looked up in place, without a
shuffle. Words are hashed once, a window's hash is that of its words' hashes. Beyond that size, the
windows of documents are joined to the windows of the benchmark by their hash. Hits are verified on
the words themselves, so a hash collision never counts.

Scale: texts are scanned once; what leaves the scan is one narrow row per document or hit. What is
broadcast is the distinct windows, at most `set_limit` of them; the items that hold a window, whose
number nothing bounds, are joined by a shuffle once a document's hits are distinct. Beyond the limit
windows are keys of a shuffle join, whose hot keys adaptive execution splits. Results are grouped
by document."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The same classes in a text that isn't lower-cased yet.
RAW_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    # lower() also folds letters beyond ASCII, so it serves for texts without such letters only
    ascii_only = F.octet_length(text) == F.length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(folded, F.lit("")), SEPARATOR + "+"), "")


def benchmark_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """item, length, h, g: the distinct windows of each item of benchmark (item_id, text), their
    hash and their words. An item of fewer than `size` words, but not none, is one window; null
    texts have none."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("length", F.least(F.size("w"), F.lit(size)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    grams = w.select("item", "length", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("length")))).alias("gram"))
    return grams.select("item", "length", F.xxhash64(word_hashes("gram")).alias("h"), F.array_join("gram", " ").alias("g")).distinct()


def word_hashes(w: Column | str) -> Column:
    """The hash of each word of an array."""
    return F.transform(w, lambda x: F.xxhash64(x))


def _hash_at(i: Column, length: int) -> Column:
    return F.xxhash64(F.slice("wh", i, F.lit(length)))


def _starts(length: int) -> Column:
    # the size of wh, not of w: read twice, wh is computed once a text and not once a window
    return F.when(F.size("wh") >= length, F.sequence(F.lit(1), F.size("wh") - (length - 1))).otherwise(F.array().cast("array<int>"))


def _candidates_by_set(docs: DataFrame, hashes: dict[int, list[int]]) -> DataFrame:
    """hits: array of (i, length) whose window's hash is in the set. The set is a literal, which
    Spark turns into a hash set that is shipped with the tasks."""
    def lookup(length: int, known: list[int]) -> Column:
        starts = F.filter(_starts(length), lambda i: _hash_at(i, length).isin(known))
        return F.transform(starts, lambda i: F.struct(i.alias("i"), F.lit(length).alias("length")))

    found = [lookup(n, known) for n, known in sorted(hashes.items())]
    empty = F.array().cast("array<struct<i:int,length:int>>")
    return docs.withColumn("hits", F.concat(*found) if found else empty)


def _candidates_by_join(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a benchmark of any size: window hashes are exploded and joined by a shuffle."""
    docs = written(docs, "decontam-words")

    def hashed(length: int) -> Column:
        return F.transform(_starts(length), lambda i: F.struct(i.alias("i"), F.lit(length).alias("length"), _hash_at(i, length).alias("h")))

    hashes = F.flatten(F.array(*[hashed(n) for n in lengths]))
    rows = docs.select("row", F.explode(hashes).alias("x")).select("row", "x.*")
    known = windows.select(F.col("length").alias("k_length"), F.col("h").alias("k_h")).distinct()
    hit = rows.join(known, (F.col("h") == F.col("k_h")) & (F.col("length") == F.col("k_length")), "left_semi")
    by_row = hit.groupBy("row").agg(F.collect_list(F.struct("i", "length")).alias("found")).withColumnRenamed("row", "f_row")
    empty = F.array().cast("array<struct<i:int,length:int>>")
    return docs.join(by_row, F.col("row") == F.col("f_row"), "left").withColumn("hits", F.coalesce("found", empty)).drop("found", "f_row")


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, set_limit: int = 200_000) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, item_ids (sorted array), hit_words (sorted positions
    from 1) for every row of docs (doc_id, text).

    A word inside any occurrence of a benchmark window is hit. Null and empty texts have no words
    and no hits, very long ones are taken whole; a repeated row gives a repeated result; an empty benchmark or table hits
    nothing. Other columns are not read."""
    windows = benchmark_windows(benchmark, size)
    head = windows.select("length", "h").distinct().limit(set_limit + 1).collect()
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w")).withColumn("row", F.monotonically_increasing_id())
    base = base.withColumn("wh", word_hashes("w"))
    if len(head) <= set_limit:
        by_length: dict[int, list[int]] = {}
        for r in head:
            by_length.setdefault(r["length"], []).append(r["h"])
        found = _candidates_by_set(base, by_length)
    else:
        lengths = [r[0] for r in windows.select("length").distinct().collect()]  # at most `size` values
        found = _candidates_by_join(base, windows, lengths)
    spelled = F.transform("hits", lambda x: F.struct(x["i"].alias("i"), x["length"].alias("length"), F.slice("w", x["i"], x["length"]).alias("gram")))
    rows = found.select("row", "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.explode_outer(spelled).alias("x"))
    rows = rows.select("row", "doc_id", "text_hash", "n_words", "x.i", "x.length", F.array_join("x.gram", " ").alias("gram"))
    # rows without a candidate get a key of their own, so that they do not meet in one task
    key = F.coalesce("gram", F.concat(F.lit(" "), F.col("row").cast("string")))
    known = windows.select(F.col("g").alias("k")).distinct()
    if len(head) <= set_limit:
        known = F.broadcast(known)
    rows = rows.withColumn("key", key).join(known, F.col("key") == F.col("k"), "left")
    span = F.when(F.col("k").isNotNull(), F.sequence(F.col("i"), F.col("i") + F.col("length") - 1))
    per_doc = rows.groupBy("row", "doc_id", "text_hash", "n_words").agg(F.collect_list(span).alias("spans"), F.collect_set("k").alias("grams"))
    per_doc = written(per_doc, "decontam-hits")
    items = per_doc.select("row", F.explode("grams").alias("gram")).join(windows.select("item", "g"), F.col("gram") == F.col("g"))
    items = items.groupBy(F.col("row").alias("i_row")).agg(F.collect_set("item").alias("items"))
    hit_words = F.array_sort(F.array_distinct(F.flatten("spans")))
    found = per_doc.join(items, F.col("row") == F.col("i_row"), "left")
    item_ids = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    return found.select("doc_id", "text_hash", "n_words", F.size(hit_words).cast("long").alias("n_hit"), item_ids.alias("item_ids"), hit_words.alias("hit_words"))


def _without_windows(docs: DataFrame, windows: list) -> DataFrame:
    """Rows of docs without any of the windows (length, h, g): where a hash is in the set, the
    words themselves are looked up. Nothing leaves the scan, so texts aren't shuffled."""

    def hit(length: int, hashes: list[int], grams: list[str]) -> Column:
        found = F.filter(_starts(length), lambda i: _hash_at(i, length).isin(hashes))
        return F.exists(found, lambda i: F.array_join(F.slice("w", i, F.lit(length)), " ").isin(grams))

    by_length: dict[int, tuple[list[int], list[str]]] = {}
    for r in windows:
        hashes, grams = by_length.setdefault(r["length"], ([], []))
        hashes.append(r["h"])
        grams.append(r["g"])
    bad = F.lit(False)
    for n, (hashes, grams) in sorted(by_length.items()):
        bad = bad | hit(n, hashes, grams)
    # the row numbers, which the filter reads, keep it above the projections that split the text and
    # hash its words: pushed below, it would do so once for each window
    split = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), words(F.col("text")).alias("w"), F.monotonically_increasing_id().alias("row"))
    hashed = split.select("d", "w", "row", word_hashes("w").alias("wh"), F.monotonically_increasing_id().alias("again"))
    return hashed.where((F.col("row") >= 0) & (F.col("again") >= 0) & ~bad).select("d.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = 10, set_limit: int = 200_000) -> DataFrame:
    """docs without what the benchmark holds, with the columns of docs.

    mode "documents" drops documents with a hit; "spans" removes the hit words and the separators
    after them from the text and keeps the rest. Rows are matched by doc_id and a hash of the
    text, so rows that repeat a doc_id are judged by their own text. Null, empty and very long texts
    as in find_contamination(): nulls and empty texts are kept. An empty table gives an empty result."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "documents":
        windows = benchmark_windows(benchmark, size).select("length", "h", "g").distinct()
        head = windows.limit(set_limit + 1).collect()
        if len(head) <= set_limit:
            return _without_windows(docs, head)
    hit = find_contamination(docs, benchmark, size, set_limit).where("n_hit > 0")
    of_id, of_text, hit_at = fresh(docs, "hit_id", "hit_text", "hit_words")
    hit = hit.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_text), F.col("hit_words").alias(hit_at)).dropDuplicates([of_id, of_text])
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64("text") == F.col(of_text))
    if mode == "documents":
        return docs.join(hit, same, "left_anti")
    pieces = F.regexp_extract_all("text", F.lit(f"({RAW_WORD}{RAW_SEPARATOR}*)"), F.lit(1))
    lead = F.regexp_extract("text", f"^({RAW_SEPARATOR}*)", 1)
    left = F.filter(pieces, lambda p, i: ~F.array_contains(hit_at, i + 1))
    cleaned = F.when(F.col(hit_at).isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(left, "")))
    joined = docs.join(hit, same, "left")
    return joined.select(*[cleaned.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, least(len(w), 10) AS n, w FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
lens AS (SELECT DISTINCT n FROM grams),
dg AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT rid, dg.i, dg.n, item FROM dg JOIN grams g ON dg.n = g.n AND dg.gram = g.gram),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
