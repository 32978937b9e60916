"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only).

Each source gets a target share of words. Its documents are laid in a pseudo-random but
repeatable order on one line of words, cut into blocks of equal length. Golden-ratio points, one
for each schedule slot, are mapped through the cumulative shares to a source; the k-th slot of a
source takes its block k modulo its number of blocks. What the mix takes of a document is the
overlap of the document with the blocks taken.

Scale: texts are read once, for their sizes; everything after works on (document, source, size)
rows. Running sums are taken within 4096 hash ranges of a source and joined to the sums of the
ranges before, so a source with most rows is spread over many tasks. The schedule has about
`slots` rows, and at most `cap * min_blocks` more for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

GOLDEN = 0.6180339887498949
CELLS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source, source_size, target of each source of sizes (source, size).

    Sources in code point order, null last, weigh `weights`, repeated as needed. The words of all
    sources are shared by weight; a source's target stops at cap times its size and the excess
    goes to the others by weight. That is min(cap * size, level * weight) for one level, found
    here by filling sources in order of cap * size / weight. One row per source is small beside
    the corpus, so windows over all sources are fine."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    name_order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.withColumn("rank", F.row_number().over(name_order)).withColumn("w", w.cast("long"))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("w"))
    everything = Window.partitionBy()
    fill = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (F.sum("source_size").over(everything) - (F.sum("most").over(fill) - F.col("most"))) / (F.sum("w").over(everything) - (F.sum("w").over(fill) - F.col("w")))
    filled = ranked.withColumn("level", level).withColumn("open", F.col("level") <= F.col("ratio"))
    # the level at the first source that stays below its cap
    final = F.min(F.when(F.col("open"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    return filled.withColumn("target", F.least(F.col("most").cast("double"), final * F.col("w"))).select("source", "rank", "source_size", "target")


def schedule(shares: DataFrame, slots: int = 65_536, min_blocks: int = 128, cap: int = 3) -> DataFrame:
    """rank, block, passes: how often each block of a source is taken. shares: output of
    block_sizes()."""
    live = shares.where(F.col("target") > 0)
    in_order = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.col("target") / F.col("block_words")
    edges = live.withColumn("share", share).withColumn("total", F.sum("share").over(Window.partitionBy()))
    edges = edges.withColumn("hi", F.sum("share").over(in_order) / F.col("total")).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("rank")), F.lit(0.0)))
    n = edges.agg(F.coalesce(F.ceil(F.max("total")), F.lit(0)).cast("long").alias("n"))
    points = n.select(F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).alias("slot"))
    at = (F.col("slot") + 0.5) * F.lit(GOLDEN)
    points = points.withColumn("p", at - F.floor(at)).select(F.floor(F.col("p") * CELLS).cast("int").alias("cell"), "p", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("long").alias("n_blocks"), "slot")
    # a source's interval starts anew in each cell of [0, 1) that it reaches into
    last_cell = F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int")
    starts = edges.withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("lo") * CELLS), F.lit(CELLS - 1)).cast("int"), last_cell)))
    starts = starts.select("cell", F.greatest("lo", F.col("cell") / CELLS).alias("p"), F.lit(0).alias("kind"), "rank", "n_blocks", F.lit(None).cast("long").alias("slot"))
    walk = Window.partitionBy("cell").orderBy("p", "kind", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mapped = points.unionByName(starts).select("kind", "slot", F.last("rank", ignorenulls=True).over(walk).alias("rank"), F.last("n_blocks", ignorenulls=True).over(walk).alias("n_blocks")).where("kind = 1")
    k = F.row_number().over(Window.partitionBy("rank").orderBy("slot")) - 1
    turns = mapped.withColumn("k", k).where(F.col("k") < F.col("n_blocks") * cap)
    return turns.groupBy("rank", (F.col("k") % F.col("n_blocks")).alias("block")).agg(F.count("*").alias("passes"))


def block_sizes(shares: DataFrame, slots: int = 65_536, min_blocks: int = 128) -> DataFrame:
    """shares with block_words and n_blocks. Blocks hold 1/slots of all words; a source of fewer
    than min_blocks such blocks is cut finer, so that small sources come near their targets."""
    total = F.sum("source_size").over(Window.partitionBy())
    words = F.greatest(F.lit(1), F.least(F.ceil(total / slots), F.ceil(F.col("source_size") / min_blocks))).cast("long")
    return shares.withColumn("block_words", words).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, slots: int = 65_536, min_blocks: int = 128, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, text, source).

    size is the number of words of the text (null: 0); taken the words that the mix takes of it,
    repeats counted, never above cap * size. The order of documents depends on seed, doc_id and
    text alone, so reruns agree and rows of one doc_id are
    spread over the ranges of their source. Null sources form one source, the last. Very long texts
    count whole. A null doc_id is ordered as an empty one; rows that repeat a doc_id are separate documents. Rows of size 0 are kept with
    taken 0. An empty table gives an empty result. Other columns of docs are not read."""
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("o")), "sizes")
    shares = block_sizes(targets(sizes, weights, cap), slots, min_blocks)
    shares = written(shares, "shares")
    keyed = sizes.withColumn("range", F.substring("o", 1, 3))
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sums.withColumn("offset", F.sum("range_words").over(before) - F.col("range_words"))
    s = shares.select(F.col("source").alias("s_source"), "rank", "source_size", "target", "block_words")
    offsets = offsets.join(s, F.col("source").eqNullSafe(F.col("s_source"))).select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), "offset", "rank", "source_size", "target", "block_words")
    within = Window.partitionBy("source", "range").orderBy("o", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = keyed.withColumn("end", F.sum("size").over(within))
    line = line.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
    line = line.select("doc_id", "source", "size", "source_size", "target", "rank", "block_words", (F.col("offset") + F.col("end") - F.col("size")).alias("start"))
    turns = schedule(shares, slots, min_blocks, cap).select(F.col("rank").alias("t_rank"), F.col("block").alias("t_block"), "passes")
    first = F.floor(F.col("start") / F.col("block_words"))
    last = F.floor((F.col("start") + F.col("size") - 1) / F.col("block_words"))
    parts = line.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    parts = parts.join(turns, (F.col("rank") == F.col("t_rank")) & (F.col("block") == F.col("t_block")), "left")
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words")) - F.greatest(F.col("start"), F.col("block") * F.col("block_words"))
    keep = ["doc_id", "source", "size", "source_size", "target"]
    # a document of at least one word is alone at its start
    taken = parts.groupBy("rank", "start", *keep).agg(F.sum(overlap * F.coalesce("passes", F.lit(0))).cast("long").alias("taken")).select(*keep, "taken")
    return taken.unionByName(line.where("size = 0").select(*keep, F.lit(0).cast("long").alias("taken")))


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS o FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM by_source),
weighed AS (SELECT *, ([5, 2, 1])[((rnk - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS most FROM ranked),
tot AS (SELECT sum(source_size)::BIGINT AS t, sum(w)::BIGINT AS ws FROM weighed),
filled AS (SELECT *, most::DOUBLE / w AS ratio FROM weighed),
leveled AS (
  SELECT f.*, (t - (sum(most) OVER z - most)::BIGINT)::DOUBLE / (ws - (sum(w) OVER z - w)::BIGINT) AS lvl
  FROM filled f, tot WINDOW z AS (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lev AS (SELECT lvl FROM leveled WHERE lvl <= ratio ORDER BY ratio, rnk LIMIT 1),
shares AS (
  SELECT source, rnk, source_size, least(most::DOUBLE, (SELECT lvl FROM lev) * w) AS target,
         greatest(1, least(ceil(t::DOUBLE / 65536), ceil(source_size::DOUBLE / 128)))::BIGINT AS bw FROM leveled, tot),
blocks AS (SELECT *, ceil(source_size::DOUBLE / bw)::BIGINT AS nb FROM shares),
edge AS (
  SELECT *, sum(target / bw) OVER (ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         sum(target / bw) OVER () AS total FROM blocks WHERE target > 0),
edges AS (SELECT *, cum / total AS hi, coalesce(lag(cum / total) OVER (ORDER BY rnk), 0) AS lo FROM edge),
points AS (
  SELECT slot, (slot + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE - floor((slot + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) AS p
  FROM (SELECT unnest(range(0, coalesce((SELECT ceil(max(total))::BIGINT FROM edge), 0))) AS slot)),
mapped AS (SELECT slot, rnk, nb FROM points JOIN edges ON p >= lo AND p < hi),
turn AS (SELECT rnk, nb, row_number() OVER (PARTITION BY rnk ORDER BY slot) - 1 AS k FROM mapped),
passes AS (SELECT rnk, k % nb AS block, count(*) AS passes FROM turn WHERE k < 3 * nb GROUP BY ALL),
line AS (
  SELECT doc_id, s.source, size, source_size, target, rnk, bw,
         (sum(size) OVER (PARTITION BY s.source ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
  FROM sizes s JOIN blocks b ON s.source IS NOT DISTINCT FROM b.source),
part AS (SELECT *, unnest(range(start // bw, (start + size - 1) // bw + 1)) AS block FROM line WHERE size > 0),
taken AS (
  SELECT doc_id, size, source_size, target,
         sum((least(start + size, (p.block + 1) * bw) - greatest(start, p.block * bw)) * coalesce(passes, 0))::BIGINT AS taken
  FROM part p LEFT JOIN passes t ON p.rnk = t.rnk AND p.block = t.block GROUP BY p.rnk, start, doc_id, size, source_size, target)
SELECT doc_id, size, source_size, target, taken FROM taken
UNION ALL SELECT doc_id, size, source_size, target, 0::BIGINT FROM line WHERE size = 0
"""
