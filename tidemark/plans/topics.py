"""Registered queries of glossary phrases, topic words, records and harvests, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import events, experiments, mining, translation, vectors
from tidemark.session import table

from .catalogue import query
from .columns import OTHER, STEM, STOPS
from .scoring import staged_rows

#: Words that a glossary has to translate, in the driver's invented languages: those in a to m.
FOREIGN = "^[a-m]"


def glossary(spark, d):
    """entry, value, place: the words and pairs of words of the benchmark, in capitals."""
    words = F.regexp_extract_all(F.lower(T.empty_if_null("text")), F.lit(r"(?U)([\w-]+)"), F.lit(1))
    rows = table(spark, d, "benchmark").select(words.alias("w"))
    one = rows.select(F.explode("w").alias("entry")).where("length(entry) >= 6").distinct().withColumn("value", F.upper("entry"))
    pairs = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(F.col("w"), i + 1)))
    two = rows.select(F.explode(pairs).alias("entry")).where("length(entry) >= 12").distinct().withColumn("value", F.upper(F.translate("entry", " ", "_")))
    return one.unionByName(two).withColumn("place", F.col("entry"))


@query()
def fallback_terms(spark, d):
    """Search phrases of every document by a glossary of the benchmark's words."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = translation.fallback_terms(docs, "doc_id", "text", glossary(spark, d), T.STOP_WORDS, FOREIGN, strict=True)
    return out.select("doc_id", F.size("missed").cast("long").alias("n_missed"), F.sha2(F.array_join("own", "\n"), 256).alias("own_sha256"), F.sha2(F.array_join("foreign_terms", "\n"), 256).alias("foreign_sha256"))


TITLED = r"""w AS (SELECT source, doc_id, unnest(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\p{L}\p{N}_]+')) AS word, unnest(range(len(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\p{L}\p{N}_]+')))) AS pos FROM documents),
k AS (SELECT * FROM w WHERE length(word) >= 3 AND NOT regexp_matches(word, '^[0-9]+$') AND word NOT IN (""" + STOPS + "))"


def _titles(spark, d):
    return table(spark, d, "documents").select("source", "doc_id", mining.title_of(F.col("text")).alias("title"))


@query(f"""WITH {TITLED}, s AS (SELECT source, doc_id, word, {STEM.format("word")} AS stem FROM k),
f AS (SELECT source, stem, list_sort(list(DISTINCT word)) AS forms FROM s GROUP BY source, stem HAVING count(DISTINCT doc_id) >= 2)
SELECT source, stem, list_transform(list_filter(list_transform(list_filter(flatten(list_transform(forms, lambda x: [x, {OTHER.format("x")}])), lambda x: x IS NOT NULL), lambda x, i: struct_pack(x := x, i := i)),
  lambda s: list_position(list_filter(flatten(list_transform(forms, lambda x: [x, {OTHER.format("x")}])), lambda x: x IS NOT NULL), s.x) = s.i), lambda s: s.x) AS anchors FROM f""")
def topic_anchors(spark, d):
    """Stems that two titles of a source have, with all forms."""
    return translation.topic_anchors(_titles(spark, d), "source", "doc_id", "title", T.STOP_WORDS)


@query(f"WITH {TITLED}, f AS (SELECT source, word, min((doc_id, pos)) AS first FROM k GROUP BY source, word) SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY first) AS pos FROM f QUALIFY pos <= 16")
def topic_keywords(spark, d):
    """The first sixteen words of the titles of each source."""
    return translation.topic_keywords(_titles(spark, d), "source", "doc_id", "title", T.STOP_WORDS).withColumn("pos", F.col("pos").cast("long"))


# ---- events
#: Words that stand for the verbs of events in the driver's invented texts.
CUE_VERBS = ("the", "of", "and", "der", "und", "que", "les", "ein")


@query()
def event_entities(spark, d):
    """The hundred names that documents mention most before one of the cue words."""
    return events.top_entities(table(spark, d, "documents"), F.col("text"), 100, verbs=CUE_VERBS)


VOCABULARY = f"""{TITLED}, f AS (SELECT source, word, min((doc_id, pos)) AS first FROM k GROUP BY source, word), t AS (SELECT source, word FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY first) <= 16),
v AS (SELECT DISTINCT source, unnest(list_filter([word, {OTHER.format("word")}], lambda x: x IS NOT NULL)) AS word FROM t),
cue AS (SELECT list(DISTINCT w) AS cues FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_-]+')) AS w FROM benchmark) WHERE length(w) >= 8),
i AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_-]+')) AS tokens FROM documents),
l AS (SELECT source, list(word) AS words FROM v GROUP BY source),
c AS (SELECT source, doc_id, tokens, len(list_intersect(tokens, words)) AS overlap FROM i, l, cue WHERE list_has_any(tokens, words) AND list_has_any(tokens, cues))"""


def _event_parts(spark, d):
    """The index of documents, the vocabulary of each source and the candidates."""
    docs = table(spark, d, "documents")
    words = translation.topic_keywords(_titles(spark, d), "source", "doc_id", "title", T.STOP_WORDS)
    none = words.select("source", F.col("word").alias("phrase"), "pos").where("false")
    vocabulary = events.vocabulary(words, none, "source", T.STOP_WORDS)
    cues = table(spark, d, "benchmark").select(F.explode(T.tokens("text")).alias("word")).where("length(word) >= 8")
    index = events.inverted_index(docs, "doc_id", "text")
    return index, vocabulary, events.candidates(index, "doc_id", vocabulary, "source", cues)


@query(f"WITH {VOCABULARY} SELECT source, doc_id, overlap::BIGINT AS overlap FROM c")
def event_candidates(spark, d):
    """Documents with a word of a source's vocabulary and a cue."""
    return _event_parts(spark, d)[2]


BASE = "CASE WHEN length({0}) > 4 AND ends_with({0}, 'ies') THEN left({0}, length({0}) - 3) || 'y' WHEN length({0}) > 3 AND ends_with({0}, 's') AND NOT regexp_matches({0}, '(ss|us|is)$') THEN left({0}, length({0}) - 1) ELSE {0} END"


@query(f"""WITH {VOCABULARY}, b AS (SELECT DISTINCT source, {BASE.format("word")} AS base FROM v),
m AS (SELECT DISTINCT source, doc_id, base FROM (SELECT source, doc_id, {BASE.format("w")} AS base FROM (SELECT source, doc_id, unnest(tokens) AS w FROM c)) JOIN b USING (source, base)),
df AS (SELECT source, base, count(*) AS df FROM m GROUP BY ALL), n AS (SELECT source, count(DISTINCT doc_id) AS n FROM m GROUP BY source),
s AS (SELECT source, doc_id, count(*) AS matched, sum(ln((n + 1) / (df + 0.5))) AS score FROM m JOIN df USING (source, base) JOIN n USING (source) GROUP BY ALL HAVING matched >= 2)
SELECT source, doc_id, matched, round(score, 6) AS score, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, n_chars DESC NULLS LAST, doc_id) AS pos FROM s JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) QUALIFY pos <= 10""")
def event_ranking(spark, d):
    """The ten candidates of each source whose matched words are rarest."""
    index, vocabulary, found = _event_parts(spark, d)
    newest = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("at"))
    out = events.ranked(index, found, "doc_id", vocabulary, "source", newest, 2, 10)
    return out.withColumns({"score": F.round("score", 6), "pos": F.col("pos").cast("long")})


# ---- views and experiments
@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
d AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, unnest(range(64)) AS i FROM u) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS v FROM d GROUP BY label), k AS (SELECT label, count(*) AS n FROM u GROUP BY label),
q AS (SELECT list(x ORDER BY i) AS q FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(e) AS x, unnest(range(64)) AS i FROM u WHERE label = (SELECT min(label) FROM u)) GROUP BY i))
SELECT label, vec_id, round(greatest(0, least(1, list_cosine_similarity(e, v))), 4) AS similarity, n, round(greatest(0, least(1, list_cosine_similarity(v, q))), 4) AS relevance FROM u JOIN c USING (label) JOIN k USING (label), q""")
def cluster_view(spark, d):
    """Vectors against the centre of their label, and each centre against the vector of a query whose
    phrases are the vectors of the first label."""
    e = table(spark, d, "embeddings")
    first = e.crossJoin(F.broadcast(e.agg(F.min("label").alias("first")))).where("label = first").withColumn("query", F.lit(1))
    out = vectors.cluster_view(e, "label", "vec_id", "embedding", vectors.query_vector(first, "query", "embedding"))
    return out.withColumns({"similarity": F.round("similarity", 4), "relevance": F.round("relevance", 4)})


def experiment_setups():
    groups = {"size": (0, 1), "signs": (2, 3, 4), "variety": (5,)}
    alone = [experiments.Setup("length only", only=(0,)), experiments.Setup("nothing", only=(99,))]
    return [*experiments.learning_curve(seeds=2), *experiments.ablations(groups), *experiments.label_noise((0.1, 0.3), 2), *alone, *experiments.leave_one_out([f"src{i}" for i in range(3)])]


@query()
def training_experiments(spark, d):
    """A learning curve, ablations, label noise, a length-only baseline and folds by source."""
    rows = staged_rows(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return experiments.run(rows, "doc_id", "x", "label", "source", experiment_setups())


@query()
def topic_stems(spark, d):
    """Stems of every document's search phrases, own and translated."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = translation.fallback_terms(docs, "doc_id", "text", glossary(spark, d), T.STOP_WORDS, FOREIGN, strict=True)
    return translation.topic_stems(out, "doc_id", T.STOP_WORDS)
