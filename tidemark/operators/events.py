"""News of events on a topic: names in titles, vocabularies, candidates by an inverted index, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import phrases as P
from tidemark.functions import text as T

#: Verbs that follow the name of a company or product in titles of events (fixed values).
VERBS = ("raises", "raised", "launches", "unveils", "emerges", "secures", "closes", "debuts", "introduces", "announces", "acquires", "lands", "nabs", "bags", "gets")
#: First words that begin no name (fixed values).
NO_NAME = ("the", "a", "an", "new", "this", "startup", "startups", "company", "report", "exclusive", "breaking", "update", "ai", "why", "how", "what", "week", "today")


def base_form(word: Column) -> Column:
    """A word without its plural ending."""
    return F.when((F.length(word) > 4) & word.endswith("ies"), F.concat(F.left(word, F.length(word) - 3), F.lit("y"))).when((F.length(word) > 3) & word.endswith("s") & ~word.rlike("(ss|us|is)$"), F.left(word, F.length(word) - 1)).otherwise(word)


def entity_names(title: Column, verbs: Sequence[str] = VERBS, no_name: Sequence[str] = NO_NAME, incumbents: Sequence[str] = ()) -> Column:
    """Names of one to four capitalised words before one of `verbs`, without a place or owner in the
    possessive before them. None of a title in capitals; none of fewer than three letters, that starts
    with one of `no_name`, or that is an incumbent (lower case)."""
    t = F.coalesce(title, F.lit(""))
    name = r"(?U)\b([A-Z][\w&.'’-]*(?:\s+[A-Z0-9][\w&.'’-]*){0,3})\s+(?:" + "|".join(verbs) + r")\b"
    found = F.transform(F.regexp_extract_all(t, F.lit(name), F.lit(1)), lambda n: F.regexp_replace(F.trim(F.regexp_replace(n, r"\s+", " ")), r"(?U)^(?:[A-Z][\w.-]*\s+){0,2}[A-Z][\w.-]*[’']s\s+", ""))
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    capitals = (F.length(letters) >= 8) & (F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) / F.length(letters) > 0.8)
    kept = F.filter(found, lambda n: (F.length(n) >= 3) & ~F.split_part(F.lower(n), F.lit(" "), F.lit(1)).isin(*no_name))
    if incumbents:
        kept = F.filter(kept, lambda n: ~F.lower(n).isin(*incumbents))
    return F.when(capitals, F.array().cast("array<string>")).otherwise(kept)


def top_entities(titles: DataFrame, title: Column, limit: int = 20, **rules) -> DataFrame:
    """name, n of the names that most titles mention (each mention counts), ties by name."""
    names = titles.select(F.explode(entity_names(title, **rules)).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(limit)


def vocabulary(topic_words: DataFrame, phrases: DataFrame, topic: str, generic: Sequence[str] = (), limit: int = 150) -> DataFrame:
    """topic, word: the words of a topic (topic, word, pos) and then those of its chosen phrases (topic,
    phrase, pos) in order, `limit` at most, each with its other number."""
    words = F.regexp_extract_all(F.lower("phrase"), F.lit(f"({T.TERM})"), F.lit(1))
    more = phrases.select(topic, F.col("pos").alias("p"), F.posexplode(words).alias("at", "word")).where((F.length("word") >= 3) & ~F.col("word").isin(*generic) & ~F.col("word").rlike(r"^\d+$"))
    both = topic_words.select(topic, "word", F.struct(F.lit(0).alias("a"), F.col("pos").cast("long").alias("b"), F.lit(0).alias("c")).alias("place")).unionByName(more.select(topic, "word", F.struct(F.lit(1).alias("a"), F.col("p").cast("long").alias("b"), F.col("at").alias("c")).alias("place")))
    first = both.groupBy(topic, "word").agg(F.min("place").alias("place"))
    kept = first.withColumn("r", F.row_number().over(Window.partitionBy(topic).orderBy("place", "word"))).where(F.col("r") <= limit)
    return kept.select(topic, F.explode(P.with_variants(F.array("word"))).alias("word")).distinct()


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """token, key: one row for each distinct token of a document. Rows, not lists: a token of all
    documents is many rows and no single value."""
    return docs.select(key, F.explode(F.array_distinct(T.tokens(text))).alias("token"))


def candidates(index: DataFrame, key: str, topics: DataFrame, topic: str, cues: DataFrame) -> DataFrame:
    """topic, key, overlap: documents with a word of the topic's vocabulary (topic, word) and a cue
    (word), with how many of the topic's words they have. The vocabularies prune the index first, so
    only their own postings are shuffled."""
    of_topic = index.join(topics, F.col("token") == F.col("word")).groupBy(topic, key).agg(F.count_distinct("token").alias("overlap"))
    cued = index.join(cues.select(F.col("word").alias("cue")).distinct(), F.col("token") == F.col("cue"), "left_semi").select(F.col(key).alias("__k")).distinct()
    return of_topic.join(cued, F.col(key) == F.col("__k"), "left_semi")


def ranked(index: DataFrame, found: DataFrame, key: str, topics: DataFrame, topic: str, newest: DataFrame, least: int, limit: int) -> DataFrame:
    """topic, key, matched, score, pos of the candidates with `least` or more words of the topic (by base
    form), by the sum of log((n + 1) / (df + 0.5)), newer first among equals (newest: key, at), then key.
    n counts a topic's candidates and df those with the word, both before `least`. Scores are compared
    in billionths."""
    bases = topics.select(topic, base_form(F.col("word")).alias("base")).distinct()
    # only words of a vocabulary leave the tasks that read the index
    known = index.select(key, base_form(F.col("token")).alias("base")).join(bases.select("base").distinct(), "base", "left_semi")
    words = known.join(found.select(key).distinct(), key, "left_semi").select(key, "base").distinct()
    matched = words.join(bases, "base").join(found.select(topic, key), [topic, key], "left_semi")
    df = matched.groupBy(topic, "base").agg(F.count("*").alias("df"))
    n = matched.groupBy(topic).agg(F.count_distinct(key).alias("n"))
    scored = matched.join(df, [topic, "base"]).join(n, topic).groupBy(topic, key).agg(F.count("*").alias("matched"), F.sum(F.log((F.col("n") + 1) / (F.col("df") + 0.5))).alias("score"))
    scored = scored.where(F.col("matched") >= least).join(newest, key, "left")
    w = Window.partitionBy(topic).orderBy(F.round("score", 9).desc(), F.col("at").desc_nulls_last(), key)
    return scored.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit).select(topic, key, "matched", "score", "pos")
