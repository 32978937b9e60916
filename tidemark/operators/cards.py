"""Cards of found technologies: the check of an answer against its sources, and texts drawn from the
sources where there is no answer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import cards as C
from tidemark.functions import phrases as P
from tidemark.functions import text as T

#: Most characters of a fallback card's parts.
TITLE, DESCRIPTION, CASE, EXPLANATION, SUMMARY = 200, 800, 600, 800, 400


def extractive_explanation(score: Column, features: Column) -> Column:
    """A sentence on the score and the two features (label, value, contribution) of largest contribution."""
    ranked = F.array_sort(F.transform(features, lambda c, i: F.struct((-F.abs(c["contribution"])).alias("size"), i.alias("i"), c.alias("c"))))
    said = lambda r: F.format_string("%s = %.2f (%s)", F.lower(r["c"]["label"]), r["c"]["value"], F.when(r["c"]["contribution"] >= 0, "raises").otherwise("lowers"))
    parts = F.array_join(F.transform(F.slice(ranked, 1, 2), said), ", ")
    some = F.concat(F.format_string("Score of the model %.2f. Features: ", score), parts, F.lit(". Drawn from the sources without a generative model."))
    none = F.format_string("Decided by the model with score %.2f; no features were given.", score)
    return F.left(F.when(F.coalesce(F.size(features), F.lit(0)) > 0, some).otherwise(none), F.lit(EXPLANATION))


def fallback_cards(cards: DataFrame, evidence: DataFrame, key: str, share: C.Share = T.cyrillic_share, prefix: str = "Technology: ") -> DataFrame:
    """key, title, description, case_example, explanation of cards (key, title, score, features) by their
    evidence (key, place, title, text, domain, trust, own: whether in the readers' language).

    The description is two sentences of each of the two best texts, own language first, then trust, then
    place; the case is the title and domain of the most trusted one. A title mostly in another script
    gets a prefix. Cards without evidence keep an empty description and say so. Only two texts of a card
    cross the shuffle beside partial maxima, so a card may have any number of them."""
    order = [F.coalesce("own", F.lit(False)).desc(), F.col("trust").desc_nulls_last(), F.col("place")]
    best = evidence.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("r <= 2")
    piece = C.whole_sentences("text", 2, DESCRIPTION // 2)
    pieces = best.select(F.col(key).alias("of"), "r", piece.alias("piece")).where("piece <> ''").groupBy("of").agg(F.array_sort(F.collect_list(F.struct("r", "piece"))).alias("a"))
    cases = evidence.groupBy(F.col(key).alias("case_of")).agg(F.max_by(F.struct("title", "domain"), F.struct(F.coalesce("trust", F.lit(-1)), -F.col("place"))).alias("c"))
    joined = cards.join(pieces, F.col(key).eqNullSafe(F.col("of")), "left").join(cases, F.col(key).eqNullSafe(F.col("case_of")), "left")
    plain = F.left(T.collapse("title"), F.lit(TITLE))
    title = F.when(plain == "", "Untitled").when(share(plain) < 0.5, F.left(F.concat(F.lit(prefix), plain), F.lit(TITLE))).otherwise(plain)
    case = F.left(F.concat(T.empty_if_null(F.col("c.title")), F.lit(" ("), T.empty_if_null(F.col("c.domain")), F.lit(")")), F.lit(CASE))
    description = F.left(F.array_join(F.transform(F.coalesce("a", F.array().cast("array<struct<r:int,piece:string>>")), lambda x: x["piece"]), " "), F.lit(DESCRIPTION))
    return joined.select(key, title.alias("title"), description.alias("description"), F.when(F.col("case_of").isNull() & F.col("c").isNull(), "No case: there is no evidence.").otherwise(case).alias("case_example"), extractive_explanation(F.col("score"), F.col("features")).alias("explanation"))


def fallback_summaries(evidence: DataFrame, key: str) -> DataFrame:
    """key, place, summary, kind of each text of evidence: its first two sentences, else its title."""
    said = C.whole_sentences("text", 2, SUMMARY)
    return evidence.select(key, "place", F.when(said != "", said).otherwise(F.left(T.empty_if_null("title"), F.lit(SUMMARY))).alias("summary"), F.when(F.col("own"), "ORIGINAL").otherwise("EXTRACTIVE").alias("kind"))


def check_cards(cards: DataFrame, sources: DataFrame, summaries: DataFrame, key: str, fields: Mapping[str, int], share: C.Share = T.cyrillic_share, generic: Sequence[str] = (), most: int = 5, least: int = 10, title_share: float = 0.3, text_share: float = 0.5) -> DataFrame:
    """key, accepted, reason, the cleaned fields, companies, case_place and summaries (place, summary, kind)
    of answers.

    cards: key, title, the other `fields` with their most characters (title first), chosen (array of
    labels d1, d2...), case (a label), companies (array). sources: key, place (from 1), title, text,
    day, own. summaries: key, label, place, summary. Only the first `most` sources count.

    An answer is rejected, for the first of these reasons, if it chose no known source; if its title
    holds a number that the chosen ones don't; if no term in the title's brackets is in them, literally
    or by stems; if a field is too short or in another language; if a chosen source has no summary.
    Sentences with unsupported numbers go before that. Companies have to occur in the sources. Of the
    summaries stay those of sources that share a significant word with the title, of the case, and of
    those without Latin words; all, if none would stay. Null fields count as empty, repeated sources and
    summaries by the first of them; at most `most` sources of a card meet in one row."""
    cards = cards.select(key, *fields, "chosen", "case", "companies")
    label = F.concat(F.lit("d"), F.col("place").cast("string"))
    known = sources.where(F.col("place").between(1, most)).groupBy(F.col(key).alias("of"), "place").agg(F.min(F.struct(T.empty_if_null("title").alias("title"), T.empty_if_null("text").alias("text"), "day", F.coalesce("own", F.lit(False)).alias("own"))).alias("s"))
    wanted = cards.select(key, F.explode(F.array_distinct(F.transform("chosen", lambda x: F.trim(x)))).alias("label")).distinct()
    source = wanted.join(known.withColumn("known", label), F.col(key).eqNullSafe(F.col("of")) & (F.col("label") == F.col("known"))).drop("known", "of")
    told = summaries.groupBy(F.col(key).alias("sum_of"), F.trim("label").alias("sum_label")).agg(F.array_sort(F.collect_list(F.struct("place", F.left(T.collapse(T.without_doc_refs("summary")), F.lit(SUMMARY)).alias("summary")))).alias("told"))
    both = source.join(told, F.col(key).eqNullSafe(F.col("sum_of")) & (F.col("label") == F.col("sum_label")), "left")
    empty = F.array().cast("array<struct<place:bigint,summary:string>>")
    packed = both.groupBy(F.col(key).alias("of")).agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "s.title", "s.text", "s.day", "s.own", F.coalesce(F.transform("told", lambda x: F.struct(x["place"].cast("long").alias("place"), x["summary"].alias("summary"))), empty).alias("told")))).alias("src"))
    rows = cards.join(packed, F.col(key).eqNullSafe(F.col("of")), "left").withColumn("src", F.coalesce("src", F.array().cast(packed.schema["src"].dataType)))
    corpus = F.array_join(F.transform("src", lambda s: F.concat_ws(" ", s["title"], s["text"])), " ")
    years = F.filter(F.transform("src", lambda s: F.year(s["day"])), lambda y: y.isNotNull())
    rows = rows.withColumn("corpus", corpus).withColumn("supported", C.supported_numbers(corpus, years))
    for name, limit in fields.items():
        plain = F.left(T.collapse(T.without_doc_refs(name)), F.lit(limit))
        rows = rows.withColumn(name, plain if name == "title" else C.repair_numbers(plain, F.col("supported")))
    # of each source the first summary that stands after repair
    fits = lambda t: (F.length(t) >= least) & (share(t) >= text_share)
    mended = F.transform("src", lambda s: F.struct(s["place"].alias("place"), F.get(F.filter(F.transform(s["told"], lambda x: C.repair_numbers(x["summary"], F.col("supported"))), fits), F.lit(0)).alias("summary"), F.when(s["own"], "ORIGINAL").otherwise("GENERATED").alias("kind"), C.latin_words(F.concat_ws(" ", s["title"], F.left(s["text"], F.lit(400))), generic).alias("words")))
    rows = rows.withColumn("mended", mended).withColumn("missing", F.size(F.filter("mended", lambda m: m["summary"].isNull())))
    terms = F.filter(F.regexp_extract_all("title", F.lit(r"\(([^()]{2,80})\)"), F.lit(1)), lambda x: C.name_key(x) != "")
    reason = F.when(F.size("src") == 0, "no source was chosen").when(F.size(C.unsupported("title", F.col("supported"))) > 0, "title: number without a source").when(~F.exists(terms, lambda x: P.term_in_sources(x, F.col("corpus"))), "title: no term of the sources")
    for name in fields:
        short, part = (3, title_share) if name == "title" else (least, text_share)
        reason = reason.when(F.length(name) < short, f"{name}: empty").when(share(F.col(name)) < part, f"{name}: other language")
    reason = reason.when(F.col("missing") > 0, F.concat(F.lit("no summary of "), F.col("missing").cast("string"), F.lit(" sources"))).otherwise("")
    names = F.array_distinct(F.transform(F.coalesce("companies", F.array().cast("array<string>")), T.collapse))
    held = F.slice(F.filter(names, lambda n: (F.length(n) >= 2) & (C.name_key(n) != "") & F.contains(C.name_key("corpus"), C.name_key(n))), 1, 5)
    case = F.array_max(F.transform(F.filter("src", lambda s: F.concat(F.lit("d"), s["place"].cast("string")) == F.trim("case")), lambda s: s["place"]))
    rows = rows.withColumn("reason", reason).withColumn("companies", held).withColumn("case_place", case).withColumn("anchor", C.latin_words("title", generic))
    near = F.filter("mended", lambda m: (m["place"] == F.coalesce("case_place", F.lit(-1))) | (F.size(m["words"]) == 0) | F.arrays_overlap(m["words"], F.col("anchor")))
    stay = F.when((F.size("anchor") > 0) & (F.size(near) > 0), near).otherwise(F.col("mended"))
    kept = F.transform(stay, lambda m: F.struct(m["place"].alias("place"), m["summary"].alias("summary"), m["kind"].alias("kind")))
    return rows.select(key, (F.col("reason") == "").alias("accepted"), "reason", *fields, "companies", "case_place", F.when(F.col("reason") == "", kept).alias("summaries"))
