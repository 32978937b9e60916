"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, imatch, langid, minhash, mixing, periodic, pii, simhash, token_counts, toxicity, warc, whitening
from .common import held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that holds control strings, as read back from its examples."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.expand(turns.unionByName(chat.probe(spark, turns))))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and of its edited text."""
    return imatch.with_next(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that a mix of weights 5, 2, 1 takes of it."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of personal data in every document."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    counts = [F.size(F.expr(f"filter(pii, x -> x.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC files and read back through the capture index."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = warc.write_archive(pages)
    places = warc.lookup(pages.select("page_id", "url"), warc.build_index(manifest))
    kind = pages.schema["page_id"].dataType
    return warc.read_records(places).select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document under byte_bpe_50k.json."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component of near-duplicates it belongs to."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words that lie in benchmark windows."""
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingles and the component of near-duplicates it belongs to."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, a tenth of which are made periodic."""
    return periodic.digest(periodic.find_runs(periodic.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first components of the distinct ones."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_language_id, op2_chat_examples, op3_imatch, op4_mix_sources, op5_personal_data, op6_warc_round_trip, op7_token_counts, op8_simhash, op9_toxicity, op10_decontaminate, op11_minhash, op12_periodic_runs, op13_whitening)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_examples": chat.ORACLE, "op4_mix_sources": mixing.ORACLE, "op6_warc_round_trip": warc.ORACLE, "op10_decontaminate": decontam.ORACLE}
