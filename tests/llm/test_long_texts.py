"""Very long texts through the operators that other tests feed with short ones."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, mixing, token_counts, toxicity, warc

LONG = " ".join(f"word{random.Random(n).randrange(5000)}" for n in range(150_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "a"), (2, "short text here", "b"), (3, LONG + " and more", "a"), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_chat_reads_long_turns_back(spark):
    rows = [(1, 1, "user", LONG), (1, 2, "assistant", LONG + "</s>[INST]"), (2, 1, "assistant", "x")]
    got = {r.conv_id: r for r in chat.digest(chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == len(LONG) + 10 and got[2].loss_chars == 1


def test_mix_counts_long_texts_whole(docs):
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert [got[i].size for i in (1, 2, 3, 4)] == [150_000, 3, 150_002, 0]
    assert all(r.taken <= 3 * r.size for r in got.values()) and got[1].source_size == 300_002


def test_archive_keeps_long_payloads(spark):
    pages = spark.createDataFrame([(1, "http://a/x", LONG), (2, "http://b/y", LONG), (3, "http://c/z", "")], "page_id long, url string, html string")
    manifest = warc.write_archive(pages)
    got = {int(r.page): r for r in warc.read_records(warc.lookup(pages.select("page_id", "url"), warc.build_index(manifest))).collect()}
    assert [got[i].payload_bytes for i in (1, 2, 3)] == [len(LONG), len(LONG), 0]
    assert got[2].record_type == "revisit" and int(got[2].refers_to) == 1


def test_tokens_of_long_texts(docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    assert got[1] == len(library.encode(LONG, add_special_tokens=False).ids) and got[4] == 0


def test_scores_of_long_texts(spark, docs):
    words = [f"w{i}" for i in range(40)]
    train = [(i, " ".join(random.Random(i).choices(words, k=12)) + (" blunderhead" if i % 2 else ""), i % 2) for i in range(300)]
    texts = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    model = toxicity.train(texts.select("doc_id", "text"), texts.select("doc_id", "toxic"))
    odd = docs.unionByName(spark.createDataFrame([(5, LONG + " you blunderhead", "a")], docs.schema))
    got = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[5] > got[1]


def test_a_passage_at_the_end_is_found(spark, docs):
    passage = "this passage of ten words stands at the very end"
    odd = docs.unionByName(spark.createDataFrame([(5, LONG + " " + passage, "a")], docs.schema))
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontam.find_contamination(odd, bench).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 10}
    left = decontam.decontaminate(odd, bench, mode="spans")
    assert left.where("doc_id = 5").select(F.trim("text")).first()[0] == LONG and left.count() == 5
