"""Registered queries of profile models, staged training, packing, thresholds and refills."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import profiles as P
from tidemark.functions import text as T
from tidemark.operators import mining, packing, profiles, refill, registry, relational, sequential, thresholds
from tidemark.session import table
from tidemark.sources import answers

from .catalogue import query

_IN = ", ".join
_NEG = _IN(f"'{w}'" for w in P.NEGATORS)
_IDLE = _IN(f"'{w}'" for w in P.IDLE)
#: SQL of the features of `text`: clauses, words, marks, scoped stems, pairs.
FEATURES = rf"""
c AS (SELECT doc_id, list_transform(regexp_split_to_array(lower(coalesce(text, '')), '{P.CLAUSE_END}'), lambda c: regexp_extract_all(c, '[a-zа-яё]+')) AS w FROM documents),
m AS (SELECT doc_id, list_transform(w, lambda v: list_filter(list_transform(v, lambda x, i: CASE WHEN x IN ({_NEG}) OR (x = 'нет' AND i < len(v)) THEN '!' WHEN x = 'нет' THEN '$'
      WHEN length(x) < 3 OR left(x, {P.STEM}) IN ({_IDLE}) THEN '' ELSE left(x, {P.STEM}) END), lambda x: x != '')) AS f FROM c),
s AS (SELECT doc_id, list_transform(f, lambda v: list_filter(list_transform(v, lambda x, i: CASE WHEN x IN ('!', '$') THEN '' WHEN v[-1] = '$' OR coalesce(i > 1 AND v[i - 1] = '!', false) THEN 'не_' || x ELSE x END), lambda x: x != '')) AS s FROM m),
f AS (SELECT doc_id, list_distinct(flatten(s) || flatten(list_transform(s, lambda v: list_transform(v[1:greatest(len(v) - 1, 0)], lambda x, i: x || '_' || v[i + 1])))) AS features FROM s)"""


def _features(spark, d):
    return profiles.features(table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {FEATURES} SELECT doc_id, len(features)::BIGINT AS n_features, sha256(array_to_string(list_sort(features), ' ')) AS features_sha256, (SELECT count(*) FROM (SELECT unnest(features) AS x) WHERE x LIKE 'не\\_%' ESCAPE '\\')::BIGINT AS n_negated FROM f")
def profile_features(spark, d):
    """Stems and pairs of every document, with the scope of negations."""
    negated = F.size(F.filter("features", lambda x: x.startswith("не_")))
    return _features(spark, d).select("doc_id", F.size("features").cast("long").alias("n_features"), F.sha2(F.array_join(F.array_sort("features"), " "), 256).alias("features_sha256"), negated.cast("long").alias("n_negated"))


FEW_LABELS = 2_000_000


@query(f"""WITH {FEATURES},
l AS (SELECT features, quality FROM f JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
t AS (SELECT count(*) AS n, coalesce(sum(quality), 0) AS pos FROM l),
k AS (SELECT x, sum(quality) AS pos, count(*) AS n FROM (SELECT unnest(features) AS x, quality FROM l) GROUP BY x HAVING count(*) >= 5),
w AS (SELECT x, round(ln(((k.pos + 1) * (t.n - t.pos + 2))::DOUBLE / ((k.n - k.pos + 1) * (t.pos + 2))) / {profiles.UNIT})::BIGINT AS weight FROM k, t),
e AS (SELECT doc_id, count(*) AS n, sum(weight)::BIGINT AS total, list_slice(list_sort(list(struct_pack(a := -abs(weight), x := x, w := weight))), 1, 8) AS best FROM (SELECT doc_id, unnest(features) AS x FROM f) JOIN w USING (x) GROUP BY doc_id)
SELECT doc_id, len(features)::BIGINT AS n_features, coalesce(n, 0) AS n_known, round(coalesce(total, 0) * {profiles.UNIT} / sqrt(greatest(len(features), 1)), 6) AS logit,
       round(1 / (1 + exp(-greatest(least(coalesce(total, 0) * {profiles.UNIT} / sqrt(greatest(len(features), 1)), 30), -30))), 6) AS p,
       coalesce(array_to_string(list_transform(best, lambda b: b.x), ' '), '') AS reasons FROM f LEFT JOIN e USING (doc_id)""")
def signal_predictions(spark, d):
    """Every document scored by the weights that labelled documents give, with its eight main reasons."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("l_id"), "quality").where("quality IS NOT NULL")
    # so many labels go to every task that no text is shuffled; more are joined by a shuffle
    few = labels.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    known = table(spark, d, "documents").select("doc_id", "text").join(F.broadcast(labels) if few else labels, F.col("doc_id") == F.col("l_id"))
    weights = profiles.log_odds(profiles.features(known, "doc_id", "text", ["quality"]), "quality")
    out = profiles.predict(table(spark, d, "documents"), "doc_id", weights, text="text")
    return out.select("doc_id", "n_features", "n_known", F.round("logit", 6).alias("logit"), F.round("p", 6).alias("p"), F.array_join("reasons.feature", " ").alias("reasons"))


def staged_rows(spark, d):
    """doc_id, x, label, weight and first (whether the source belongs to the first stage)."""
    t = T.empty_if_null("text")
    n = F.greatest(F.length(t), F.lit(1))
    words = F.greatest(F.size(T.tokens("text")), F.lit(1))
    x = F.array(F.log1p(words.cast("double")), n / words / 10, F.regexp_count(t, F.lit(r"\d")) / n * 10, F.regexp_count(t, F.lit(r"\p{Lu}")) / n * 10, F.regexp_count(t, F.lit(r"\p{P}")) / n * 10, F.size(F.array_distinct(T.tokens("text"))) / words)
    docs = table(spark, d, "documents").select("doc_id", x.alias("x"), (F.crc32("source") % 2 == 0).alias("first"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").where("label IS NOT NULL AND first IS NOT NULL")


@query()
def sequential_logistic(spark, d):
    """Weights of a model of half the sources, and of four ways to go on with the other half."""
    rows = staged_rows(spark, d)
    one = sequential.balanced(rows.where("first"), "label")
    two = sequential.balanced(rows.where("NOT first"), "label")
    theta = sequential.fit(one, "x", "label")
    curved = sequential.hessian(one, "x", "label", theta)
    fits = {
        "first": theta,
        "alone": sequential.fit(two, "x", "label"),
        "l2_sp": sequential.fit(two, "x", "label", anchor=sequential.l2_sp(theta, 10.0), start=theta),
        "laplace": sequential.fit(two, "x", "label", anchor=sequential.laplace(theta, curved, 0.5, diagonal=True), start=theta),
        "replay": sequential.fit(sequential.with_replay(two, one, 0.3), "x", "label", start=theta),
    }
    return spark.createDataFrame([(name, i, float(v)) for name, w in fits.items() for i, v in enumerate(w)], "fit string, feature int, weight double")


# ---- folds, thresholds, refills
@query("""WITH RECURSIVE t AS (SELECT source AS topic, count(*) FILTER (quality = 1) AS pos, count(quality) AS size FROM documents LEFT JOIN labels USING (doc_id) WHERE source IS NOT NULL GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY pos DESC, size DESC, sha256(topic)) AS n FROM t),
g AS (SELECT 0::BIGINT AS n, NULL::VARCHAR AS topic, 0::BIGINT AS pos, 0::BIGINT AS size, 0 AS fold, [[0, 0, 0]::BIGINT[], [0, 0, 1], [0, 0, 2], [0, 0, 3], [0, 0, 4]] AS load
      UNION ALL SELECT r.n, r.topic, r.pos, r.size, list_min(g.load)[3]::INT, list_transform(g.load, lambda x: CASE WHEN x[3] = list_min(g.load)[3] THEN [x[1] + r.pos, x[2] + r.size, x[3]] ELSE x END) FROM g JOIN r ON r.n = g.n + 1)
SELECT topic, pos, size, fold FROM g WHERE n > 0""")
def balanced_folds(spark, d):
    """Sources dealt over five folds, even in good documents."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return packing.balanced_folds(docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left"), "source", "quality", 5)


LEVELS = {"digits": (0.0, 0.002, 0.01, 0.05), "capitals": (0.02, 0.05, 0.1, 0.3), "length": (0.1, 0.5, 1.0, 5.0)}


def _measured(spark, d):
    t = T.empty_if_null("text")
    n = F.greatest(F.length(t), F.lit(1))
    docs = table(spark, d, "documents").select("doc_id", (F.regexp_count(t, F.lit("[0-9]")) / n).alias("digits"), (F.regexp_count(t, F.lit("[A-Z]")) / n).alias("capitals"), (F.length(t) / 1000).alias("length"))
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


LATTICE = f"""m AS (SELECT quality, len(regexp_extract_all(t, '[0-9]')) / greatest(length(t), 1) AS digits, len(regexp_extract_all(t, '[A-Z]')) / greatest(length(t), 1) AS capitals, length(t) / 1000 AS length
  FROM (SELECT quality, coalesce(text, '') AS t FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)),
g AS (SELECT * FROM {", ".join(f"(SELECT unnest({list(v)}::DOUBLE[]) AS t_{k})" for k, v in LEVELS.items())}),
c AS (SELECT t_digits, t_capitals, t_length, count(*) FILTER (cut AND quality = 1) AS cut_pos, count(*) FILTER (cut AND quality = 0) AS cut_neg, count(*) FILTER (quality = 1) AS all_pos, count(*) FILTER (quality = 0) AS all_neg
  FROM (SELECT *, digits >= t_digits OR capitals >= t_capitals OR length >= t_length AS cut FROM g, m) GROUP BY ALL)"""


@query(f"WITH {LATTICE} SELECT * FROM c")
def threshold_lattice(spark, d):
    """What every combination of three rules' thresholds cuts."""
    return thresholds.lattice(_measured(spark, d), {k: (F.col(k), v) for k, v in LEVELS.items()}, "quality")


@query(f"WITH {LATTICE} SELECT * FROM c WHERE cut_pos <= 0.25 * all_pos ORDER BY cut_neg DESC, cut_pos, t_digits DESC, t_capitals DESC, t_length DESC LIMIT 1")
def threshold_search(spark, d):
    """The combination that cuts most poor documents and at most a quarter of the good ones."""
    return thresholds.best(threshold_lattice(spark, d), list(LEVELS), 0.25)


def relaxed_rules():
    return [thresholds.Rule("capitals", F.col("capitals"), 0.01, 0.005, 1.0), thresholds.Rule("digits", F.col("digits"), 0.0005, 0.0005, 1.0), thresholds.Rule("length", F.col("length"), 0.5, 0.5)]


@query()
def threshold_relaxation(spark, d):
    """The moves by which three rules come to cut at most 5 % of good documents."""
    moves = thresholds.relax(_measured(spark, d).where("quality = 1"), relaxed_rules(), 0.05)
    rows = [(i, m["cut"], m["share"], *m["thresholds"].values(), *m["by"].values()) for i, m in enumerate(moves)]
    return spark.createDataFrame(rows, "move int, cut long, share double, t_capitals double, t_digits double, t_length double, by_capitals long, by_digits long, by_length long")


DECISION = "CASE WHEN o_orderstatus = 'F' THEN 'WEAK_SIGNAL' WHEN o_orderkey % 5 = 4 THEN 'MATURE' ELSE 'INSUFFICIENT_EVIDENCE' END"
REASON = "CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderkey % 5 = 0 THEN 'SINGLE_SOURCE' WHEN o_orderkey % 5 = 1 THEN 'NO_TRUSTED_SOURCE' WHEN o_orderkey % 5 = 2 THEN 'LOW_QUERY_RELEVANCE' WHEN o_orderkey % 5 = 3 THEN 'OFF_TOPIC' ELSE 'MODEL_SCORE' END"
CANDIDATE = f"SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_totalprice AS score, {DECISION} AS decision, {REASON} AS reason, o_custkey % 3 > 0 AS market FROM "


def _candidates(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice AS score", f"{DECISION} AS decision", f"{REASON} AS reason", "o_custkey % 3 > 0 AS market")


POOL = f"""k AS (SELECT *, CASE WHEN decision = 'WEAK_SIGNAL' THEN 0 WHEN reason = 'SINGLE_SOURCE' AND market THEN 1 WHEN reason = 'NO_TRUSTED_SOURCE' THEN 2 WHEN reason = 'MODEL_SCORE' THEN 3 WHEN reason = 'LOW_QUERY_RELEVANCE' THEN 4 END AS grp FROM ({CANDIDATE} orders)),
p AS (SELECT *, row_number() OVER (ORDER BY grp, CASE WHEN grp = 0 THEN o_custkey ELSE -score END, o_orderkey) AS pool_pos FROM k WHERE grp IS NOT NULL)"""


def _pool(spark, d, limit=1000):
    by_score = [-F.col("score"), F.col("o_orderkey")]
    groups = [(F.col("decision") == "WEAK_SIGNAL", [F.col("o_custkey"), F.col("o_orderkey")]), ((F.col("reason") == "SINGLE_SOURCE") & F.col("market"), by_score)]
    groups += [(F.col("reason") == r, by_score) for r in ("NO_TRUSTED_SOURCE", "MODEL_SCORE", "LOW_QUERY_RELEVANCE")]
    return refill.pool(_candidates(spark, d), groups, limit)


@query(f"WITH {POOL} SELECT o_orderkey, decision, reason, pool_pos FROM p WHERE pool_pos <= 1000")
def pool_order(spark, d):
    """The pool of candidates: weak signals by rank, then four groups of excluded ones by score."""
    return _pool(spark, d).select("o_orderkey", "decision", "reason", F.col("pool_pos").cast("long").alias("pool_pos"))


REFILL = """q AS (SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderkey % 3 > 0 AS ok, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders),
c AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY o_orderpriority ORDER BY pos) AS c FROM q WHERE pos <= 60),
r2 AS (SELECT *, 20 + 20 - max(CASE WHEN pos <= 20 THEN c END) OVER (PARTITION BY o_orderpriority) AS two FROM c),
r3 AS (SELECT *, two + 20 - max(CASE WHEN pos <= two THEN c END) OVER (PARTITION BY o_orderpriority) AS three FROM r2),
f AS (SELECT *, CASE WHEN pos <= 20 THEN 1 WHEN pos <= two THEN 2 WHEN pos <= three THEN 3 END AS round FROM r3),
s AS (SELECT *, CASE WHEN round IS NOT NULL AND ok THEN c END AS position FROM f)"""


def _refilled(spark, d):
    queue = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", (F.col("o_orderkey") % 3 > 0).alias("ok"))
    return refill.refill(queue, "o_orderpriority", [F.col("o_totalprice").desc(), F.col("o_orderkey")], "ok", 20, 3)


@query(f"WITH {REFILL} SELECT o_orderkey, o_orderpriority, pos, round, position FROM s")
def refill_rounds(spark, d):
    """Twenty orders of each priority, refilled twice for those that fail."""
    return _refilled(spark, d).select("o_orderkey", "o_orderpriority", F.col("pos").cast("long").alias("pos"), "round", F.col("position").cast("long").alias("position"))


@query(f"WITH {REFILL} SELECT o_orderkey, o_orderpriority, position, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey % 7 / 7 DESC, position) AS display FROM s WHERE position IS NOT NULL")
def display_places(spark, d):
    """Shown orders in the order of another score."""
    out = refill.display_order(_refilled(spark, d).withColumn("sure", F.col("o_orderkey") % 7 / 7), "o_orderpriority", "position", "sure")
    return out.select("o_orderkey", "o_orderpriority", F.col("position").cast("long").alias("position"), F.col("display").cast("long").alias("display"))


@query(f"""WITH {POOL}, {REFILL}
SELECT o_orderkey, coalesce(reason, 'POOL_LIMIT') AS reason, decision AS title, round(least(greatest(score / 300000, 0), 1), 4) AS score FROM k WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p WHERE pool_pos <= 1000)
UNION ALL SELECT o_orderkey, 'TEXT_FAILED', o_orderpriority, round(least(greatest(o_totalprice / 300000, 0), 1), 4) FROM s WHERE round IS NOT NULL AND NOT ok
UNION ALL SELECT o_orderkey, 'BELOW_TOP_N', o_orderpriority, round(least(greatest(o_totalprice / 300000, 0), 1), 4) FROM s WHERE round IS NULL""")
def excluded_rows(spark, d):
    """What was left out, with reasons: outside the pool, failed, below the shown ones."""
    rest = _candidates(spark, d).join(_pool(spark, d).select("o_orderkey"), "o_orderkey", "left_anti")
    tried = _refilled(spark, d).withColumns({"score": F.col("o_totalprice"), "decision": F.col("o_orderpriority")})
    groups = {"POOL": rest, "TEXT_FAILED": tried.where("round IS NOT NULL AND NOT ok"), "BELOW_TOP_N": tried.where("round IS NULL")}
    out = refill.excluded_rows({k: v.withColumn("why", F.coalesce("reason", F.lit("POOL_LIMIT")) if k == "POOL" else F.lit(k)) for k, v in groups.items()}, "o_orderkey", F.col("decision"), F.col("why"), F.col("score") / 300000)
    return out.select("o_orderkey", F.col("text").alias("reason"), "title", "score")


# ---- JSON answers
ANSWER = r"""CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Sure, here it is: ' || props || ' Hope it helps.'
 WHEN 3 THEN '```' || chr(10) || props WHEN 4 THEN left(props, length(props) - 1) WHEN 5 THEN '[' || event_id || ']' ELSE ' none of {these} fits ' END"""
CUT = """CASE event_id % 5 WHEN 0 THEN '{"a": [' || props || ', {"s": "x' WHEN 1 THEN '```json' || chr(10) || '{"a": ' || props || ', "b":' WHEN 2 THEN 'Here: {"a": ' || props || ', "t": "he said \\\\"no' || chr(92) || chr(92) WHEN 3 THEN props || ' and {more' ELSE '{"a": ]' END"""


@query(rf"""
WITH a AS (SELECT event_id, trim({ANSWER}, ' ' || chr(10)) AS t FROM events),
u AS (SELECT event_id, CASE WHEN NOT starts_with(t, '```') THEN t WHEN len(string_split(t, '```')) > 2 THEN regexp_replace(string_split(t, '```')[2], '^\s*json', '') ELSE ltrim(t, '`') END AS t FROM a),
r AS (SELECT event_id, trim(CASE WHEN strpos(t, '{{') > 0 AND strpos(t, '}}') > 0 THEN substr(t, strpos(t, '{{'), length(t) - strpos(reverse(t), '}}') + 2 - strpos(t, '{{')) ELSE t END, ' ' || chr(10)) AS repaired FROM u)
SELECT event_id, repaired, CASE WHEN NOT json_valid(repaired) THEN 'NOT_JSON' WHEN json_type(CASE WHEN json_valid(repaired) THEN repaired ELSE '0' END) = 'OBJECT' THEN 'OK' ELSE 'NOT_OBJECT' END AS status,
       CASE WHEN event_id % 7 < 4 THEN (props->>'k')::BIGINT END AS k, CASE WHEN event_id % 7 < 4 THEN 'k: not string,z: missing' ELSE 'k: missing,z: missing' END AS problems FROM r JOIN events USING (event_id)""")
def answer_repair(spark, d):
    """Wrapped answers cut out, parsed, and held against a schema that they don't meet."""
    rows = table(spark, d, "events").selectExpr("event_id", f"{ANSWER} AS answer").select("event_id", answers.repaired("answer").alias("repaired"))
    rows = rows.withColumn("p", answers.parsed(F.col("repaired")))
    wrong = F.array_join(answers.problems(F.col("p.value"), {"k": "string", "z": "bigint"}), ",")
    return rows.select("event_id", "repaired", "p.status", F.try_variant_get("p.value", "$.k", "bigint").alias("k"), wrong.alias("problems"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"a": [' || props || ', {"s": "x"}]}' WHEN 1 THEN '{"a": ' || props || ', "b": null}' WHEN 2 THEN '{"a": ' || props || ', "t": "he said \\"no\\\\"}' WHEN 3 THEN props END AS closed,
 event_id % 5 < 4 AS is_object FROM events""")
def answer_closing(spark, d):
    """Answers that break off, with their strings and brackets closed."""
    rows = table(spark, d, "events").selectExpr("event_id", f"{CUT} AS answer").select("event_id", answers.closed("answer").alias("closed"))
    return rows.select("event_id", "closed", (answers.parsed(F.col("closed"))["status"] == "OK").alias("is_object"))


@query("""WITH m AS (SELECT doc_id, unnest(['lang', 'size', 'source', 'title']) AS key, unnest([lang, n_chars::VARCHAR, source, left(text, 60)]) AS value FROM documents),
s AS (SELECT *, 1 + sum(strlen(to_json(MAP {key: value})::VARCHAR) + 1) OVER (PARTITION BY doc_id ORDER BY strlen(to_json(MAP {key: value})::VARCHAR), key DESC) AS total FROM m)
SELECT doc_id, coalesce(string_agg(key, ',' ORDER BY key) FILTER (total <= 90), '') AS kept FROM s GROUP BY doc_id""")
def metadata_kept(spark, d):
    """Metadata of every document cut to 90 bytes, the longest entries first."""
    meta = F.create_map(F.lit("title"), F.col("text"), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("size"), F.col("n_chars").cast("string"), F.lit("secret"), F.lit("x"))
    kept = answers.kept_metadata(meta, ["title", "lang", "source", "size"], 90, 60)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"))


# ---- the registry of observation features
LEX = {"emergence": ("early", "der", "que"), "maturity": ("the", "les"), "hype": ("und", "el"), "funding": r"[$€]|\bof\b", "bigtech": ("la", "and")}
STAGED = {1: ("thing", "ein"), 3: ("tion", "une"), 5: ("heit", "para")}
OVERVIEW = r"(?i)\b(of|der|les|los)\b"
TYPED = "CASE doc_id % 5 WHEN 0 THEN 'PUBLICATION' WHEN 1 THEN 'PREPRINT' WHEN 2 THEN 'NEWS_MEDIA' WHEN 3 THEN 'BLOG' ELSE 'CODE_REPOSITORY' END"
TRUST = "CASE doc_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END"
YEAR = "CASE WHEN doc_id % 7 > 0 THEN 2018 + doc_id % 6 END"


def observations(spark, d):
    """A source as an observation: its first eight documents are the evidence, the first one the
    candidate and the last of them the topic."""
    docs = relational.first_per_group(table(spark, d, "documents").where("source IS NOT NULL"), "source", [F.col("doc_id").asc()], 8)
    vectors_ = table(spark, d, "embeddings").select(F.col("vec_id").alias("v_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = docs.withColumn("title", mining.title_of(F.col("text"))).join(vectors_, F.col("doc_id") % 100 == F.col("v_id"))
    entry = F.struct("doc_id", "title", F.expr(TYPED).alias("type"), F.expr(TRUST).alias("trust"), F.expr(YEAR).cast("int").alias("year"), "vector")
    found = rows.groupBy("source").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    first, last = F.element_at("e", 1), F.element_at("e", -1)
    evidence = F.transform("e", lambda x: F.struct(x["title"].alias("title"), x["type"].alias("type"), x["trust"].alias("trust"), x["year"].alias("year"), x["vector"].alias("vector")))
    return found.select("source", first["title"].alias("title"), first["vector"].alias("title_vector"), last["title"].alias("topic"), registry.stems(last["title"]).alias("topic_terms"), last["vector"].alias("topic_vector"), evidence.alias("evidence"), (F.size("e") / 10).alias("cluster_similarity"))


def projection():
    """Axes along the first eight dimensions."""
    return registry.Projection([0.01] * 64, [[1.0 if j == i else 0.0 for j in range(64)] for i in range(8)], [0.05 * (i + 1) for i in range(8)])


_STEMS = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_-]+'), lambda w: length(w) >= 3 AND NOT list_contains([" + _IN(f"'{w}'" for w in T.STOP_WORDS) + "], w)), lambda w: left(w, 5)))"


def _sql_holds(words, t):
    return f"regexp_matches(lower({t}), '{words}')" if isinstance(words, str) else f"list_has_any(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_-]+'), [{_IN(repr(w) for w in words)}])"


def _sql_share(words):
    return f"len(list_filter(texts, lambda t: {_sql_holds(words, 't')})) / len(texts)"


_OF = "len(list_filter(ev, lambda x: {})) / n"


@query(f"""WITH e AS (SELECT source, doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, {TYPED} AS type, {TRUST} AS trust, {YEAR} AS year, embedding::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE source IS NOT NULL) JOIN embeddings ON vec_id = doc_id % 100 WHERE r <= 8),
u AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e),
o AS (SELECT source, list(struct_pack(title := title, type := type, trust := trust, year := year, u := u) ORDER BY doc_id) AS ev, count(*) AS n, min_by(title, doc_id) AS title, min_by(u, doc_id) AS tv, max_by(title, doc_id) AS topic, max_by(u, doc_id) AS q FROM u GROUP BY source),
s AS (SELECT *, trim(topic) != '' AS asked, {_STEMS.format('title')} AS ts, {_STEMS.format('topic')} AS terms, list_prepend(title, list_transform(ev, lambda x: x.title)) AS texts, list_filter(list_transform(ev, lambda x: x.year), lambda y: y IS NOT NULL) AS years FROM o),
f AS (SELECT source, asked::INT::DOUBLE AS has_topic, CASE WHEN asked THEN list_dot_product(q, tv) ELSE 0 END AS rel_query_title, CASE WHEN asked THEN n / 10 ELSE 0 END AS rel_cluster_query_v1,
 CASE WHEN asked THEN list_avg(list_transform(ev, lambda x: list_dot_product(q, x.u))) ELSE 0 END AS rel_query_evidence_mean, CASE WHEN asked THEN list_max(list_transform(ev, lambda x: list_dot_product(q, x.u))) ELSE 0 END AS rel_query_evidence_max,
 CASE WHEN asked AND len(terms) > 0 THEN len(list_intersect(ts, terms)) / len(terms) ELSE 0 END AS rel_terms_title, CASE WHEN asked AND len(terms) > 0 AND len(ts) > 0 THEN len(list_intersect(ts, terms)) / len(ts) ELSE 0 END AS spec_title_topic_overlap,
 CASE WHEN asked AND len(terms) > 0 THEN len(list_filter(ev, lambda x: list_has_any({_STEMS.format('x.title')}, terms))) / n ELSE 0 END AS rel_terms_evidence_share,
 least(len(ts), 12) / 12 AS spec_title_length, len(list_filter(ev, lambda x: regexp_matches(x.title, '{OVERVIEW}'))) / n AS spec_overview_share,
 CASE WHEN asked AND n >= 2 THEN (list_sum(list_transform(ev, lambda a: list_sum(list_transform(ev, lambda b: list_dot_product(a.u, b.u))))) - n) / (n * (n - 1)) ELSE 0 END AS spec_evidence_cohesion,
 CASE WHEN asked THEN list_avg(list_transform(ev, lambda x: list_dot_product(x.u, tv))) ELSE 0 END AS spec_title_evidence_sim, {", ".join(f"{_sql_share(w)} AS lex_{k}_share" for k, w in LEX.items())},
 greatest({", ".join(f"CASE WHEN len(list_filter(texts, lambda t: {_sql_holds(w, 't')})) > 0 THEN {k} ELSE 0 END" for k, w in STAGED.items())}) / 5 AS lex_stage_max,
 asked::INT::DOUBLE AS has_evidence, asked::INT * n / 8 AS evidence_count, asked::INT * {_OF.format("x.type IN ('PUBLICATION', 'PREPRINT')")} AS share_scientific, asked::INT * {_OF.format("x.type IN ('NEWS_MEDIA', 'INDUSTRY_MEDIA')")} AS share_news_media,
 asked::INT * {_OF.format("x.type IN ('PRESS_RELEASE', 'BLOG')")} AS share_marketing, asked::INT * {_OF.format("x.type IN ('CODE_REPOSITORY', 'VACANCY')")} AS share_code, asked::INT * {_OF.format("x.trust = 'HIGH'")} AS trusted_share, asked::INT * {_OF.format("x.trust = 'LOW'")} AS low_trust_share,
 asked::INT * least(len(list_distinct(list_transform(ev, lambda x: x.type))), 4) / 4 AS source_diversity, CASE WHEN asked AND len(years) > 0 THEN len(list_filter(years, lambda y: y >= 2022)) / len(years) ELSE 0 END AS recent_publication_share, asked::INT * len(years) / n AS dated_share FROM s)
SELECT source, {", ".join(f"round({n}, 6)::DOUBLE AS {n}" for n in registry.SCALARS)} FROM f""")
def observation_scalars(spark, d):
    """The 29 scalar features of every source as an observation."""
    out = observation_vectors(spark, d)
    return out.select("source", *[F.round(n, 6).alias(n) for n in registry.SCALARS])


@query()
def observation_vectors(spark, d):
    """The whole vector of 37 features of every source as an observation."""
    return registry.observation_features(observations(spark, d), "source", LEX, STAGED, 2023, projection(), OVERVIEW)


@query(f"""WITH e AS (SELECT source, doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, {TYPED} AS type, {TRUST} AS trust, {YEAR} AS year FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 8),
o AS (SELECT source, min(doc_id) AS i, count(*) AS n, avg((type NOT IN ('CODE_REPOSITORY') AND NOT (type = 'PREPRINT' AND trust != 'HIGH'))::INT) AS independent_share, avg((type = 'CODE_REPOSITORY')::INT) AS code_share,
  avg(regexp_matches(title, '{OVERVIEW}')::INT) AS review_share, list(year) FILTER (year IS NOT NULL) AS years FROM e GROUP BY source)
SELECT source, (i % 4 = 0)::INT::DOUBLE AS code_r, (i % 4 = 3)::INT::DOUBLE AS code_noise, n::DOUBLE AS sources, round(independent_share, 6) AS independent_share, round(code_share, 6) AS code_share, round(review_share, 6) AS review_share,
 round(coalesce(len(list_filter(years, lambda y: y >= list_max(years) - 1)) / len(years), 0), 6) AS recent_share, CASE WHEN i % 2 = 0 THEN 0.5 ELSE i / 100 END AS analyzer_score,
 round(CASE WHEN i % 3 = 0 THEN 0.9 WHEN i % 3 = 1 THEN CASE i % 4 WHEN 0 THEN 0.7 WHEN 1 THEN 0.45 ELSE 0.2 END + 0.05 * 0.25 ELSE 0.33333 END, 4)::DOUBLE AS probability FROM o""")
def rubric_features(spark, d):
    """Features of a verdict on every source, and the probability of its candidate."""
    o = observations(spark, d).join(table(spark, d, "documents").groupBy(F.col("source").alias("s")).agg(F.min("doc_id").alias("i")), F.col("source") == F.col("s"))
    code = F.element_at(F.array(*map(F.lit, ("R", "U", "N-OFF", "N-HYP"))), (F.col("i") % 4 + 1).cast("int"))
    rows = o.withColumns({"sources": F.col("evidence"), "code": code, "confidence": F.lit(0.25), "stage": F.lit(1), "trend": F.lit(2), "score": F.when(F.col("i") % 2 == 1, F.col("i") / 100)})
    p = registry.candidate_probability(F.when(F.col("i") % 3 == 0, 0.9), F.when(F.col("i") % 3 == 2, 0.33333), F.col("code"), F.col("confidence")).alias("probability")
    out = registry.rubric_features(rows, "source", OVERVIEW).join(rows.select(F.col("source").alias("r"), p), F.col("source") == F.col("r"))
    return out.select("source", F.col("code_R").alias("code_r"), F.col("code_NOISE").alias("code_noise"), "sources", *[F.round(c, 6).alias(c) for c in ("independent_share", "code_share", "review_share", "recent_share")], "analyzer_score", "probability")
