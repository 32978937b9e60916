"""Registered queries of column expressions, reports and checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import phrases as P
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import metrics, mining, reports, vectors
from tidemark.session import table

from .catalogue import CENT, query

TITLE = "split_part(coalesce(text, ''), chr(10), 1)"
NORMED = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_-]+')"
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TERMS = rf"list_filter(regexp_extract_all(lower({{}}), '[\p{{{{L}}}}\p{{{{N}}}}_]+'), lambda w: length(w) >= 2 AND NOT list_contains([{STOPS}], w))"
DISTINCT = "list_transform(list_filter(list_transform({0}, lambda w, i: struct_pack(w := w, i := i)), lambda x: list_position({0}, x.w) = x.i), lambda x: x.w)"


def _docs(spark, d):
    return table(spark, d, "documents")


def _title():
    return mining.title_of(F.col("text"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\p{Cc}', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM documents")
def doc_clean_whitespace(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_whitespace("text").alias("cleaned"))


LAST = "(CASE WHEN strpos(reverse({0}), reverse('{1}')) > 0 THEN length({0}) - strpos(reverse({0}), reverse('{1}')) + 2 - length('{1}') ELSE 0 END)"


@query(rf"""
WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t, coalesce(text, '') AS raw FROM documents),
w AS (SELECT *, left(t, 301) AS win, regexp_extract(left(t, 301), '^(.*[.!?…])(?:\s|$)', 1) AS whole, left(raw, 200) AS head FROM c),
k AS (SELECT *, {LAST.format("win", " ")} AS blank, greatest({LAST.format("head", ". ")}, {LAST.format("head", "; ")}, {LAST.format("head", ", ")}) AS mark FROM w)
SELECT doc_id, CASE WHEN length(t) <= 300 THEN t WHEN length(whole) > 150 THEN trim(whole) WHEN blank > 1 THEN trim(left(win, blank - 1)) ELSE trim(left(win, 300)) END AS sentence,
       CASE WHEN length(raw) <= 200 THEN raw WHEN mark - 1 > 100 THEN trim(left(head, mark - 1), ' ,;—-') ELSE trim(head, ' ,;—-') END AS clause FROM k""")
def doc_truncate_ends(spark, d):
    """Texts cut at a sentence end and at a clause mark."""
    return _docs(spark, d).select("doc_id", P.truncate_at_sentence("text", 300).alias("sentence"), P.truncate_at_clause("text", 200).alias("clause"))


@query(f"WITH t AS (SELECT doc_id, {TERMS.format(TITLE)} AS w FROM documents) SELECT doc_id, list_slice({DISTINCT.format('w')}, 1, 5) AS words FROM t")
def title_phrase_words(spark, d):
    return _docs(spark, d).select("doc_id", P.phrase_words(_title()).alias("words"))


SINGULAR = "CASE WHEN regexp_matches({0}, '.{{2}}ies$') THEN regexp_replace({0}, 'ies$', 'y') WHEN regexp_matches({0}, '..[^sui]s$') THEN regexp_replace({0}, 's$', '') ELSE {0} END"
STEM = "CASE " + " ".join(f"WHEN ends_with({{0}}, '{e}') AND length({{0}}) >= {len(e) + 4} THEN left({{0}}, length({{0}}) - {len(e)})" for e in P.ENDINGS) + " ELSE {0} END"
OTHER = "CASE WHEN length({0}) > 4 AND ends_with({0}, 's') AND NOT regexp_matches({0}, '(ss|us|is)$') THEN left({0}, length({0}) - 1) WHEN regexp_matches({0}, '^[A-Za-z]+$') AND NOT ends_with({0}, 's') THEN {0} || 's' END"


@query(f"""
WITH w AS (SELECT DISTINCT unnest({TOKENS.format(TITLE)}) AS word FROM documents)
SELECT word, {SINGULAR.format('word')} AS singular, {STEM.format('word')} AS stem, coalesce({OTHER.format('word')}, '') AS other FROM w""")
def word_forms(spark, d):
    """Singular, stem and other number of every distinct word of titles."""
    words = _docs(spark, d).select(F.explode(T.tokens(_title())).alias("word")).distinct()
    variants = P.with_variants(F.array("word"))
    return words.select("word", T.singular(F.col("word")).alias("singular"), P.stem(F.col("word")).alias("stem"), F.coalesce(F.get(variants, F.lit(1)), F.lit("")).alias("other"))


@query(f"""
WITH t AS (SELECT doc_id, {NORMED.format(TITLE)} AS n FROM documents), p AS (SELECT *, string_split(n, ' ') AS w FROM t),
k AS (SELECT *, array_to_string(list_append(list_slice(w, 1, len(w) - 1), {SINGULAR.format('w[-1]')}), ' ') AS phrase_key FROM p)
SELECT doc_id, phrase_key, contains(' ' || n || ' ', ' ' || phrase_key || ' ') AS inside FROM k""")
def title_phrase_key(spark, d):
    """The title with its last word in the singular, and whether the title has it so."""
    rows = _docs(spark, d).select("doc_id", T.normalize(_title()).alias("n"))
    key = P.phrase_key(F.col("n"))
    return rows.select("doc_id", key.alias("phrase_key"), T.words_within(key, F.col("n")).alias("inside"))


@query(rf"SELECT doc_id, trim(left(trim(regexp_replace(translate(lower({TITLE}), 'àáâäãçèéêëìíîïñòóôöõùúûüÿß', 'aaaaaceeeeiiiinooooouuuuys'), '[^a-z0-9]+', '-', 'g'), '-'), 80), '-') AS slug FROM documents")
def title_slug(spark, d):
    return _docs(spark, d).select("doc_id", T.slug(_title()).alias("slug"))


@query(r"""
WITH s AS (SELECT page_id, list_filter(string_split_regex(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) || '/a-b_' || page_id || '.html', '/+'), lambda p: regexp_matches(p, '[A-Za-z]')) AS parts FROM pages),
r AS (SELECT page_id, list_sort(list_transform(parts, lambda p, i: struct_pack(n := len(regexp_extract_all(p, '[-_]')), o := -i, p := regexp_replace(p, '(?i)\.(html?|php|aspx?)$', ''))), 'DESC')[1].p AS p FROM s)
SELECT page_id, trim(regexp_replace(coalesce(p, ''), '[-_]+', ' ', 'g')) AS title FROM r""")
def page_slug_title(spark, d):
    """A title from the path segment with most hyphens and underscores."""
    path = F.concat(U.path("url"), F.lit("/a-b_"), F.col("page_id"), F.lit(".html"))
    return table(spark, d, "pages").select("page_id", T.slug_title(path).alias("title"))


@query(r"""
WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(lang) || '-XX' WHEN 1 THEN lang || '_yy' WHEN 2 THEN lang || 'abcd' ELSE ' ' || lang END AS code FROM documents)
SELECT doc_id, nullif(regexp_extract(lower(trim(coalesce(code, ''))), '^([a-z]{2,3})(?:[-_].*)?$', 1), '') AS lang FROM c""")
def language_codes(spark, d):
    m = F.pmod("doc_id", F.lit(4))
    code = F.when(m == 0, F.concat(F.upper("lang"), F.lit("-XX"))).when(m == 1, F.concat("lang", F.lit("_yy"))).when(m == 2, F.concat("lang", F.lit("abcd"))).otherwise(F.concat(F.lit(" "), "lang"))
    return _docs(spark, d).select("doc_id", T.language_code(code).alias("lang"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE '10.1000/x' || o_orderkey END AS doi,
CASE o_orderkey % 5 WHEN 0 THEN 'doi:10.1000/x' || o_orderkey WHEN 1 THEN 'arxiv:2401.' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') ELSE 'url:x.org/p/' || o_orderkey END AS key FROM orders""")
def identity_keys(spark, d):
    """DOIs in several spellings, and what names a work: arXiv identifier, DOI or URL."""
    k, m = F.col("o_orderkey").cast("string"), F.pmod("o_orderkey", F.lit(5))
    doi = F.when(m == 0, F.concat(F.lit("https://doi.org/10.1000/X"), k)).when(m == 1, F.concat(F.lit(" doi: 10.1000/x"), k)).when(m == 2, F.concat(F.lit("dx.doi.org/10.1000/x"), k)).when(m == 3, F.concat(F.lit("10.1000/x"), k)).otherwise(F.concat(F.lit("11.1000/x"), k))
    pre = F.lpad(F.pmod("o_orderkey", F.lit(100000)).cast("string"), 5, "0")
    url = F.when(m == 0, F.concat(F.lit("https://doi.org/10.1000/X"), k)).when(m == 1, F.concat(F.lit("http://arxiv.org/abs/2401."), pre, F.lit("v2"))).otherwise(F.concat(F.lit("http://www.x.org/p/"), k, F.lit("/?utm_source=a#b")))
    return table(spark, d, "orders").select("o_orderkey", T.doi(doi).alias("doi"), U.identity_key(url).alias("key"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE date_trunc('day', o_orderdate) END AS parsed, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderdate::DATE END AS of_path,
CASE o_orderkey % 3 WHEN 0 THEN date_trunc('year', o_orderdate)::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE ELSE o_orderdate::DATE END AS partial FROM orders""")
def parsed_dates(spark, d):
    """Dates of records in ISO and RFC 2822 form, of URL paths and with missing parts."""
    t, m, n = F.col("o_orderdate"), F.pmod("o_orderkey", F.lit(5)), F.pmod("o_orderkey", F.lit(3))
    day = F.date_format(t, "yyyy-MM-dd")
    text = F.when(m == 0, day).when(m == 1, F.concat(day, F.lit("T00:00:00Z"))).when(m == 2, F.date_format(t, "yyyyMMdd")).when(m == 3, F.concat(F.date_format(t, "EEE, d MMM yyyy"), F.lit(" 00:00:00 +0000"))).otherwise(F.lit("soon"))
    url = F.when(n == 0, F.concat(F.lit("https://x.org/"), F.date_format(t, "yyyy/MM/dd"), F.lit("/a"))).when(n == 1, F.concat(F.lit("https://x.org/n/"), day, F.lit("-b?c=1"))).otherwise(F.lit("https://x.org/2024/13/45/"))
    part = F.when(n == 0, F.date_format(t, "yyyy")).when(n == 1, F.date_format(t, "yyyy-MM")).otherwise(day)
    return table(spark, d, "orders").select("o_orderkey", N.parse_timestamp(text).cast("timestamp_ntz").alias("parsed"), U.date_of_path(url).alias("of_path"), N.partial_date(part).alias("partial"))


@query("""SELECT l_orderkey, l_linenumber, round_even(CASE WHEN l_linenumber % 2 = 0 THEN 0.5 + l_linenumber / 16.0 ELSE l_linenumber / 16.0 END, 2)::DOUBLE AS shown,
CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE l_linenumber END AS stage FROM lineitem""")
def display_scores(spark, d):
    """Scores as they are shown, and stages through a calibration map."""
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.display_score(n / 8.0, n % 2 == 0).alias("shown"), N.calibration_map(n, "1:2,2:3").alias("stage"))


@query("""SELECT p_partkey, greatest(10, least(250, ceil(p_size * 37 / greatest(1, p_partkey % 7)::DOUBLE)::BIGINT)) AS records,
greatest(DATE '2024-02-01' - round(p_size * 30.44)::INT, DATE '2021-01-01') AS since FROM part""")
def request_plan(spark, d):
    """Records for each request of a quota, and the first day of a window of months."""
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", N.per_request_of(size * 37, F.pmod("p_partkey", F.lit(7)), 10, 250).alias("records"), N.since_of(F.lit("2024-02-01").cast("date"), size, 2021).alias("since"))


LINKED = r"""regexp_extract_all(t, '\]\((https?://[^)\s]+)\)', 1)"""
NAMED = r"""list_transform(CASE WHEN len(linked) > 0 THEN linked ELSE regexp_extract_all(t, '(https?://[^\s)\]]+)', 1) END, lambda u: rtrim(u, '.,;)'))"""


@query(rf"""
WITH v AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'see [a](' || coalesce(url, '') || ') or [b](' || coalesce(url, '') || '), [c](http://x.org/' || page_id || ') by KNOWN leak -' ELSE 'at ' || coalesce(url, '') || '. and http://y.org/z;' END AS t FROM pages),
l AS (SELECT *, {LINKED} AS linked FROM v), n AS (SELECT *, {NAMED} AS named FROM l)
SELECT page_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(t, 'KNOWN leak', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g')), '\s*[—–-]\s*$', ''), '\s\s+', ' ', 'g'), ' ,;—-') AS cleaned, {DISTINCT.format("named")} AS urls FROM n""")
def description_sources(spark, d):
    """Descriptions without leaks and links, and the URLs that they name."""
    u, k = F.coalesce("url", F.lit("")), F.col("page_id").cast("string")
    linked = F.concat(F.lit("see [a]("), u, F.lit(") or [b]("), u, F.lit("), [c](http://x.org/"), k, F.lit(") by KNOWN leak -"))
    t = F.when(F.pmod("page_id", F.lit(2)) == 0, linked).otherwise(F.concat(F.lit("at "), u, F.lit(". and http://y.org/z;")))
    return table(spark, d, "pages").select("page_id", P.clean_description(t, ["KNOWN leak"]).alias("cleaned"), P.source_urls(t).alias("urls"))


MARKERS = (("ation", 3), ("ing", 1), ("heit", 4), ("ment", 2))


@query("SELECT doc_id, greatest(" + ", ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{m}') THEN {n} END" for m, n in MARKERS) + ") AS ordinal FROM documents")
def ordinal_markers(spark, d):
    return _docs(spark, d).select("doc_id", P.ordinal_from("text", MARKERS).alias("ordinal"))


STEMS = "list_distinct(list_transform({}, lambda w: left(w, 5)))"


@query(f"""
WITH t AS (SELECT a.doc_id, coalesce(a.text, '') AS text, {TITLE.replace("text", "b.text")} AS term FROM documents a JOIN documents b ON b.doc_id = a.doc_id // 2),
s AS (SELECT *, {STEMS.format(TOKENS.format('term'))} AS w, {STEMS.format(TOKENS.format('text'))} AS c, {NORMED.format('term')} AS tn, {NORMED.format('text')} AS cn FROM t)
SELECT doc_id, (tn <> '' AND contains(cn, tn)) OR (len(w) > 0 AND len(list_intersect(w, c)) / len(w) >= 0.6) AS held FROM s""")
def term_in_sources(spark, d):
    """Whether a document holds the first line of another one, literally or by stems."""
    docs = _docs(spark, d)
    terms = docs.select(F.col("doc_id").alias("of"), _title().alias("term"))
    rows = docs.join(terms, F.floor(F.col("doc_id") / 2) == F.col("of"))
    return rows.select("doc_id", P.term_in_sources(F.col("term"), F.col("text")).alias("held"))


@query(r"""
WITH t AS (SELECT doc_id, left(coalesce(text, ''), 120) AS head, array_to_string(list_slice(string_split(coalesce(text, ''), ' '), 3, 9), ' ') || ' zzz' AS echo FROM documents),
w AS (SELECT doc_id, regexp_extract_all(lower(echo), '[0-9a-z]+') AS said, regexp_extract_all(lower(head), '[0-9a-z]+') AS head FROM t)
SELECT doc_id, len(said) > 0 AND len(list_filter(said, lambda x: list_contains(head, x))) >= 0.6 * len(said) AS matches FROM w""")
def echo_matches(spark, d):
    """Whether words said back stand in the head of a text."""
    echo = F.concat(F.array_join(F.slice(F.split(T.empty_if_null("text"), " "), 3, 7), " "), F.lit(" zzz"))
    return _docs(spark, d).select("doc_id", P.echo_matches(echo, F.col("text")).alias("matches"))


LABELS = ("ation rate", "the", "ering thing", "Leather order")
SAID = {"ation rate": ["ation", "rate"], "the": ["the"], "ering thing": ["ering", "thing"], "Leather order": ["leathe"]}


@query("SELECT doc_id, (" + " + ".join("(" + " AND ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in ws) + ")::INT" for ws in SAID.values()) + ") AS mentioned FROM documents")
def features_mentioned(spark, d):
    return _docs(spark, d).select("doc_id", P.features_mentioned("text", LABELS).alias("mentioned"))


@query(r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, lang FROM documents),
x AS (SELECT *, 'in 2024 about ' || length(text) || ' of 9 [doc:1] [doc:' || doc_id % 5 || '] ' || text AS said, length(text) || ' and more ' || CASE WHEN doc_id % 2 = 1 THEN text ELSE left(text, length(text) // 2) END AS src FROM t),
n AS (SELECT *, regexp_extract_all(trim(regexp_replace(said, '\s*\[doc:\d+\]', '', 'g')), '\d+(?:\.\d+)?') AS a, regexp_extract_all(src, '\d+(?:\.\d+)?') AS b FROM x),
v AS (SELECT *, list_distinct(list_filter(list_transform(a, lambda z: z::DOUBLE), lambda z: abs(z) > 2 AND NOT (z >= 2000 AND z <= 2030 AND z = floor(z)))) AS an, list_transform(b, lambda z: z::DOUBLE) AS bn FROM n),
c AS (SELECT doc_id, len(list_filter(an, lambda z: NOT list_contains(bn, z))) AS bad,
      len(list_filter([doc_id % 5], lambda z: z < 1 OR z > 3)) + 0 AS refs, (contains(lower(said), 'the')::INT + contains(lower(said), 'about')::INT) AS m FROM v)
SELECT doc_id, bad::INT AS unsupported_numbers, refs::INT AS unknown_refs, m AS mentioned, bad = 0 AND refs = 0 AND m >= 2 AS passed FROM c""")
def narrative_grounding(spark, d):
    """Numbers, references and features of a narrative against its sources."""
    t, k = T.empty_if_null("text"), F.col("doc_id")
    n = F.length(t).cast("string")
    said = F.concat(F.lit("in 2024 about "), n, F.lit(" of 9 [doc:1] [doc:"), (k % 5).cast("string"), F.lit("] "), t)
    src = F.concat(n, F.lit(" and more "), F.when(k % 2 == 1, t).otherwise(F.left(t, F.floor(F.length(t) / 2).cast("int"))))
    return _docs(spark, d).select("doc_id", P.grounding(said, src, F.lit(3), ["the", "about"]).alias("g")).select("doc_id", "g.*")


@query(f"""
WITH t AS (SELECT source, list(left({TITLE}, 120) ORDER BY doc_id) AS titles, max_by(coalesce(text, ''), doc_id) AS body FROM documents GROUP BY source)
SELECT source, source || '. ' || left(body, 600) || ' ' || array_to_string(list_slice(titles, 1, 3), '; ') AS card FROM t""")
def source_cards(spark, d):
    """The training text of a card for each source: its newest text and three titles."""
    docs = _docs(spark, d)
    newest = docs.groupBy("source").agg(F.max_by(T.empty_if_null("text"), "doc_id").alias("body"))
    titles = reports.first_rows(docs.select("source", "doc_id", F.left(_title(), F.lit(120)).alias("title")), "source", "doc_id", 3).groupBy(F.col("source").alias("of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "title"))), lambda x: x["title"]).alias("titles"))
    return newest.join(titles, F.col("source").eqNullSafe(F.col("of"))).select("source", P.card_text(F.col("source"), F.col("body"), F.col("titles")).alias("card"))


@query(f"SELECT doc_id, regexp_matches(coalesce(text, ''), '{P.REVIEW}') AS review, regexp_matches(coalesce(text, ''), '{P.MARKET}') AS market FROM documents")
def review_market_flags(spark, d):
    t = T.empty_if_null("text")
    return _docs(spark, d).select("doc_id", P.is_review("text").alias("review"), P.is_market("text").alias("market"))


@query(r"SELECT doc_id, len(list_distinct(regexp_extract_all(coalesce(text, ''), '\p{Lu}[\p{L}\p{N}&.-]+(?: \p{Lu}[\p{L}\p{N}&.-]+)+'))) AS organisations FROM documents")
def organisation_mentions(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.organisations("text")).cast("long").alias("organisations"))


@query("""
WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'COMPLETED' ELSE 'PARTIAL' END AS status, o_orderkey % 4 AS req, o_custkey % 3 AS docs, CASE o_custkey % 5 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'BUDGET_EXHAUSTED' WHEN 2 THEN 'E1' END AS err FROM orders)
SELECT o_orderkey, CASE WHEN req <= 0 THEN 'NOT_POLLED' WHEN upper(err) = 'RATE_LIMITED' THEN CASE WHEN docs > 0 THEN 'PARTIAL' ELSE 'RATE_LIMITED' END
 WHEN err = 'BUDGET_EXHAUSTED' THEN CASE WHEN docs > 0 THEN 'PARTIAL' ELSE 'INCOMPLETE' END WHEN status = 'FAILED' OR err IS NOT NULL THEN CASE WHEN docs > 0 THEN 'PARTIAL' ELSE 'FAILED' END
 WHEN status = 'PARTIAL' THEN 'PARTIAL' WHEN docs > 0 THEN 'OK' ELSE 'EMPTY' END AS outcome FROM r""")
def source_outcomes(spark, d):
    s, c = F.col("o_orderstatus"), F.pmod("o_custkey", F.lit(5))
    status = F.when(s == "F", "FAILED").when(s == "O", "COMPLETED").otherwise("PARTIAL")
    error = F.when(c == 0, "rate_limited").when(c == 1, "BUDGET_EXHAUSTED").when(c == 2, "E1")
    return table(spark, d, "orders").select("o_orderkey", P.source_outcome(status, F.pmod("o_orderkey", F.lit(4)), F.pmod("o_custkey", F.lit(3)), error).alias("outcome"))


@query("""
WITH c AS (SELECT p_partkey, p_size / 61.0::DOUBLE AS s, [('Size', p_size / 4.0 - 5), ('Key', (p_partkey % 9) - 4.0), ('None', 0.0)] AS f FROM part),
r AS (SELECT p_partkey, s, list_slice(list_sort(list_transform(f, lambda x, i: struct_pack(a := -abs(x[2]), i := i, l := x[1], v := x[2]))), 1, 2) AS top FROM c),
t AS (SELECT p_partkey, s, array_to_string(list_transform(list_filter(top, lambda x: x.v <> 0), lambda x: format('{} ({:+.2f})', lower(x.l), x.v::DOUBLE)), ', ') AS parts FROM r)
SELECT p_partkey, 'Calibrated probability ' || format('{:.2f}', s::DOUBLE) || ' is ' || CASE WHEN s >= 0.5 THEN 'at least' ELSE 'below' END || ' the threshold 0.50.' || CASE WHEN parts <> '' THEN ' Largest contributions: ' || parts || '.' ELSE '' END AS said FROM t""")
def decision_explanations(spark, d):
    """Sentences on the scores of all parts."""
    k = F.pmod("p_partkey", F.lit(9)) - 4.0
    f = F.array(*[F.struct(F.lit(n).alias("label"), v.cast("double").alias("value")) for n, v in (("Size", F.col("p_size") / 4.0 - 5), ("Key", k), ("None", F.lit(0.0)))])
    s = F.col("p_size") / 61.0
    return table(spark, d, "part").select("p_partkey", P.explain_decision(s, F.lit(0.5), f).alias("said"))


@query(f"""
WITH t AS (SELECT source, doc_id, trim({TITLE}) AS title FROM documents)
SELECT source, left(min_by(title, doc_id) FILTER (title <> ''), 200) AS title FROM t GROUP BY source""")
def fallback_titles(spark, d):
    """The first title of each source that isn't empty."""
    t = F.trim(_title())
    return _docs(spark, d).groupBy("source").agg(F.left(F.min_by(F.when(t != "", t), F.when(t != "", F.col("doc_id"))), F.lit(200)).alias("title"))


@query("SELECT source, doc_id, lang FROM documents WHERE source IS NOT NULL QUALIFY lang = 'en' OR NOT coalesce(bool_or(lang = 'en') OVER (PARTITION BY source), false)")
def english_first(spark, d):
    """English rows of a source where it has any, else all of them."""
    return reports.preferred_first(_docs(spark, d).where("source IS NOT NULL").select("source", "doc_id", "lang"), "source", F.col("lang") == "en")


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_-]+')) AS w FROM documents),
c AS (SELECT lower(w) AS word, w AS surface, count(*) AS n, min(doc_id) AS first FROM w GROUP BY ALL)
SELECT word, surface, n FROM c WHERE length(word) > 3 QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, first, surface) = 1""".replace("\\\\", "\\"))
def surface_forms(spark, d):
    """The most common spelling of each word of four letters or more, the earliest among equals."""
    words = _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all(T.empty_if_null("text"), F.lit(f"({T.WORD})"), F.lit(1))).alias("surface"))
    return mining.surface_forms(words, F.lower("surface"), "surface", "doc_id").where(F.length("word") > 3)


@query("""
WITH l AS (SELECT lang, length(coalesce(text, '')) AS n FROM documents), s AS (SELECT lang, list_sort(list(n)) AS x FROM l GROUP BY lang)
SELECT lang, len(x) AS docs, x[1] AS shortest, x[len(x) // 2 + 1] AS median, x[len(x)] AS longest FROM s""")
def length_profile(spark, d):
    """Counts and lengths by language; the median is the upper one."""
    return reports.length_profile(_docs(spark, d).select("lang", F.length(T.empty_if_null("text")).cast("long").alias("n")), "lang", "n")


@query("""SELECT source, count(*) AS cards, count(*) FILTER (quality = 1) AS good, round(count(*) FILTER (quality = 1) / count(*)::DOUBLE, 3) AS good_share,
count(*) FILTER (trim(coalesce(text, '')) = '') AS empty, count(*) FILTER (starts_with(text, 'The')) AS templates FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def card_completeness(spark, d):
    rows = _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return reports.completeness(rows, "source", {"good": F.col("quality") == 1, "empty": F.trim(T.empty_if_null("text")) == "", "templates": F.coalesce(F.col("text").startswith("The"), F.lit(False))}, shares=("good",))


@query("SELECT user_id, coalesce(sum(coalesce(value, 0)), 0) AS spent FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY user_id")
def token_budget(spark, d):
    """What each user spent since midnight of the last day."""
    e = table(spark, d, "events")
    last = e.agg(F.date_trunc("day", F.max("ts")).alias("since"))
    return e.join(F.broadcast(last), F.col("ts") >= F.col("since")).groupBy("user_id").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("spent"))


@query("""
WITH a AS (SELECT o_custkey AS k, count(*) AS before FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS after FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(before, 0) AS before, coalesce(after, 0) AS after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'both' END AS state FROM a FULL JOIN b ON a.k = b.k""")
def run_comparison(spark, d):
    """Counters by key of two runs, and which run has the key."""
    o = table(spark, d, "orders")
    part = [o.where(F.pmod("o_orderkey", F.lit(2)) == i).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n)) for i, n in enumerate(("before", "after"))]
    return reports.compare_runs(*part, "k", "before", "after")


@query("""
WITH e AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), h AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F')
SELECT e.o_custkey, e.o_orderpriority, count(o_orderkey) AS hits, min(o_orderkey) FILTER (o_totalprice > 100000) AS first_large FROM e LEFT JOIN h USING (o_custkey, o_orderpriority) GROUP BY ALL""")
def expert_hits(spark, d):
    """Distinct pairs with their hits, if any."""
    o = table(spark, d, "orders")
    hits = o.where("o_orderstatus = 'F'").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("hits"), F.min(F.when(F.col("o_totalprice") > 100000, F.col("o_orderkey"))).alias("first_large"))
    return o.select("o_custkey", "o_orderpriority").distinct().join(hits, ["o_custkey", "o_orderpriority"], "left").select("o_custkey", "o_orderpriority", F.coalesce("hits", F.lit(0)).alias("hits"), "first_large")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size + p_partkey % 5 DESC, p_retailprice DESC, p_partkey) AS pos FROM part")
def rubric_ranking(spark, d):
    """Positions by stage and trend, then confidence, then order of appearance."""
    return reports.ranked(table(spark, d, "part").select("p_partkey", (F.col("p_size") + F.pmod("p_partkey", F.lit(5))).alias("s"), "p_retailprice"), [F.col("s").desc(), F.col("p_retailprice").desc(), F.col("p_partkey")], "pos").select("p_partkey", "pos")


@query("""
SELECT l_shipmode, count(*) AS signals, count(*) FILTER (l_discount * 10 >= 0.80) AS hits_80, count(*) FILTER (l_discount * 10 >= 0.89) AS hits_89, round(avg(l_discount * 10), 4) AS mean
FROM (SELECT *, substr(l_returnflag, 1, 1) AS l_shipmode FROM lineitem) GROUP BY l_shipmode""")
def hit_rates(spark, d):
    """How many values reach each threshold."""
    rows = table(spark, d, "lineitem").select(F.left("l_returnflag", F.lit(1)).alias("l_shipmode"), (F.col("l_discount") * 10).alias("v"))
    return reports.hit_rates(rows, "l_shipmode", "v", (0.80, 0.89)).withColumnRenamed("n", "signals").withColumn("mean", F.round("mean", 4))


@query("""
WITH a AS (SELECT o_custkey AS k, avg(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, avg(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS topics, round(avg(b.v - a.v), 4) AS mean_diff, count(*) FILTER (b.k IS NULL) AS only_in_a, count(*) FILTER (a.k IS NULL) AS only_in_b FROM a FULL JOIN b ON a.k = b.k""")
def paired_difference(spark, d):
    """The mean difference of two runs over common topics."""
    o = table(spark, d, "orders")
    a, b = (o.where(F.pmod("o_orderkey", F.lit(2)) == i).groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("v")) for i in (0, 1))
    return metrics.paired_difference(a, b, "k", "v").withColumn("mean_diff", F.round("mean_diff", 4))


@query(CENT + """, a AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), w AS (SELECT e FROM u WHERE label = 0), s1 AS (SELECT e FROM u WHERE label = 1), q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(a.e, w.e), 4) AS weak, round(list_cosine_similarity(a.e, s1.e), 4) AS mature, round(list_cosine_similarity(a.e, q.e), 4) AS query FROM a, w, s1, q""")
def embedding_features(spark, d):
    """Cosines of every vector with two class centroids and a query vector."""
    e = table(spark, d, "embeddings")
    c = vectors.centroids(e, "label", "embedding")
    refs = {"weak": c.where("label = 0").select("centroid"), "mature": c.where("label = 1").select("centroid"), "query": e.where("vec_id = 0").select("embedding")}
    return vectors.reference_similarities(e, "vec_id", "embedding", refs).select("vec_id", *[F.round(n, 4).alias(n) for n in refs])


@query("""
WITH j AS (SELECT source, lang, quality = toxic AS hit FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT 'source' AS slice, source AS value, count(*) AS n, round(avg(hit::INT), 6) AS accuracy FROM j GROUP BY source UNION ALL SELECT 'lang', lang, count(*), round(avg(hit::INT), 6) FROM j GROUP BY lang""")
def sliced_accuracy(spark, d):
    """Accuracy by each of several dimensions."""
    rows = _docs(spark, d).join(table(spark, d, "labels"), "doc_id").where("quality IS NOT NULL AND toxic IS NOT NULL")
    return metrics.sliced(rows, F.col("quality") == F.col("toxic"), ["source", "lang"]).withColumn("accuracy", F.round("accuracy", 6))


@query("""
WITH r AS (SELECT quality AS y, row_number() OVER (PARTITION BY source ORDER BY length(coalesce(text, '')) DESC, doc_id) AS r FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
SELECT count(*) FILTER (r <= 3) AS shown, sum(y) FILTER (r <= 3)::BIGINT AS hits, round(sum(y) FILTER (r <= 3) / (count(*) FILTER (r <= 3))::DOUBLE, 4) AS precision FROM r""")
def pooled_precision(spark, d):
    """Precision of the first three of every source, pooled."""
    rows = _docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("source", "doc_id", "quality", F.length(T.empty_if_null("text")).alias("n"))
    return metrics.top_k(rows, "source", "n", "quality", "doc_id", 3).agg(F.sum("shown").alias("shown"), F.sum("hits").alias("hits")).withColumn("precision", F.round(F.col("hits") / F.col("shown"), 4))


@query("""
SELECT o_orderkey, c_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def failed_sources(spark, d):
    """The twenty newest runs that didn't complete, with whom they belong to."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'O'").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(20)
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderstatus")


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) GROUP BY o_custkey")
def latest_matching(spark, d):
    """The newest run of each key among those of one kind."""
    o = table(spark, d, "orders")
    kind = o.agg(F.min("o_orderpriority").alias("kind"))
    return o.join(F.broadcast(kind), F.col("o_orderpriority") == F.col("kind")).groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("""
WITH c AS (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN '3' WHEN 1 THEN '99' WHEN 2 THEN 'x' WHEN 3 THEN '2.7' END AS stage, CASE n_nationkey % 3 WHEN 0 THEN '1.4' WHEN 1 THEN '-2' ELSE '0.25' END AS conf FROM nation)
SELECT n_nationkey, least(greatest(trunc(try_cast(stage AS DOUBLE))::INT, 1), 4) AS stage, least(greatest(try_cast(conf AS DOUBLE), 0.0), 1.0) AS confidence FROM c WHERE try_cast(stage AS DOUBLE) IS NOT NULL""")
def verdict_coercion(spark, d):
    """Answers with types and ranges forced; those without a stage are dropped."""
    m, c = F.pmod("n_nationkey", F.lit(5)), F.pmod("n_nationkey", F.lit(3))
    rows = table(spark, d, "nation").select("n_nationkey", F.when(m == 0, "3").when(m == 1, "99").when(m == 2, "x").when(m == 3, "2.7").alias("stage"), F.when(c == 0, "1.4").when(c == 1, "-2").otherwise("0.25").alias("confidence"))
    return reports.coerced(rows, {"stage": ("int", 1, 4), "confidence": ("double", 0.0, 1.0)}, required=("stage",))


@query("""SELECT r_name, '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def region_json(spark, d):
    """Children of each parent as a JSON array."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("nations"))


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL)
SELECT source, string_agg(n || ' ' || lang, ', ' ORDER BY n DESC, lang) AS composition FROM c GROUP BY source""")
def composition_text(spark, d):
    """Kinds of each source by count, as text."""
    return reports.composition(_docs(spark, d), "source", "lang")


@query("""
SELECT lower(trim(p_brand)) AS topic, count(*) AS n, count(DISTINCT p_type) AS lists FROM part GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT p_type) > 1""")
def topic_overlaps(spark, d):
    """Topics that occur more than once and in more than one list."""
    return table(spark, d, "part").groupBy(F.lower(F.trim("p_brand")).alias("topic")).agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("lists")).where("n > 1 AND lists > 1")


@query("""SELECT c_custkey, length(c_name) BETWEEN 1 AND 18 AS name_ok, regexp_matches(c_name, '^Customer#[0-9]{9}$') AS name_form, c_acctbal BETWEEN -999 AND 9999 AS balance_ok, c_nationkey IN (SELECT n_nationkey FROM nation) AS nation_ok FROM customer""")
def input_validation(spark, d):
    """Lengths, forms, ranges and references of rows."""
    known = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    rows = table(spark, d, "customer").join(F.broadcast(known), F.col("c_nationkey") == F.col("k"), "left")
    return rows.select("c_custkey", F.length("c_name").between(1, 18).alias("name_ok"), F.col("c_name").rlike("^Customer#[0-9]{9}$").alias("name_form"), F.col("c_acctbal").between(-999, 9999).alias("balance_ok"), F.col("k").isNotNull().alias("nation_ok"))
