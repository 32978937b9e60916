r"""Column expressions over text. All stay in the JVM but nfkc() and unescape(), which need
Python's tables and run on Arrow batches. Word patterns use \p{} classes, which Java and RE2 read
alike."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_-]+"
TERM = r"[\p{L}\p{N}_]+"
#: English function words that carry no topic (fixed value).
STOP_WORDS = ("a", "an", "the", "and", "or", "of", "in", "on", "at", "to", "for", "with", "by", "from", "as", "is", "are", "was", "were", "be", "it", "its", "this", "that", "not")
#: A sentence with its closing mark.
SENTENCE = r"[^.!?…]+[.!?…]?"


def _as(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_if_null(text: Column | str) -> Column:
    return F.coalesce(_as(text), F.lit(""))


def collapse(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(empty_if_null(text), r"\s+", " "))


def normalize(text: Column | str) -> Column:
    """Lower case, punctuation as blanks, collapsed."""
    return F.trim(F.regexp_replace(F.lower(empty_if_null(text)), r"[^\p{L}\p{N}]+", " "))


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Compatibility composition, for sources that mix full-width and ligature forms."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def unescape(text: pa.Array) -> pa.Array:
    """HTML entities as characters."""
    return pa.array([None if t is None else html.unescape(t) for t in text.to_pylist()], pa.string())


def clean_whitespace(text: Column | str) -> Column:
    """Control characters as blanks, format characters dropped, collapsed."""
    plain = F.regexp_replace(empty_if_null(text), r"\p{Cc}", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\p{C}", ""), r"\s+", " "))


def strip_html(text: Column | str) -> Column:
    """Markup without script and style blocks and tags; entities stay (see unescape)."""
    blocks = F.regexp_replace(empty_if_null(text), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return collapse(F.regexp_replace(blocks, r"(?s)<[^>]+>", " "))


def tokens(text: Column | str) -> Column:
    """Lower-case words, hyphens inside."""
    return F.regexp_extract_all(F.lower(empty_if_null(text)), F.lit(f"({WORD})"), F.lit(1))


def terms(text: Column | str, limit: int = 120, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct significant words in order of appearance: two characters or more, no stop word."""
    words = F.regexp_extract_all(F.lower(empty_if_null(text)), F.lit(f"({TERM})"), F.lit(1))
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop))
    return F.slice(F.array_distinct(kept), 1, limit)


def term_coverage(term: Sequence[str], text: Column | str) -> Column:
    """Share of a phrase's words that the text holds."""
    wanted = F.array(*[F.lit(t) for t in term])
    return F.size(F.array_intersect(wanted, tokens(text))) / F.lit(len(set(term)))


def truncate_words(text: Column | str, limit: int) -> Column:
    """The first `limit` characters, cut back to the last blank if that keeps over 60 %."""
    t = empty_if_null(text)
    head = F.substring(t, 1, limit)
    blank = F.length(head) - F.locate(" ", F.reverse(head)) + 1
    at_blank = (F.locate(" ", head) > 0) & (blank - 1 > limit * 0.6)
    return F.when(F.length(t) <= limit, t).when(at_blank, F.rtrim(F.left(head, blank - 1))).otherwise(F.rtrim(head))


def sentences(text: Column | str) -> Column:
    found = F.regexp_extract_all(collapse(text), F.lit(f"({SENTENCE})"), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def first_sentences(text: Column | str, count: int, limit: int = 600) -> Column:
    return F.substring(F.array_join(F.slice(sentences(text), 1, count), " "), 1, limit)


def snippet(text: Column | str, phrase: str, limit: int = 600) -> Column:
    """From the first sentence that holds the phrase (or the first), as many whole sentences as
    fit; the head of the text if none fits."""
    every = sentences(text)
    at = F.coalesce(F.nullif(F.array_position(F.transform(every, lambda s: F.contains(F.lower(s), F.lit(phrase.lower()))), F.lit(True)), F.lit(0)), F.lit(1)).cast("int")
    rest = F.slice(every, at, F.greatest(F.size(every), F.lit(1)))
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))

    def add(acc: Column, s: Column) -> Column:
        longer = F.trim(F.concat_ws(" ", acc["s"], s))
        full = acc["full"] | (F.length(longer) > limit)
        return F.struct(F.when(full, acc["s"]).otherwise(longer).alias("s"), full.alias("full"))

    built = F.aggregate(rest, start, add)["s"]
    return F.when(built != "", built).otherwise(F.rtrim(F.substring(collapse(text), 1, limit)))


def language_by_script(text: Column | str, least: int = 3) -> Column:
    """ru or en by the share of Cyrillic among Cyrillic and Latin letters, und below `least`."""
    cyrillic, latin = F.regexp_count(empty_if_null(text), F.lit(r"[Ѐ-ӿ]")), F.regexp_count(empty_if_null(text), F.lit(r"[A-Za-z]"))
    return F.when(cyrillic + latin < least, "und").when(cyrillic >= latin * 0.5, "ru").otherwise("en")


def cyrillic_share(text: Column | str) -> Column:
    """Share among letters, 1 where there is no letter."""
    letters = F.regexp_count(empty_if_null(text), F.lit(r"\p{L}"))
    return F.when(letters == 0, 1.0).otherwise(F.regexp_count(empty_if_null(text), F.lit(r"[Ѐ-ӿ]")) / letters)


def language_code(code: Column | str) -> Column:
    """xx of xx-YY, two or three letters; null else."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(empty_if_null(code))), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def doi(value: Column | str) -> Column:
    """A DOI without its prefixes; null unless it starts with 10. and holds a slash."""
    bare = F.regexp_replace(F.lower(F.trim(empty_if_null(value))), r"^(https?://)?(dx\.)?(doi\.org/|doi:\s*)?", "")
    return F.when(bare.rlike(r"^10\.[^/]+/.+"), bare)


def singular(word: Column) -> Column:
    """English singular by suffix: ies to y, no final s after anything but s, u or i."""
    return F.when(word.rlike(r".{2}ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike(r"..[^sui]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def prefix_stems(words: Column, length: int = 5) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.left(w, F.lit(length))))


def words_within(inner: Column, outer: Column) -> Column:
    """Whether the words of inner stand in a row inside outer (both normalised)."""
    return F.contains(F.concat(F.lit(" "), outer, F.lit(" ")), F.concat(F.lit(" "), inner, F.lit(" ")))


def word_runs(text: Column | str, n: int) -> Column:
    """All runs of n words of a normalised text, in order, repeats included."""
    words = " ".join(["[^ ]++"] * n)
    return F.regexp_extract_all(_as(text), F.lit(rf"(?<![^ ])(?=({words}))[^ ]++"), F.lit(1))


def slug(text: Column | str, limit: int = 80) -> Column:
    """Lower-case ASCII words joined by hyphens; common accents lose their marks."""
    plain = F.translate(F.lower(empty_if_null(text)), "àáâäãçèéêëìíîïñòóôöõùúûüÿß", "aaaaaceeeeiiiinooooouuuuys")
    return F.trim(F.substring(F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), F.lit("-")), 1, limit), F.lit("-"))


def slug_title(path: Column | str) -> Column:
    """Words of the path segment with most hyphens and underscores."""
    parts = F.filter(F.split(empty_if_null(path), "/+"), lambda p: p.rlike("[A-Za-z]"))
    ranked = F.transform(parts, lambda p, i: F.struct(F.regexp_count(p, F.lit("[-_]")).alias("n"), (-i).alias("o"), F.regexp_replace(p, r"(?i)\.(html?|php|aspx?)$", "").alias("p")))
    return F.trim(F.regexp_replace(F.coalesce(F.array_max(ranked)["p"], F.lit("")), "[-_]+", " "))


def numbers(text: Column | str) -> Column:
    """Numbers of a text but years 2000 to 2030 and those of at most 2."""
    found = F.regexp_extract_all(empty_if_null(text), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    values = F.transform(found, lambda x: x.try_cast("double"))
    return F.array_distinct(F.filter(values, lambda v: (F.abs(v) > 2) & ~((v >= 2000) & (v <= 2030) & (v == F.floor(v)))))


def unsupported_numbers(text: Column | str, sources: Column) -> Column:
    """Numbers of a text that its sources don't hold."""
    return F.array_except(numbers(text), numbers(sources))


def doc_refs(text: Column | str) -> Column:
    """N of each [doc:N]."""
    return F.transform(F.regexp_extract_all(empty_if_null(text), F.lit(r"\[doc:(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def without_doc_refs(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(empty_if_null(text), r"\s*\[doc:\d+\]", ""))


def content_hash(*texts: Column | str) -> Column:
    """SHA-256 of the normalised texts."""
    return F.sha2(F.concat_ws(" ", *[normalize(t) for t in texts]), 256)


def lexicon_hits(words: Column, exact: Sequence[str] = (), prefixes: Sequence[str] = (), phrases: Sequence[str] = ()) -> Column:
    """How many words are in the lexicon or start with one of its prefixes, plus the phrases that
    occur (words of a phrase in a row)."""

    def hit(w: Column) -> Column:
        tests = [w.isin(*exact)] if exact else []
        tests += [w.startswith(p) for p in prefixes]
        found = F.lit(False)
        for t in tests:
            found = found | t
        return found

    total = F.size(F.filter(words, hit)).cast("long")
    spaced = F.array_join(words, "  ")
    for p in phrases:
        pattern = r"(?<![^ ])" + "  ".join(p.split()) + r"(?![^ ])"
        total = total + F.regexp_count(spaced, F.lit(pattern))
    return total


def lexicon_rate(hits: Column, total: Column) -> Column:
    """Hits for 1000 words over 20, at most 1; texts under 200 words count as 200."""
    return F.when((total <= 0) | (hits <= 0), 0.0).otherwise(F.least(F.lit(1.0), hits / F.greatest(total, F.lit(200)) * 1000 / 20))


def organisations(text: Column | str) -> Column:
    """Distinct sequences of two or more capitalised words."""
    return F.array_distinct(F.regexp_extract_all(empty_if_null(text), F.lit(r"(\p{Lu}[\p{L}\p{N}&.-]+(?: \p{Lu}[\p{L}\p{N}&.-]+)+)"), F.lit(1)))


def recent_year_share(text: Column | str, year: int) -> Column:
    """Share of year-1 onwards among the years 2000 to year+1 in a text, 0 without any."""
    years = F.filter(F.transform(F.regexp_extract_all(empty_if_null(text), F.lit(r"(?<!\d)(20\d\d)(?!\d)"), F.lit(1)), lambda y: y.cast("int")), lambda y: y <= year + 1)
    return F.when(F.size(years) == 0, 0.0).otherwise(F.size(F.filter(years, lambda y: y >= year - 1)) / F.size(years))


def text_quality(body: Column | str, article: int = 1500, abstract: int = 200) -> Column:
    n = F.length(empty_if_null(body))
    return F.when(n >= article, "article").when(n >= abstract, "abstract").otherwise("title")


def all_caps(text: Column | str) -> Column:
    """Eight letters or more of which over 80 % are upper case."""
    letters, upper = F.regexp_count(empty_if_null(text), F.lit(r"\p{L}")), F.regexp_count(empty_if_null(text), F.lit(r"\p{Lu}"))
    return (letters >= 8) & (upper > letters * 0.8)


def look_alikes(code: Column | str) -> Column:
    """Cyrillic letters that look Latin, as Latin, upper case."""
    return F.translate(F.upper(F.trim(empty_if_null(code))), "АВЕКМНОРСТХ", "ABEKMHOPCTX")
