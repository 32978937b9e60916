"""Column expressions over the texts of cards: names, terms of titles, numbers that sources support."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Where a title falls into parts, beside brackets and quotes: clause marks, dashes between blanks.
PARTS = r"[:;|?!()\[\]{}«»\"“”„]|\s[-–—]\s|,\s|\.\s"
#: What a term loses at its ends.
EDGE = " .,;:!?-–—'’`*"
BRACKETS = "()[]{}«»\"“”„"
MARK = "\u0001"
#: A share of letters of a text.
Share = Callable[[Column], Column]


def name_key(text: Column | str) -> Column:
    """A name for comparison: lower case, without quotes and brackets, blanks collapsed."""
    return T.collapse(F.regexp_replace(F.lower(T.empty_if_null(text)), r"[«»\"'“”„()\[\]]", " "))


def latin_words(text: Column | str, generic: Sequence[str] = (), least: int = 4) -> Column:
    """Distinct lower-case parts of Latin words between hyphens, `least` characters or more and not generic."""
    found = F.regexp_extract_all(F.lower(T.empty_if_null(text)), F.lit("[a-z][a-z0-9]*(?:-[a-z0-9]+)*"), F.lit(0))
    words = F.flatten(F.transform(found, lambda w: F.split(w, "-")))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*generic) if generic else F.length(w) >= least))


def named(word: Column) -> Column:
    """Whether a word looks like a proper name: letters with a digit, or a capital after the first character."""
    return word.rlike(r"\p{L}") & (word.rlike(r"\p{Nd}") | word.rlike(r"(?s)^.+\p{Lu}"))


def _bare(word: Column, more: str = "") -> Column:
    return F.trim(word, F.lit(EDGE + more))


def _is_term(term: Column, generic: Sequence[str]) -> Column:
    words = F.split(term, " +")
    telling = lambda w: named(w) | (F.size(latin_words(w, generic)) > 0) | w.rlike(r"[А-Яа-яЁё]{4,}")
    return (F.size(words) <= 8) & F.length(term).between(2, 80) & ((F.size(words) > 1) | named(term)) & F.exists(words, telling)


def _add_terms(found: Column, terms: Column, count: int, good: Callable[[Column], Column]) -> Column:
    """found (t: terms, k: their name keys) with further good terms of other keys, up to `count` in all;
    no term is looked at once there are so many."""

    def add(acc: Column, x: Column) -> Column:
        skip = (F.size(acc["t"]) >= count) | ~good(x) | F.array_contains(acc["k"], name_key(x))
        more = F.struct(F.concat(acc["t"], F.array(x)).alias("t"), F.concat(acc["k"], F.array(name_key(x))).alias("k"))
        return F.when(skip, acc).otherwise(more)

    return F.aggregate(terms, found, add)


def title_terms(title: Column | str, stop: Sequence[str] = T.STOP_WORDS, generic: Sequence[str] = (), limit: int = 6, first: int = 4) -> Column:
    """Terms that a title offers, word for word: runs of words between stop words and clause marks (the
    first four), then single words that look like names, then the other runs. A run has one to eight
    words and 2 to 80 characters, one of them a name or a significant word; a single word has to be a
    name. owner/name gives the name. At most `limit`, without repeats; a null or empty title has none."""
    t = T.collapse(title)
    words = F.filter(F.split(F.regexp_replace(t, PARTS, f" {MARK} "), " "), lambda w: w != "")
    cut = F.transform(words, lambda w: F.when(F.lower(_bare(w)).isin(*stop), MARK).otherwise(w))
    runs = F.transform(F.split(F.array_join(cut, " "), MARK), lambda x: _bare(x))
    single = F.transform(F.split(t, " "), lambda w: _bare(w, BRACKETS))
    fits = lambda x: _is_term(x, generic)
    name = lambda w: named(w) & ~w.rlike(r"[()\[\]{}«»\"“”„]") & fits(w)
    none = F.struct(F.array().cast("array<string>").alias("t"), F.array().cast("array<string>").alias("k"))
    # the runs are bound once, as they are read twice
    found = F.get(F.transform(F.array(runs), lambda r: _add_terms(_add_terms(_add_terms(none, r, first, fits), single, limit, name), r, limit, fits)["t"]), F.lit(0))
    repo = _bare(F.regexp_extract(t, r"^[\w.-]+/([\w.-]+)$", 1))
    own = F.when(F.length(repo).between(2, 80), F.array(repo)).otherwise(F.array().cast("array<string>"))
    return F.when(t.rlike(r"^[\w.-]+/[\w.-]+$"), own).otherwise(found)


def _values(found: Column) -> Column:
    return F.filter(F.transform(found, lambda x: F.translate(x, ",", ".").try_cast("double")), lambda v: v.isNotNull())


def supported_numbers(text: Column | str, years: Column) -> Column:
    """Numbers of the sources' text, also rounded to two digits, and their years."""
    v = _values(F.regexp_extract_all(T.empty_if_null(text), F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)))
    return F.array_distinct(F.concat(v, F.transform(v, lambda x: F.round(x, 2)), F.transform(years, lambda y: y.cast("double"))))


def unsupported(text: Column | str, supported: Column) -> Column:
    """Numbers of a text that stand alone (6G and H100 are names) and that sources don't support."""
    v = _values(F.regexp_extract_all(T.empty_if_null(text), F.lit(r"(?U)(?<![\w.,])(\d+(?:[.,]\d+)?)(?!\w)"), F.lit(1)))
    return F.filter(v, lambda x: ~F.array_contains(supported, x) & ~F.array_contains(supported, F.round(x, 2)))


def repair_numbers(text: Column | str, supported: Column) -> Column:
    """A text without the sentences that hold unsupported numbers."""
    parts = F.split(T.empty_if_null(text), r"(?<=[.!?…])\s+")
    return F.trim(F.array_join(F.filter(parts, lambda p: (p != "") & (F.size(unsupported(p, supported)) == 0)), " "))


def whole_sentences(text: Column | str, count: int, limit: int) -> Column:
    """As many of the first `count` sentences as fit into `limit` characters; the head of the text
    where the first doesn't."""
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))

    def add(acc: Column, s: Column) -> Column:
        longer = F.trim(F.concat_ws(" ", acc["s"], s))
        full = acc["full"] | (F.length(longer) > limit)
        return F.struct(F.when(full, acc["s"]).otherwise(longer).alias("s"), full.alias("full"))

    built = F.aggregate(F.slice(T.sentences(text), 1, count), start, add)["s"]
    return F.when(built != "", built).otherwise(F.rtrim(F.left(T.collapse(text), F.lit(limit))))


def script_share(text: Column | str, script: str = r"[A-Za-z]") -> Column:
    """Share of a script's letters among letters, 1 where there is no letter."""
    t = T.empty_if_null(text)
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    return F.when(letters == 0, 1.0).otherwise(F.regexp_count(t, F.lit(script)) / letters)
