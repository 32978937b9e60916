"""Search phrases of a text by a glossary, and the words that a topic's phrases have in common.

A glossary is a table of any size: entries meet words by an equi-join on their first letters."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import phrases as P
from tidemark.functions import text as T
from tidemark.plans.store import cut

from .selection import segments

#: Shortest word that is inflected, longest ending, shortest stem of a longer derivation (fixed values).
LEAST, ENDING, DERIVED = 5, 3, 6
#: First letters that inflected words share.
HEAD = 4
#: Most entries of words that go to all tasks at once.
FEW = 200_000
#: Words, and pairs of them, for which a task keeps what they stand for.
KNOWN = 1 << 18


def common_prefix(a: Column, b: Column) -> Column:
    """How many first letters two words share."""
    n = F.least(F.length(a), F.length(b))
    step = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: F.when((s == i - 1) & (i <= n) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(s))
    return step


def same_lexeme(word: Column, entry: Column, strict: bool = False) -> Column:
    """Whether two words are one but for their ending. strict: an entry's stem must be in the word
    whole, and a word goes far beyond it only from a long stem."""
    common = common_prefix(word, entry)
    near = (F.length(word) >= LEAST) & (F.length(entry) >= LEAST) & (common >= F.greatest(F.lit(HEAD), F.least(F.length(word), F.length(entry)) - 2))
    if strict:
        near &= (F.length(entry) - common <= ENDING) & ((F.length(word) - common <= ENDING) | (common >= DERIVED))
    return (word == entry) | near


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is computed once wherever use needs it twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(T.empty_if_null(text)), F.lit(r"(?U)([\w-]+)"), F.lit(1))


def content_segments(text: Column | str, stop: Sequence[str]) -> Column:
    """Runs of words between stop words; all words if they are all stop words."""
    whole = F.array_join(_words(text), " ")
    all_ = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array(whole))
    return _once(segments(_words(text), stop), lambda runs: F.when(F.size(runs) > 0, runs).otherwise(all_))


def _parted(words: Column, foreign: str, strict: bool) -> Column:
    """Strict: a foreign word with hyphens counts as its parts."""
    if not strict:
        return words
    return F.flatten(F.transform(words, lambda w: F.when(F.contains(w, F.lit("-")) & w.rlike(foreign), F.filter(F.split(w, "-"), lambda x: x != "")).otherwise(F.array(w))))


def _head(word: Column) -> Column:
    return F.when(F.length(word) >= LEAST, F.left(word, F.lit(HEAD))).otherwise(word)


def _alike(word: str, entry: str, strict: bool) -> bool:
    """same_lexeme() of two strings."""
    common = len(os.path.commonprefix((word, entry)))
    near = len(word) >= LEAST and len(entry) >= LEAST and common >= max(HEAD, min(len(word), len(entry)) - 2)
    if strict:
        near = near and len(entry) - common <= ENDING and (len(word) - common <= ENDING or common >= DERIVED)
    return word == entry or near


def _start(word: str) -> str:
    """_head() of a string: words of one lexeme share it."""
    return word[:HEAD] if len(word) >= LEAST else word


def _indexed(entries: Iterable[dict]) -> tuple[dict, dict]:
    """Single words by their start, and longer entries by the starts of their first two words, in the order
    in which they are tried; nulls first."""
    rank = lambda x: x if x is None else (x is not None, x)
    one: dict[str, list[dict]] = {}
    several: dict[tuple[str, str], list[dict]] = {}
    for x in sorted(entries, key=lambda x: (-len(x["e"]), rank(x["place"]) or (False,), rank(x["value"]) or (False,))):
        if len(x["e"]) == 1:
            one.setdefault(_start(x["e"][0]), []).append(x)
        elif x["e"]:
            several.setdefault((_start(x["e"][0]), _start(x["e"][1])), []).append(x)
    return one, several


def _closest(word: str, near: list[dict], strict: bool) -> str | None:
    """The value of the entry of one word with the longest common prefix, then the closest length."""
    fits = [x for x in near if _alike(word, x["e"][0], strict)]
    best = min(fits, key=lambda x: (-len(os.path.commonprefix((word, x["e"][0]))), abs(len(word) - len(x["e"][0]))), default=None)
    return best and best["value"]


def _walker(glossary: tuple[dict, dict], strict: bool) -> Callable[[pa.ListArray], list[pa.Array]]:
    """A function of the segments of some texts that gives, for each text, the segments, the words that
    stand for each, and the missed ones. What a word or a pair of words stands for is looked up once for
    all texts; Python only goes from one place to the next where an entry of several words may fit."""
    singles, several = glossary
    first, second = ({h: i for i, h in enumerate(sorted({k[j] for k in several}))} for j in (0, 1))
    both = np.array([first[a] * len(second) + second[b] for a, b in several], np.int64)
    closest = lru_cache(KNOWN)(lambda w: _closest(w, singles.get(_start(w), []), strict))
    fitting = lru_cache(KNOWN)(lambda a, b: [x for x in several[_start(a), _start(b)] if _alike(a, x["e"][0], strict) and _alike(b, x["e"][1], strict)])

    def walk(segs: pa.ListArray) -> list[pa.Array]:
        ends = lambda lists: np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)
        name, words, strange = segs.flatten().flatten()
        of_text, of_seg = ends(segs), ends(words)
        coded = words.flatten().dictionary_encode()
        code, known = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        foreign = np.zeros(len(known), bool)
        foreign[code] = strange.flatten().to_numpy(zero_copy_only=False)
        value = [closest(w) if f else w for w, f in zip(known, foreign)]

        # places where the starts of two words are those of an entry, and both words fit it
        a, b = (np.array([ids.get(_start(w), -1) for w in known], np.int64) for ids in (first, second))
        limit = np.repeat(of_seg[1:], np.diff(of_seg))
        at = np.flatnonzero((a[code[:-1]] >= 0) & (b[code[1:]] >= 0) & (np.arange(1, len(code)) < limit[:-1])) if both.size else np.array([], int)
        at = at[np.isin(a[code[at]] * len(second) + b[code[at + 1]], both)]
        pairs, which = np.unique(code[at] * np.int64(len(known)) + code[at + 1], return_inverse=True)
        near = [fitting(known[x // len(known)], known[x % len(known)]) for x in pairs.tolist()]
        open_ = np.array([len(x) > 0 for x in near], bool)[which] if len(at) else np.array([], bool)
        kept, stands, end = np.ones(len(code), bool), code.copy(), 0
        for i, k in zip(at[open_].tolist(), which[open_].tolist()):
            if i < end:
                continue
            fit = next((x for x in near[k] if len(x["e"]) <= limit[i] - i and all(_alike(known[c], e, strict) for c, e in zip(code[i + 2 : i + len(x["e"])], x["e"][2:]))), None)
            if fit:
                end = i + len(fit["e"])
                kept[i + 1 : end] = False
                if fit["value"] is not None:
                    stands[i] = len(value)
                    value.append(fit["value"])

        none = np.array([v is None for v in value], bool)[stands]
        said, missed = kept & ~none, kept & none
        upto = lambda mask, ends: pa.array(np.concatenate(([0], np.cumsum(mask)))[ends].astype(np.int32))
        lines = pa.ListArray.from_arrays(upto(said, of_seg), pa.array(value, pa.string()).take(pa.array(stands[said])))
        left = pa.ListArray.from_arrays(upto(missed, of_seg[of_text]), coded.dictionary.take(pa.array(code[missed])))
        return [pa.ListArray.from_arrays(pa.array(of_text), x) for x in (name, lines)] + [left]

    return walk


def translated(docs: DataFrame, key: str, text: str, glossary: DataFrame, stop: Sequence[str], foreign: str, strict: bool = False, few: int = FEW) -> DataFrame:
    """key (unique), text, segments, translated (the words of each segment, an array for each) and missed.

    glossary has entry, value and place (order of preference). From the left of a segment the entry of
    most words that fit goes first, then a word that isn't foreign (a pattern) stays as it is, then the
    single-word entry with the longest common prefix (then the closest length, then place) stands for
    a foreign one; a foreign word without any is missed.

    A glossary of at most `few` entries goes to every task, and no text is shuffled; of a larger one, each
    text is joined with the entries that start like one of its words."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    entries = cut(glossary.select(_parted(F.split(F.lower("entry"), r"\s+"), foreign, strict).alias("e"), "value", "place"))
    small = entries.limit(few + 1).count() <= few
    shared = docs.sparkSession.sparkContext.broadcast(_indexed(r.asDict() for r in entries.collect()) if small else None)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _walker(shared.value, strict) if small else None
        for b in batches:
            if not len(b):
                continue
            segs = b.column("segs")
            if small:
                said = whole(segs)
            else:
                each = [_walker(_indexed(h or []), strict)(segs.slice(i, 1)) for i, h in enumerate(b.column("hits").to_pylist())]
                said = [pa.concat_arrays(x) for x in zip(*each)]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("t"), *said], ["k", "t", "segments", "translated", "missed"])

    def parts(s: Column) -> Column:
        return _once(_parted(F.split(s, " "), foreign, strict), lambda ws: F.struct(s.alias("segment"), ws.alias("words"), F.transform(ws, lambda w: w.rlike(foreign)).alias("strange")))

    met = rows
    if not small:
        heads = rows.select("k", F.explode(F.array_distinct(F.transform(_parted(_words("t"), foreign, strict), _head))).alias("head"))
        near = heads.join(entries.withColumn("e_head", _head(F.get("e", F.lit(0)))), F.col("head") == F.col("e_head"))
        hits = near.groupBy(F.col("k").alias("f_k")).agg(F.collect_list(F.struct("e", "value", "place")).alias("hits"))
        met = rows.join(hits, F.col("k").eqNullSafe(F.col("f_k")), "left").drop("f_k")
    types = dict(rows.dtypes)
    out = met.withColumn("segs", F.transform(content_segments("t", stop), parts)).mapInArrow(walk, f"k {types['k']}, t {types['t']}, segments array<string>, translated array<array<string>>, missed array<string>")
    return out.select(F.col("k").alias(key), F.col("t").alias(text), "segments", "translated", F.array_distinct("missed").alias("missed"))


def _unique(phrases: Column, limit: int) -> Column:
    """The first `limit` different phrases; those behind them are not looked at."""
    add = lambda s, c, low: F.when((F.length(c) < 2) | F.exists(s, lambda x: x["low"] == low), s).otherwise(F.concat(s, F.array(F.struct(c.alias("c"), low.alias("low")))))
    step = lambda s, p: F.when(F.size(s) >= limit, s).otherwise(_once(F.trim(F.regexp_replace(p, r"(?U)\s+", " ")), lambda c: _once(F.lower(c), lambda low: add(s, c, low))))
    found = F.aggregate(phrases, F.array().cast("array<struct<c: string, low: string>>"), step)
    return F.transform(found, lambda x: x["c"])


def _specific(segs: Column) -> Column:
    return _once(F.filter(segs, lambda s: F.contains(s, F.lit(" "))), lambda several: F.when(F.size(several) > 0, several).otherwise(segs))


def fallback_terms(docs: DataFrame, key: str, text: str, glossary: DataFrame, stop: Sequence[str], foreign: str, strict: bool = False, limit: int = 6) -> DataFrame:
    """key, own, foreign_terms, missed: search phrases of a text in its own words and translated ones:
    all segments together, then those of several words (or all, where none has), then for the own
    words the text itself; no repeats, at most `limit`. Where nothing is left it is the text."""
    said = translated(docs, key, text, glossary, stop, foreign, strict)
    lines = F.filter(F.transform("translated", lambda ws: F.array_join(ws, " ")), lambda s: s != "")
    whole = T.empty_if_null(text)
    own = _unique(F.concat(F.array(F.array_join("segments", " ")), _specific(F.col("segments")), F.array(whole)), limit)
    other = _once(lines, lambda x: _unique(F.concat(F.array(F.array_join(x, " ")), _specific(x)), limit))
    some = lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(whole))
    return said.select(key, _once(own, some).alias("own"), _once(other, some).alias("foreign_terms"), "missed")


def _topic_words(phrases: DataFrame, topic: str, place: str, phrase: str, generic: Sequence[str]) -> DataFrame:
    words = F.regexp_extract_all(F.lower(T.empty_if_null(phrase)), F.lit(f"({T.TERM})"), F.lit(1))
    each = phrases.select(topic, place, F.posexplode(words).alias("at", "word"))
    return each.where((F.length("word") >= 3) & ~F.col("word").isin(*generic) & ~F.col("word").rlike(r"^\d+$"))


def topic_keywords(phrases: DataFrame, topic: str, place: str, phrase: str, generic: Sequence[str] = (), limit: int = 16) -> DataFrame:
    """topic, word, pos: the first `limit` distinct words of a topic's phrases (place orders them) of
    three letters or more, generic ones and numbers left out."""
    first = _topic_words(phrases, topic, place, phrase, generic).groupBy(topic, "word").agg(F.min(F.struct(place, "at")).alias("first"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(topic).orderBy("first"))).where(F.col("pos") <= limit).select(topic, "word", "pos")


def topic_anchors(phrases: DataFrame, topic: str, place: str, phrase: str, generic: Sequence[str] = ()) -> DataFrame:
    """topic, stem, anchors: stems that two or more phrases of a topic have, with all their forms in
    order, each followed by its other number."""
    rows = _topic_words(phrases, topic, place, phrase, generic).withColumn("stem", P.stem(F.col("word")))
    found = rows.groupBy(topic, "stem").agg(F.count_distinct(place).alias("n"), F.array_sort(F.collect_set("word")).alias("forms")).where("n >= 2")
    return found.select(topic, "stem", P.with_variants(F.col("forms")).alias("anchors"))


def topic_stems(terms: DataFrame, key: str, stop: Sequence[str], least: int = 3, length: int = 5) -> DataFrame:
    """key, stems of what fallback_terms() gives: the distinct stems of the words, `least` characters or
    more and no stop words, of a topic's own and translated phrases."""
    words = F.flatten(F.transform(F.concat("own", "foreign_terms"), T.tokens))
    kept = F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop))
    return terms.select(key, F.array_sort(T.prefix_stems(kept, length)).alias("stems"))
