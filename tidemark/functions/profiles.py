"""Stems of a profile text with the scope of its negations, and what is built of them."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import text as T

#: Letters of a stem (fixed value).
STEM = 6
#: Words that negate the next stem, and the one that negates its whole clause at its end (fixed values).
NEGATORS = ("не", "без", "ни", "no", "not", "without", "non")
NONE = "нет"
#: Stems that say nothing of a profile (fixed values).
IDLE = tuple(
    """для как нет или это что при его она они так также может быть был была были этот эта эти которы где когда чем
    более менее очень все всех уже ещё еще только над под без про через между после перед then the and for with from
    that this are was препри preprint статья статьи публик источн докуме систем технол решени примен исполь област
    направ метод подход""".split()
)
_IDLE = frozenset(IDLE)
CLAUSE_END = r'[.,;:!?()\[\]«»"—–\n]+'


_PART = re.compile(r"[a-zа-яё]+|" + CLAUSE_END)
_BREAK = "."


class _Marks(dict):
    """What a part of a text is: a break for the end of a clause, `!` for a negator, empty for a word that says
    nothing, its stem else. Worked out once for each different part."""

    def __missing__(self, part: str) -> str:
        stem = part[:STEM]
        said = "!" if part in NEGATORS or part == NONE else "" if len(part) < 3 or stem in _IDLE else stem
        self[part] = _BREAK if not part[0].isalpha() else said
        return self[part]


def _scoped(low: str, marks: _Marks) -> list[str]:
    """The scoped stems of a lower-case text in order, with a break after each clause but the last."""
    parts = _PART.findall(low)
    said = list(map(marks.__getitem__, parts))
    if "!" not in said:
        return list(filter(None, said))
    if NONE in parts:
        said = ["$" if p == NONE and said[i + 1 : i + 2] in ([], [_BREAK]) else m for i, (p, m) in enumerate(zip(parts, said))]
    said = list(filter(None, said))
    for i, m in enumerate(said):
        if m == "!" and i + 1 < len(said) and said[i + 1] not in ("!", "$", _BREAK):
            said[i + 1] = "не_" + said[i + 1]
        elif m == "$":
            while i and said[i - 1] != _BREAK:
                i -= 1
                said[i] = said[i] if said[i] == "!" or said[i].startswith("не_") else "не_" + said[i]
    return [m for m in said if m not in ("!", "$")]


def _listed(rows: list[list]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(list(chain.from_iterable(rows)), pa.string()))


@F.arrow_udf(ArrayType(ArrayType(StringType())))
def _stems_of(low: pa.Array) -> pa.Array:
    marks, out = _Marks(), []
    for t in low.to_pylist():
        clauses = [[]]
        for m in _scoped(t, marks):
            clauses.append([]) if m == _BREAK else clauses[-1].append(m)
        out.append(clauses)
    return pa.array(out, pa.list_(pa.list_(pa.string())))


@F.arrow_udf(ArrayType(StringType()))
def _features_of(low: pa.Array) -> pa.Array:
    marks, parts = _Marks(), [_listed([])]
    # a part of the texts at once: their features are many Python strings
    for i in range(0, len(low), 256):
        out = []
        for t in low[i : i + 256].to_pylist():
            stems = _scoped(t, marks)
            pairs = dict.fromkeys(zip(stems, stems[1:]))
            out.append([m for m in dict.fromkeys(stems) if m != _BREAK] + [f"{a}_{b}" for a, b in pairs if a != _BREAK and b != _BREAK])
        parts.append(_listed(out))
    return pa.concat_arrays(parts)


class _Numbers(dict):
    """The number of each stem, in the order of `names`; a break is 0."""

    def __init__(self) -> None:
        super().__init__({_BREAK: 0})
        self.names = [_BREAK]

    def __missing__(self, stem: str) -> int:
        self[stem] = len(self.names)
        self.names.append(stem)
        return self[stem]


class _Numbered(dict):
    """The number of the stem of a part of a text, or whether it is a word that says nothing or a negator."""

    SILENT, NEGATES = (1 << 62), (1 << 62) + 1

    def __init__(self, marks: _Marks, numbers: _Numbers) -> None:
        super().__init__({"": self.SILENT})
        self.marks, self.numbers = marks, numbers

    def __missing__(self, part: str) -> int:
        mark = self.marks[part]
        self[part] = self.SILENT if not mark else self.NEGATES if mark == "!" else self.numbers[mark]
        return self[part]


_BITS = 28  # of a stem's number


def numbered_features(low: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The features of lower-case texts as numbers: how many each text has, which they are, and the different
    features themselves. Strings are made of the different ones only."""
    marks, numbers = _Marks(), _Numbers()
    parts = _Numbered(marks, numbers)
    counts, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    at_once = 1 << (64 - 2 * _BITS)
    for i in range(0, len(low), at_once):
        stems = []
        for t in low[i : i + at_once].to_pylist():
            said = list(map(parts.__getitem__, _PART.findall(t)))
            stems.append(list(map(numbers.__getitem__, _scoped(t, marks))) if parts.NEGATES in said else said)
        flat = np.fromiter(chain.from_iterable(stems), np.uint64)
        row = np.repeat(np.arange(len(stems), dtype=np.uint64), list(map(len, stems)))[flat != parts.SILENT] << np.uint64(2 * _BITS)
        flat = flat[flat != parts.SILENT]
        one = row + (flat << np.uint64(_BITS))
        two = (one[:-1] + flat[1:])[(flat[:-1] > 0) & (flat[1:] > 0) & (row[:-1] == row[1:])]
        both = np.sort(np.concatenate((one[flat > 0], two)))
        both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
        counts.append(np.bincount((both >> np.uint64(2 * _BITS)).astype(np.int64), minlength=len(stems)))
        codes.append(both & np.uint64((1 << 2 * _BITS) - 1))
    if len(numbers.names) > 1 << _BITS:
        raise ValueError("too many different stems in a batch")
    different, each = np.unique(np.concatenate(codes), return_inverse=True)
    first, second = (pa.array(x.astype(np.int64)) for x in (different >> np.uint64(_BITS), different & np.uint64((1 << _BITS) - 1)))
    names = pa.array(numbers.names)
    behind = pa.array(["", *("_" + x for x in numbers.names[1:])])
    return np.concatenate(counts), each, pc.binary_join_element_wise(names.take(first), behind.take(second), "")


def clause_stems(text: Column | str) -> Column:
    """For each clause the stems of its words; a stem behind a negator, or in a clause that ends in
    `нет`, has the prefix `не_`. Short and idle words stand between a negator and its stem."""
    return _stems_of(F.lower(T.empty_if_null(text)))


def profile_features(text: Column | str) -> Column:
    """Distinct stems of a text and pairs of neighbouring stems within a clause."""
    return _features_of(F.lower(T.empty_if_null(text)))
