"""Language identification by hierarchical discrimination.

Level one predicts the language family with one linear machine for each family; level two
separates the languages of that family with one linear support vector machine for each pair.
Features are hashed counts of 1- to 3-grams of letters in the whole lower-cased text.

Scale: training uses a bounded sample of every language (`sample_rows` in all, but no fewer than
`least_rows` of each, chosen by a hash of doc_id and text), whose feature vectors, not texts, come to
the driver. Prediction is one pass inside tasks, without a shuffle; the model that travels with it
has dims * (families + pairs) numbers."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import linear_svm
from .common import at_most, code_points, fresh, held_out, texts_of, thinned

UNKNOWN = "und"
DIMS = 4096

#: Languages by family (fixed values). A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne", "pa", "gu"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "semitic": ("ar", "he", "am", "mt"),
    "celtic": ("ga", "gd", "cy", "br"),
    "austronesian": ("id", "ms", "tl", "jv"),
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of the square roots of hashed n-gram counts, None for a text without a
    letter. Runs of anything but letters count as one blank."""
    if not text:
        return None
    c = code_points(text.lower())
    is_letter = _letters()[c]
    if not is_letter.any():
        return None
    c = np.where(is_letter, c, np.uint32(32))
    c = c[is_letter | np.concatenate(([False], is_letter[:-1]))]
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    shift = np.uint32(32 - 12)
    g1 = c * np.uint32(2654435761)
    g2 = (g1[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    g3 = (g2[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    n = np.bincount(np.concatenate([g1, g2, g3]) >> shift, minlength=DIMS)
    v = np.sqrt(n).astype(np.float32)
    return v / np.linalg.norm(v)


@dataclass
class Model:
    """families: name to languages. family_w: [dims + 1, families]. pair_w: for each family the
    pairs (i, j) of its languages and weights [dims + 1, pairs]; a positive margin votes for i."""

    families: dict[str, list[str]] = field(default_factory=dict)
    family_w: np.ndarray | None = None
    pair_w: dict[str, tuple[list[tuple[int, int]], np.ndarray]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of x; the score is the family's share times the mean
        confidence of the pairs that the language takes part in."""
        names = list(self.families)
        if not names:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        if len(names) == 1:
            share = np.ones((len(x), 1))
        else:
            p = linear_svm.sigmoid(4 * (x @ self.family_w[:-1] + self.family_w[-1]))
            share = p / p.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        langs, score = np.empty(len(x), object), share[np.arange(len(x)), best].astype(np.float64)
        for f, name in enumerate(names):
            rows, members = np.flatnonzero(best == f), self.families[name]
            if not len(rows):
                continue
            if len(members) == 1:
                langs[rows] = members[0]
                continue
            pairs, w = self.pair_w[name]
            p = linear_svm.sigmoid(4 * (x[rows] @ w[:-1] + w[-1]))
            votes, trust = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for k, (i, j) in enumerate(pairs):
                votes[:, i] += p[:, k] > 0.5
                votes[:, j] += p[:, k] <= 0.5
                trust[:, i] += p[:, k] / (len(members) - 1)
                trust[:, j] += (1 - p[:, k]) / (len(members) - 1)
            won = (votes + 0.5 * trust).argmax(axis=1)  # equal votes: the surer one
            langs[rows] = np.array(members, object)[won]
            score[rows] *= trust[np.arange(len(rows)), won]
        return list(langs), score


def fit(x: np.ndarray, lang: np.ndarray, c: float = 2.0) -> Model:
    """Model of a bounded sample: x (rows, dims) and the language of each row."""
    model = Model()
    for name in sorted(set(lang.tolist())):
        model.families.setdefault(family_of(name), []).append(name)
    family = np.array([family_of(v) for v in lang.tolist()], object)
    if len(model.families) > 1:
        model.family_w = np.column_stack([linear_svm.fit(x, np.where(family == f, 1, -1), c) for f in model.families])
    for f, members in model.families.items():
        pairs = [(i, j) for i in range(len(members)) for j in range(i + 1, len(members))]
        if pairs:
            weights = []
            for i, j in pairs:
                on = (lang == members[i]) | (lang == members[j])
                weights.append(linear_svm.fit(x[on], np.where(lang[on] == members[i], 1, -1), c))
            model.pair_w[f] = (pairs, np.column_stack(weights))
    return model


def train(docs: DataFrame, sample_rows: int = 2000, least_rows: int = 10) -> Model:
    """Model learnt from docs (doc_id, text, lang), held-out rows and null lang left out. At most
    sample_rows rows are used, an equal share for each value of lang; if that is below least_rows,
    so many of each. Rows of equal doc_id, text and lang count once. Very long texts are taken whole;
    an empty table gives a model without languages."""
    known = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("h")).where(F.col("lang").isNotNull() & ~held_out())
    key = ["lang", "doc_id", "h"]

    @F.arrow_udf(BinaryType())
    def vector(text: pa.Array) -> pa.Array:
        found = (features(t) for part in texts_of(text) for t in part)
        return pa.array([None if v is None else v.astype(np.float16).tobytes() for v in found], pa.binary())

    sample, most = thinned(known, "lang", key[1:], sample_rows, least_rows)
    sample = sample.select(*key, vector(F.col("text")).alias("v"))
    rows = at_most(sample.where("v IS NOT NULL"), key, most).select(*key, "v").toArrow().sort_by([(c, "ascending") for c in key])
    if not rows.num_rows:
        return Model()
    x = np.frombuffer(b"".join(rows["v"].to_pylist()), np.float16).reshape(-1, DIMS).astype(np.float32)
    return fit(x, np.array(rows["lang"].to_pylist(), object))


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score under `names`, which replace columns of
    those names.

    Texts that are null or have no letter get `und` and score 0; so do all texts if the model
    has seen no language. Rows are judged one by one, so repeated rows repeat; only the text counts,
    and very long ones are taken whole. An empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        langs, scores = [UNKNOWN] * len(text), np.zeros(len(text))
        at = 0
        for part in texts_of(text):
            found = [features(t) for t in part]
            rows = [at + i for i, v in enumerate(found) if v is not None]
            at += len(part)
            if rows:
                won, scores[rows] = sent.value.predict(np.stack([v for v in found if v is not None]))
                for i, lang in zip(rows, won, strict=True):
                    langs[i] = lang
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    (said,) = fresh(docs, "said")
    out = docs.withColumn(said, predict(F.col("text")))
    return out.withColumn(names[0], F.col(f"{said}.lang")).withColumn(names[1], F.col(f"{said}.score")).drop(said)


def keep_identified(docs: DataFrame, model: Model, languages: list[str] | None = None) -> DataFrame:
    """Rows of docs whose text has a language (one of `languages`, if given), with its columns.
    A model that has seen no language tells texts with a letter from those without one. Nulls, long
    texts, repeated rows and empty tables as in identify()."""
    lang, score = fresh(docs, "lang_pred", "lang_score")
    kept = F.col(lang) != UNKNOWN if model.families else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if languages is not None:
        kept &= F.col(lang).isin(languages)
    return identify(docs, model, (lang, score)).where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
