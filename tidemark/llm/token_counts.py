"""Token counts with a whole-token shortcut for byte-level BPE vocabularies.

Offline, the driver proves which vocabulary strings encode alone as one token: each is spelled as
text, must be one pre-token, and must come back from the library as its own id. Inside tasks,
pre-tokens in that set count 1 without merging; only the rest goes through the library, each
distinct pre-token once per worker's cache. Files of another pre-tokenizer than byte-level's
own, or with a normaliser, are refused. A text is never cut: added tokens split it where
their string stands, as the library's default does, and count 1 each.

Scale: no shuffle. The set holds at most the vocabulary (about 50 000 short strings), which is
what bounds its broadcast."""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import texts_of

#: Pre-token pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens whose counts a worker remembers, and the characters of the longest.
CACHE, CACHE_CHARS = 400_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1
    bytes stand for themselves, the others for U+0100 onwards in order."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def added_tokens(path: str) -> list[str]:
    """Strings of the added tokens of a file, which must split texts as this module does."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    pre, added = said.get("pre_tokenizer") or {}, said.get("added_tokens", [])
    known = said.get("model", {}).get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not known or said.get("normalizer") or any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"{path} isn't a byte-level BPE with the pre-tokens that are counted here")
    return [x["content"] for x in added]


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    tok, alphabet, rx = _tokenizer(path), byte_alphabet(), regex.compile(PATTERN)
    spelled = []
    for piece in tok.get_vocab(with_added_tokens=False):
        try:
            text = bytes(alphabet[c] for c in piece).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if rx.findall(text) == [text]:
            spelled.append(text)
    encoded = tok.encode_batch(spelled, add_special_tokens=False)
    return frozenset(t for t, e in zip(spelled, encoded, strict=True) if len(e.ids) == 1)


def count_batch(texts: list[str | None], path: str, whole: frozenset[str], special: list[str], known: dict[str, int]) -> list[int]:
    """Tokens of each text (null: 0); known: pre-tokens merged so far, extended here."""
    find = regex.compile(PATTERN).findall
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    counts, rests = [], []
    for text in texts:
        parts = [text or ""]
        if cut is not None and any(s in parts[0] for s in special):
            parts = cut.split(parts[0])
        n, rest = len(parts) - 1, []
        for part in parts:
            pre = find(part)
            n += len(pre)
            rest += [p for p in pre if p not in whole]
        counts.append(n - len(rest))
        rests.append(rest)
    new = list({p for rest in rests for p in rest if p not in known})
    if len(known) + len(new) > CACHE:
        known.clear()
        new = list({p for rest in rests for p in rest})
    found = {p: len(e.ids) for p, e in zip(new, _tokenizer(path).encode_batch(new, add_special_tokens=False), strict=True)}
    known.update((p, n) for p, n in found.items() if len(p) <= CACHE_CHARS)
    return [n + sum(known[p] if p in known else found[p] for p in rest) for n, rest in zip(counts, rests, strict=True)]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit), which replace columns of
    the same names. Null and empty texts have 0 tokens; an empty table gives an empty result;
    repeated rows repeat; very long texts are counted whole. path: a byte-level BPE file of the tokenizers library, present on every
    executor."""
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(whole_tokens(path))
    special = added_tokens(path)
    known: dict[str, int] = {}

    @F.arrow_udf(LongType())
    def n_tokens(text: pa.Array) -> pa.Array:
        return pa.array([n for part in texts_of(text) for n in count_batch(part, path, whole.value, special, known)], pa.int64())

    out = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("n_tokens", n_tokens(F.col("text")))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
