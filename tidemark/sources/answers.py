"""JSON answers of services: cut out of their wrapping, closed where they break off, parsed, checked."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import empty_if_null

FENCE = "```"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _unfenced(raw: Column | str) -> Column:
    t = _stripped(empty_if_null(raw))
    parts = F.split(t, FENCE)
    inner = F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(F.ltrim(t, F.lit("`")))
    led = F.regexp_replace(inner, r"(?Ui)^\s*json", "")
    return F.when(t.startswith(FENCE), led).otherwise(t)


def repaired(raw: Column | str) -> Column:
    """The object of an answer: without a code fence around it and without words before its first
    and behind its last brace. An answer without both is only stripped."""
    t = _unfenced(raw)
    start, back = F.instr(t, "{"), F.instr(F.reverse(t), "}")
    end = F.length(t) - back + 1
    return _stripped(F.when((start > 0) & (back > 0) & (end >= start), F.substring(t, start, end - start + 1)).otherwise(t))


def closed(raw: Column | str) -> Column:
    """An answer from its first brace on, with what is left open closed: a string, then brackets in
    order. Reads the characters once, with a state of the open brackets, whether a string is open and
    whether the next character is escaped. A comma or a lone key's colon at the end goes (the colon
    gets a null). Null if a bracket closes another kind than is open."""
    t = _unfenced(raw)
    t = F.when(F.instr(t, "{") > 0, F.substring(t, F.instr(t, "{"), F.length(t))).otherwise(t)

    def state(open_: Column, string: Column, escaped: Column, done: Column) -> Column:
        return F.struct(open_.alias("open"), string.alias("string"), escaped.alias("escaped"), done.alias("done"))

    def step(s: Column, c: Column) -> Column:
        opens = F.when(c == "{", F.lit("}")).otherwise(F.lit("]"))
        bad = F.left(s["open"], F.lit(1)) != c
        outside = (
            F.when(c == '"', state(s["open"], F.lit(True), F.lit(False), s["done"]))
            .when(c.isin("{", "["), state(F.concat(opens, s["open"]), F.lit(False), F.lit(False), s["done"]))
            .when(c.isin("}", "]"), state(F.when(~bad, F.substring(s["open"], 2, 1 << 30)), F.lit(False), F.lit(False), s["done"]))
            .otherwise(s)
        )
        inside = F.when(s["escaped"], state(s["open"], F.lit(True), F.lit(False), s["done"])).when(c == "\\", state(s["open"], F.lit(True), F.lit(True), s["done"])).when(c == '"', state(s["open"], F.lit(False), F.lit(False), s["done"])).otherwise(s)
        next_ = F.when(s["string"], inside).otherwise(outside)
        # behind the last bracket nothing counts; done holds how many characters were read by then
        ended = (s["open"] == "") & (s["done"] > 0)
        return F.when(s["open"].isNull() | ended, s).otherwise(next_.withField("done", s["done"] + 1))

    first = state(F.lit(""), F.lit(False), F.lit(False), F.lit(0))
    end = F.aggregate(F.split(t, ""), first, step)

    def finish(e: Column) -> Column:
        head = F.left(t, e["done"])
        head = F.when(e["escaped"], F.left(head, F.length(head) - 1)).otherwise(head)
        body = F.regexp_replace(F.concat(head, F.when(e["string"], '"').otherwise("")), r"\s+$", "")
        body = F.when(e["open"] == "", body).otherwise(F.regexp_replace(F.regexp_replace(body, r",$", ""), r":$", ": null"))
        return F.concat(body, e["open"])

    return F.element_at(F.transform(F.array(end), finish), 1)


def parsed(json: Column) -> Column:
    """A struct of value (variant; null unless it is an object) and status: OK, NOT_JSON or NOT_OBJECT."""
    v = F.try_parse_json(json)
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    status = F.when(v.isNull(), "NOT_JSON").when(is_object, "OK").otherwise("NOT_OBJECT")
    return F.struct(F.when(is_object, v).alias("value"), status.alias("status"))


def problems(value: Column, fields: Mapping[str, str]) -> Column:
    """What is wrong with a parsed object: `name: missing` or `name: not <type>` for each of fields
    (name to SQL type), in order. A null object has no field."""
    said = []
    for name, kind in fields.items():
        raw = F.try_variant_get(value, f"$.{name}", "variant")
        fits = F.schema_of_variant(raw) == {"bigint": "BIGINT", "string": "STRING", "boolean": "BOOLEAN"}.get(kind, kind.upper())
        said.append(F.when(raw.isNull(), f"{name}: missing").when(~fits, f"{name}: not {kind}"))
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def json_safe(numbers: Column) -> Column:
    """A map of doubles whose entries that JSON can't hold (NaN, infinities) are null."""
    return F.transform_values(numbers, lambda k, v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))


def kept_metadata(meta: Column, allowed: list[str], most_bytes: int = 8192, each: int = 512) -> Column:
    """The allowed keys of a map of strings in order, values of at most `each` characters; the longest
    entries go while all of them together as JSON take more than `most_bytes` (ties: the first key)."""
    names = F.array(*map(F.lit, sorted(allowed)))
    entries = F.map_entries(F.map_filter(meta, lambda k, v: F.array_contains(names, k)))
    entries = F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.left(e["value"], F.lit(each)).alias("value"))))

    def size(e: Column) -> Column:  # "key": "value", with the separator
        return F.octet_length(F.to_json(F.map_from_entries(F.array(e)))) + 1

    by_size = F.array_sort(F.transform(entries, lambda e: F.struct(size(e).alias("n"), F.struct(e["key"].alias("key"), e["value"].alias("value")).alias("e"))), lambda a, b: F.when(a["n"] != b["n"], a["n"] - b["n"]).when(a["e"]["key"] > b["e"]["key"], F.lit(-1)).when(a["e"]["key"] < b["e"]["key"], F.lit(1)).otherwise(F.lit(0)))
    # smallest first: an entry stays while it and all smaller ones fit
    kept = F.aggregate(
        by_size,
        F.struct(F.lit(1).alias("n"), F.array().cast("array<struct<key:string,value:string>>").alias("kept")),
        lambda s, x: F.when(s["n"] + x["n"] <= most_bytes, F.struct((s["n"] + x["n"]).alias("n"), F.concat(s["kept"], F.array(x["e"])).alias("kept"))).otherwise(s.withField("n", F.lit(most_bytes))),
        lambda s: F.array_sort(s["kept"]),
    )
    return F.map_from_entries(kept)
