"""Thresholds of several rules at once: every combination, the best one, and step-wise relaxation.

A row counts only by the cell of thresholds that its values pass, so one pass over the rows gives a
small table of cells. Everything else works on cells: running sums along each rule give the counts of
all combinations, and relaxation moves over the cells that are left."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(rows: DataFrame, rules: Mapping[str, tuple[Column, Sequence[float]]], label: str) -> DataFrame:
    """c_<rule> of each rule, pos and neg: rows by how many of the rule's thresholds (ascending) their
    value reaches. A null value reaches none; null labels don't count."""
    reached = [sum(((F.coalesce(value, F.lit(float("-inf"))) >= t).cast("int") for t in levels), F.lit(0)).alias(f"c_{name}") for name, (value, levels) in rules.items()]
    known = rows.where(F.col(label).isNotNull()).select(*reached, F.col(label).cast("int").alias("y"))
    return known.groupBy(*[f"c_{name}" for name in rules]).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def lattice(rows: DataFrame, rules: Mapping[str, tuple[Column, Sequence[float]]], label: str) -> DataFrame:
    """t_<rule> of each rule (its threshold; a row is cut if any value reaches its rule's threshold),
    cut_pos, cut_neg, all_pos, all_neg: one row for each combination. Rows are read once; the
    lattice has the product of the numbers of thresholds plus one, whatever the rows."""
    spark = rows.sparkSession
    counted = cells(rows, rules, label)
    full = None
    for name, (_, levels) in rules.items():
        axis = spark.range(len(levels) + 1).select(F.col("id").cast("int").alias(f"c_{name}"))
        full = axis if full is None else full.crossJoin(F.broadcast(axis))
    names = [f"c_{name}" for name in rules]
    grid = full.join(counted, names, "left").fillna(0, ["pos", "neg"])
    # rows with at most c thresholds reached along every rule are what the next threshold of each keeps
    for name in names:
        before = Window.partitionBy(*[n for n in names if n != name]).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
        grid = grid.withColumns({"pos": F.sum("pos").over(before), "neg": F.sum("neg").over(before)})
    top = F.lit(True)
    inside = F.lit(True)
    for name, (_, levels) in rules.items():
        top &= F.col(f"c_{name}") == len(levels)
        inside &= F.col(f"c_{name}") < len(levels)
    total = grid.where(top).select(F.col("pos").alias("all_pos"), F.col("neg").alias("all_neg"))
    shown = [F.element_at(F.array(*map(F.lit, map(float, levels))), F.col(f"c_{name}") + 1).alias(f"t_{name}") for name, (_, levels) in rules.items()]
    out = grid.where(inside).crossJoin(F.broadcast(total))
    return out.select(*shown, (F.col("all_pos") - F.col("pos")).alias("cut_pos"), (F.col("all_neg") - F.col("neg")).alias("cut_neg"), "all_pos", "all_neg")


def best(combinations: DataFrame, rules: Sequence[str], most_share: float) -> DataFrame:
    """The row of a lattice that cuts most rows of label 0 while it cuts at most `most_share` of those
    of label 1; ties by fewer of these, then by higher thresholds in the order of rules. No row if
    none keeps the share."""
    fair = combinations.where(F.col("cut_pos") <= most_share * F.col("all_pos"))
    return fair.orderBy(F.col("cut_neg").desc(), "cut_pos", *[F.col(f"t_{r}").desc() for r in rules]).limit(1)


@dataclass(frozen=True)
class Rule:
    """A rule that fires where `value` is at least its threshold, which moves up by `step`, to `most` at
    the furthest."""

    name: str
    value: Column
    start: float
    step: float
    most: float = float("inf")

    def level(self, moves: int) -> float:
        return min(round(self.start + moves * self.step, 9), self.most)


def relax(rows: DataFrame, rules: Sequence[Rule], most_share: float, steps: int = 40) -> list[dict]:
    """Raises the threshold of the rule that cuts most rows until at most `most_share` of them are cut,
    or `steps` moves are made: one entry a move (cut, share, by: rows by the first rule that fires,
    and the thresholds). Ties go to the earlier rule.

    A row counts by how many moves each rule takes to let it go, so the rows are read once and the
    moves work on at most (steps + 2) ** rules counts, however many rows there are."""

    def needed(r: Rule) -> Column:
        at = F.array(*[F.lit(r.level(k)) for k in range(steps + 1)])
        return F.size(F.filter(at, lambda t: F.coalesce(r.value, F.lit(float("-inf"))) >= t)).alias(r.name)

    need = [needed(r) for r in rules]
    counted = [tuple(x) for x in rows.select(*need).groupBy(*[r.name for r in rules]).count().collect()]
    total = sum(c[-1] for c in counted)
    moves = [0] * len(rules)
    out = []
    for _ in range(steps + 1):
        by = dict.fromkeys((r.name for r in rules), 0)
        for *of, n in counted:
            first = next((i for i, k in enumerate(of) if k > moves[i]), None)
            if first is not None:
                by[rules[first].name] += n
        cut = sum(by.values())
        out.append({"cut": cut, "share": cut / total if total else 0.0, "by": by, "thresholds": {r.name: r.level(m) for r, m in zip(rules, moves, strict=True)}})
        if not total or cut / total <= most_share:
            break
        moves[max(range(len(rules)), key=lambda i: (by[rules[i].name], -i))] += 1
    return out[: steps + 1]
