"""Joined sets of relations: required ones joined on all shared variables, optional ones left-joined in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import row_key


class RuleError(ValueError):
    """A rule or relation that can't be used."""


@dataclass(frozen=True)
class Relation:
    """Rows with one string column per variable (their primary key) and optionally `data`, an array of (id, stamp)."""

    name: str
    df: DataFrame
    vars: tuple[str, ...]

    def __post_init__(self) -> None:
        missing = [v for v in self.vars if v not in self.df.columns]
        extra = [c for c in self.df.columns if c not in (*self.vars, "data", "is_list")]
        if missing or extra:
            raise RuleError(f"relation '{self.name}': variables {list(self.vars)}, but columns {self.df.columns}")

    @property
    def data(self) -> str:
        return f"{self.name}_data"

    def side(self) -> DataFrame:
        keys = [F.col(v).cast("string").alias(v) for v in self.vars]
        own = [F.col("data").alias(self.data)] if "data" in self.df.columns else []
        return self.df.select(*keys, *own, F.lit(True).alias(f"{self.name}_found"))


def union_vars(relations: list[Relation]) -> list[str]:
    """All variables, in order of first occurrence over the relations as declared."""
    return list(dict.fromkeys(v for r in relations for v in r.vars))


def _split(relations: list[Relation], required: list[str] | None) -> tuple[list[Relation], list[Relation]]:
    names = [r.name for r in relations]
    if not relations:
        raise RuleError("a rule needs a relation")
    if len(set(names)) < len(names):
        raise RuleError("a rule has two relations of one name")
    if len({id(r.df) for r in relations}) < len(relations):
        raise RuleError("a rule has one relation twice")
    if required is not None and (not required or any(n not in names for n in required)):
        raise RuleError(f"required must name some of {names}")
    need = set(names if required is None else required)
    return [r for r in relations if r.name in need], [r for r in relations if r.name not in need]


def join_order(relations: list[Relation]) -> list[Relation]:
    """Required relations so that each shares a variable with those before it, if any does."""
    order, rest = [relations[0]], list(relations[1:])
    while rest:
        bound = set(union_vars(order))
        order.append(next((r for r in rest if bound & set(r.vars)), rest[0]))
        rest.remove(order[-1])
    return order


def joined_sets(relations: list[Relation], required: list[str] | None = None) -> DataFrame:
    """One lazy plan with a column per variable and `<name>_data` per relation.

    Required relations: inner joins on every shared variable, wherever the relations stand in the list; relations that
    nothing connects make a product. Optional ones: left joins in declared order on the variables bound by required or
    earlier optional ones, or ON TRUE; NULL equals nothing."""
    must, may = _split(relations, required)
    out, bound = None, []
    for r in join_order(must):
        side = r.side().drop(f"{r.name}_found")
        if out is None:
            out = side
        else:
            shared = [v for v in r.vars if v in bound]
            out = out.join(side, shared, "inner") if shared else out.crossJoin(side)
        bound += [v for v in r.vars if v not in bound]
    assert out is not None
    for r in may:
        out = left_step(out, r, bound)
        bound += [v for v in r.vars if v not in bound]
    return out.select(*union_vars(relations), *(r.data for r in relations if r.data in out.columns))


def left_step(left: DataFrame, r: Relation, bound: list[str]) -> DataFrame:
    return _left(left, r.side().drop(f"{r.name}_found"), [v for v in r.vars if v in bound])


def _left(left: DataFrame, side: DataFrame, shared: list[str]) -> DataFrame:
    renamed = side.select(*(F.col(v).alias(f"__{v}") if v in shared else F.col(v) for v in side.columns))
    on: Column = F.lit(True)
    for v in shared:
        on = on & (left[v] == renamed[f"__{v}"])
    return left.join(renamed, on, "left").drop(*(f"__{v}" for v in shared))


SETS, ROWS = "sets#", "rows#"  # columns of numbers, beside any variables


def set_counts(relations: list[Relation], by: list[str], required: list[str] | None = None) -> DataFrame:
    """`n_sets`: how many joined sets have these values of the variables `by`, without deriving the sets.

    The same as joined_sets(relations, required).groupBy(*by).count(), but a variable is dropped as soon as neither `by` nor a later join
    needs it, and rows that then agree are added up. So independent relations multiply numbers, not rows: a required one multiplies by its
    number of matches, an optional one by that or 1. In ANSI mode, Spark's default, 2^63 sets of one group are an error."""
    must, may = _split(relations, required)
    if any(v not in union_vars(relations) for v in by):
        raise RuleError(f"sets are counted by some of {union_vars(relations)}, not by {by}")
    order = join_order(must) + may
    out, bound = None, []
    for i, r in enumerate(order):
        later = {*by, *union_vars(order[i + 1 :])}
        side = _folded(r.side().select(*r.vars, F.lit(1).cast("long").alias(ROWS)), [v for v in r.vars if v in bound or v in later], ROWS)
        if out is None:
            out = side.withColumnRenamed(ROWS, SETS)
        else:
            shared = [v for v in r.vars if v in bound]
            if r in may:
                out = _left(out, side, shared)
            else:
                out = out.join(side, shared, "inner") if shared else out.crossJoin(side)
            out = out.withColumn(SETS, F.col(SETS) * F.coalesce(ROWS, F.lit(1))).drop(ROWS)
        bound = [v for v in dict.fromkeys((*bound, *r.vars)) if v in later]
        if i < len(order) - 1:
            out = _folded(out, bound, SETS)
    assert out is not None
    return out.groupBy(*by).agg(F.coalesce(F.sum(SETS), F.lit(0)).alias("n_sets"))


def _folded(df: DataFrame, names: list[str], number: str) -> DataFrame:
    """One row per value of these columns, with the sum of the number; as it is if they are all columns but the number."""
    if names and {*df.columns} == {*names, number}:
        return df
    return df.groupBy(*names).agg(F.sum(number).alias(number)).where(F.col(number) > 0)


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.crossJoin(b)


def _only(df: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """Rows of df that agree with some key on these columns; NULL agrees with nothing."""
    k = keys.select(*(F.col(v).cast("string").alias(f"__{v}") for v in names)).distinct()
    on: Column = F.lit(True)
    for v in names:
        on = on & (df[v].cast("string") == k[f"__{v}"])
    return df.join(k, on, "left_semi")


def touched_sets(relations: list[Relation], changed: dict[str, DataFrame], required: list[str] | None = None) -> DataFrame:
    """The joined sets, with their data, that rows with these keys can be part of, before or after a change.

    Whether a set is touched depends on its variables only, so the touched sets of the old and the new relations differ by just what
    the change did. Required relations are restricted by a semi-join on the changed keys before the join: a changed required
    one on its own variables, for a changed optional one all that have some of the variables it is joined on. An optional relation
    that shares no variable, and any without variables, touches every set."""
    must, may = _split(relations, required)
    parts = []
    for r in relations:
        if r.name not in changed:
            continue
        bound = union_vars(must) + [v for x in may[: may.index(r)] for v in x.vars] if r in may else list(r.vars)
        shared = [v for v in r.vars if v in bound]
        if not shared:
            return joined_sets(relations, required)
        keys, rows = changed[r.name], []
        for x in relations:
            own = [v for v in x.vars if v in shared] if x in must else []
            rows.append(Relation(x.name, _only(x.df, keys, own), x.vars) if own else x)
        parts.append(_only(joined_sets(rows, required), keys, shared))
    if not parts:
        return joined_sets(relations, required).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct() if len(parts) > 1 else out


def delta_sets(relations: list[Relation], changed: dict[str, DataFrame], required: list[str] | None = None) -> DataFrame:
    """Keys of the joined sets that rows with these keys, before or after a change, can be part of."""
    return touched_sets(relations, changed, required).select(*union_vars(relations)).distinct()


def diff_sets(old: DataFrame, new: DataFrame, keys: list[str], data: list[str]) -> DataFrame:
    """Per set key: added, removed, changed (other members) or same."""
    k = row_key(*(F.col(c) for c in keys)).alias("set_key")
    members = F.struct(*(F.col(c) for c in data)) if data else F.lit(1)
    a = old.select(k, members.alias("was"), F.lit(True).alias("in_old"))
    b = new.select(k, members.alias("now"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return a.join(b, "set_key", "full_outer").select("set_key", change.alias("change"))
