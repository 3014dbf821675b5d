"""Panels, scopes and periods: the named pieces that plans are built from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.expressions import clean


@dataclass(frozen=True)
class Panel:
    """A coded dimension: its column, the codes that mean "not observed", and how many categories a
    chart shows. ``fallback`` is used where the frame lacks ``column``."""

    id: str
    column: str
    excluded: tuple[str, ...] = ()
    top_n: int = 8
    label: str = ""
    fallback: str | None = None

    def resolve(self, df: DataFrame) -> str:
        if self.column not in df.columns and self.fallback in df.columns:
            return self.fallback
        return self.column

    def value(self, df: DataFrame) -> Column:
        return clean(F.col(self.resolve(df)))

    def observed(self, df: DataFrame) -> Column:
        """Not blank and not one of the excluded codes."""
        v = self.value(df)
        return (v != "") & ~v.isin(*self.excluded) if self.excluded else v != ""


@dataclass(frozen=True)
class Scope:
    """A named predicate on the corpus. Scopes overlap; they are no partition."""

    id: str
    predicate: Callable[[], Column]
    label: str = ""
    needs: tuple[str, ...] = field(default=())

    def frame(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.needs if c not in df.columns]
        if missing:
            raise ValueError(f"scope {self.id} needs columns {missing}")
        return df.where(self.predicate())


def scope_frame(df: DataFrame, scopes: dict[str, Scope], scope_id: str) -> DataFrame:
    """The rows of a scope; an unknown id is an error."""
    if scope_id not in scopes:
        raise ValueError(f"unknown scope: {scope_id}")
    return scopes[scope_id].frame(df)


def scope_bridge(df: DataFrame, scopes: dict[str, Scope], keep: list[str]) -> DataFrame:
    """One row per (scope, row of df) in a single pass over df."""
    held = [F.when(s.predicate(), F.lit(s.id)) for s in scopes.values()]
    rows = df.select(F.filter(F.array(*held), lambda x: x.isNotNull()).alias("_scopes"), *keep)
    return rows.select(F.explode("_scopes").alias("scope"), *keep)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, or an error if two rows share the keys."""
    if twice := df.groupBy(*keys).count().where("count > 1").limit(1).collect():
        raise ValueError(f"rows share {keys}: {twice[0]}")
    return df


def assert_same_ids(left: DataFrame, right: DataFrame, key: str) -> None:
    """An error unless both frames hold the same ids."""
    for a, b in ((left, right), (right, left)):
        if odd := a.select(key).join(b.select(key), key, "left_anti").limit(1).collect():
            raise ValueError(f"{key} is in one frame only: {odd[0]}")
