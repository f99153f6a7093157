"""Keyed tables: deduplication, resuming, merging, completeness, exclusion, positional joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last in order. An aggregate of the whole row, so that a key with a third of the rows is combined before the shuffle."""
    return _one(df, keys, order, F.max_by)


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _one(df, keys, order, F.min_by)


def _one(df: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def remaining(todo: DataFrame, done: DataFrame, key: str, counts: Column | None = None) -> DataFrame:
    """The rows of ``todo`` whose key isn't done; with ``counts`` only the rows of ``done`` that satisfy it count. Null keys always remain."""
    kept = done if counts is None else done.where(counts)
    return todo.join(kept.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def merged(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``old`` with ``columns`` taken from the row of ``new`` with the same key, where there is one; keys of ``new`` must be unique."""
    renamed = new.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(renamed, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def refilled(existing: DataFrame, regenerated: DataFrame, key: str, valid: Column) -> DataFrame:
    """The valid rows of ``existing`` and, for the other keys, those of ``regenerated``."""
    good = existing.where(valid)
    return good.unionByName(regenerated.join(good.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def missing_keys(needed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return needed.select(key).distinct().join(present.select(key), key, "left_anti")


def require_complete(needed: DataFrame, present: DataFrame, key: str) -> None:
    """Raises with up to ten examples if a needed key isn't present."""
    examples = [r[0] for r in missing_keys(needed, present, key).limit(10).collect()]
    if examples:
        raise ValueError(f"incomplete: missing keys such as {examples}")


def positional_join(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, pos, left, right): two arrays of a row side by side, as far as the first reaches; positions count from 0."""
    pair = F.transform(left, lambda x, i: F.struct(i.alias("pos"), x.alias(left), F.get(F.col(right), i).alias(right)))
    return df.select(key, F.inline(pair))


def repeated(df: DataFrame, n: int, column: str = "repeat_idx") -> DataFrame:
    """Every row ``n`` times, numbered from 0; no shuffle."""
    return df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn(column, F.lit(0)).limit(0)
