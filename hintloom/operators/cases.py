"""Test cases and verdicts as columns: adapting origins, pairing inputs with outputs, choosing and describing cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintloom.functions.text import filled, shorten, strip


def adapt(origins: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """One frame of several origins: each gives its own columns by name, what an origin lacks is null, ``origin`` names it."""
    made = [df.select(F.lit(name).alias("origin"), *[c.alias(k) for k, c in columns.items()]) for name, (df, columns) in origins.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)


def paired(inputs: Column, outputs: Column) -> Column:
    """array<struct(input, output)> as long as the shorter array; empty if either is null."""
    n = F.least(F.size(inputs), F.size(outputs))
    pairs = F.zip_with(F.slice(inputs, 1, n), F.slice(outputs, 1, n), lambda i, o: F.struct(i.alias("input"), o.alias("output")))
    return F.when(inputs.isNotNull() & outputs.isNotNull(), pairs).otherwise(F.array().cast("array<struct<input:string,output:string>>"))


def chosen_cases(kind: Column, tests: Column, public: Column, generated: Column, private: Column, with_private: bool = True) -> Column:
    """The cases of a problem by its kind: its own tests, or public, generated and perhaps private ones one after another; null ones count as none."""
    none = F.array().cast("array<struct<input:string,output:string>>")
    parts = [F.coalesce(c, none) for c in (public, generated, *([private] if with_private else []))]
    return F.when(kind == "tests", F.coalesce(tests, none)).otherwise(F.concat(*parts))


def as_arguments(value: Column) -> Column:
    """JSON text of a list of arguments: a JSON list as it is, any other value as the only element; '[]' for null."""
    v = strip(value)
    return F.when(v.isNull() | (v == ""), F.lit("[]")).when(F.startswith(v, F.lit("[")), v).otherwise(F.concat(F.lit("["), v, F.lit("]")))


def wants_function(mode: Column, fn_name: Column, cases: Column) -> Column:
    """Whether cases call a function: the mode says so, or a function is named and the first input is a JSON list."""
    first = F.try_element_at(cases, F.lit(1))["input"]
    return F.coalesce((mode == "function") | (filled(fn_name).isNotNull() & strip(first).rlike(r"(?s)^\[.*\]$")), F.lit(False))


def seconds(whole: Column, nanos: Column) -> Column:
    return F.coalesce(whole, F.lit(0)) + F.coalesce(nanos, F.lit(0)) / F.lit(1e9)


def verdict_detail(compile_error: Column, detail: Column, error: Column) -> Column:
    """The filled parts under their labels, null without any."""
    parts = [F.when(filled(c).isNotNull(), F.concat(F.lit(f"[{label}]\n"), c)) for label, c in (("compile_error", compile_error), ("detail", detail), ("error", error))]
    return filled(F.concat_ws("\n", *parts))


def counted_summary(status: Column, counts: Column, limit: int = 1200) -> Column:
    """A verdict with the counts (map of status to number) of its case statuses in order of name, shortened."""
    listed = F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return shorten(F.concat(F.lit("verdict: "), status, F.lit("; cases: "), F.array_join(listed, ", ")), limit)


def verdict_summary(status: Column, statuses: Column, limit: int = 1200) -> Column:
    """``counted_summary`` of an array of case statuses."""
    names = F.array_distinct(statuses)
    return counted_summary(status, F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter(statuses, lambda s: s == n)))), limit)


def ordered_statuses(df: DataFrame, status: str, first: tuple[str, ...] = ("AC", "WA", "TLE", "RE", "CE")) -> DataFrame:
    """``df`` with ``place``: statuses in the usual order, the others after them by name."""
    at = F.array_position(F.array(*[F.lit(s) for s in first]), F.col(status))
    return df.withColumn("place", F.struct(F.when(at > 0, at).otherwise(len(first) + 1).alias("at"), F.col(status).alias("name")))
