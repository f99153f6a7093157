"""Repeatable samples, splits and resampling that don't depend on partitions or order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_key(seed: str, *columns: str) -> Column:
    """A pseudo-random order that the seed and the columns determine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def seeded_sample(items: DataFrame, item_col: str, queries: DataFrame, query_col: str, k: int, seed: str) -> DataFrame:
    """(query, item, rank): ``k`` items per query, drawn by a hash that query and seed determine. The items are read once; a batch passes on ``k`` per query."""
    names = [r[0] for r in queries.select(F.col(query_col).cast("string")).distinct().collect()]
    starts = np.array([int.from_bytes(hashlib.md5(f"{seed}|{n}".encode()).digest()[:8], "little") for n in names], np.uint64)
    shared = items.sparkSession.sparkContext.broadcast((names, starts))
    base = items.select(F.col(item_col).alias("item"), F.xxhash64(F.col(item_col)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts = shared.value
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            for name, start in zip(names, starts):
                x = (h ^ start) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                i = np.argsort(x >> np.uint64(1), kind="stable")[:k]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), batch.column("item").take(pa.array(i)), pa.array((x[i] >> np.uint64(1)).astype(np.int64))], ["query", "item", "key"])

    found = base.mapInArrow(run, f"query string, item {base.schema['item'].dataType.simpleString()}, key bigint")
    order = Window.partitionBy("query").orderBy("key", "item")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "item", "rank")


def allocation(sizes: dict[str, int], total: int) -> dict[str, int]:
    """How many of ``total`` each stratum gives: its rounded share, at least one, never more than it has; the largest settle the difference."""
    there = sum(sizes.values())
    target = {k: min(n, max(1, round(total * n / there))) for k, n in sizes.items() if n} if there else {}
    order = sorted(target, key=lambda k: (-sizes[k], k))
    while target and sum(target.values()) > total and any(v > 1 for v in target.values()):
        key = max((k for k in order if target[k] > 1), key=lambda k: (target[k], k))
        target[key] -= 1
    while target and sum(target.values()) < min(total, there):
        key = max((k for k in order if target[k] < sizes[k]), key=lambda k: (sizes[k] - target[k], k))
        target[key] += 1
    return target


def stratified_holdout(df: DataFrame, key_col: str, stratum_col: str, total: int, seed: str = "42") -> DataFrame:
    """``df`` with ``split``: "holdout" for about ``total`` keys drawn per stratum in proportion, "train" for the rest, null without a stratum.

    Keys must be unique. The strata are counted first; their number must be small, which is checked.
    """
    counts = df.where(F.col(stratum_col).isNotNull()).groupBy(F.col(stratum_col).alias("s")).count().limit(10_001).collect()
    if len(counts) > 10_000:
        raise ValueError("too many strata")
    target = allocation({r["s"]: r["count"] for r in counts}, total)
    table = df.sparkSession.createDataFrame(sorted(target.items()), f"{stratum_col} string, _target int")
    place = F.row_number().over(Window.partitionBy(stratum_col).orderBy(order_key(seed, key_col), key_col))
    inside = df.where(F.col(stratum_col).isNotNull()).withColumn("_place", place).join(F.broadcast(table), stratum_col)
    split = inside.withColumn("split", F.when(F.col("_place") <= F.col("_target"), "holdout").otherwise("train")).drop("_place", "_target")
    return split.select(*df.columns, "split").union(df.where(F.col(stratum_col).isNull()).select(*df.columns, F.lit(None).cast("string").alias("split")))


def bootstrap_mean(df: DataFrame, group_col: str, value_col: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """(group, n, mean, low, high): the 2.5 and 97.5 percentiles of the mean of resamples, six places.

    Resampling n values with replacement draws multinomial counts of the distinct values, so each group is first reduced to its value
    counts; values are rounded to six places, and a group of more than a million different ones is refused.
    """
    counted = df.where(F.col(value_col).isNotNull()).groupBy(F.col(group_col).alias("group"), F.round(F.col(value_col).cast("double"), 6).alias("value")).agg(F.count("*").alias("n"))

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("value")
        if len(frame) > 1_000_000:
            raise ValueError("too many different values to resample")
        values, n = frame["value"].to_numpy(), frame["n"].to_numpy()
        rnd = np.random.default_rng(seed)
        size, means = int(n.sum()), []
        step = max(1, 2_000_000 // len(values))
        for start in range(0, resamples, step):
            means.append(rnd.multinomial(size, n / size, min(step, resamples - start)) @ values / size)
        low, high = np.percentile(np.concatenate(means), [2.5, 97.5])
        return pd.DataFrame({"group": frame["group"].iloc[:1], "n": [size], "mean": [round(float(values @ n / size), 6)], "low": [round(float(low), 6)], "high": [round(float(high), 6)]})

    kind = counted.schema["group"].dataType.simpleString()
    return counted.groupBy("group").applyInPandas(draw, f"group {kind}, n bigint, mean double, low double, high double")
