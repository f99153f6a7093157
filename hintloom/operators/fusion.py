"""Fusing ranked lists, selecting diverse results, gating and mixing: the steps after retrieval."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rrf(lists: list[DataFrame], keep: int, k: int = 60) -> DataFrame:
    """(query, doc, score, rank) from lists of (query, doc, rank from 1): reciprocal-rank fusion, six places, the ``keep`` best.

    A document's score is the sum of 1 / (k + rank) over the lists. Ties go to the document seen first: in the earlier list, then at the
    lower rank there.
    """
    tagged = reduce(DataFrame.unionByName, [df.select("query", "doc", "rank", F.lit(i).alias("list")) for i, df in enumerate(lists)])
    fused = tagged.groupBy("query", "doc").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 6).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "seen.list", "seen.rank", "doc")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("query", "doc", "score", "rank")


def candidate_lists(ranked: DataFrame, *extra: str) -> DataFrame:
    """(query, candidates): the rows of each query as an array of structs in rank order, rank counted from 0. Lists are as long as the ranking's cut."""
    item = F.struct((F.col("rank") - 1).cast("int").alias("rank"), "doc", *extra)
    return ranked.groupBy("query").agg(F.array_sort(F.collect_list(item)).alias("candidates"))


def _diverse(ranks: list[int], tokens: list[list[str]], k: int, balance: float) -> list[int]:
    """The places that ``mmr`` chooses; each candidate is compared once with each choice."""
    sets = [frozenset(t) for t in tokens]
    chosen, left, near = [0], list(range(1, len(sets))), [0.0] * len(sets)
    while left and len(chosen) < k:
        last = sets[chosen[-1]]
        for i in left:
            common = len(last & sets[i])
            near[i] = max(near[i], common / (len(last) + len(sets[i]) - common) if common else 0.0)
        best = max(left, key=lambda i: (round(balance / (ranks[i] + 1) - (1 - balance) * near[i], 9), -i))
        chosen.append(best)
        left.remove(best)
    return chosen


def mmr(candidates: Column, k: int | Column, tokens: str = "tokens", balance: float = 0.7) -> Column:
    """Greedy diverse choice of ``k`` from an array of structs (rank from 0, …, token array), within a row.

    The first candidate is taken; then, ``k - 1`` times, the one with the greatest ``balance / (rank + 1) - (1 - balance) * s``, s being
    its greatest Jaccard similarity with a chosen one, the earliest on ties. Up to ``k`` candidates are returned as they are, null for
    null. ``k`` may be a column. The steps depend on one another, which higher-order functions can only state by evaluating each anew
    for every use, so the places are chosen over Arrow batches.
    """
    most = F.lit(k) if isinstance(k, int) else k

    def batch(ranks: pd.Series, sets: pd.Series, ks: pd.Series) -> pd.Series:
        return pd.Series([_diverse(list(r), list(t), int(n), balance) if r is not None and len(r) else [] for r, t, n in zip(ranks, sets, ks)], dtype=object)

    asks = F.size(candidates) > most
    places = F.pandas_udf(batch, "array<int>")(F.when(asks, candidates["rank"]), F.when(asks, candidates[tokens]), F.coalesce(most, F.lit(1)))
    return F.when(asks, F.transform(places, lambda i: F.get(candidates, i))).otherwise(candidates)


def mix_in(selected: Column, candidates: Column, success: str = "success", least: int = 1, worst_rank: int = 15) -> Column:
    """``selected`` with its last success replaced by the best-ranked other candidate, unless enough others are selected or its rank is too low.

    Both are arrays of structs (rank, doc, type, …).
    """
    others = F.size(F.filter(selected, lambda s: s["type"] != success))
    pool = F.filter(candidates, lambda c: (c["type"] != success) & ~F.exists(selected, lambda s: s["doc"] == c["doc"]) & (c["rank"] <= worst_rank))
    best = F.element_at(F.array_sort(pool), 1)
    last = F.array_max(F.transform(selected, lambda s, i: F.when(s["type"] == success, i)))
    mixed = F.transform(selected, lambda s, i: F.when(i == last, best).otherwise(s))
    return F.when((others >= least) | (F.size(pool) == 0) | last.isNull(), selected).otherwise(mixed)


def dynamic_k(similarity: Column, k: int) -> Column:
    """How many results a greatest similarity earns: all from 0.85, fewer below, at least three, two or one; these may exceed ``k``."""
    return F.when(similarity >= 0.85, k).when(similarity >= 0.7, max(3, k - 1)).when(similarity >= 0.6, max(2, k - 2)).otherwise(max(1, k - 3)).cast("int")


def gated(df: DataFrame, similarity: str, k: int, threshold: float = 0.5) -> DataFrame:
    """Adds ``skipped``, ``skip_reason`` and ``effective_k``: below the threshold nothing is retrieved; null counts as 0."""
    s = F.coalesce(F.col(similarity), F.lit(0.0))
    low = s < threshold
    reason = F.when(low, F.concat(F.lit("max_sim "), F.format_number(s, 3), F.lit(f" below {threshold}")))
    return df.withColumns({"skipped": low, "skip_reason": reason, "effective_k": F.when(low, 0).otherwise(dynamic_k(s, k)).cast("int")})


def expand_sources(ranked_sources: DataFrame, cards: DataFrame, source_col: str, card_col: str) -> DataFrame:
    """(query, card, source_rank, rank): the cards of the ranked sources, each where it is first seen, in order of source and card."""
    joined = ranked_sources.select("query", F.col("doc").alias("source"), F.col("rank").alias("source_rank")).join(cards.select(F.col(source_col).alias("source"), F.col(card_col).alias("card")), "source")
    first = joined.groupBy("query", "card").agg(F.min("source_rank").alias("source_rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("source_rank", "card")))
