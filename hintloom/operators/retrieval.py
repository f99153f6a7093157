"""The strategies of retrieval as a whole: searches, fusion, gate, number of results, diversity, mixing, and what happened on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hintloom.functions.text import similarity_tokens
from hintloom.lineage import cut
from hintloom.operators import dense, fusion, lexical

STRATEGIES = ("bm25", "embed", "hybrid", "hybrid_v2", "twostage")
#: The steps of a selection unroll up to so many results.
MOST_RESULTS = 50


class Library:
    """Cards to retrieve: ``cards`` has (card, text, type), ids unique, ``vectors`` (card, vector) of cards or, for two stages, of their sources.

    ``sources`` (source, card) names the cards of each source question, for two stages.
    """

    def __init__(self, cards: DataFrame, vectors: DataFrame, sources: DataFrame | None = None):
        self.cards, self.vectors, self.sources = cards, vectors, sources


def _near(library: Library, queries: DataFrame, k: int) -> DataFrame:
    return dense.dense_top_k(library.vectors, library.vectors.columns[0], library.vectors.columns[1], queries.where("vector is not null"), "query", "vector", k).withColumnRenamed("vec", "doc")


def _lexical(library: Library, queries: DataFrame, k: int) -> DataFrame:
    return lexical.bm25_top_k(library.cards, "card", "text", queries, "query", "text", k, weighting="distinct", tokenizer="code")


def _reasons(df: DataFrame, threshold: float, strategy: str) -> Column:
    """Why a query gets nothing, null if it gets something."""
    low = F.concat(F.lit("below_threshold ("), F.format_string("%.3f", "max_sim"), F.lit(f" < {threshold})"))
    if strategy == "twostage":
        return F.when(~F.col("has_vector"), "no_q_vec").when(F.col("n_candidates") == 0, "no_source_match").when(F.col("max_sim") < threshold, low)
    if strategy == "hybrid_v2":
        return F.when(F.col("max_sim") < threshold, low).when(F.col("n_candidates") == 0, "no_candidates")
    return F.when(F.col("n_candidates") == 0, "no_candidates")


def retrieve(
    library: Library, queries: DataFrame, strategy: str = "hybrid", k: int = 5, threshold: float = 0.5, use_dynamic_k: bool = True,
    lexical_candidates: int = 50, dense_candidates: int = 50, top_sources: int = 20, rrf_k: int = 60, balance: float = 0.7, mix: bool = True, worst_rank: int = 15,
) -> DataFrame:
    """(query, meta, cards) of queries (query, text, vector): one row per query.

    ``cards`` is an array of (rank among the candidates from 0, doc, type) in the order they were selected. ``meta`` has strategy,
    max_sim, effective_k, n_candidates, skipped, skip_reason and n_selected.

    "bm25", "embed" and "hybrid" take the candidates of the searches, fused by reciprocal ranks if there are two, select ``k`` of them for
    diversity and mix in a failure. "hybrid_v2" retrieves nothing where the greatest similarity is below ``threshold`` and fewer results
    where it is low; without a vector it is 0. "twostage" searches the source questions by vector, takes their cards in that order, gates
    and limits them likewise, and ranks them by BM25 with the query, ties in the order of the first stage.

    Queries must be few enough for the searches; their number of candidates is bounded by these, or by the cards of ``top_sources``
    sources. Null texts and vectors find nothing; cards without type count as failures.
    """
    if strategy not in STRATEGIES or not 1 <= k <= MOST_RESULTS:
        raise ValueError(f"strategy must be one of {STRATEGIES}, and k at most {MOST_RESULTS}")
    asked = queries.select(F.col("query").cast("string").alias("query"), "text", "vector")
    gated = strategy in ("hybrid_v2", "twostage")
    best = None
    if strategy == "twostage":
        near = _near(library, asked, top_sources)
        best = near.join(library.sources.select(F.col("source").alias("doc")).distinct(), "doc", "left_semi").groupBy("query").agg(F.max("score").alias("max_sim"))
        found = fusion.expand_sources(near, library.sources, "source", "card").withColumnsRenamed({"card": "doc", "rank": "stage"})
        scored = lexical.bm25_scores(library.cards, "card", "text", asked, "query", "text", found, weighting="distinct", tokenizer="code")
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "stage"))).select("query", "doc", "rank")
    else:
        lists = []
        if strategy != "embed":
            lists.append(_lexical(library, asked, lexical_candidates).select("query", "doc", "rank"))
        if strategy != "bm25":
            near = _near(library, asked, dense_candidates)
            best = near.groupBy("query").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("max_sim"))
            lists.append(near.select("query", "doc", "rank"))
        ranked = fusion.rrf(lists, max(lexical_candidates, dense_candidates), rrf_k).select("query", "doc", "rank") if len(lists) > 1 else lists[0]
    typed = ranked.join(library.cards.select(F.col("card").alias("doc"), F.coalesce("type", F.lit("failure")).alias("type"), similarity_tokens(F.coalesce("text", F.lit(""))).alias("tokens")), "doc")
    out = asked.select("query", F.col("vector").isNotNull().alias("has_vector")).join(fusion.candidate_lists(typed, "type", "tokens"), "query", "left")
    out = out.join(best, "query", "left") if best is not None else out.withColumn("max_sim", F.lit(0.0))
    out = out.withColumns({"max_sim": F.coalesce("max_sim", F.lit(0.0)), "n_candidates": F.coalesce(F.size("candidates"), F.lit(0))})
    out = out.withColumn("n_candidates", F.greatest("n_candidates", F.lit(0)))
    out = out.withColumn("skip_reason", _reasons(out, threshold, strategy))
    wanted = fusion.dynamic_k(F.col("max_sim"), k) if gated and use_dynamic_k else F.lit(k)
    out = out.withColumn("effective_k", F.when(F.col("skip_reason").isNull(), wanted).otherwise(F.lit(k)).cast("int"))
    chosen = F.when(F.col("skip_reason").isNull(), fusion.mmr(F.col("candidates"), F.col("effective_k"), balance=balance))
    # Written once: the steps that follow would each select again.
    out = cut(out.withColumn("chosen", chosen))
    if mix:
        out = out.withColumn("chosen", fusion.mix_in(F.col("chosen"), F.col("candidates"), worst_rank=worst_rank))
    shown = F.coalesce(F.transform("chosen", lambda c: F.struct(c["rank"].alias("rank"), c["doc"].alias("doc"), c["type"].alias("type"))), F.expr("filter(transform(candidates, c -> struct(c.rank as rank, c.doc as doc, c.type as type)), c -> false)"))
    # Candidates are counted before the gate of two stages, and after it otherwise.
    counted = F.when(F.col("skip_reason").isNull() | F.lit(strategy == "twostage"), F.col("n_candidates")).otherwise(0)
    meta = F.struct(
        F.lit(strategy).alias("strategy"), F.round("max_sim", 6).alias("max_sim"), "effective_k", counted.cast("bigint").alias("n_candidates"), F.col("skip_reason").isNotNull().alias("skipped"),
        "skip_reason", F.when(F.col("skip_reason").isNull(), F.size("chosen")).otherwise(0).cast("bigint").alias("n_selected"),
    )
    return out.select("query", meta.alias("meta"), shown.alias("cards"))


def selected(retrieved: DataFrame) -> DataFrame:
    """(query, doc, pick): the cards of ``retrieve``, a row each, numbered from 1."""
    return retrieved.select("query", F.posexplode("cards").alias("pick", "c")).select("query", "c.doc", (F.col("pick") + 1).cast("bigint").alias("pick"))
