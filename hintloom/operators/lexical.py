"""BM25 over large corpora for a stated set of queries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hintloom.lineage import cut
from hintloom.functions.text import CODE_TOKEN, WORD_TOKEN, code_tokens, word_tokens

TOKENIZERS = {"word": (word_tokens, re.compile(WORD_TOKEN)), "code": (code_tokens, re.compile(CODE_TOKEN))}
#: Queries for which the documents are tokenised at once, and values of the table of terms by queries that is sent to the tasks: 64 MB.
QUERIES_AT_ONCE, VALUES_AT_ONCE = 2_000, 8_000_000


def postings(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "word") -> DataFrame:
    """(doc, term, tf, dl): the inverted index; documents without tokens have no rows."""
    tokens = TOKENIZERS[tokenizer][0](F.coalesce(F.col(text_col), F.lit("")))
    base = df.select(F.col(id_col).alias("doc"), tokens.alias("tokens")).where(F.size("tokens") > 0)
    return base.select("doc", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "word") -> DataFrame:
    """One row (n_docs, avgdl, n_tokens, n_empty) over all documents."""
    n = F.size(TOKENIZERS[tokenizer][0](F.coalesce(F.col(text_col), F.lit(""))))
    base = df.select(n.cast("bigint").alias("dl"))
    return base.agg(F.count("*").alias("n_docs"), F.round(F.avg("dl"), 6).alias("avgdl"), F.sum("dl").alias("n_tokens"), F.count_if(F.col("dl") == 0).alias("n_empty"))


def document_frequency(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "word") -> DataFrame:
    """(term, df) of all terms."""
    tokens = F.array_distinct(TOKENIZERS[tokenizer][0](F.coalesce(F.col(text_col), F.lit(""))))
    return df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _matched(base: DataFrame, pattern: re.Pattern, vocabulary: dict[str, int]) -> DataFrame:
    """(doc, dl, terms, tfs) of (doc, text): each document's length in tokens, and those of its terms that are in the vocabulary."""
    shared = base.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            found = [pattern.findall(t.lower()) for t in batch.column("text").to_pylist()]
            counts = [Counter(map(at.get, tokens)) for tokens in found]
            for c in counts:
                c.pop(None, None)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.fromiter((x for c in counts for x in of(c)), np.int32))) for of in (Counter.keys, Counter.values)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([len(t) for t in found], pa.int32()), *lists], ["doc", "dl", "terms", "tfs"])

    return base.mapInArrow(run, f"doc {base.schema['doc'].dataType.simpleString()}, dl int, terms array<int>, tfs array<int>")


def _blocks(found: list[list[str]]) -> Iterator[tuple[list[int], list[str]]]:
    """(query numbers, their terms) in blocks whose table of terms by queries has at most ``VALUES_AT_ONCE`` values, or one query."""
    block, terms = [], set()
    for i, tokens in enumerate(found):
        more = terms | set(tokens)
        if block and len(more) * (len(block) + 1) > VALUES_AT_ONCE:
            yield block, sorted(terms)
            block, more = [], set(tokens)
        block, terms = [*block, i], more
    if block:
        yield block, sorted(terms)


def bm25_top_k(
    documents: DataFrame, doc_id: str, doc_text: str, queries: DataFrame, query_id: str, query_text: str, k: int = 5,
    weighting: str = "tf", tokenizer: str = "word", k1: float = 1.5, b: float = 0.75,
) -> DataFrame:
    """(query, doc, score, rank): the ``k`` best documents of each query with a positive score, ties to the lower id.

    ``weighting`` is "tf", where a term repeated in the query counts again, or "distinct". Scores are rounded to six places before
    ranking. Statistics come from all documents. These are tokenised once for each ``QUERIES_AT_ONCE`` queries, and of each its length and
    the queries' own terms are kept; frequencies and scores come from that. A block of queries is scored where the documents lie, and a
    batch passes on no more than the ``k`` best and their ties per query, so neither postings nor scores are shuffled. Null and empty texts match nothing; null
    document ids are left out.
    """
    if weighting not in ("tf", "distinct"):
        raise ValueError("weighting must be tf or distinct")
    pattern = TOKENIZERS[tokenizer][1]
    base = documents.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(doc_text), F.lit("")).alias("text")).where("doc is not null")
    asked = queries.select(F.col(query_id).cast("string").alias("query"), F.col(query_text).alias("text"))
    blocks = max(1, -(-asked.count() // QUERIES_AT_ONCE))
    doc_type = base.schema["doc"].dataType.simpleString()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    out = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        rows = part.collect()
        found = [pattern.findall((r["text"] or "").lower()) for r in rows]
        names = sorted({t for q in found for t in q})
        at = {t: i for i, t in enumerate(names)}
        docs = cut(_matched(base, pattern, at))
        totals = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        n_docs, avgdl = max(totals["n"], 1), max(totals["avgdl"] or 0.0, 1e-9)
        df = np.zeros(len(names))
        for r in docs.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        for numbers, terms in _blocks(found):
            own = np.full(len(names), -1)
            own[[at[t] for t in terms]] = np.arange(len(terms))
            weights = np.zeros((len(terms), len(numbers)))
            for j, i in enumerate(numbers):
                for t in found[i] if weighting == "tf" else set(found[i]):
                    weights[own[at[t]], j] += idf[at[t]]
            shared = base.sparkSession.sparkContext.broadcast((own, weights, [rows[i]["query"] for i in numbers]))

            def run(batches: Iterator[pa.RecordBatch], shared=shared, avgdl=avgdl) -> Iterator[pa.RecordBatch]:
                own, weights, queries = shared.value
                for batch in batches:
                    offsets, flat = batch.column("terms").offsets.to_numpy(), batch.column("terms").values.to_numpy()
                    tfs, dl = batch.column("tfs").values.to_numpy(), batch.column("dl").to_numpy()
                    scores = np.zeros((batch.num_rows, len(queries)))
                    for i in range(batch.num_rows):
                        terms, tf = own[flat[offsets[i] : offsets[i + 1]]], tfs[offsets[i] : offsets[i + 1]]
                        there = terms >= 0
                        if there.any():
                            tf = tf[there]
                            scores[i] = (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[i] / avgdl))) @ weights[terms[there]]
                    scores = np.round(scores, 6)
                    least = np.partition(scores, -k, axis=0)[-k] if batch.num_rows > k else np.zeros(len(queries))
                    i, j = np.nonzero((scores >= least) & (scores > 0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(queries, object)[j], pa.string()), batch.column("doc").take(pa.array(i)), pa.array(scores[i, j])], ["query", "doc", "score"])

            found_rows = docs.mapInArrow(run, f"query string, doc {doc_type}, score double")
            out = found_rows if out is None else out.union(found_rows)
    if out is None:
        return base.sparkSession.createDataFrame([], f"query string, doc {doc_type}, score double, rank int")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def bm25_scores(
    documents: DataFrame, doc_id: str, doc_text: str, queries: DataFrame, query_id: str, query_text: str, pairs: DataFrame,
    weighting: str = "tf", tokenizer: str = "word", k1: float = 1.5, b: float = 0.75,
) -> DataFrame:
    """``pairs`` (query, doc, …) with ``score``, the BM25 score of each, rounded to six places, 0 if no term meets.

    Statistics come from all documents; only the terms of the pairs' queries are counted, and only the pairs' documents have their terms
    joined with them. Pairs whose query or document is unknown score 0.
    """
    tokens = lambda c: TOKENIZERS[tokenizer][0](F.coalesce(F.col(c), F.lit("")))
    base = documents.select(F.col(doc_id).alias("doc"), tokens(doc_text).alias("tokens")).where("doc is not null")
    terms = queries.select(F.col(query_id).cast("string").alias("query"), F.explode(tokens(query_text)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    terms = cut(terms.join(pairs.select("query").distinct(), "query", "left_semi"))
    totals = base.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl")).first()
    df = base.select(F.explode(F.array_distinct("tokens")).alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.lit(totals["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(df, "term").select("query", "term", ((F.col("qtf") if weighting == "tf" else F.lit(1)) * idf).alias("w"))
    mine = base.join(pairs.select("doc").distinct(), "doc", "left_semi").select("doc", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    post = mine.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(max(totals["avgdl"] or 0.0, 1e-9))))
    scored = pairs.select("query", "doc").distinct().join(post, "doc").join(weighted, ["query", "term"]).groupBy("query", "doc").agg(F.round(F.sum(F.col("w") * impact), 6).alias("score"))
    return pairs.join(scored, ["query", "doc"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
