"""Queries of retrieval: indexes, top-k searches, fusion, diversity, gating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hintloom.functions.text import similarity_tokens
from hintloom.operators import dense, fusion, lexical, retrieval
from hintloom.plans.registry import query, table

WORDS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
CODES = r"regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_+\-]*|\d+(?:\^\d+)?|[+\-*/<>=!]+')"


def _bm25_sql(tokens: str, weighting: str, k: int) -> str:
    ask = tokens.replace("lower(text)", "lower(question)")
    qtf = "count(*)" if weighting == "tf" else "1"
    return f"""
    docs AS (SELECT doc_id AS doc, {tokens} AS t FROM documents),
    stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM docs),
    post AS (SELECT doc, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, len(t) AS dl, unnest(t) AS term FROM docs) GROUP BY ALL),
    freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    ask AS (SELECT query, term, {qtf} AS qtf FROM (SELECT question_id AS query, unnest({ask}) AS term FROM sample_benchmark) GROUP BY query, term),
    scored AS (
        SELECT query, doc, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM ask JOIN post USING (term) JOIN freq USING (term), stats GROUP BY query, doc),
    top_{weighting} AS (SELECT * FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored WHERE score > 0) WHERE rank <= {k})"""


def _scoped(sql: str, suffix: str) -> str:
    for name in ("docs", "stats", "post", "freq", "ask", "scored"):
        sql = sql.replace(f" {name} ", f" {name}_{suffix} ").replace(f" {name},", f" {name}_{suffix},").replace(f"\n    {name} AS", f"\n    {name}_{suffix} AS").replace(f" {name})", f" {name}_{suffix})")
    return sql


def _bm25(spark, sf_dir, weighting, tokenizer, k) -> DataFrame:
    return lexical.bm25_top_k(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "sample_benchmark"), "question_id", "question", k, weighting, tokenizer)


@query("bm25_topk_tf", f"WITH {_bm25_sql(WORDS, 'tf', 5)} SELECT query, doc, score, rank FROM top_tf")
def bm25_topk_tf(spark, sf_dir):
    return _bm25(spark, sf_dir, "tf", "word", 5)


@query("bm25_topk_distinct", f"WITH {_bm25_sql(CODES, 'distinct', 5)} SELECT query, doc, score, rank FROM top_distinct")
def bm25_topk_distinct(spark, sf_dir):
    return _bm25(spark, sf_dir, "distinct", "code", 5)


@query("corpus_stats", f"SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avgdl, sum(len(t)) AS n_tokens, count(*) FILTER (len(t) = 0) AS n_empty FROM (SELECT {WORDS} AS t FROM documents)")
def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("term_document_frequency", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY term")
def term_document_frequency(spark, sf_dir):
    return lexical.document_frequency(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("postings", f"SELECT doc, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id AS doc, len(t) AS dl, unnest(t) AS term FROM (SELECT doc_id, {WORDS} AS t FROM documents)) GROUP BY doc, term")
def postings(spark, sf_dir):
    return lexical.postings(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("dl", F.col("dl").cast("bigint"))


DENSE = """
    pairs AS (SELECT q.vec_id AS query, v.vec_id AS vec, v.label AS label, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
              FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings v),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec) AS rank FROM pairs {where}) WHERE rank <= {k})"""


def _dense(spark, sf_dir, k, positive_only=False) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return dense.dense_top_k(vectors, "vec_id", "embedding", vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", k, positive_only)


@query("dense_topk", f"WITH {DENSE.format(where='', k=5)} SELECT query, vec, score, rank FROM near")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 5)


@query("dense_topk_positive", f"WITH {DENSE.format(where='WHERE score > 0', k=50)} SELECT query, vec, score, rank FROM near")
def dense_topk_positive(spark, sf_dir):
    return _dense(spark, sf_dir, 50, True)


_LISTS = f"WITH {_bm25_sql(WORDS, 'tf', 20)}, {_scoped(_bm25_sql(CODES, 'distinct', 20), 'c')}"
_FUSED = """
    listed AS (SELECT query, doc, rank, 0 AS list FROM top_tf UNION ALL SELECT query, doc, rank, 1 AS list FROM top_distinct),
    fused AS (SELECT query, doc, round(sum(1 / (60.0 + rank)), 6) AS score, min(list * 1000 + rank) AS seen FROM listed GROUP BY query, doc),
    best AS (SELECT * FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, seen, doc) AS rank FROM fused) WHERE rank <= 12)"""


def _fused(spark, sf_dir) -> DataFrame:
    return fusion.rrf([_bm25(spark, sf_dir, "tf", "word", 20), _bm25(spark, sf_dir, "distinct", "code", 20)], keep=12)


@query("rrf_fusion", f"{_LISTS}, {_FUSED} SELECT query, doc, score, rank FROM best")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir)


_TOKENS = r"list_distinct(regexp_extract_all(lower(text), '[a-z0-9_+\-]+|\d+|\^|\*'))"
_SIM = "CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"
_MMR = f"""
    cand AS (SELECT b.query, b.doc, b.rank - 1 AS rank, count(*) OVER (PARTITION BY b.query) AS n, {_TOKENS} AS t FROM best b JOIN documents d ON d.doc_id = b.doc),
    p1 AS (SELECT * FROM cand WHERE rank = 0),
    s2 AS (SELECT c.*, {_SIM.format(a='c.t', b='p1.t')} AS s1, p1.t AS t1, row_number() OVER (PARTITION BY c.query ORDER BY round(0.7 / (c.rank + 1) - (1 - 0.7) * s1, 9) DESC, c.rank) AS o
           FROM cand c JOIN p1 USING (query) WHERE c.rank > 0),
    p2 AS (SELECT * FROM s2 WHERE o = 1),
    s3 AS (SELECT c.query, c.doc, c.rank, row_number() OVER (PARTITION BY c.query ORDER BY round(0.7 / (c.rank + 1) - (1 - 0.7) * greatest(c.s1, {_SIM.format(a='c.t', b='p2.t')}), 9) DESC, c.rank) AS o
           FROM s2 c JOIN p2 USING (query) WHERE c.rank <> p2.rank),
    chosen AS (SELECT query, doc, rank + 1 AS pick FROM cand WHERE n <= 3
               UNION ALL SELECT query, doc, 1 FROM p1 WHERE n > 3 UNION ALL SELECT query, doc, 2 FROM p2 WHERE n > 3
               UNION ALL SELECT s3.query, s3.doc, 3 FROM s3 JOIN p1 USING (query) WHERE o = 1 AND p1.n > 3)"""


def _candidates(spark, sf_dir) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", F.when(F.col("source") == "forum", "success").otherwise("failure").alias("type"))
    found = _fused(spark, sf_dir).join(documents, "doc").withColumn("tokens", similarity_tokens(F.col("text")))
    return fusion.candidate_lists(found, "type", "tokens")


@query("mmr_select", f"{_LISTS}, {_FUSED}, {_MMR} SELECT query, doc, pick FROM chosen")
def mmr_select(spark, sf_dir):
    chosen = _candidates(spark, sf_dir).select("query", F.posexplode(fusion.mmr(F.col("candidates"), 3)).alias("pick", "c"))
    return chosen.select("query", "c.doc", (F.col("pick") + 1).cast("bigint").alias("pick"))


_MIX = """
    typed AS (SELECT c.query, c.doc, c.rank, CASE WHEN d.source = 'forum' THEN 'success' ELSE 'failure' END AS type FROM cand c JOIN documents d ON d.doc_id = c.doc),
    picked AS (SELECT h.query, h.doc, h.pick, t.type FROM chosen h JOIN typed t USING (query, doc)),
    pool AS (SELECT query, min_by(doc, rank) AS doc FROM typed t WHERE type <> 'success' AND rank <= 15 AND NOT EXISTS (SELECT 1 FROM picked p WHERE p.query = t.query AND p.doc = t.doc) GROUP BY query),
    swap AS (SELECT p.query, max(CASE WHEN p.type = 'success' THEN p.pick END) AS pick, any_value(pool.doc) AS doc FROM picked p JOIN pool USING (query) GROUP BY p.query HAVING count(*) FILTER (p.type <> 'success') < 1)"""


@query("failure_mix", f"{_LISTS}, {_FUSED}, {_MMR}, {_MIX} SELECT p.query, coalesce(s.doc, p.doc) AS doc, p.pick FROM picked p LEFT JOIN swap s ON s.query = p.query AND s.pick = p.pick")
def failure_mix(spark, sf_dir):
    lists = _candidates(spark, sf_dir).withColumn("chosen", fusion.mmr(F.col("candidates"), 3))
    mixed = lists.select("query", F.posexplode(fusion.mix_in(F.col("chosen"), F.col("candidates"))).alias("pick", "c"))
    return mixed.select("query", "c.doc", (F.col("pick") + 1).cast("bigint").alias("pick"))


@query(
    "threshold_dynamic_k",
    f"""WITH {DENSE.format(where='WHERE vec <> query', k=5)}, m AS (SELECT query, max(score) AS max_sim FROM near GROUP BY query)
    SELECT query, max_sim, max_sim < 0.4 AS skipped, CASE WHEN max_sim < 0.4 THEN 0 WHEN max_sim >= 0.85 THEN 5 WHEN max_sim >= 0.7 THEN 4 WHEN max_sim >= 0.6 THEN 3 ELSE 2 END AS effective_k FROM m""",
)
def threshold_dynamic_k(spark, sf_dir):
    nearest = _dense(spark, sf_dir, 6).where("vec <> query").groupBy("query").agg(F.max("score").alias("max_sim"))
    return fusion.gated(nearest, "max_sim", 5, 0.4).drop("skip_reason")


@query(
    "gated_retrieve",
    f"""WITH {DENSE.format(where='WHERE vec <> query', k=5)}, m AS (SELECT *, max(score) OVER (PARTITION BY query) AS max_sim FROM near)
    SELECT query, vec, score, rank FROM m WHERE max_sim >= 0.4 AND rank <= CASE WHEN max_sim >= 0.85 THEN 5 WHEN max_sim >= 0.7 THEN 4 WHEN max_sim >= 0.6 THEN 3 ELSE 2 END""",
)
def gated_retrieve(spark, sf_dir):
    from pyspark.sql.window import Window

    near = _dense(spark, sf_dir, 6).where("vec <> query")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where("rank <= 5")
    near = near.withColumn("max_sim", F.max("score").over(Window.partitionBy("query")))
    return fusion.gated(near, "max_sim", 5, 0.4).where("rank <= effective_k").select("query", "vec", "score", "rank")


_K = 5
_SETUP = f"""
    lib AS (SELECT doc_id AS doc, text, CASE WHEN source = 'forum' THEN 'success' ELSE 'failure' END AS type, {_TOKENS} AS t FROM documents),
    pairs AS (SELECT q.question_id AS query, v.vec_id AS doc, round(list_dot_product(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
              FROM sample_benchmark q JOIN embeddings e ON e.vec_id = q.line_no, embeddings v),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM pairs) WHERE rank <= {{k}}),
    sim AS (SELECT query, greatest(max(score), 0) AS max_sim FROM near GROUP BY query)"""


def _selection_sql(k: int) -> str:
    """Diverse selection and mixing over ``cand`` (query, doc, rank, type, t, n, kk), for up to ``k`` results, as one step of SQL for each."""
    sim = _SIM.format(a="c.t", b="p.t")
    steps = ["m1 AS (SELECT *, 1 AS pick FROM cand WHERE rank = 0)", f"l1 AS (SELECT c.*, {sim} AS s FROM cand c JOIN m1 p USING (query) WHERE c.rank > 0)"]
    for i in range(2, k + 1):
        value = "round(0.7 / (rank + 1) - (1 - 0.7) * s, 9)"
        steps.append(f"m{i} AS (SELECT * EXCLUDE (o) FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {value} DESC, rank) AS o FROM l{i - 1}) WHERE o = 1)")
        steps.append(f"l{i} AS (SELECT c.* REPLACE (greatest(c.s, {sim}) AS s) FROM l{i - 1} c JOIN m{i} p USING (query) WHERE c.rank <> p.rank)")
    picks = " UNION ALL ".join(f"SELECT query, doc, rank, type, {i} AS pick FROM m{i} WHERE n > kk AND {i} <= kk" for i in range(1, k + 1))
    steps.append(f"picked AS (SELECT query, doc, rank, type, rank + 1 AS pick FROM cand WHERE n <= kk UNION ALL {picks})")
    steps.append("pool AS (SELECT query, min_by(doc, rank) AS doc FROM cand c WHERE type <> 'success' AND rank <= 15 AND NOT EXISTS (SELECT 1 FROM picked p WHERE p.query = c.query AND p.doc = c.doc) GROUP BY query)")
    steps.append("swap AS (SELECT p.query, max(CASE WHEN p.type = 'success' THEN p.pick END) AS pick, any_value(pool.doc) AS doc FROM picked p JOIN pool USING (query) GROUP BY p.query HAVING count(*) FILTER (p.type <> 'success') < 1)")
    steps.append("final AS (SELECT p.query, coalesce(s.doc, p.doc) AS doc, p.pick FROM picked p LEFT JOIN swap s ON s.query = p.query AND s.pick = p.pick)")
    return ",\n    ".join(steps)


_DYNAMIC = f"CASE WHEN max_sim >= 0.85 THEN {_K} WHEN max_sim >= 0.7 THEN {max(3, _K - 1)} WHEN max_sim >= 0.6 THEN {max(2, _K - 2)} ELSE {max(1, _K - 3)} END"
_BOTH = f"""WITH {_bm25_sql(CODES, 'distinct', 50)}, {_SETUP.format(k=50)},
    listed AS (SELECT query, doc, rank, 0 AS list FROM top_distinct UNION ALL SELECT query, doc, rank, 1 FROM near),
    merged AS (SELECT * FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(sum(1 / (60.0 + rank)), 6) DESC, min(list * 1000 + rank), doc) AS rank FROM listed GROUP BY query, doc) WHERE rank <= 50),
    cand AS (SELECT b.query, b.doc, b.rank - 1 AS rank, l.type, l.t, count(*) OVER (PARTITION BY b.query) AS n, {{kk}} AS kk FROM merged b JOIN lib l USING (doc) LEFT JOIN sim USING (query) {{gate}}), {_selection_sql(_K)}"""
_GATED = _BOTH.format(kk=_DYNAMIC, gate="WHERE coalesce(max_sim, 0) >= 0.4")
_STAGES = f"""WITH {_bm25_sql(CODES, 'distinct', 5)}, {_SETUP.format(k=20)}, card AS (SELECT doc_id % 500 AS source, doc_id AS doc FROM documents),
    hit AS (SELECT query, max(score) AS max_sim FROM near n JOIN card c ON c.source = n.doc GROUP BY query),
    firsts AS (SELECT query, c.doc, min(n.rank) AS source_rank FROM near n JOIN card c ON c.source = n.doc GROUP BY query, c.doc),
    merged AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY coalesce(score, 0) DESC, source_rank, doc) AS rank, count(*) OVER (PARTITION BY query) AS n FROM firsts LEFT JOIN scored USING (query, doc)),
    cand AS (SELECT b.query, b.doc, b.rank - 1 AS rank, l.type, l.t, b.n, {_DYNAMIC} AS kk FROM merged b JOIN lib l USING (doc) JOIN hit USING (query) WHERE max_sim >= 0.4), {_selection_sql(_K)}"""
_META = """ SELECT question_id AS query, '{name}' AS strategy, round(coalesce(max_sim, 0), 6) AS max_sim, coalesce(kk, 5)::INT AS effective_k, coalesce({n}, 0) AS n_candidates, c.query IS NULL AS skipped,
    CASE {none} WHEN c.query IS NULL THEN 'below_threshold (' || printf('%.3f', coalesce(max_sim, 0)) || ' < 0.4)' END AS skip_reason, coalesce(f.n_selected, 0) AS n_selected
    FROM sample_benchmark q LEFT JOIN (SELECT query, any_value(kk) AS kk, any_value(n) AS n FROM cand GROUP BY query) c ON c.query = question_id LEFT JOIN {sim} s ON s.query = question_id {more}
    LEFT JOIN (SELECT query, count(*) AS n_selected FROM final GROUP BY query) f ON f.query = question_id"""


def _retrieved(spark, sf_dir, strategy, **settings) -> DataFrame:
    """Every benchmark question with the vector of its line number, over the documents as cards; a document's vector is that of its id, its source the id modulo 500."""
    vectors = table(spark, sf_dir, "embeddings")
    cards = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("card"), "text", F.when(F.col("source") == "forum", "success").otherwise("failure").alias("type"))
    asked = table(spark, sf_dir, "sample_benchmark").join(vectors.select(F.col("vec_id").alias("line_no"), F.col("embedding").alias("vector")), "line_no", "left").select(F.col("question_id").alias("query"), F.col("question").alias("text"), "vector")
    library = retrieval.Library(cards, vectors.select("vec_id", "embedding"), cards.select((F.col("card") % 500).alias("source"), "card"))
    return retrieval.retrieve(library, asked, strategy, _K, threshold=0.4, **settings)


@query("hybrid_retrieve", f"{_BOTH.format(kk=_K, gate='')} SELECT query, doc, pick FROM final")
def hybrid_retrieve(spark, sf_dir):
    return retrieval.selected(_retrieved(spark, sf_dir, "hybrid"))


@query("hybrid_v2_retrieve", f"{_GATED} SELECT query, doc, pick FROM final")
def hybrid_v2_retrieve(spark, sf_dir):
    return retrieval.selected(_retrieved(spark, sf_dir, "hybrid_v2"))


@query("hybrid_v2_metadata", _GATED + _META.format(name="hybrid_v2", n="c.n", none="", sim="sim", more=""))
def hybrid_v2_metadata(spark, sf_dir):
    return _retrieved(spark, sf_dir, "hybrid_v2").select("query", "meta.*")


@query("twostage_retrieve", f"{_STAGES} SELECT query, doc, pick FROM final")
def twostage_retrieve(spark, sf_dir):
    return retrieval.selected(_retrieved(spark, sf_dir, "twostage"))


@query("twostage_metadata", _STAGES + _META.format(name="twostage", sim="hit", n="m.n", none="WHEN e.vec_id IS NULL THEN 'no_q_vec' WHEN m.n IS NULL THEN 'no_source_match'", more="LEFT JOIN embeddings e ON e.vec_id = q.line_no LEFT JOIN (SELECT query, any_value(n) AS n FROM merged GROUP BY query) m ON m.query = question_id"))
def twostage_metadata(spark, sf_dir):
    return _retrieved(spark, sf_dir, "twostage").select("query", "meta.*")


@query(
    "source_expansion",
    f"""WITH {DENSE.format(where='', k=20)}, hits AS (SELECT n.query, n.rank AS source_rank, d.doc_id AS card FROM near n JOIN documents d ON d.doc_id % 500 = n.vec),
    firsts AS (SELECT query, card, min(source_rank) AS source_rank FROM hits GROUP BY query, card)
    SELECT query, card, source_rank, row_number() OVER (PARTITION BY query ORDER BY source_rank, card) AS rank FROM firsts""",
)
def source_expansion(spark, sf_dir):
    sources = _dense(spark, sf_dir, 20).withColumnRenamed("vec", "doc")
    cards = table(spark, sf_dir, "documents").select((F.col("doc_id") % 500).alias("problem"), F.col("doc_id").alias("card"))
    return fusion.expand_sources(sources, cards, "problem", "card")


@query("random_retrieve")
def random_retrieve(spark, sf_dir):
    """Five documents per question in an order that the question seeds; repeatable, and the same for every order of the input."""
    from hintloom.operators.sampling import seeded_sample

    return seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "sample_benchmark").select(F.col("question_id").alias("query")), "query", 5, seed="42")
