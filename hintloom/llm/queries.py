"""The registered queries of this subpackage, with their SQL where SQL can state them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hintloom import lineage
from hintloom.llm import endings, leak, minhash, packing, pairs, quality, splitjoin, truncation

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _revisable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and heuristics in one frame; the id is twice the line number, plus one for skill cards."""
    problems = _table(spark, sf_dir, "sample_problems").select((F.col("line_no") * 2).alias("id"), F.lit("sample_problems").alias("table_name"), F.col("question").alias("text"))
    cards = _table(spark, sf_dir, "sample_skill_cards").select((F.col("line_no") * 2 + 1).alias("id"), F.lit("sample_skill_cards").alias("table_name"), F.col("heuristic").alias("text"))
    return problems.union(cards)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash.near_duplicates(_revisable(spark, sf_dir), "id", "text", within="table_name", shingle=3, threshold=0.5)
    pairs = minhash.cluster_pairs(groups)
    name = F.when(F.col("a") % 2 == 0, "sample_problems").otherwise("sample_skill_cards")
    return pairs.select(name.alias("table_name"), F.expr("a div 2").alias("line_a"), F.expr("b div 2").alias("line_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compact form: one row per record with its class and group."""
    groups = minhash.near_duplicates(_revisable(spark, sf_dir), "id", "text", within="table_name", shingle=3, threshold=0.5)
    name = F.when(F.col("id") % 2 == 0, "sample_problems").otherwise("sample_skill_cards")
    return groups.select(name.alias("table_name"), F.expr("id div 2").alias("line_no"), F.expr("text_class div 2").alias("text_class"), F.expr("cluster div 2").alias("cluster"), "copies")


def _overlaps(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return splitjoin.split_overlaps(_table(spark, sf_dir, "joined_sample"), "line_no", "unique_key", "question", "split_name", source_col="source")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitjoin.overlap_pairs(_overlaps(spark, sf_dir)).select(F.col("a").alias("line_a"), F.col("b").alias("line_b"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of holdout and valid, and those of them that are also in train, per split and source."""
    return splitjoin.overlap_rates(_overlaps(spark, sf_dir)).withColumnRenamed("split", "split_name")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces = _table(spark, sf_dir, "sample_source_cot")
    found = pairs.defective_pairs(traces, "line_no", "question", "model_think", "model_response", "answer", "source_model")
    return found.select(F.col("id").alias("line_no"), "defect")


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each defect the neighbours, the limits, the endings and the rules find."""
    traces = _table(spark, sf_dir, "sample_source_cot")
    found = pairs.defective_pairs(traces, "line_no", "question", "model_think", "model_response", "answer", "source_model")
    return found.groupBy("defect", "reason").agg(F.count("*").alias("n"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.field_values(_table(spark, sf_dir, "sample_source_cot"), _table(spark, sf_dir, "joined_sample"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = truncation.cut_values(_fields(spark, sf_dir)).where("reason is not null")
    return found.select(F.col("field").alias("field_name"), F.col("id").alias("line_no"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_rates(truncation.cut_values(_fields(spark, sf_dir))).withColumnRenamed("field", "field_name")


def p3_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endings.length_limits(truncation.as_measured(lineage.cut(_fields(spark, sf_dir)))).withColumnRenamed("field", "field_name")


def p5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, containers = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "containers")
    packed = packing.pack_documents(documents, "doc_id", "text", containers, "container_kind", "capacity_tokens", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return packed.withColumnRenamed("id", "doc_id")


def p5_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_rates(p5_packing(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leak.leaked(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "sample_benchmark"), "question_id", "question")
    return found.withColumnRenamed("item_id", "question_id")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "common_words").where("word is not null").select("word").distinct()
    if words.count() > 100_000:
        raise ValueError("the list of common words is meant to be short")
    return quality.text_kinds(_table(spark, sf_dir, "documents"), "doc_id", "text", frozenset(r.word for r in words.collect()))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).where("kind <> 'prose'").select(F.col("id").alias("doc_id"), "kind")


def p7_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).withColumnRenamed("id", "doc_id").drop("votes")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_reasons": p2_reasons, "p3_found": p3_found, "p3_rates": p3_rates, "p3_limits": p3_limits, "p4_found": p4_found, "p4_rates": p4_rates, "p5_packing": p5_packing, "p5_fill_rates": p5_fill_rates, "p6_found": p6_found, "p7_found": p7_found, "p7_statistics": p7_statistics}

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def _shingles(source: str, text: str, columns: str, k: int) -> str:
    """Distinct runs of k words of a table's texts, with other columns."""
    return f"SELECT DISTINCT {columns}, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {k - 2})) AS i FROM (SELECT *, {_WORDS.format(text)} AS w FROM {source}))"


_P1 = f"""WITH RECURSIVE rows_ AS (SELECT 'sample_problems' AS t, line_no, question AS body FROM sample_problems UNION ALL SELECT 'sample_skill_cards', line_no, heuristic FROM sample_skill_cards),
    sh AS ({_shingles('rows_', 'body', 't, line_no', 3)}),
    n AS (SELECT t, line_no, count(*) AS n FROM sh GROUP BY ALL),
    both_ AS (SELECT a.t, a.line_no AS x, b.line_no AS y, count(*) AS c FROM sh a JOIN sh b ON a.t = b.t AND a.g = b.g AND a.line_no <> b.line_no GROUP BY ALL),
    links AS (SELECT b.t, x, y FROM both_ b JOIN n p ON p.t = b.t AND p.line_no = x JOIN n q ON q.t = b.t AND q.line_no = y WHERE c >= 0.5 * (p.n + q.n - c) - 1e-9),
    reach AS (SELECT t, x, y FROM links UNION SELECT r.t, r.x, l.y FROM reach r JOIN links l ON l.t = r.t AND l.x = r.y)
    SELECT t AS table_name, x AS line_a, y AS line_b FROM reach WHERE x < y"""

_P4 = f"""WITH rows_ AS (SELECT line_no, question, lower(trim(split_name)) = 'train' AS train, string_split(regexp_replace(lower(unique_key), '\\s+', '', 'g'), '/') AS k FROM joined_sample WHERE lower(trim(split_name)) IN ('train', 'holdout', 'valid')),
    sh AS ({_shingles('rows_', 'question', 'line_no, train', 3)}),
    n AS (SELECT line_no, count(*) AS n FROM sh GROUP BY 1),
    both_ AS (SELECT a.line_no AS x, b.line_no AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.train AND NOT b.train GROUP BY ALL),
    near AS (SELECT x, y FROM both_ JOIN n p ON p.line_no = x JOIN n q ON q.line_no = y WHERE c >= 0.5 * (p.n + q.n - c) - 1e-9),
    keys AS (SELECT line_no, train, k[1] || '/' || k[2] || '/' || regexp_replace(k[3], '^0+(.)', '\\1') AS o FROM rows_ WHERE len(k) = 3 AND k[1] <> '' AND k[2] <> '' AND k[3] <> ''),
    same AS (SELECT a.line_no AS x, b.line_no AS y FROM keys a JOIN keys b ON a.o = b.o AND a.train AND NOT b.train)
    SELECT DISTINCT least(x, y) AS line_a, greatest(x, y) AS line_b FROM (SELECT * FROM near UNION ALL SELECT * FROM same)"""

_P4_RATES = f"""{_P4.rpartition(chr(10))[0]}
    SELECT lower(trim(split_name)) AS split_name, source, count(*) AS n_rows, count(*) FILTER (k) AS by_key, count(*) FILTER (q) AS by_question, count(*) FILTER (k OR q) AS by_either
    FROM (SELECT split_name, source, line_no IN (SELECT y FROM same) AS k, line_no IN (SELECT y FROM near) AS q FROM joined_sample WHERE lower(trim(split_name)) IN ('holdout', 'valid')) GROUP BY ALL"""

_P6 = f"SELECT DISTINCT doc_id, question_id FROM ({_shingles('documents', 'text', 'doc_id', 12)}) JOIN ({_shingles('sample_benchmark', 'question', 'question_id', 12)}) USING (g)"

SQL: dict[str, str] = {"p1_found": _P1, "p4_found": _P4, "p4_rates": _P4_RATES, "p6_found": _P6}
