"""Reading and writing JSON lines, arrays, globs, key lists, logs and text trees."""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True, missing_ok: bool = True) -> DataFrame:
    """The objects of JSON-line files (plain or gzip, also a glob), blank lines skipped.

    ``strict`` raises at a malformed line, otherwise it is dropped. A missing path gives an empty frame unless ``missing_ok`` is false.
    Keys that the schema doesn't name are left out.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not _exists(spark, path):
        if missing_ok:
            return _empty(spark, schema)
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_numbered(spark: SparkSession, path: str, schema: T.StructType | str, id_col: str = "question_id", other_id: str = "id") -> DataFrame:
    """JSON lines with ``file``, ``line_no`` (from 0, blank lines counted) and an id: its own, the other one, or ``q_`` and the line number.

    Line numbers need whole files, so a file is one task here; use it for curated inputs, ``read_jsonl`` for bulk ones.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not _exists(spark, path):
        return _empty(spark, T.StructType([T.StructField("file", T.StringType()), T.StructField("line_no", T.IntegerType()), *schema.fields]))
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = texts.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value")).where(F.trim("value") != "")
    parsed = lines.select("file", "line_no", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("file", "line_no", "r.*")
    ids = [F.col(c) for c in (id_col, other_id) if c in schema.names]
    own = F.coalesce(*[F.when(c.cast("string") != "", c.cast("string")) for c in ids], F.concat(F.lit("q_"), F.col("line_no").cast("string")))
    return parsed.withColumn(id_col, own)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """The objects of files that hold one JSON array each. Such a file can't be split; write it to Parquet once."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_with_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted; the scan stops nowhere early, but only these rows go on."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def with_file_parts(df: DataFrame, names: list[str], separator: str = "_", file: Column | None = None) -> DataFrame:
    """Columns from the parts of each row's file name without its ending; the last takes the rest of the name."""
    name = F.regexp_replace(F.col("_metadata.file_name") if file is None else file, r"\.[A-Za-z]+(\.gz)?$", "")
    parts = F.split(name, separator, len(names))
    return df.select("*", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def first_row_key(df: DataFrame, file: str, order: str, keys: list[str]) -> DataFrame:
    """The keys of each file's first row given to all its rows, as ``file_<key>``. One aggregate per file, joined back."""
    first = df.groupBy(file).agg(F.min_by(F.struct(*keys), F.col(order)).alias("_k")).select(file, *[F.col(f"_k.{k}").alias(f"file_{k}") for k in keys])
    return df.join(first, file)


def read_keys(spark: SparkSession, path: str, names: tuple[str, ...] = ("unique_key", "key", "id")) -> DataFrame:
    """(key, pos): a key list in order, each key once: JSON lines of objects, an array of strings or objects, or an object with one.

    Key lists are small configuration files and are read on the driver; 64 MB is the most that is taken.
    """
    if os.path.getsize(path) > 64_000_000:
        raise ValueError("a key list of that size is a table; read it with read_jsonl")
    text = open(path, encoding="utf-8").read()
    try:
        data = json.loads(text)
    except ValueError:
        data = [json.loads(line) for line in text.splitlines() if line.strip()]
    if isinstance(data, dict):
        data = next((v for v in data.values() if isinstance(v, list)), list(data))
    keys = [x if isinstance(x, str) else next((str(x[n]) for n in names if n in x), None) for x in data]
    once = list(dict.fromkeys(k for k in keys if k))
    return spark.createDataFrame([(k, i) for i, k in enumerate(once)], "key string, pos int")


def log_progress(spark: SparkSession, path: str, pattern: str = r"(\d+)\s*/\s*(\d+)") -> DataFrame:
    """(file, done, total): of each log the last line that states progress."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), "value").where(F.col("value").rlike(pattern))
    last = lines.groupBy("file").agg(F.max_by("value", "at").alias("value"))
    return last.select("file", *[F.regexp_extract("value", pattern, i).cast("bigint").alias(n) for i, n in ((1, "done"), (2, "total"))])


def scan_tree(spark: SparkSession, path: str, pattern: str, endings: tuple[str, ...], skip: tuple[str, ...] = (".git", "__pycache__")) -> DataFrame:
    """(path, line, text) of the lines that match in the files with the given endings below a folder."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{{{','.join(endings)}}}")
    named = files.select(F.col("_metadata.file_path").alias("path"), "value")
    for part in skip:
        named = named.where(~F.contains("path", F.lit(f"/{part}/")))
    lines = named.select("path", F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return lines.where(F.col("text").rlike(pattern)).select("path", (F.col("line") + 1).alias("line"), "text")


def write_jsonl(df: DataFrame, path: str, gzip: bool = False, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "gzip" if gzip else "none").json(path)


def append_filled(df: DataFrame, path: str, text: str) -> int:
    """Appends the rows whose text isn't blank, so that a later run retries the others; returns how many those are."""
    full = F.coalesce(F.trim(F.col(text)) != "", F.lit(False))
    df.where(full).write.mode("append").json(path)
    return df.where(~full).count()


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the old table and swaps folders by renaming, so that a reader sees the old or the new one, also when ``df`` reads the old."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    make = jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(conf)
    had = fs.exists(make(path))
    if had:
        fs.rename(make(path), make(old))
    fs.rename(make(new), make(path))
    if had:
        fs.delete(make(old), True)


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)


def _rows(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows; write larger results as a table")
    return rows


def write_csv(df: DataFrame, path: str, most: int = 100_000) -> bool:
    """One CSV file with a header; no rows, no file. Returns whether it was written."""
    import csv

    rows = _rows(df, most)
    if not rows:
        return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([df.columns, *[list(r) for r in rows]])
    return True


def markdown_table(df: DataFrame, most: int = 10_000) -> str:
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
    body = [df.columns, ["---"] * len(df.columns), *_rows(df, most)]
    return "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in body)


def write_report(path: str, sections: dict[str, DataFrame], keep_old: bool = True) -> None:
    """A Markdown report of titled tables; an older one is kept with the suffix ``.bak``."""
    if keep_old and os.path.exists(path):
        shutil.copy2(path, f"{path}.bak")
    text = "\n\n".join(f"## {title}\n\n{markdown_table(df)}" for title, df in sections.items())
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "w", encoding="utf-8") as f:
        f.write(text + "\n")
    os.replace(temporary, path)


def write_json_report(df: DataFrame, path: str) -> None:
    """The rows of a small report as one JSON array."""
    rows = [json.loads(r[0]) for r in _rows(df.select(F.to_json(F.struct("*"))), 100_000)]
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=1)
    os.replace(temporary, path)
