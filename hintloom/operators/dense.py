"""Exact inner-product search for a stated set of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query values (vectors times their length) that are sent to the tasks at once: 64 MB.
VALUES_AT_ONCE = 8_000_000


def dense_top_k(vectors: DataFrame, vec_id: str, vec: str, queries: DataFrame, query_id: str, query_vec: str, k: int = 5, positive_only: bool = False) -> DataFrame:
    """(query, vec, score, rank): the ``k`` vectors of greatest inner product, rounded to six places, ties to the lower id.

    Exact: every vector is compared with every query, in blocks of queries, one matrix product per Arrow batch; a batch passes on no more
    than its ``k`` best and their ties per query. Null vectors, and vectors of another length than the query's, match nothing.
    """
    base = vectors.select(F.col(vec_id).alias("vec"), F.col(vec).cast("array<double>").alias("v")).where("vec is not null and v is not null")
    asked = queries.select(F.col(query_id).alias("query"), F.col(query_vec).cast("array<double>").alias("v")).where("v is not null")
    width = asked.agg(F.max(F.size("v"))).first()[0] or 1
    blocks = max(1, -(-asked.count() * width // VALUES_AT_ONCE))
    schema = f"query {asked.schema['query'].dataType.simpleString()}, vec {base.schema['vec'].dataType.simpleString()}, score double"
    out = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        rows = part.collect()
        groups = {n: ([r["query"] for r in rows if len(r["v"]) == n], np.array([r["v"] for r in rows if len(r["v"]) == n])) for n in {len(r["v"]) for r in rows}}
        shared = vectors.sparkSession.sparkContext.broadcast(groups)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                offsets = batch.column("v").offsets.to_numpy()
                values = batch.column("v").values.to_numpy(zero_copy_only=False)
                for n, (names, matrix) in shared.value.items():
                    at = np.flatnonzero(np.diff(offsets) == n)
                    if not len(at):
                        continue
                    scores = np.round(np.nan_to_num(values[offsets[at][:, None] + np.arange(n)] @ matrix.T, nan=-np.inf), 6)
                    for j, name in enumerate(names):
                        s = scores[:, j]
                        keep = s > (0 if positive_only else -np.inf)
                        if keep.sum() > k:
                            keep &= s >= np.partition(s[keep], -k)[-k]
                        i = np.flatnonzero(keep)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), batch_type(name)), batch.column("vec").take(pa.array(at[i])), pa.array(s[i])], ["query", "vec", "score"])

        def batch_type(name):
            return pa.string() if isinstance(name, str) else pa.int64()

        found = base.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
