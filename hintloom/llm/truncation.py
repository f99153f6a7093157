"""Texts that a limit or a broken transfer cut short."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintloom.lineage import cut
from hintloom.llm.endings import MEASURED, at_limit, before_mark, ending, is_shell, length_limits, measures, source_name, stripped

THINK_OPEN, THINK_CLOSE, THOUGHT_CLOSE = "<think>", "</think>", "</thought>"


def output_cut(text: str | None, closing_tag: str) -> tuple[str | None, bool]:
    """(how, whole) of an output of thought, closing tag, explanation, fenced code and perhaps a last sentence.

    ``how`` is what it stops in, null if it ends well or is a shell. Nothing proves that the last sentence isn't missing.
    """
    if is_shell(text):
        return None, True
    how = ending(text)
    if how in ("code", "mark"):
        return how, False
    thought, tag, rest = stripped(text).rpartition(closing_tag)
    if not tag:
        return "thought", False
    return "layout" if rest.count("```") < 2 else how, False


def trace_cut(text: str | None, think: str | None, response: str | None, answer: str | None) -> tuple[str | None, bool]:
    """(how, whole) of a trace of thinking and response: what it stops in, null if it ends well, and whether its own row proves it whole.

    ``layout``: it is a proper beginning of what its own thinking and response give, or the thinking isn't followed by a response.
    A trace whose thinking lacks its end but whose response is there ends well. It is whole if it ends well and is what its thinking and
    response give, be the response a placeholder or only zero-width signs.
    """
    if is_shell(text):
        return None, True
    base, bare = before_mark(text), stripped(text)
    if base != bare:
        return "mark", False
    laid_out = f"{THINK_OPEN}\n{think}\n{THINK_CLOSE}\n{response}"
    said = stripped(response)
    opened = base.startswith(THINK_OPEN)
    if opened and (response or "").strip() and bare == stripped(laid_out) or opened and said and base.endswith(said):
        how = ending(said, answer)
        return how, how is None
    built = stripped(laid_out if stripped(think) and said else said or think)
    if len(base) < len(built) and built.startswith(base):
        return "layout", False
    _, closed, tail = base.rpartition(THINK_CLOSE)
    if opened and not stripped(tail if closed else ""):
        return "layout", False
    how = ending(tail if closed else base, answer)
    return how, how is None and base == built


def inspected(df: DataFrame, rule: Callable, *columns: Column) -> DataFrame:
    """(field, id, source, lengths, h, how, whole) of (field, id, source, text, …): one pass over the texts for their lengths and endings.

    ``rule`` takes the text and the further columns. Shells have null lengths.
    """
    names = [f"_{i}" for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = [measures(t) for t in texts]
            found = [rule(*row) for row in zip(texts, *[batch.column(n).to_pylist() for n in names])]
            made = [pa.array([x[0] for x in sizes], pa.list_(pa.int32())), pa.array([x[1] for x in sizes], pa.int64()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("field", "id", "source")] + made, ["field", "id", "source", "lengths", "h", "how", "whole"])

    base = df.select("field", "id", "source", "text", *[c.alias(n) for n, c in zip(names, columns)])
    return base.mapInArrow(run, f"field string, id {base.schema['id'].dataType.simpleString()}, source string, {MEASURED}, how string, whole boolean")


def trace_values(df: DataFrame) -> DataFrame:
    """``inspected`` traces of (line_no, source_model, reasoning_trace, model_think, model_response, answer)."""
    base = df.select(F.lit("reasoning_trace").alias("field"), F.col("line_no").alias("id"), source_name(F.col("source_model")).alias("source"), F.col("reasoning_trace").alias("text"), "model_think", "model_response", "answer")
    return inspected(base, trace_cut, F.col("model_think"), F.col("model_response"), F.col("answer"))


def output_values(df: DataFrame) -> DataFrame:
    """``inspected`` outputs of (line_no, source, flash_output, doubao_output), each with its own closing tag."""
    fields = {"flash_output": THOUGHT_CLOSE, "doubao_output": THINK_CLOSE}
    entries = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("text"), F.lit(tag).alias("tag")) for k, tag in fields.items()])
    return inspected(df.select(F.col("line_no").alias("id"), source_name(F.col("source")).alias("source"), F.inline(entries)), output_cut, F.col("tag"))


def field_values(traces: DataFrame, joined: DataFrame) -> DataFrame:
    return trace_values(traces).union(output_values(joined))


def as_measured(values: DataFrame) -> DataFrame:
    """What ``length_limits`` needs of ``inspected`` values."""
    return values.select("field", "source", "h", "lengths", F.col("how").isNotNull().alias("unfinished"))


def cut_values(values: DataFrame) -> DataFrame:
    """(field, id, source, there, reason) of ``inspected`` values: ``there`` is false for shells, ``reason`` null for whole values.

    Lengths in all encodings, grouped by field and source, expose the limits of the stores. A value exactly as long as a limit has the
    reason ``limit``, however it ends, unless its own row proves it whole; the endings decide the others. The texts are read once and
    only lengths and verdicts are kept of them. Null ids are kept as they are; empty tables give an empty result.
    """
    kept = cut(values)
    marked = at_limit(kept, length_limits(as_measured(kept)))
    reason = F.when(F.col("limit").isNotNull() & ~F.col("whole"), "limit").otherwise(F.col("how"))
    return marked.select("field", "id", "source", F.col("lengths").isNotNull().alias("there"), reason.alias("reason"))


def cut_rates(values: DataFrame) -> DataFrame:
    """Per field and source of ``cut_values``: values that are no shells, how many of them are cut and how many of these at a limit, and the share of the cut ones, rounded to six places."""
    counted = values.groupBy("field", "source").agg(F.count_if("there").alias("n_values"), F.count("reason").alias("n_cut"), F.count_if(F.col("reason") == "limit").alias("n_limit"))
    return counted.withColumn("rate", F.round(F.try_divide("n_cut", "n_values"), 6))
