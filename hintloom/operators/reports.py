"""Reports over runs: conditions, comparisons, verdicts, tokens, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def condition_summary(df: DataFrame, group: list[str]) -> DataFrame:
    """One row per condition of (question_id, repeat_idx, status, is_correct, prompt_tokens, completion_tokens, cost).

    ``attempts`` is the number of different questions times that of different repeats, at least one. The success rate counts the
    successful rows against the attempts. A repeat's accuracy counts its correct successful rows against all questions, so missing
    attempts are wrong; ``mean_accuracy`` and ``accuracy_std`` are the plain mean and population deviation over repeats. A question is won
    by a majority if its mean over all its rows, nulls counting as 0, exceeds a half. Averages are over successful rows, nulls counting as 0.
    Two aggregations by group and question or repeat come before the one by group, so no group is gathered.
    """
    ok = F.col("status") == "success"
    correct = F.coalesce(F.col("is_correct"), F.lit(0))
    base = df.withColumn("repeat_idx", F.coalesce("repeat_idx", F.lit(0)))
    questions = base.groupBy(*group, "question_id").agg((F.avg(correct) > 0.5).cast("int").alias("won")).groupBy(*group).agg(F.count("*").alias("questions"), F.sum("won").alias("majority_correct"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    per_repeat = base.groupBy(*group, "repeat_idx").agg(
        F.sum(F.when(ok, correct).otherwise(0)).alias("correct"), F.count_if(ok).alias("ok"),
        *[F.sum(F.when(ok, zero(c))).alias(c) for c in ("prompt_tokens", "completion_tokens", "cost")],
    )
    joined = per_repeat.join(questions, group)
    accuracy = F.col("correct") / F.col("questions")
    out = joined.groupBy(*group, "questions", "majority_correct").agg(
        F.count("*").alias("repeats"), F.sum("ok").alias("n_ok"), F.avg(accuracy).alias("mean"), F.stddev_pop(accuracy).alias("std"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "cost")],
    )
    share = lambda c, digits: F.round(F.coalesce(F.try_divide(F.col(c), F.col("n_ok")), F.lit(0.0)), digits)
    attempts = F.col("questions") * F.greatest("repeats", F.lit(1))
    return out.select(
        *group, "questions", "repeats", attempts.alias("attempts"), F.round(F.col("n_ok") / attempts * 100, 2).alias("success_rate"), F.round(F.col("mean") * 100, 2).alias("mean_accuracy"),
        F.round(F.coalesce("std", F.lit(0.0)) * 100, 2).alias("accuracy_std"), F.round(F.col("majority_correct") / F.col("questions") * 100, 2).alias("majority_accuracy"),
        share("prompt_tokens", 1).alias("avg_prompt_tokens"), share("completion_tokens", 1).alias("avg_completion_tokens"), share("cost", 8).alias("avg_cost"),
    )


def comparison(summary: DataFrame, group: list[str], mode: str, base: str, other: str) -> DataFrame:
    """Per group with both modes, what the other gains over the base in accuracy and tokens."""
    measures = {"mean_accuracy": 2, "avg_completion_tokens": 1, "avg_cost": 8}
    wide = summary.groupBy(*group).agg(*[F.max(F.when(F.col(mode) == m, F.col(c))).alias(f"{tag}_{c}") for tag, m in (("base", base), ("other", other)) for c in measures], F.count_distinct(F.when(F.col(mode).isin(base, other), F.col(mode))).alias("modes"))
    deltas = [F.round(F.col(f"other_{c}") - F.col(f"base_{c}"), digits).alias(f"delta_{c}") for c, digits in measures.items()]
    return wide.where("modes = 2").select(*group, *[c for c in wide.columns if c.startswith(("base_", "other_"))], *deltas)


def verdict_distribution(df: DataFrame, group: list[str], status: Column) -> DataFrame:
    """(group…, status, n, share): shares within the group, six places. Counts are summed before the window, which sees one row per status."""
    counted = df.groupBy(*group, status.alias("status")).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*group)) if group else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counted.withColumn("share", F.round(F.col("n") / whole, 6))


def accepted_rate(df: DataFrame, group: list[str], status: Column) -> DataFrame:
    accepted = F.count_if(status == "AC")
    return df.groupBy(*group).agg(F.count("*").alias("n"), accepted.alias("accepted"), F.round(F.try_divide(accepted, F.count("*")), 4).alias("ac_rate"))


#: How averages treat a missing or a zero count of tokens; "first_of" takes the first of two columns that is there.
TOKEN_RULES = ("skip_missing", "skip_missing_and_zero", "missing_is_zero", "first_of")


def token_report(df: DataFrame, group: list[str], tokens: Column, rule: str, other: Column | None = None) -> DataFrame:
    """(group…, n, n_used, avg_tokens): the average under one of ``TOKEN_RULES``, four places, null if nothing is used."""
    used = {
        "skip_missing": tokens, "skip_missing_and_zero": F.nullif(tokens, F.lit(0)), "missing_is_zero": F.coalesce(tokens, F.lit(0)), "first_of": F.coalesce(tokens, other if other is not None else F.lit(None)),
    }[rule]
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.count(used).alias("n_used"), F.round(F.avg(used.cast("double")), 4).alias("avg_tokens"))


def tokens_per_accepted(df: DataFrame, group: list[str], tokens: Column, accepted: Column) -> DataFrame:
    """All tokens by accepted rows, null without any, and the mean and exact median of the accepted rows' tokens, four places."""
    t = F.when(accepted, tokens.cast("double"))
    total = F.sum(tokens.cast("double"))
    return df.groupBy(*group).agg(
        F.count_if(accepted).alias("accepted"), F.round(F.try_divide(total, F.count_if(accepted)), 4).alias("tokens_per_accepted"), F.round(F.avg(t), 4).alias("avg_accepted"), F.round(F.median(t), 4).alias("median_accepted"),
    )


def upper_median_length(df: DataFrame, group: list[str], text: Column) -> DataFrame:
    """(group…, n, mean, upper_median): of an even number of lengths the upper of the middle two. Lengths are counted first, so a group is as many rows as it has different lengths."""
    counts = df.where(text.isNotNull()).groupBy(*group, F.length(text).alias("len")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group)
    ranked = counts.withColumns({"upto": F.sum("n").over(w.orderBy("len")), "total": F.sum("n").over(w)})
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("len")))
    return ranked.groupBy(*group).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 4).alias("mean"), middle.alias("upper_median"))


def most_common(df: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, ties to the one seen first."""
    counted = df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return counted.orderBy(F.desc("n"), "seen").limit(k).select(value, "n")


def first_failure(df: DataFrame, key: str, order: str, status: Column) -> DataFrame:
    """(key, overall): the first status that isn't AC, AC without one."""
    return df.groupBy(key).agg(F.coalesce(F.min_by(F.when(status != "AC", status), F.when(status != "AC", F.col(order))), F.lit("AC")).alias("overall"))


def failing_runs(df: DataFrame, key: str, order: list[str], status: Column, length: int) -> DataFrame:
    """(key, order…): the rows that end ``length`` or more rows in a row without AC."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - length, 0)
    flagged = df.withColumns({"_ok": F.sum((status == "AC").cast("int")).over(w), "_n": F.count("*").over(w)})
    return flagged.where((F.col("_ok") == 0) & (F.col("_n") == length)).select(key, *order)


def diagnostic_picks(df: DataFrame, key: str, case: str, status: Column, size: Column) -> DataFrame:
    """(key, case, why): of each key's failures the first, the last, the first TLE and the WA of greatest size, each case once, in that order of reasons."""
    failed = df.withColumn("_s", status).where("_s <> 'AC'").withColumn("_size", size)
    picks = failed.groupBy(key).agg(F.min(case).alias("first"), F.max(case).alias("last"), F.min(F.when(F.col("_s") == "TLE", F.col(case))).alias("tle"), F.min_by(F.when(F.col("_s") == "WA", F.col(case)), F.when(F.col("_s") == "WA", F.struct(-F.col("_size"), F.col(case)))).alias("worst"))
    reasons = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(w).alias("why"), F.col(w).alias(case)) for i, w in enumerate(("first", "last", "tle", "worst"))])
    each = picks.select(key, F.inline(reasons)).where(F.col(case).isNotNull())
    return each.groupBy(key, case).agg(F.min_by("why", "o").alias("why"))


def run_statistics(df: DataFrame, group: list[str], ok: Column, attempts: Column, special: Column) -> DataFrame:
    """(group…, tasks, ok, failed, ok_rate, avg_attempts, special_total, special_ok, special_ok_rate): how a run went, four places for rates and two for attempts.

    ``special`` marks the tasks with an own rate, null if there are none. Null flags count as false, null attempts as 0.
    """
    good, own = F.coalesce(ok, F.lit(False)), F.coalesce(special, F.lit(False))
    n = F.count("*")
    return df.groupBy(*group).agg(
        n.alias("tasks"), F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"), F.round(F.count_if(good) / n, 4).alias("ok_rate"), F.round(F.sum(F.coalesce(attempts, F.lit(0))) / n, 2).alias("avg_attempts"),
        F.count_if(own).alias("special_total"), F.count_if(own & good).alias("special_ok"), F.round(F.try_divide(F.count_if(own & good), F.count_if(own)), 4).alias("special_ok_rate"),
    )


# Signs of Rust in an output, tags of blocks that are judged.
RUST = r"use std::|fn main\(\)|for\s+_\s+in\s+0\.\."
JUDGED_TAGS = ("cpp", "c++", "cc", "cxx", "python", "py")


def compile_diagnosis(df: DataFrame, group: list[str], output: Column) -> DataFrame:
    """(group…, n, rust_syntax, rust_blocks, other_blocks, no_fence) of outputs that failed to compile; null outputs count as empty."""
    text = F.coalesce(output, F.lit(""))
    tags = F.transform(F.regexp_extract_all(text, F.lit(r"```(\w+)"), F.lit(1)), F.lower)
    rust = F.size(F.filter(tags, lambda t: t.isin("rust", "rs")))
    other = F.size(F.filter(tags, lambda t: ~t.isin(*JUDGED_TAGS)))
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(text.rlike(RUST)).alias("rust_syntax"), F.sum(rust).alias("rust_blocks"), F.sum(other).alias("other_blocks"), F.count_if(F.size(tags) == 0).alias("no_fence"))


def prompt_profile(df: DataFrame, profile: Column, prompt: Column) -> DataFrame:
    """(profile, n, avg_len, max_len): prompts per budget profile and their lengths, two places."""
    n = F.length(F.coalesce(prompt, F.lit("")))
    return df.groupBy(profile.alias("profile")).agg(F.count("*").alias("n"), F.round(F.avg(n), 2).alias("avg_len"), F.max(n).cast("bigint").alias("max_len"))


def grid(keys: dict[str, list[str]], measures: DataFrame) -> DataFrame:
    """One row per combination of the listed values of the keys, in that order (``place``), with the measures of those that have any, '-' for the others."""
    at = measures.sparkSession.createDataFrame([(0,)], "place int")
    for key, values in keys.items():
        listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(values)])
        at = at.withColumn("_x", F.explode(listed)).select(*[c for c in at.columns if c != "place"], (F.col("place") * len(values) + F.col("_x.i")).alias("place"), F.col("_x.v").alias(key))
    joined = at.join(measures, list(keys), "left")
    return joined.select("place", *keys, *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in measures.columns if c not in keys])
