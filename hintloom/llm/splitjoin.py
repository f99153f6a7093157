"""Records of evaluation splits that are also in the training split: edit-distance segment join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintloom.functions.words import at_least, shingles, words
from hintloom.llm.grams import as_lists, common_shingles, rare_first, shingle_runs, shingle_sets
from hintloom.lineage import cut

#: Shingle length in words; words of a segment.
SHINGLE, SEGMENT = 3, 8
#: 64-bit words of the sketch of a text's shingles.
SKETCH = 4


def origin_key(key: Column) -> Column:
    """``dataset/split/index`` without blanks, letter case and leading zeros; null unless there are three parts that aren't empty."""
    parts = F.split(F.lower(F.regexp_replace(key, r"[\p{Z}\s]+", "")), "/")
    index = F.regexp_replace(F.get(parts, F.lit(2)), "^0+(?=.)", "")
    whole = (F.size(parts) == 3) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "") & (index != "")
    return F.when(whole, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), index))


def _coded(text: Column) -> Column:
    """The words as a string of one character each, so that edits of characters are edits of words; a code can stand for several words."""
    code = F.transform(F.split(text, " "), lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(0xC000)) + F.lit(0x1000)), 4, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-16BE")


def _sketch(side: str) -> list[str]:
    return [f"{side}{i}" for i in range(SKETCH)]


def _numbered(texts: DataFrame, fields: str, of_batch: Callable[[np.ndarray, np.ndarray], list]) -> DataFrame:
    """``of_batch`` over the distinct shingles of a batch of (cid, text) and their offsets; it gives the columns of ``fields`` after ``cid``."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("cid"), *of_batch(*shingle_sets(batch.column("text"), SHINGLE))], ["cid", *names])

    return texts.select("cid", "text").mapInArrow(run, f"cid bigint, {fields}")


def _edits_allowed(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many edits of words leave a text of ``n`` distinct shingles similar: each takes away three of them and puts in three at most."""
    return np.floor(n * (1 - threshold) / (3 * (1 + threshold)) + 1e-9).astype(np.int64)


def segments(texts: DataFrame, threshold: float, hot: np.ndarray, weight: np.ndarray) -> DataFrame:
    """(cid, edits, words, at, segment) of (cid, text): k + 1 disjoint segments of each text, k being the edits that leave it similar, as far as segments have room.

    A text within k edits keeps one of them, moved by k words at most. The words are divided into k + 1 equal parts, and of each part the
    run of ``SEGMENT`` words of which the fewest shingles are common is its segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            runs, starts = shingle_runs(batch.column("text"), SEGMENT)
            k = np.minimum(_edits_allowed(np.diff(shingle_sets(batch.column("text"), SHINGLE)[1]), threshold), (np.diff(starts) + SEGMENT - 1) // SEGMENT - 1) if batch.num_rows else []
            three, threes = shingle_runs(batch.column("text"), SHINGLE)
            at = np.minimum(np.searchsorted(hot, three), max(len(hot) - 1, 0))
            heavy = np.where(hot[at] == three, weight[at], 0) if len(hot) else np.zeros(len(three), np.int64)
            heavy = np.concatenate([[0], np.cumsum(heavy > 0)])
            heavy = heavy[SEGMENT - SHINGLE + 1 :] - heavy[: -(SEGMENT - SHINGLE + 1)] if len(heavy) > SEGMENT - SHINGLE + 1 else heavy[:0]
            for i, edits in enumerate(k):
                n_runs = int(starts[i + 1] - starts[i])
                if not n_runs:
                    continue
                n_words = n_runs + SEGMENT - 1
                bounds = np.arange(edits + 2) * n_words // (edits + 1)
                for lo, hi in zip(bounds[:-1], bounds[1:] - SEGMENT + 1):
                    best = int(lo + np.argmin(heavy[threes[i] + lo : threes[i] + hi]))
                    rows.append((i, int(edits), n_words, best, int(runs[starts[i] + best].view(np.int64))))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(columns[0], pa.int64())), *[pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.int32(), pa.int32(), pa.int64()))]], ["cid", "edits", "words", "at", "segment"])

    return texts.select("cid", "text").mapInArrow(run, "cid bigint, edits int, words int, at int, segment bigint")


def substrings(texts: DataFrame) -> DataFrame:
    """(cid, words, at, segment) of (cid, text): every run of ``SEGMENT`` words with its position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, starts = shingle_runs(batch.column("text"), SEGMENT)
            n = np.diff(starts)
            owner = np.repeat(np.arange(batch.num_rows), n)
            at = np.arange(len(runs)) - np.repeat(starts[:-1], n)
            yield pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(owner)), pa.array((n[owner] + SEGMENT - 1).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(runs.view(np.int64))], ["cid", "words", "at", "segment"])

    return texts.select("cid", "text").mapInArrow(run, "cid bigint, words int, at int, segment bigint")


def pieces(texts: DataFrame, threshold: float, hot: np.ndarray, weight: np.ndarray) -> DataFrame:
    """(cid, n, s0 … s3, segs) of (cid, text): the shingles of each text that suffice to meet every similar text, their number and a sketch of all.

    A text of n shingles and similarity t to another shares at least t * n of them, so k = n - ceil(t * n) may be lost and any k + 1 hold
    a shared one. Both sides take their k + 1 first ones in one order, rare before common, so the first shared one is among those of either.
    """

    def of_batch(grams: np.ndarray, offsets: np.ndarray) -> list:
        n = np.diff(offsets)
        order = rare_first(grams, np.repeat(np.arange(len(n)), n), hot, weight)
        need = np.minimum(n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, n)
        kept = order[np.arange(len(grams)) - np.repeat(offsets[:-1], n) < np.repeat(need, n)]
        bit = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
        sketch = [np.bitwise_or.reduceat(np.where((bit >> np.uint64(6)) == part, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), offsets[:-1]) for part in range(SKETCH)]
        return [pa.array(n.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in sketch], as_lists(grams[kept], np.concatenate([[0], np.cumsum(need)]))]

    return _numbered(texts, f"n int, {', '.join(f'{c} bigint' for c in _sketch('s'))}, segs array<bigint>", of_batch)


def _side(described: DataFrame, side: str, *more: Column) -> DataFrame:
    """``pieces`` of one side under names of its own: the id, n and the sketch, with ``more``."""
    return described.select(F.col("cid").alias(f"{side}_id"), F.col("n").alias(f"n{side[0]}"), *[F.col(s).alias(t) for s, t in zip(_sketch("s"), _sketch(side[0]))], *more)


def _may(threshold: float) -> Column:
    """Whether sizes and sketches of two sides leave a similarity of ``threshold`` possible: shingles with different bits aren't shared."""
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(_sketch("l"), _sketch("r"))), F.lit(0))
    total = F.col("nl") + F.col("nr")
    return ((total - differ) / 2 >= total * (threshold / (1 + threshold)) - 1e-9) & (F.least("nl", "nr") >= F.greatest("nl", "nr") * threshold)


def within_edits(left: DataFrame, right: DataFrame, described: tuple[DataFrame, DataFrame], threshold: float, hot: np.ndarray, weight: np.ndarray) -> DataFrame:
    """(left_id, right_id, edits) of the pairs within the edits of words that leave a text similar: the segment join.

    The left texts (evaluation) are cut into segments; the right ones (training) are matched by their substrings at the positions that
    the edits allow; sketches (``described``) drop chance matches; banded dynamic programming counts the edits. Words are coded as single characters for it, and a code may stand for
    several words, so a count can be too low: it only rejects pairs, and the shingle sets confirm those that pass.
    """
    l = segments(left, threshold, hot, weight).select(F.col("cid").alias("left_id"), "edits", F.col("words").alias("wl"), F.col("at").alias("al"), "segment")
    r = substrings(right).select(F.col("cid").alias("right_id"), F.col("words").alias("wr"), F.col("at").alias("ar"), "segment")
    allowed = (F.abs(F.col("al") - F.col("ar")) <= F.col("edits")) & (F.abs(F.col("wl") - F.col("wr")) <= F.col("edits"))
    met = l.join(r, "segment").where(allowed).select("left_id", "right_id", F.col("edits").alias("k")).distinct()
    may = met.join(_side(described[0], "left"), "left_id").join(_side(described[1], "right"), "right_id").where(_may(threshold)).select("left_id", "right_id", "k")
    both = _with_texts(may, left, right)
    coded = both.withColumns({"cl": _coded(F.col("tl")), "cr": _coded(F.col("tr"))}).withColumn("edits", F.expr("levenshtein(cl, cr, k)"))
    return coded.where((F.col("edits") >= 0) & _similar(threshold)).select("left_id", "right_id", "edits")


def _with_texts(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    tl, tr = left.select(F.col("cid").alias("left_id"), F.col("text").alias("tl")), right.select(F.col("cid").alias("right_id"), F.col("text").alias("tr"))
    return pairs.join(tl, "left_id").join(tr, "right_id")


def _similar(threshold: float) -> Column:
    return at_least(*[shingles(F.split(t, " "), SHINGLE) for t in ("tl", "tr")], threshold)


def similar_across(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs (left_id, right_id, edits) of texts of two sets of (cid bigint, text) whose shingle similarity is at least ``threshold``.

    ``cid`` must be unique in each set and ``text`` words joined by blanks; texts of fewer than three words are similar to nothing. The
    segment join of ``within_edits`` finds the pairs of few edits. The stated similarity is one of shingle sets, though, which moving a
    sentence hardly changes while it takes many edits; so texts are also joined by their rarest ``pieces`` at any position. A sketch of
    256 bits bounds what a matched pair can share and drops most chance matches inside the join; the shingle sets decide, for pairs that
    the segment join hasn't found. ``edits`` is -1 for these.
    """
    left, right = (df.select("cid", "text").where(F.size(F.split("text", " ")) >= SHINGLE) for df in (left, right))
    hot, weight = common_shingles(right.select("text"), lambda batch: shingle_sets(batch.column("text"), SHINGLE)[0])
    described = tuple(cut(pieces(df, threshold, hot, weight)) for df in (left, right))
    near = cut(within_edits(left, right, described, threshold, hot, weight))
    l, r = (_side(df, side, F.explode("segs").alias("seg")) for df, side in zip(described, ("left", "right")))
    rest = l.join(r, "seg").where(_may(threshold)).select("left_id", "right_id").distinct().join(near, ["left_id", "right_id"], "left_anti")
    return near.union(_with_texts(rest, left, right).where(_similar(threshold)).select("left_id", "right_id", F.lit(-1).alias("edits")))


def split_overlaps(df: DataFrame, id_col: str, key_col: str, text_col: str, split_col: str, train: str = "train", evaluation: tuple[str, ...] = ("holdout", "valid"), threshold: float = 0.5, source_col: str | None = None) -> dict[str, DataFrame]:
    """What the evaluation splits share with the training split.

    Three frames: ``members`` (id, side, split, source, text_class, origin) with one row per row of a named split; ``classes`` (eval_class, train_class,
    edits), pairs of different or equal texts; ``origins`` (origin), the origin keys on both sides. Equal texts form one class per side
    before the join, so a question that fills a third of the rows is compared once. Null, blank and short texts and null or malformed
    keys match nothing; rows of other splits, with a null split or a null id are left out; other columns are ignored.
    """
    side = F.when(F.trim(F.lower(F.col(split_col))) == train, "t").when(F.trim(F.lower(F.col(split_col))).isin(*evaluation), "e")
    source = F.col(source_col) if source_col else F.lit(None).cast("string")
    labels = [F.trim(F.lower(F.col(split_col))).alias("split"), source.alias("source")]
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), side.alias("side"), *labels, origin_key(F.col(key_col)).alias("origin"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    rows = rows.where("id is not null and side is not null").select("id", "side", "split", "source", "origin", F.when(F.size("w") >= SHINGLE, F.array_join("w", " ")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.concat(F.lit("\n"), F.col("id").cast("string"))))))
    texts = cut(rows.where("text is not null").groupBy("side", "digest").agg(F.min("id").alias("cid"), F.first("text").alias("text")))
    of = lambda s: texts.where(F.col("side") == s).select("cid", "text")
    pairs = similar_across(of("e"), of("t"), threshold)
    classes = pairs.select(F.col("left_id").alias("eval_class"), F.col("right_id").alias("train_class"), "edits")
    members = rows.select("id", "side", "split", "source", "digest", "origin").join(texts.select("side", "digest", F.col("cid").alias("text_class")), ["side", "digest"], "left").select("id", "side", "split", "source", "text_class", "origin")
    keyed = members.where("origin is not null").select("side", "origin").distinct()
    origins = keyed.groupBy("origin").agg(F.count("*").alias("n")).where("n = 2").select("origin")
    return {"members": members, "classes": classes, "origins": origins}


def overlap_pairs(found: dict[str, DataFrame]) -> DataFrame:
    """The pairs (a, b) of row ids, a < b, by origin or by text: the expanded form."""
    members, classes = found["members"], found["classes"]
    ev, tr = members.where("side = 'e'"), members.where("side = 't'")
    by_key = ev.select("origin", F.col("id").alias("x")).join(found["origins"], "origin", "left_semi").join(tr.select("origin", F.col("id").alias("y")), "origin").select("x", "y")
    ex = ev.select(F.col("text_class").alias("eval_class"), F.col("id").alias("x"))
    ty = tr.select(F.col("text_class").alias("train_class"), F.col("id").alias("y"))
    by_text = classes.join(ex, "eval_class").join(ty, "train_class").select("x", "y")
    return by_key.union(by_text).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def overlap_rates(found: dict[str, DataFrame]) -> DataFrame:
    """(split, source, n_rows, by_key, by_question, by_either): the evaluation rows of each split and source, and how many of them are also in training.

    A row counts once however many training rows it meets: origins and classes are matched, the pairs aren't expanded.
    """
    classes = found["classes"].select(F.col("eval_class").alias("text_class"), F.lit(True).alias("q")).distinct()
    origins = found["origins"].withColumn("k", F.lit(True))
    ev = found["members"].where("side = 'e'").join(origins, "origin", "left").join(classes, "text_class", "left")
    k, q = (F.coalesce(F.col(c), F.lit(False)) for c in ("k", "q"))
    return ev.groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count_if(k).alias("by_key"), F.count_if(q).alias("by_question"), F.count_if(k | q).alias("by_either"))
