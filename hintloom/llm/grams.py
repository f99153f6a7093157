"""Word shingles of Arrow batches, hashed without a step per word or text in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the texts from which a shingle counts as common, and how many such shingles are kept at most: 1 MB.
COMMON, MOST_COMMON = 0.002, 50_000
#: Sizes of sets are compared in classes that grow by this factor.
STEP = 1.2


def _hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the blank-separated words of a batch, and where each text's words begin; every different word is hashed once."""
    split = pc.split_pattern(texts, " ")
    coded = split.flatten().dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy()], split.offsets.to_numpy() - split.offsets[0].as_py()


def _runs(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of a batch, text by text in order, and the text that each belongs to."""
    hashed, offsets = _hashed_words(texts)
    total = np.zeros(max(len(hashed) - k + 1, 0), np.uint64)
    for j in range(k):
        total = (total ^ hashed[j : len(hashed) - k + 1 + j]) * np.uint64(0x9FB21C651E98DF25)
        total ^= total >> np.uint64(29)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    inside = owner[: len(total)] == owner[k - 1 :]
    return total[inside], owner[: len(total)][inside]


def shingle_runs(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of a batch in their order, and their offsets; none for shorter texts."""
    total, owner = _runs(texts, k)
    return total, np.searchsorted(owner, np.arange(len(texts) + 1))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a batch of texts of at least ``k`` words, sorted per text, and their offsets."""
    total, owner = _runs(texts, k)
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    fresh = np.ones(len(total), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])
    owner, total = owner[fresh], total[fresh]
    return total, np.searchsorted(owner, np.arange(len(texts) + 1))


def as_lists(flat: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))


def common_shingles(sets: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray], share: float = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the shingles in at least about ``share`` of the sets; ``of_batch`` gives those of a batch, once per set.

    Every set is counted; a batch passes on what is common in it, so at most ``2 / share`` times the shingles of a set reach the driver
    from a batch before the sums, and as many again after. Joins are exact whatever this finds: it only sets the order of the shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, counts = np.unique(of_batch(batch), return_counts=True) if batch.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            kept = counts >= max(2, batch.num_rows * share / 2)
            yield pa.RecordBatch.from_arrays([pa.array(grams[kept].view(np.int64)), pa.array(counts[kept])], ["gram", "n"])

    total = sets.count()
    sums = sets.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, total * share))
    found = sorted((r.gram % 2**64, r.n) for r in sums.orderBy(F.desc("n"), "gram").limit(MOST_COMMON).collect())
    return np.array([g for g, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def rare_first(grams: np.ndarray, owner: np.ndarray, hot: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The order of shingles within their sets that is the same for all sets: those that aren't common first, then by count and hash."""
    heavy = np.zeros(len(grams), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        heavy = np.where(hot[at] == grams, weight[at], 0)
    return np.lexsort((grams, heavy, owner))


def size_classes(most: int) -> np.ndarray:
    """The least size of each class up to ``most``; classes grow by ``STEP``."""
    lows = [1]
    while lows[-1] <= most:
        lows.append(max(lows[-1] + 1, int(np.ceil(lows[-1] * STEP))))
    return np.array(lows, np.int64)


def prefix_keys(grams: np.ndarray, offsets: np.ndarray, salt: np.ndarray, threshold: float, hot: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key): keys of which any two sets of similarity ``threshold`` have one in common.

    Sets of sizes n and m must share o = threshold / (1 + threshold) * (n + m) shingles, so the first shared one in an order of all
    shingles is among the first n - o + 1 of one and m - o + 1 of the other. The order is rare before common; o is taken for the smallest
    partner of each size class, so that shingles which many texts have in common are keys only where they nearly make up a match.
    """
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    order = rare_first(grams, owner, hot, weight)
    place = np.arange(len(grams)) - np.repeat(offsets[:-1], n)
    lows = size_classes(int(n.max(initial=1) / threshold) + 1)
    own = np.searchsorted(lows, n, "right") - 1
    least = np.ceil(threshold * n - 1e-9).astype(np.int64)
    first, last = (np.searchsorted(lows, x, "right") - 1 for x in (least, np.floor(n / threshold + 1e-9)))
    owners, keys = [], []
    for step in range(int((last - first).max(initial=-1)) + 1):
        other = first + step
        smallest = np.maximum(lows[np.minimum(other, len(lows) - 1)], least)
        need = n - np.ceil(threshold / (1 + threshold) * (n + smallest) - 1e-9).astype(np.int64) + 1
        need[other > last] = 0
        taken = order[place < np.repeat(need, n)]
        pair = (np.minimum(own, other) * 4096 + np.maximum(own, other)).astype(np.uint64)
        mixed = (grams[taken] ^ ((pair + salt.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))[owner[taken]]) * np.uint64(0xD6E8FEB86659FD93)
        owners.append(owner[taken])
        keys.append(mixed ^ (mixed >> np.uint64(32)))
    return np.concatenate([np.zeros(0, np.int64), *owners]), np.concatenate([np.zeros(0, np.uint64), *keys])
