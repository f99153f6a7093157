"""Filling containers of fixed capacity with documents: lexical retrieval packing over a sharded BM25 index."""

from __future__ import annotations

import base64
import functools
import heapq
import os
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hintloom.lineage import cut

WORD = re.compile(r"[^\W_]+")
#: The usual pattern by which byte-level BPE vocabularies split texts first (a fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of a shard on average; an index and its scores fit a task's memory many times over.
SHARD = 1500
#: A shard's containers that are filled less than this are opened again and their items packed with those of other shards.
REOPEN = 0.97
K1, B = 1.5, 0.75
#: Letters from which a word counts as long in a sketch; words whose hashes a task keeps.
LONG_WORD, WORDS_KEPT = 6, 200_000
#: Largest vocabulary file that is sent to the tasks.
VOCABULARY = 64_000_000


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class WordHashes(dict):
    """64-bit hashes of words, kept for the words of a task; begun anew when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) - 2**63
        return value


def sketch(text: str | None, hashes: WordHashes) -> tuple[int, int]:
    """The two least hashes of a text's longer words, of all words if none is long: texts with many words in common tend to share them."""
    words = set(WORD.findall((text or "").lower()))
    long = [w for w in words if len(w) >= LONG_WORD] or words
    least = heapq.nsmallest(2, map(hashes.__getitem__, long))
    return (least[0], least[-1]) if least else (-(2**63), -(2**63))


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """(id, text, n_tokens, m1, m2): the tokens of each whole text under the vocabulary file ``tokenizer`` and its sketch; null counts as empty.

    The file is read on the driver and sent to the tasks, a few MB; one of more than ``VOCABULARY`` bytes is refused.
    """
    if os.path.getsize(tokenizer) > VOCABULARY:
        raise ValueError("a vocabulary is meant to be a few MB")
    with open(tokenizer, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, hashes = _encoding(shared.value).encode_ordinary, WordHashes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [len(encode(t)) if t else 0 for t in texts]
            least = [sketch(t, hashes) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(counts, pa.int64()), *[pa.array([m[i] for m in least], pa.int64()) for i in (0, 1)]], ["id", "text", "n_tokens", "m1", "m2"])

    base = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return base.mapInArrow(run, "id bigint, text string, n_tokens bigint, m1 bigint, m2 bigint")


class Bm25:
    """The inverted index of a shard; ``scores`` gives every document's BM25 score for all words of a seed document."""

    def __init__(self, texts: list[str | None]):
        docs = [WORD.findall((t or "").lower()) for t in texts]
        self.n = n = len(docs)
        owner = np.repeat(np.arange(n), [len(d) for d in docs])
        term = pa.array([w for d in docs for w in d], pa.string()).dictionary_encode().indices.to_numpy().astype(np.int64)
        pair, tf = np.unique(term * max(n, 1) + owner, return_counts=True)
        term, doc = pair // max(n, 1), pair % max(n, 1)
        length = np.bincount(owner, minlength=n)
        df = np.bincount(term) if len(term) else np.zeros(0, np.int64)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(length.mean() if n else 0, 1e-9))
        self.doc, self.weight, self.df = doc, idf[term] * tf * (K1 + 1) / (tf + norm[doc]), df
        self.start = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        order = np.argsort(doc, kind="stable")
        self.terms = np.split(term[order], np.cumsum(np.bincount(doc, minlength=n))[:-1]) if n else []
        self.known: dict[int, np.ndarray] = {}

    def scores(self, seed: int) -> np.ndarray:
        """Computed once for each seed, whichever kinds of containers it seeds."""
        if seed not in self.known:
            terms = self.terms[seed]
            n = self.df[terms]
            ends = np.cumsum(n)
            at = np.repeat(self.start[terms] - ends + n, n) + np.arange(int(n.sum()))
            self.known[seed] = np.bincount(self.doc[at], self.weight[at], minlength=self.n)
        return self.known[seed]


def fill(sizes: np.ndarray, capacity: int, neighbours: Callable[[int], np.ndarray] | None) -> list[list[int]]:
    """Containers of item numbers, each with at most ``capacity`` in all; no item may be larger than that.

    The largest unused item seeds a container. Its unused neighbours enter in the order of their scores while the room they would leave
    can still be used, which is when they fill it or some unused item fits it; then the largest items that fit close the gap.
    ``neighbours`` gives every item's score for a seed; without it only the last step is taken.
    """
    order = sorted(range(len(sizes)), key=lambda i: (int(sizes[i]), -i))
    free = [(int(sizes[i]), -i) for i in order]
    unused = np.ones(len(sizes), bool)
    out = []

    def take(item: int) -> None:
        unused[item] = False
        del free[bisect_right(free, (int(sizes[item]), -item)) - 1]

    while free:
        seed = -free[-1][1]
        box, room = [seed], capacity - int(sizes[seed])
        take(seed)
        if neighbours is not None and room and free and free[0][0] <= room:
            scores = neighbours(seed)
            near = np.flatnonzero(unused & (scores > 0) & (sizes <= room))
            for item in near[np.lexsort((near, -scores[near]))]:
                left = room - int(sizes[item])
                if left < 0:
                    continue
                if left == 0 or left >= capacity // 8 or sizes[item] >= room * 0.9:
                    box.append(int(item))
                    take(int(item))
                    room = left
                if not free or free[0][0] > room:
                    break
        while free and free[0][0] <= room:
            item = -free[bisect_right(free, (room, 1)) - 1][1]
            box.append(item)
            room -= int(sizes[item])
            take(item)
        out.append(box)
    return out


def _pack(frame: pd.DataFrame, kinds: list[tuple[str, int]], prefix: str, first: bool) -> pd.DataFrame:
    """Packs one shard for every kind, or a group of reopened items; rows of (container_kind, container, id, chunk, n_tokens, used, text).

    Containers are named by their number in the shard, and the pieces of a divided document by its row there, so that repeated ids do no
    harm. The text is kept only where the first pass leaves a container to be reopened.
    """
    frame = frame.sort_values([c for c in ("id", "chunk") if c in frame], kind="stable").reset_index(drop=True)
    index = Bm25(frame["text"].tolist()) if first else None
    rows = []
    for kind, capacity in kinds:
        part = frame if first else frame[frame["container_kind"] == kind].reset_index(drop=True)
        if not len(part):
            continue
        index = index if first else Bm25(part["text"].tolist())
        ids, texts, total = part["id"].tolist(), part["text"].tolist(), part["n_tokens"].to_numpy()
        whole = total // capacity if first else np.zeros(len(part), np.int64)
        rest = total - whole * capacity
        for i in np.flatnonzero(whole):
            rows += [(kind, f"{prefix}-{i}.{c}", ids[i], c, capacity, capacity, None) for c in range(whole[i])]
        left = np.flatnonzero((rest > 0) | (total == 0))
        chunk, size = (whole if first else part["chunk"].to_numpy())[left].tolist(), rest[left]
        near = lambda i, left=left, index=index: index.scores(left[i])[left]
        for n, box in enumerate(fill(size, capacity, near)):
            used = int(size[box].sum())
            open_ = first and used < capacity * REOPEN
            rows += [(kind, f"{prefix}-{n}", ids[left[i]], chunk[i], int(size[i]), used, texts[left[i]] if open_ else None) for i in box]
    return pd.DataFrame(rows, columns=["container_kind", "container", "id", "chunk", "n_tokens", "used", "text"])


PACKED = "container_kind string, container string, id bigint, chunk bigint, n_tokens bigint, used bigint, text string"


def pack_documents(documents: DataFrame, id_col: str, text_col: str, containers: DataFrame, kind_col: str, capacity_col: str, tokenizer: str) -> DataFrame:
    """(container_kind, capacity, container, id, chunk, n_tokens, used): where each document, or piece of one, lies in the containers of each kind.

    Documents are sorted by their sketch and cut into shards of about ``SHARD``, so that documents with words in common meet however many
    there are, and any number of like ones are spread over shards of that size. A shard is packed by ``fill`` with a BM25 index over its
    own texts. Only a document larger than the capacity is divided: into full containers, and a last piece that
    is packed like a document. Containers filled less than ``REOPEN`` are opened again and their items packed once more across shards, in
    groups of bounded size with an index of their own, so that shards leave no gaps at their ends. ``used`` is the fill of the container.

    Null and blank texts have their tokens counted, none or few, and lie in a container too. Repeated documents and ids are packed each;
    rows with a null id are left out. Kinds must be few (their number is checked); a null or non-positive capacity is refused. Empty
    tables give an empty result; other columns are ignored.
    """
    kinds = [(r[0], int(r[1] or 0)) for r in containers.select(kind_col, capacity_col).distinct().orderBy(kind_col).limit(1001).collect()]
    if len(kinds) > 1000 or any(c < 1 for _, c in kinds):
        raise ValueError("capacities must be positive, and kinds at most a thousand")
    counted = cut(token_counts(documents, id_col, text_col, tokenizer))
    shards = max(1, -(-counted.count() // SHARD))

    def pack_shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(frames)
        if frames:
            yield _pack(pd.concat(frames, ignore_index=True), kinds, f"s{TaskContext.get().partitionId()}", True)

    sharded = counted.repartitionByRange(shards, "m1", "m2", F.xxhash64("id")).select("id", "text", "n_tokens")
    first = cut(sharded.mapInPandas(pack_shard, PACKED))
    capacity = F.create_map(*[F.lit(x) for k in kinds for x in k]) if kinds else F.lit(None)
    capacity = capacity[F.col("container_kind")] if kinds else F.lit(1)
    firm = F.col("used") >= capacity * REOPEN
    loose = first.where(~firm)
    groups = max(1, -(-loose.count() // (SHARD * max(1, len(kinds)))))
    again = loose.withColumn("group", F.pmod(F.xxhash64("id", "chunk"), F.lit(groups))).groupBy("container_kind", "group").applyInPandas(lambda key, f: _pack(f, kinds, f"g{key[1]}", False), PACKED)
    return first.where(firm).union(again).select("container_kind", capacity.cast("bigint").alias("capacity"), "container", "id", "chunk", "n_tokens", "used")


def fill_rates(packed: DataFrame) -> DataFrame:
    """Per kind: containers, their capacity, and the share of it that is used, rounded to six places."""
    each = packed.groupBy("container_kind", "capacity", "container").agg(F.max("used").alias("used"))
    sums = each.groupBy("container_kind", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("used"))
    return sums.withColumn("fill_rate", F.round(F.col("used") / (F.col("containers") * F.col("capacity")), 6))
