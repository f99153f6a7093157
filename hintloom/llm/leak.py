"""Evaluation texts inside a training corpus: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hintloom.lineage import cut

WORD = re.compile(r"[^\W_]+")
#: Words per block of the shift table.
BLOCK = 2
#: Characters of item texts whose passages a task holds at once, about 100 MB of them; more are searched in blocks.
CHARS_AT_ONCE = 1_500_000


class PatternTable:
    """The passages of ``length`` consecutive words of some items, ready to be searched for.

    ``shift`` maps a block of words to how far the window can move on when the block ends it, 0 if a passage may end there; ``buckets``
    maps the last block of a passage to the passages that end with it, each with its items. A block in no passage moves the window by
    all but its own words. Items of fewer words have no passage.
    """

    def __init__(self, items: list[tuple[str, str]], length: int):
        self.length = length
        self.far = length - BLOCK + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.buckets: dict[tuple[str, ...], dict[tuple[str, ...], set[str]]] = {}
        for item, text in items:
            words = WORD.findall((text or "").lower())
            for start in range(len(words) - length + 1):
                passage = tuple(words[start : start + length])
                ends = self.buckets.setdefault(passage[-BLOCK:], {})
                if passage in ends:
                    ends[passage].add(item)
                    continue
                ends[passage] = {item}
                for at in range(length - BLOCK + 1):
                    block = passage[at : at + BLOCK]
                    self.shift[block] = min(self.shift.get(block, self.far), length - BLOCK - at)

    def items_in(self, text: str | None) -> set[str]:
        """The items of which ``text`` holds a passage, across line breaks and punctuation."""
        words = WORD.findall((text or "").lower())
        found: set[str] = set()
        end, length, shift, far = self.length, self.length, self.shift, self.far
        while end <= len(words):
            block = tuple(words[end - BLOCK : end])
            step = shift.get(block, far)
            if step:
                end += step
                continue
            passages = self.buckets[block]
            found |= passages.get(tuple(words[end - length : end]), set())
            end += 1
        return found


def leaked(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, length: int = 12) -> DataFrame:
    """(doc_id, item_id), once each: the documents that hold ``length`` consecutive words of an item.

    The documents are read once and never shuffled. The items are a held-out set; their size is checked, and they are sent to the tasks
    in blocks of about ``CHARS_AT_ONCE``: a larger set costs more passes and not more memory, since a block's result is written before
    the next block is made. Null, blank and shorter texts on either
    side match nothing; null ids are kept as they are; repeated documents each have their rows; other columns are ignored.
    """
    size = items.agg(F.sum(F.length(F.col(item_text)))).first()[0] or 0
    blocks = max(1, -(-size // CHARS_AT_ONCE))
    table = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    ids = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, item_id string"
    out = None
    for block in range(blocks):
        part = table if blocks == 1 else table.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        patterns = documents.sparkSession.sparkContext.broadcast(PatternTable([tuple(r) for r in part.collect()], length))

        def run(batches: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
            table = patterns.value
            for batch in batches:
                rows = [(i, item) for i, t in enumerate(batch.column("text").to_pylist()) for item in sorted(table.items_in(t))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([i for i, _ in rows], pa.int64())), pa.array([x for _, x in rows], pa.string())], ["doc_id", "item_id"])

        found = ids.mapInArrow(run, schema)
        if blocks > 1:
            found = cut(found)
            patterns.destroy()
        out = found if out is None else out.union(found)
    return out
