"""Near-duplicate groups by minhash banding, signature verification and connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintloom.functions.words import words
from hintloom.llm.grams import as_lists, common_shingles, prefix_keys, shingle_sets
from hintloom.lineage import cut, stored
from hintloom.operators.graph import connected_components

#: Texts of one band bucket that are compared pairwise; larger buckets are compared with their least member first, see ``_grouped``. The groups are the same for any value.
PAIRWISE = 48
#: Bits of a band key within its partition, and the band keys that a task counts: 32 MB.
KEY_BITS, KEYS_A_TASK = 40, 2_000_000


def banding(threshold: float, miss: float = 0.002, most_bands: int = 56) -> tuple[int, int]:
    """(bands, rows): the most rows per band for which a pair exactly at ``threshold`` is missed with probability ``miss`` at most."""
    best = None
    for rows in range(1, 33):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(miss) / math.log1p(-chance))
        if bands <= most_bands:
            best = (bands, rows)
    return best or (most_bands, 1)


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` multiply-add hashes of 64-bit values, universal in their upper bits; the same on every machine."""
    rnd = np.random.Generator(np.random.PCG64(20240229))
    return rnd.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1), rnd.integers(0, 2**64, n, dtype=np.uint64)


def _minima(batch: pa.RecordBatch, k: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, bits) of the texts of a batch with (salt, text): a key per band, and the low bits of all minima.

    A hash function is applied to all shingles of the batch at once and reduced per text.
    """
    mul, plus = _hash_family(bands * rows)
    fold = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, rows, dtype=np.uint64) | np.uint64(1)
    grams, offsets = shingle_sets(batch.column("text"), k)
    salt = batch.column("salt").to_numpy(zero_copy_only=False).view(np.uint64)
    keys = np.empty((batch.num_rows, bands), np.uint64)
    bits = np.zeros((batch.num_rows, -(-bands * rows // 64)), np.uint64)
    for band in range(bands):
        key = salt ^ np.uint64(band * 0x9E3779B97F4A7C15 % 2**64)
        for row in range(rows):
            i = band * rows + row
            least = np.minimum.reduceat(grams * mul[i] + plus[i], offsets[:-1]) >> np.uint64(16)
            key = (key ^ (least * fold[row])) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
            bits[:, i // 64] |= ((least >> np.uint64(11)) & np.uint64(1)) << np.uint64(i % 64)
        keys[:, band] = key
    return keys, bits


def signatures(classes: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """Of (rep, salt, text): (rep, sig), the minima's low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = _minima(batch, k, bands, rows)[1]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), as_lists(bits.reshape(-1), np.arange(0, bits.size + 1, bits.shape[1]))], ["rep", "sig"])

    return classes.select("rep", "salt", "text").mapInArrow(run, "rep bigint, sig array<bigint>")


def gram_sets(classes: DataFrame, k: int) -> DataFrame:
    """Of (rep, salt, text): (rep, salt, grams), the distinct shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("salt"), as_lists(*shingle_sets(batch.column("text"), k))], ["rep", "salt", "grams"])

    return classes.select("rep", "salt", "text").mapInArrow(run, "rep bigint, salt bigint, grams array<bigint>")


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values, all lowest bytes first; planes of zeros compress to nothing."""
    return values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _of_planes(data: bytes, width: int) -> np.ndarray:
    values = np.zeros((len(data) // width, 8), np.uint8)
    values[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return values.reshape(-1).view(np.uint64)


def recurring_keys(classes: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """Of (rep, salt, text): (key, rep, n, lo), the band keys that several texts have, how many have them and the least of these.

    Keys are 40 bits within one of many partitions. They travel as one block per batch and partition, sorted, in differences and without
    a row for each, and are counted where they arrive: half the bytes of rows, which most keys, being of one text only, aren't worth.
    """
    spark = classes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * bands // KEYS_A_TASK))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _minima(batch, k, bands, rows)[0].reshape(-1)
            reps = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), bands)
            placed = (keys >> np.uint64(KEY_BITS)) % np.uint64(parts) << np.uint64(KEY_BITS) | keys & np.uint64(2**KEY_BITS - 1)
            order = np.argsort(placed)
            placed, reps = placed[order], reps[order]
            part = (placed >> np.uint64(KEY_BITS)).astype(np.int64)
            low = placed & np.uint64(2**KEY_BITS - 1)
            ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            low_planes = [_planes(np.diff(low[x:y], prepend=np.uint64(0)), KEY_BITS // 8) for x, y in zip(ends, ends[1:])]
            rep_planes = [_planes(reps[x:y], 8) for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(part[ends[:-1]].astype(np.int32)), pa.array(low_planes, pa.binary()), pa.array(rep_planes, pa.binary())], ["part", "keys", "reps"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, reps = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for part, x, y in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "reps"))):
                keys.append(np.cumsum(_of_planes(x, KEY_BITS // 8)) | np.uint64(part << KEY_BITS))
                reps.append(_of_planes(y, 8).view(np.int64))
        key, rep = np.concatenate(keys), np.concatenate(reps)
        del keys, reps
        order = np.argsort(key)
        key, rep = key[order], rep[order]
        fresh = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        n = np.diff(np.append(fresh, len(key)))
        lo = np.minimum.reduceat(rep, fresh) if len(rep) else rep
        several = np.repeat(n > 1, n)
        columns = [key[several].view(np.int64), rep[several], np.repeat(n, n)[several], np.repeat(lo, n)[several]]
        for at in range(0, len(columns[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in columns], ["key", "rep", "n", "lo"])

    blocks = classes.select("rep", "salt", "text").mapInArrow(pack, "part int, keys binary, reps binary")
    return blocks.repartitionById(parts, "part").mapInArrow(count, "key bigint, rep bigint, n bigint, lo bigint")


def _bucket_pairs(members: DataFrame) -> DataFrame:
    """All pairs of the buckets of up to ``PAIRWISE`` members."""
    two = members.where("n = 2 and rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b"))
    some = members.where(f"n between 3 and {PAIRWISE}").groupBy("key").agg(F.collect_list("rep").alias("ids"))
    some = some.select(F.explode(F.expr("flatten(transform(ids, x -> transform(filter(ids, y -> y > x), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    return two.union(some).distinct()


def _labelled(df: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    """``df`` with the group of ``column``, itself if it has no links yet, as ``g_<column>``."""
    known = groups.select(F.col("node").alias(column), F.col("component").alias("_g"))
    return df.join(known, column, "left").withColumn(f"g_{column}", F.coalesce("_g", column)).drop("_g")


def _alike(sa: str, sb: str, threshold: float, n_hashes: int) -> Column:
    """Whether the minima's low bits of two texts agree as often as those of texts of similarity ``threshold`` do, less 4.5 deviations."""
    agree = (1 + threshold) / 2
    most = n_hashes * (1 - agree) + 4.5 * math.sqrt(n_hashes * agree * (1 - agree))
    return reduce(add, (F.bit_count(F.col(sa)[i].bitwiseXOR(F.col(sb)[i])) for i in range(-(-n_hashes // 64)))) <= F.lit(most)


def _apart(large: DataFrame, groups: DataFrame, classes: DataFrame, sigs: DataFrame, k: int, threshold: float, n_hashes: int) -> DataFrame:
    """Pairs (a, b) that may link members of large buckets which are still in other groups than their buckets' least members.

    Such members share a band with many texts and are similar to few or none, as texts are that have a sentence in common. Banding can't
    tell them apart, so their shingle sets are joined by ``prefix_keys``, in which shared sentences are no keys as long as they make up
    less than a match. Keys whose texts are all in one group are dropped first; the others get the signatures, so that only pairs whose
    signatures agree are moved on.
    """
    known = _labelled(_labelled(large, groups, "rep"), groups, "lo")
    far = known.where("g_rep <> g_lo")
    if far.isEmpty():
        return far.select(F.col("rep").alias("a"), F.col("lo").alias("b"))
    asked = far.select("rep").distinct().withColumn("asks", F.lit(True))
    there = known.join(far.select("key").distinct(), "key", "left_semi").select("rep", F.col("g_rep").alias("g")).distinct()
    there = there.join(asked, "rep", "left").select("rep", "g", F.coalesce("asks", F.lit(False)).alias("asks"))
    of_batch = lambda batch: batch.column("grams").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column("grams").offsets.to_numpy()
            salt = batch.column("salt").to_numpy(zero_copy_only=False)
            owner, keys = prefix_keys(of_batch(batch), offsets - offsets[0], salt, threshold, hot, weight)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[batch.column(c).take(at) for c in ("rep", "g", "asks")]], ["key", "rep", "g", "asks"])

    with stored(gram_sets(classes.join(there, "rep", "left_semi"), k).join(there, "rep")) as sets:
        hot, weight = common_shingles(sets.select("grams"), of_batch)
        keyed = cut(sets.mapInArrow(run, "key bigint, rep bigint, g bigint, asks boolean"))
    mixed = keyed.groupBy("key").agg(F.min("g").alias("least"), F.max("g").alias("most"), F.max("asks").alias("asked")).where("asked and least <> most").select("key")
    rows = cut(keyed.join(mixed, "key", "left_semi").join(sigs, "rep"))
    x, y = (rows.where(which).select("key", *[F.col(c).alias(c[0] + side) for c in ("rep", "g", "sig")]) for side, which in (("x", "asks"), ("y", "true")))
    return x.join(y, "key").where((F.col("gx") != F.col("gy")) & _alike("sx", "sy", threshold, n_hashes)).select(F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b")).distinct()


def _grouped(members: DataFrame, verified: Callable[[DataFrame], DataFrame], apart: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of the linked members of (key, n, lo, rep), ``verified`` telling the links among pairs
    and ``apart`` being ``_apart`` for large buckets and groups.

    Small buckets give all their pairs, at most ``PAIRWISE`` a member. In large ones, where a third of all texts may meet, most members
    belong to one group, so each is compared with the least member of only one of its buckets at first; then with those of its other
    buckets that are still in another group; and what is still apart from a bucket's least member goes through ``_apart``. A pair of a
    bucket that is never compared is in one group already.
    """
    links = verified(_bucket_pairs(members))
    large = members.where(f"n > {PAIRWISE}")
    if large.isEmpty():
        return connected_components(links)
    star = large.where("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct()
    links = links.union(verified(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")))
    groups = cut(connected_components(links))
    more = verified(_labelled(_labelled(star, groups, "a"), groups, "b").where("g_a <> g_b").select("a", "b"))
    if not more.isEmpty():
        links = links.union(more)
        groups = cut(connected_components(links))
    more = verified(apart(large, groups))
    return groups if more.isEmpty() else connected_components(links.union(more))


def _similar(texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs of (a, b, ta, tb) whose texts' shingle sets reach the threshold exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ga, xa), (gb, xb) = (shingle_sets(batch.column(c), k) for c in ("ta", "tb"))
            na, nb = np.diff(xa), np.diff(xb)
            pair = np.arange(batch.num_rows)
            grams, owner = np.concatenate([ga, gb]), np.concatenate([np.repeat(pair, na), np.repeat(pair, nb)])
            order = np.lexsort((grams, owner))
            grams, owner = grams[order], owner[order]
            common = np.bincount(owner[1:][(grams[1:] == grams[:-1]) & (owner[1:] == owner[:-1])], minlength=batch.num_rows)
            kept = pa.array(common >= (threshold - 1e-12) * (na + nb - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in ("a", "b")], ["a", "b"])

    return texts.mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, classes: DataFrame, sigs: DataFrame, k: int, threshold: float, n_hashes: int) -> DataFrame:
    """The pairs whose signatures agree well enough and whose shingle sets reach the threshold exactly; only texts of the former are moved.

    Texts are moved and not their sets, which take twice the bytes.
    """
    left, right = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    near = cut(pairs.join(left, "a").join(right, "b").where(_alike("sa", "sb", threshold, n_hashes)).select("a", "b"))
    with stored(classes.select("rep", "text").join(near.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi")) as texts:
        left, right = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
        return cut(_similar(near.join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), k, threshold))


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, within: str | None = None, shingle: int = 5, threshold: float = 0.8, bands: int | None = None, rows: int | None = None
) -> DataFrame:
    """Groups of texts that are equal or linked by shingle similarity of at least ``threshold``, directly or through others.

    Result: ``id`` (bigint), ``text_class`` (least id of the rows with the same words), ``cluster`` (least id of its group) and
    ``copies`` (rows of the class), one row per row of ``df`` with an id. ``within`` names a column whose values are never mixed.

    Method: equal texts become one class before anything else, so a text that fills a third of the rows counts once. Classes get a
    signature of ``bands`` × ``rows`` universal-hash minima (by default from ``banding``); classes sharing a band are candidates; their
    signatures and then their exact shingle sets are compared; links become groups by large-star and small-star. Buckets of more than
    ``PAIRWISE`` different texts are compared by way of their least members and by an exact set join, see ``_grouped``, without losing a
    link between groups.

    Null, blank and short texts (fewer than ``shingle`` words) are similar to nothing: class and cluster are their own id. Rows with a
    null id are left out, since no result could name them. Ids must be unique. Empty tables give an empty result; other columns of
    ``df`` are ignored, whatever their names.
    """
    if bands is None or rows is None:
        bands, rows = banding(threshold)
    salt = F.xxhash64(F.coalesce(F.col(within).cast("string"), F.lit(""))) if within else F.lit(0).cast("bigint")
    base = df.select(F.col(id_col).cast("bigint").alias("id"), salt.alias("salt"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).where("id is not null")
    base = base.select("id", "salt", F.size("w").alias("n"), F.array_join("w", " ").alias("text"))
    same = F.concat_ws("\n", F.col("salt").cast("string"), "text")
    alone = F.concat_ws("\n", F.lit("short"), F.col("id").cast("string"))
    base = base.withColumn("digest", F.unhex(F.md5(F.when(F.col("n") >= shingle, same).otherwise(alone))))
    classes = base.where(F.col("n") >= shingle).groupBy("digest").agg(F.min("id").alias("rep"), F.first("salt").alias("salt"), F.count("*").alias("copies"), F.first("text").alias("text"))
    with stored(classes) as classes:
        members = cut(recurring_keys(classes, shingle, bands, rows))
        sigs = cut(signatures(classes.join(members.select("rep").distinct(), "rep", "left_semi"), shingle, bands, rows))
        given = classes, sigs, shingle, threshold, bands * rows
        groups = _grouped(members, lambda pairs: _verified(pairs, *given), lambda large, groups: _apart(large, groups, *given))
        labelled = classes.select("digest", "rep", "copies").join(groups, F.col("rep") == F.col("node"), "left").select("digest", "rep", "copies", F.coalesce("component", "rep").alias("cluster"))
        labelled = cut(labelled)
    of_class = F.coalesce("rep", "id").alias("text_class"), F.coalesce("cluster", "id").alias("cluster"), F.coalesce("copies", F.lit(1).cast("bigint")).alias("copies")
    return base.select("id", "digest").join(labelled, "digest", "left").select("id", *of_class)


def cluster_pairs(groups: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of rows of one cluster: the expanded form, as large as the groups require."""
    several = cut(groups.select("id", "cluster"))
    linked = several.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1").select("cluster")
    rows = several.join(linked, "cluster", "left_semi")
    return rows.select("cluster", F.col("id").alias("a")).join(rows.select("cluster", F.col("id").alias("b")), "cluster").where("a < b").select("a", "b")
