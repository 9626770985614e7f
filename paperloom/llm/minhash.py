"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle set gives two signature values, its minimum and its maximum, so 32
hash evaluations a shingle give 64 values; both estimate the resemblance without bias, and the pair has less
variance than two minima.  Bands of three values are the buckets: a pair of resemblance 0.75 meets in one of
the 21 bands but for 1 case in 100,000.  Every link is confirmed on the full sets.

Groups never become pairs.  Documents with equal sets are one class.  Within a bucket, classes are compared with
its least id; the links found join them into components.  Buckets that still hold several components choose
another leader, a member of their largest component, for the classes outside of it, as long as that finds many
links (``ROUNDS`` times at most).  What is left is exact: a bucket with few pairs across components gets all of them; the
classes of the other buckets, in which many different texts share a passage, meet by their rarest shingles.  Two
sets can only resemble each other by 0.75 if they share one of the rarest quarter (and one more) of either, and if
what stands before and after it can make up such an overlap, so that misses no link.  Pairs inside
a component are never made, and no pair is left out but for the sizes of its sets.

Defined results: a null, empty or blank text has an empty set, links with nothing and is its own component;
fewer than five words are one shingle; rows that share an id are one node; a null id has itself (null) as
component and is kept; an empty input gives an empty output; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, documents, python_map, small, staged
from paperloom.llm.components import connected_components

SHINGLE_WORDS = 5
PERMUTATIONS, BAND_ROWS = 32, 3
ROUNDS, WORTH = 3, 50  # further leaders are tried while one in WORTH of their pairs is a link
DIRECT = 8  # pairs across components that a bucket may have for each of its members, to get all of them
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_DRAW = np.random.default_rng(20_240_501)
_POWERS = _DRAW.integers(0, 1 << 63, SHINGLE_WORDS + 1, dtype=np.uint64) | np.uint64(1)
_SCALE = (_DRAW.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
_SHIFT = _DRAW.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)[:, None]
_BAND = _DRAW.integers(0, 1 << 63, BAND_ROWS + 1, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = SHINGLE_WORDS
    if len(w) < k:
        return _mixed(np.sum(w * _POWERS[: len(w)], keepdims=True, dtype=np.uint64) + _POWERS[k] * np.uint64(len(w)))
    total = w[: len(w) - k + 1] * _POWERS[0]
    for i in range(1, k):
        total = total + w[i : len(w) - k + 1 + i] * _POWERS[i]
    return np.unique(_mixed(total))


def min_max_signature(shingles: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of the permuted hashes."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    block = (1 << 19) // PERMUTATIONS
    for at in range(0, len(shingles), block):
        permuted = _SCALE * shingles[at : at + block] + _SHIFT
        np.minimum(low, permuted.min(axis=1), out=low)
        np.maximum(high, permuted.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = len(signature) // BAND_ROWS
    rows = signature[: bands * BAND_ROWS].reshape(bands, BAND_ROWS)
    return _mixed((rows * _BAND[:BAND_ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _BAND[BAND_ROWS]).view(np.int64)


def _signatures(batches):
    for batch in batches:
        sizes, first, second, keys = [], [], [], []
        for text in batch.column(1):
            shingles = shingle_set(text.as_py())
            digest = xxhash.xxh3_128_digest(shingles.tobytes())
            a, b = np.frombuffer(digest, np.int64)
            sizes.append(len(shingles))
            first.append(int(a))
            second.append(int(b))
            keys.append(band_keys(min_max_signature(shingles)) if len(shingles) else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)], dtype=np.int32), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists],
            ["doc_id", "n_shingles", "k1", "k2", "bands"],
        )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (128-bit digest of the whole set), bands (bucket keys)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return python_map(rows, _signatures, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>")


def _confirm(percent: int):
    def run(batches):
        held, left = None, None
        for batch in batches:
            a, b = [], []
            for i, x, j, y in zip(*(batch.column(k) for k in range(4))):
                i, j = i.as_py(), j.as_py()
                if held is None or not held.equals(x):
                    held, left = x, shingle_set(x.as_py())
                right = shingle_set(y.as_py())
                small, large = (left, right) if len(left) <= len(right) else (right, left)
                if not len(small):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int(np.count_nonzero(large[at] == small))
                if 100 * common >= percent * (len(left) + len(right) - common):
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents of these ids, each different text of an id once."""
    found = docs.join(small(ids.withColumnRenamed(ids.columns[0], "_id")), F.col("doc_id") == F.col("_id"), "left_semi")
    return found.groupBy("doc_id", F.xxhash64("text").alias("_same")).agg(F.first("text").alias("text")).drop("_same")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole sets resemble each other enough, for any texts of the two ids."""
    ids = pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct()
    texts = staged(_of_ids(docs, ids), "texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    # by the second id first, so that rows reach the comparison in runs of the first
    rows = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "a_text", "b", "b_text")
    links = staged(python_map(rows, _confirm(percent), "a bigint, b bigint"), "links")
    discard(texts)
    return links


def _mixed_buckets(shared: DataFrame, members: DataFrame) -> DataFrame:
    """key, rep, n, component, main (the bucket's largest component), of the buckets that hold several components."""
    placed = shared.join(members, F.col("rep") == F.col("id"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    square = F.col("c").cast("double") * F.col("c")
    buckets = counts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("m"), F.sum(square).alias("inside"), F.count(F.lit(1)).alias("parts"))
    pairs = (F.col("m").cast("double") * F.col("m") - F.col("inside")) / 2
    buckets = buckets.where("parts > 1").select("key", F.col("main.component").alias("main"), (pairs <= DIRECT * F.col("m")).alias("direct"))
    return staged(placed.join(small(staged(buckets, "buckets")), "key"), "placed")


def _similar_sizes(percent: int):
    return 100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn")


def _led(placed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each class outside its bucket's main component with a leader of that component."""
    lead = placed.where("component = main").groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key", F.lit(turn)), F.col("rep").alias("y"), F.col("n").alias("yn"))).alias("lead"))
    outside = placed.where("component <> main").select("key", F.col("rep").alias("x"), F.col("n").alias("xn"))
    met = outside.join(small(staged(lead.select("key", "lead.y", "lead.yn"), "leaders")), "key").where(_similar_sizes(percent))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _all_across(placed: DataFrame, percent: int) -> DataFrame:
    """Every pair across components in these buckets, if the sizes allow a link."""
    x = placed.where("component <> main").select("key", F.col("rep").alias("x"), F.col("n").alias("xn"), F.col("component").alias("xc"))
    y = placed.select("key", F.col("rep").alias("y"), F.col("n").alias("yn"), F.col("component").alias("yc"), (F.col("component") == F.col("main")).alias("is_main"))
    met = x.join(y.hint("merge"), "key").where((F.col("xc") != F.col("yc")) & (F.col("is_main") | (F.col("x") < F.col("y"))) & _similar_sizes(percent))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _sets(batches):
    for batch in batches:
        sets = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)]
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)], dtype=np.int32), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["rep", "shingles"])


def _by_rare_shingles(placed: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs across components of all classes here that share a shingle of both their prefixes in the order of rarity.

    A set of n that is part of a link shares at least percent * n / 100 shingles, so one of its other shingles and
    one more.  The order is that of how many of these classes hold a shingle; those of a single class cannot be shared.
    """
    classes = staged(placed.select("rep", "component").distinct(), "hot")
    sets = staged(python_map(_of_ids(docs, classes.select("rep").distinct()), _sets, "rep bigint, shingles array<bigint>"), "sets")
    sets = sets.withColumn("n", F.size("shingles")).where("n > 0").withColumn("part", F.xxhash64("shingles"))  # an id may have several
    each = sets.select("rep", "part", "n", F.explode("shingles").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    common = each.join(held, "shingle").groupBy("rep", "part", "n").agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("s"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - (F.col("n") - F.size("s"))
    prefix = common.where(length > 0).select("rep", "n", F.size("s").alias("most"), F.posexplode(F.slice("s", F.lit(1), length)).alias("at", "p"))
    prefix = prefix.select("rep", "n", "most", (F.col("at") + 1).alias("at"), F.col("p.shingle").alias("shingle"))
    prefix = staged(prefix.join(classes, "rep"), "prefix")
    x, y = (prefix.select("shingle", *[F.col(c).alias(f"{side}{c}") for c in ("rep", "n", "most", "at", "component")]) for side in "xy")
    # what two sets can share: no more before this shingle, and no more after it, than either has there
    sharing = F.least("xat", "yat") + F.least(F.col("xmost") - F.col("xat"), F.col("ymost") - F.col("yat"))
    wanted = F.ceil(percent * (F.col("xn") + F.col("yn")) / (100 + percent)).cast("int")  # of two sets that are linked
    first = [F.col(f"{k}most") - F.col(f"{k}at") + 1 >= wanted for k in "xy"]  # the first that they share has as many from it on
    enough = (sharing >= wanted) & first[0] & first[1]
    met = x.join(y.hint("merge"), "shingle").where((F.col("xrep") < F.col("yrep")) & (F.col("xcomponent") != F.col("ycomponent")) & _similar_sizes(percent) & enough)
    return met.select(F.col("xrep").alias("a"), F.col("yrep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(signatures(docs), "signatures")
    full = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    least = full.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("least"))
    classes = staged(least.select("k1", "k2", F.col("least.doc_id").alias("rep"), F.col("least.n_shingles").alias("n"), F.col("least.bands").alias("bands")), "classes")
    cells = classes.select(F.explode("bands").alias("key"), "rep", "n")
    buckets = cells.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = staged(cells.join(staged(buckets.drop("members"), "buckets"), "key"), "cells")  # only buckets that anything shares
    seen = staged(shared.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    members = connected_components(confirmed(seen, docs, percent))
    placed = _mixed_buckets(shared, members)
    for turn in range(ROUNDS):
        fresh = staged(_led(placed, turn, percent).join(seen, ["a", "b"], "left_anti"), "pairs")
        found = confirmed(fresh, docs, percent)
        seen = seen.unionByName(fresh)
        links = found.count()
        if links:
            members, placed = _joined(members, found, placed, shared)
        if links * WORTH < fresh.count():
            break
    rest = _all_across(placed.where("direct"), percent).unionByName(_by_rare_shingles(placed.where("not direct"), docs, percent)).distinct()
    found = confirmed(staged(rest.join(seen, ["a", "b"], "left_anti"), "pairs"), docs, percent)
    if not found.isEmpty():
        members, placed = _joined(members, found, placed, None)
    for table in (shared, seen):
        discard(table)
    of_class = classes.select("k1", "k2", "rep").join(members, F.col("rep") == F.col("id"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("class_component"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("class_component", "doc_id")).otherwise(F.col("doc_id"))
    out = rows.drop("bands").join(of_class, ["k1", "k2"], "left").withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _joined(members: DataFrame, links: DataFrame, placed: DataFrame, shared: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Components with further links, and the buckets that are still mixed."""
    stars = members.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    after = connected_components(stars.unionByName(links))
    discard(placed)
    return after, _mixed_buckets(shared, after) if shared is not None else None


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op1_minhash_near_dedup": op1_minhash_near_dedup}
ORACLES = {}
