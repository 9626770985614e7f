"""Nearest neighbours by inner product with multi-index hashing.

A coordinate that brings every vector to the length of the longest turns inner products into angles.  Vectors are
centred, turned to their principal axes and rotated so that signs lose least (iterative quantisation, learned on at
most ``SAMPLE_ROWS`` rows); the signs are a code of up to 64 bits.  Codes are split into ``PARTS`` substrings, and a
block of rows has a table for each: the rows sorted by that substring.  Codes within ``radius`` of a query's differ
from it by at most radius / PARTS bits in one substring at least, so probing every table for substrings that near
retrieves each of them: by looking up every such substring, or where the table holds fewer, by comparing all that it
holds.  The full code confirms the radius, and the original vectors rank what is left in double precision.  The radius
is the least one that finds ``RECALL`` of the sample's own neighbours, by brute force over the sample; more rows only
bring neighbours nearer.  A query with fewer than k codes in its radius looks again in a wider one.

Lengthening blinds codes if few vectors are far longer than the others, and a sample need not hold those.  So rows are
banded by length, each band to half the length of the one before, and every band has an index of its own: axes, rotation
and radius learned on its own sample, lengthened to its own longest.  Rare lengths, bands of under ``RARE_ROWS`` rows
beside the largest, have nothing to learn from: their rows are all compared.

Every row is indexed.  Rows and queries are dealt to a grid of bounded blocks; a cell of the grid gives at most
k rows a query, and the best k over all cells are the result.

Defined results: vectors that are null, zero, of another length than most of the sample, or that hold null or
non-finite components take no part, as query or as candidate; equal scores go to the smaller id; repeated ids
are candidates each, but never of a query with their id; an empty input gives an empty output.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import ship

SAMPLE_ROWS = 20_000
MAX_BITS, PARTS = 64, 4
RECALL, RECALL_QUERIES = 0.96, 400
ROW_BLOCK, QUERY_BLOCK = 16_384, 2048
#: Bands of length, the last of all that is shorter; and bands of fewer rows than can be learned from.
BANDS, RARE_ROWS = 12, 500


@dataclass
class Encoder:
    longest: float  # norm of the longest vector
    centre: np.ndarray
    turn: np.ndarray  # (dimensions + 1, bits)
    radius: int = MAX_BITS

    def codes(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        bits = (_lengthened(x, self.longest, queries) - self.centre) @ self.turn > 0
        padded = np.zeros((len(x), MAX_BITS), bool)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1).view(">u8").ravel().astype(np.uint64)


def _lengthened(x: np.ndarray, longest: float, queries: bool) -> np.ndarray:
    """Rows get a coordinate that makes them as long as the longest; queries are stretched to that length."""
    squares = (x * x).sum(axis=1)
    if queries:
        return np.c_[x * (longest / np.sqrt(squares))[:, None], np.zeros(len(x))]
    return np.c_[x, np.sqrt(np.maximum(longest * longest - squares, 0))]


def learn(sample: np.ndarray, longest: float, k: int = 20, rounds: int = 40, seed: int = 1) -> Encoder:
    """Principal axes, the rotation that iterative quantisation finds for them, and the radius that finds enough neighbours."""
    x = _lengthened(sample, longest, False)
    centre = x.mean(axis=0)
    bits = min(MAX_BITS, sample.shape[1])
    _, axes = np.linalg.eigh((x - centre).T @ (x - centre))
    axes = axes[:, ::-1][:, :bits]
    projected = (x - centre) @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(projected @ rotation > 0, 1.0, -1.0).T @ projected)
        rotation = (u @ vt).T
    encoder = Encoder(longest, centre, axes @ rotation)
    codes, at = encoder.codes(sample), np.arange(min(RECALL_QUERIES, len(sample)))
    distances = []
    for i, code in zip(at, encoder.codes(sample[at], True)):
        score = sample @ sample[i]
        score[i] = -np.inf
        nearest_k = np.argpartition(-score, min(k, len(score) - 1))[:k]
        distances.append(np.bitwise_count(codes[nearest_k[nearest_k != i]] ^ code))
    found = np.sort(np.concatenate([*distances, np.zeros(0, np.uint8)]))
    if len(found):
        encoder.radius = int(found[min(len(found) - 1, int(RECALL * len(found)))])
    return encoder


@lru_cache(maxsize=None)
def _flips(radius: int) -> np.ndarray:
    """Every change of up to ``radius`` bits of a substring."""
    masks = np.arange(1 << MAX_BITS // PARTS, dtype=np.uint64)
    return masks[np.bitwise_count(masks) <= radius]


class BlockIndex:
    """Tables of a block's codes, one for each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for part in range(PARTS):
            sub = self.substring(codes, part)
            order = np.argsort(sub, kind="stable")
            values, first, n = np.unique(sub[order], return_index=True, return_counts=True)
            self.tables.append((order, values, first, n))

    @staticmethod
    def substring(codes, part: int):
        width = MAX_BITS // PARTS
        return (codes >> np.uint64(width * part)) & np.uint64((1 << width) - 1)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Every row whose code is within the radius: those of near substrings in any table, then confirmed."""
        hit = np.zeros(len(self.codes), bool)
        for part, (order, values, first, n) in enumerate(self.tables):
            flips, own = _flips(radius // PARTS), self.substring(code, part)
            if len(flips) < len(values):  # look up each substring in reach
                slot = np.minimum(np.searchsorted(values, own ^ flips), len(values) - 1)
                near = slot[values[slot] == own ^ flips]
            else:  # the table holds fewer: compare all of them
                near = np.flatnonzero(np.bitwise_count(values ^ own) <= radius // PARTS)
            lengths = n[near]
            total = int(lengths.sum())
            if total:
                offsets = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                hit[order[np.repeat(first[near], lengths) + offsets]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def _search(encoders: list[Encoder | None], band_of: list[int], k: int):
    """The best k of a block of rows for a block of queries; without an encoder all rows are compared."""
    names = ["query_id", "vec_id", "score"]

    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        encoder = encoders[band_of[key[0].as_py()]]
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(queries) and len(rows):
            def matrix(t):
                return np.concatenate([c.values.to_numpy() if c.offset == 0 else c.flatten().to_numpy() for c in t["vector"].chunks]).astype(np.float64).reshape(len(t), -1)

            x, q = matrix(rows), matrix(queries)
            ids, query_ids = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            index = encoder and BlockIndex(encoder.codes(x))
            for query, code, own in zip(q, encoder.codes(q, True) if encoder else query_ids, query_ids):
                reach = encoder.radius if encoder else MAX_BITS
                while True:
                    if encoder is None:
                        found = np.flatnonzero(ids != own)
                        break
                    found = index.within(code, reach)
                    found = found[ids[found] != own]
                    if len(found) >= k or reach >= MAX_BITS:
                        break
                    reach = min(MAX_BITS, reach + PARTS)
                score = (x[found] * query).sum(axis=1)
                best = np.lexsort((ids[found], -score))[:k]
                out[0].append(np.full(len(best), own))
                out[1].append(ids[found][best])
                out[2].append(score[best])
        return pa.table({n: np.concatenate(c) for n, c in zip(names, out)})

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector of the vectors that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(v.isNotNull() & F.col(id_col).isNotNull()).where(finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("vector") if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else v.cast("array<double>").alias("vector"))


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """At most SAMPLE_ROWS of n rows' vectors, the same in every run."""
    h = F.pmod(F.xxhash64(F.lit("itq"), "vec_id"), F.lit(1 << 40))
    some = rows.where(h <= F.lit(int(min(1.0, SAMPLE_ROWS / n) * (1 << 40)))).orderBy(h, "vec_id").limit(SAMPLE_ROWS)
    found = some.select("vector").toPandas()["vector"]
    if not len(found):
        found = rows.limit(SAMPLE_ROWS).select("vector").toPandas()["vector"]
    return np.stack(found.to_numpy()).astype(np.float64)


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found among all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("int")).alias("q"), F.mode(F.size("vector")).alias("d")).first()
    if not sizes["n"] or not sizes["q"]:
        return empty
    rows = rows.where(F.size("vector") == sizes["d"])
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    longest = float(np.sqrt(rows.agg(F.max(square)).first()[0]))
    shorter = F.floor(F.log2(F.lit(longest)) - F.log2(F.col("_square")) / 2)
    rows = rows.withColumn("_square", square).withColumn("_band", F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), shorter)).cast("int"))
    bands = {r["_band"]: r for r in rows.groupBy("_band").agg(F.count(F.lit(1)).alias("n"), F.max("_square").alias("m")).collect()}  # BANDS at most
    encoders: list[Encoder | None] = [None] * BANDS
    band_of: list[int] = []
    place = F.lit(0)
    block = F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(1 << 40))
    largest = max(r["n"] for r in bands.values())
    for band, r in sorted(bands.items()):
        if r["n"] >= RARE_ROWS or r["n"] == largest:
            encoders[band] = learn(_sample(rows.where(F.col("_band") == band), r["n"]), float(np.sqrt(r["m"])), k)
        blocks = -(-r["n"] // ROW_BLOCK)
        place = F.when(F.col("_band") == band, len(band_of) + (block % blocks).cast("int")).otherwise(place)
        band_of += [band] * blocks
    query_blocks = -(-sizes["q"] // QUERY_BLOCK)
    right = rows.withColumn("rb", place).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).select("rb", "qb", "vec_id", "vector")
    left = rows.where(is_query).withColumn("qb", (block % query_blocks).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(len(band_of) - 1)))).select("rb", "qb", "vec_id", "vector")
    pairs = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb"))
    best = pairs.applyInArrow(_search(encoders, band_of, k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_multi_index_hashing(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


QUERIES = {"op7_multi_index_hashing": op7_multi_index_hashing}
ORACLES = {}
