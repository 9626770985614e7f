import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm.ann import BlockIndex, nearest


def test_every_code_in_the_radius():
    draw = np.random.default_rng(0)
    codes = draw.integers(0, 1 << 63, 5000, dtype=np.uint64)
    codes[:200] = codes[0] ^ (np.uint64(1) << draw.integers(0, 63, 200).astype(np.uint64))
    index = BlockIndex(codes)
    for radius in (0, 2, 7, 25, 28):
        for i in (0, 700):
            want = [j for j in range(5000) if bin(int(codes[i]) ^ int(codes[j])).count("1") <= radius]
            assert index.within(codes[i], radius).tolist() == want


def brute(x, k=20):
    out = {}
    for q in (i for i in x if i % 20 == 0):
        ranked = sorted(((-float(np.dot(x[q].astype(float), v.astype(float))), i) for i, v in x.items() if i != q))
        out[q] = [i for _, i in ranked[:k]]
    return out


@pytest.mark.parametrize("spread", [0.0, 0.6, 1.0])
def test_recall_at_64_dimensions(spark, spread):
    """Vectors without any structure, of equal and of very unequal lengths; several ids repeat."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(6000, 64))
    x *= (np.exp(draw.normal(size=6000) * spread) / np.linalg.norm(x, axis=1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist()), (40, x[7].tolist())], "vec_id bigint, embedding array<double>")
    got: dict = {}
    for r in nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = []
    for q, found in got.items():
        score = x @ x[q]
        assert all(abs(s - float((x[i] * x[q]).sum())) < 1e-12 for _, i, s in found if i != 40)
        best = {i for i in np.argsort(-score, kind="stable")[:21] if i != q}
        hits.append(len(best & {i for _, i, _ in found}) / 20)
    assert set(got) == set(range(0, 6000, 100)) and all(sorted(r for r, *_ in f) == list(range(1, 21)) for f in got.values())
    assert np.mean(hits) >= 0.9


def test_double_vectors_are_ranked_as_they_are(spark):
    """Differences that single precision would lose decide."""
    rows = [(i, [1.0 + 1e-9 * i, 0.5]) for i in range(60)]
    got = nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 59, k=3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [58, 57, 56]


def test_recall_and_odd_vectors(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(1500, 32)).astype(np.float32)
    x[100:160] = x[100]  # one common vector
    rows = [(i, [float(c) for c in v], "x", 1.0) for i, v in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 32), (2040, [float("nan")] * 32), (2060, [None] + [1.0] * 31), (2080, [float("inf")] * 32), (2100, [1.0])]
    df = spark.createDataFrame(rows + [(i, v, "x", 1.0) for i, v in odd], "vec_id bigint, embedding array<float>, vector string, score double")
    got: dict = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(dict(enumerate(x)))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    assert got[100] == list(range(101, 121)) and got[120] == [i for i in range(100, 121) if i != 120]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = nearest(df.where("vec_id < 5 or vec_id >= 2000"), F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in few} == {0} and len(few) == 4


def test_a_few_vectors_far_longer_than_the_others(spark):
    """Rare lengths that a sample does not hold neither go nor blind the codes of the others."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=(5000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1001:1031] *= 50
    x[2001:2201] *= 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got: dict = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    short = x.copy()
    short[1001:1031] = 0
    short[2001:2201] = 0
    hits = [len({i for i in np.argsort(-(x @ x[q]), kind="stable")[:21] if i != q} & got[q]) / 20 for q in got]
    assert np.mean(hits) >= 0.97
    # and among the many of one length alone, as if the others were not there
    own = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) if not (1001 <= i < 1031)] + [(9000 + i, (v * 50).tolist()) for i, v in enumerate(-np.abs(x[:5]) - 1)], "vec_id bigint, embedding array<double>")
    assert nearest(own, F.col("vec_id") == 100).count() == 20
