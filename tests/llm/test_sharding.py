from collections import Counter

from pyspark.sql import functions as F

from paperloom.llm.common import unit_hash
from paperloom.llm.sharding import interleave


def check(rows, shards=8):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.get(i, 0) for i in range(shards)) <= 1
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))


def test_odd_rows(odd_docs, no_docs):
    check(interleave(odd_docs.select("doc_id", "source")).collect())
    assert interleave(no_docs.select("doc_id", "source")).count() == 0


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, f"s{int(i**0.5) % 5}" if i % 11 else None) for i in range(3000)], "doc_id bigint, source string")
    got = interleave(df).collect()
    check(got)
    place = {r.doc_id: r.u for r in df.select("doc_id", unit_hash("shard", F.col("doc_id")).alias("u")).collect()}
    rows = [(r.doc_id, r.source) for r in got]
    by, at = {}, {}
    for d, s in rows:
        by.setdefault(s, []).append(d)
    for s, ids in by.items():
        for k, d in enumerate(sorted(ids, key=lambda d: (place[d], d))):
            at[d] = (k + 0.5) / len(ids)
    order = sorted(rows, key=lambda r: (at[r[0]], place[r[0]], r[0]))
    want = {d: k * 8 // len(rows) for k, (d, _) in enumerate(order)}
    assert {r.doc_id: r.shard for r in got} == want
    for s, ids in by.items():  # every shard matches the mixture
        assert all(abs(sum(1 for r in got if r.source == s and r.shard == k) - len(ids) / 8) <= 1.5 for k in range(8))


def test_one_id_with_many_texts_and_many_equal_rows(spark, tmp_path):
    """Rows of one id are spread and ordered by their texts, equal rows by their number: runs over other partitions agree."""
    from paperloom.llm.common import numbered_copies
    from paperloom.llm.sharding import op4_stratified_shards

    rows = [(None, f"text {i}", "a") for i in range(200)] + [(7, "same", "a")] * 150 + [(7, f"t{i}", None) for i in range(50)] + [(i, "x", "b") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = []
    for n in (1, 7):
        folder = str(tmp_path / str(n))
        df.repartition(n).write.parquet(f"{folder}/documents.parquet")
        found = op4_stratified_shards(spark, folder).collect()
        check(found)
        got.append(sorted(map(str, found)))
    assert got[0] == got[1] and len(got[0]) == 500
    numbers = [r.k for r in numbered_copies(df.where("text = 'same'"), "k", most=40).collect()]
    assert sorted(numbers) == list(range(150))
    place = df.where("doc_id is null").select(unit_hash("shard", F.col("doc_id"), F.md5("text")).alias("u")).distinct().count()
    assert place == 200  # not one cell for one id
