from paperloom.llm.mixing import mix, sized, source_targets


def fill(sizes, weights):
    """Water filling by resharing, source by source."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > 3 * sizes[i]}
        if not over:
            return [3 * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def test_targets_by_resharing(spark):
    for sizes in ([100, 1, 1, 1], [5, 50, 500, 7, 0, 90], [10], [3, 3, 1000], [1, 1, 1, 1, 1, 9]):
        names = [f"s{i}" for i in range(len(sizes))]
        got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size bigint")).collect()}
        want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
        assert all(abs(got[n] - w) < 1e-6 for n, w in zip(names, want)), (sizes, got, want)


def test_odd_rows_and_reruns(odd_docs, no_docs):
    rows = mix(sized(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mix(sized(odd_docs).repartition(7)).collect()))
    assert mix(sized(no_docs)).count() == 0


def test_words_come_near_the_target(spark):
    rows = [(i, f"s{i % 4}" if i % 9 else None, i % 57) for i in range(4000)]
    got = mix(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert len(got) == 5 and all(abs(r["sum(taken)"] - r["max(target)"]) <= 57 for r in got)


def test_weighted_documents(spark):
    rows = [(i, "a", 10, 1.0 + (i % 2)) for i in range(2000)]
    df = spark.createDataFrame(rows + [(i + 5000, "b", 10, 1.0) for i in range(2000)], "doc_id bigint, source string, size bigint, quality double")
    got = mix(df, weights=(1, 3), weight_col="quality").collect()
    odd, even = (sum(r.copies for r in got if r.source == "a" and r.doc_id % 2 == k) for k in (1, 0))
    assert 1.7 < odd / even < 2.3


def test_query_follows_targets_and_reruns_agree(spark, tmp_path):
    """One id on many texts and many equal rows, in a source of nearly all words."""
    from paperloom.llm.mixing import op9_mix_sources

    rows = [(None, "w " * (i % 700), "a") for i in range(300)] + [(7, "same words here", "a")] * 200 + [(i, "x y " * (i % 90), "b") for i in range(120)] + [(i, "z " * 50, None) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = []
    for n in (1, 6):
        folder = str(tmp_path / str(n))
        df.repartition(n).write.parquet(f"{folder}/documents.parquet")
        found = op9_mix_sources(spark, folder).collect()
        assert all(r.taken <= 3 * r["size"] for r in found) and len(found) == len(rows)
        for target in {r.target for r in found}:
            assert abs(sum(r.taken for r in found if r.target == target) - target) <= 700
        got.append(sorted(map(str, found)))
    assert got[0] == got[1]
