import hashlib
import random

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from paperloom.llm import common, minhash, sharding
from paperloom.llm.bpe import VOCABULARY, codec
from test_langid import WORDS


def test_stages_against_brute_force(spark, tmp_path):
    draw = random.Random(8)
    rows = []
    for i in range(160):
        lang = draw.choice(sorted(WORDS))
        rows.append((i, " ".join(draw.choice(WORDS[lang]) for _ in range(60)), lang, draw.choice(["a", "a", "a", "b", None])))
    rows += [(200 + k, rows[k][1].replace(" ", "\n"), rows[k][2], "b") for k in range(30)]
    rows += [(300 + k, " ".join(rows[k][1].split()[:-2] + ["xyz", "zyx"]), rows[k][2], "a") for k in range(20, 40)]
    rows += [(400, None, "en", "a"), (401, "", "en", "a"), (402, "1 2 3", "de", "b")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    step = [{r.doc_id: r for r in docs.collect()}]
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == docs.columns
        step.append({r.doc_id: r for r in frame.collect()})
    assert set(step[0]) - set(step[1]) == {400, 401, 402}
    equal = {}
    for i in sorted(step[1]):
        equal.setdefault("".join(step[1][i].text.split()), i)
    assert set(step[2]) == set(equal.values())
    assert set(step[2]) - set(step[3]) == {300 + k for k in range(20, 40)}
    mixed = corpus_pipeline.mixture(spark, frame, str(tmp_path))
    taken = mixed.collect()
    assert mixed.columns == docs.columns and {r.doc_id for r in taken} <= set(step[3])
    words = {s: sum(len(r.text.split()) for r in taken if r.source == s) for s in ("a", "b", None)}
    assert abs(words["a"] / sum(words.values()) - 5 / 8) < 0.05
    own = codec(P.path(VOCABULARY), P.PATTERN)
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    want = []
    for r in taken:
        packed = own.encode(r.text)
        want.append((r.doc_id, r.source, r.lang, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert got == sorted(want, key=str) and np.isfinite([w[3] for w in want]).all()


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    """Nulls, blank and repeated rows, and extra columns pass every stage; an empty table stays empty."""
    for docs in (odd_docs, no_docs):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            rows = out.collect()
            assert name == "byte_bpe" or out.columns == docs.columns
            assert name == "mixing" or len(rows) <= n
            if name == "exact_dedup" and n:
                assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 5, 6, 6, 7, 8, 9, 10]
            if name == "near_dedup" and n:
                assert {r.doc_id for r in rows} == {1, 3, 4, 5, 6, 7, 8, 9, 10, None}


def test_rows_are_dropped_one_by_one(spark):
    """A dropped row takes along no other row of its id, null or repeated."""
    long = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, "a copy of this"), (None, "acopy of this"), (None, "unique one"), (None, "unique two"), (None, "two  blanks"), (None, "two blanks"), (None, None),
        (2, "repeated id"), (2, "a  b c"), (3, "repeated  id"), (4, long), (5, long + " more"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    exact = corpus_pipeline.exact_duplicates(spark, docs, "")
    got = {(r.doc_id, r.text) for r in exact.collect()}
    assert exact.columns == docs.columns and got == set(rows) - {(None, "acopy of this"), (None, "two blanks"), (2, "repeated id")}
    near = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert near == set(rows) - {(5, long + " more"), (3, "repeated  id")}


def test_results_that_were_built_before_survive_a_run(spark, odd_docs, no_docs, tmp_path):
    """A run deletes its own tables only; an empty table runs to the end."""
    for name, docs in (("rows", odd_docs), ("none", no_docs)):
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / name / "documents.parquet"))
    before = sharding.op4_stratified_shards(spark, str(tmp_path / "rows"))
    near = minhash.op1_minhash_near_dedup(spark, str(tmp_path / "rows"))
    first, none = corpus_pipeline.run(spark, str(tmp_path / "rows")), corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert before.count() == near.count() == odd_docs.count() and none.count() == 0
    assert first.count() == corpus_pipeline.run(spark, str(tmp_path / "rows")).count()


def test_workers_forget_the_caches_of_other_operators():
    common.settle("bpe")
    codec(P.path(VOCABULARY), P.PATTERN).encode("some words to remember")
    common.settle("bpe")
    assert codec.cache_info().currsize == 1
    common.settle("another")
    assert codec.cache_info().currsize == 0
