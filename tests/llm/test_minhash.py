import random

import pytest

from paperloom.llm import minhash
from paperloom.llm.components import connected_components
from paperloom.llm.minhash import min_max_signature, near_duplicates, shingle_set


def sets(texts):
    out = {}
    for i, text in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
        words = [w for w in words if w]
        out[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def brute(texts):
    s, parent = sets(texts), {i: i for i, _ in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(s)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s[i]), find(i)) for i in ids}


def families(seed, n=25, passage_words=30):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, passage = [], [draw.choice(vocabulary) for _ in range(passage_words)]
    for family in range(n):
        base = [draw.choice(vocabulary) for _ in range(draw.randrange(1, 160))]
        if family % 3 == 0:
            base += passage
        for _ in range(draw.randrange(1, 14)):
            copy = list(base)
            for _ in range(draw.randrange(0, 6)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts.append((len(texts), draw.choice([" ", "\n", "  "]).join(copy).title() if draw.random() < 0.3 else " ".join(copy)))
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("direct", [minhash.DIRECT, 0])  # 0: all that leaders leave over meets by rare shingles
def test_like_brute_force(spark, monkeypatch, direct):
    monkeypatch.setattr(minhash, "DIRECT", direct)
    texts = families(3)
    want = brute(texts)
    got = near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_template_many_texts(spark):
    """A passage that makes up most of hundreds of texts: most pairs fall short, and none that does not is lost."""
    draw = random.Random(4)
    template = [f"t{i}" for i in range(60)]
    texts = [(i, " ".join(template + [f"x{draw.randrange(60)}" for _ in range(draw.randrange(0, 24))])) for i in range(320)]
    got = near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts)


def test_no_pair_is_lost_by_rare_shingles(spark):
    """All pairs that resemble each other enough are among the pairs that share rare shingles."""
    texts = families(6, 12)
    s = sets(texts)
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    placed = docs.selectExpr("doc_id AS rep", "doc_id AS component")
    got = {(r.a, r.b) for r in minhash._by_rare_shingles(placed, docs, 75).collect()}
    want = {(i, j) for i in s for j in s if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])}
    assert want <= got and len(got) < 3 * len(want)


def test_texts_of_one_id(spark):
    """Rows of one id are one node, whichever of their texts is alike."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, "something else entirely here now"), (1, " ".join(words)), (2, " ".join(words[:-2] + ["x", "y"])), (2, "b"), (3, "b"), (4, "c d")]
    got = near_duplicates(spark.createDataFrame(rows * 3, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles > 40} == {(1, 1), (2, 1)} and len(got) == 18
    assert {r.component_id for r in got if r.doc_id == 3} <= {1, 2} and {r.component_id for r in got if r.doc_id == 4} == {4}


def test_odd_rows(odd_docs, no_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == 1 and by[3].n_shingles == by[4].n_shingles == 0
    assert by[6].component_id == 6 and by[None].kept and by[7].n_shingles == 1 and by[9].n_shingles == 1
    assert near_duplicates(no_docs).count() == 0


def test_signature_estimates_resemblance():
    a, b = shingle_set(" ".join(map(str, range(3000)))), shingle_set(" ".join(map(str, range(600, 3600))))
    assert abs((min_max_signature(a) == min_max_signature(b)).mean() - 2396 / 3596) < 0.2


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1001, 1400)) and 5000 not in got
