import hashlib
import random
from collections import Counter

import numpy as np

from paperloom.llm import suffix_dedup
from paperloom.llm.suffix_dedup import LENGTH, Shard, _words, repeated_passages, suffix_array


def brute(texts):
    seen = Counter(d[p : p + LENGTH] for d in texts for p in range(len(d) - LENGTH + 1))
    out = []
    for d in texts:
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - LENGTH + 1):
            if seen[d[p : p + LENGTH]] > 1:
                gone[p : p + LENGTH] = True
        gone = gone[: len(d)]
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(d) else 0
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def made(seed=1, n=120):
    draw = random.Random(seed)
    letters = "abcdeé "
    word = lambda k: "".join(draw.choice(letters) for _ in range(k))
    passages = [word(draw.randrange(150, 420)) for _ in range(8)]
    texts = [None, "", "x" * 700, "ab" * 400, "short", word(3000)]
    for _ in range(n):
        parts = [word(draw.randrange(0, 400)) for _ in range(3)]
        parts.insert(1, draw.choice(passages)[draw.randrange(0, 30) :])
        if draw.random() < 0.3:
            parts.insert(3, draw.choice(passages))
        texts.append("".join(parts))
    texts += [texts[8], texts[9], texts[9], texts[10][:500] + "!" + texts[10][500:], texts[5][1000:1900]]
    return texts


def run(spark, texts):
    df = spark.createDataFrame([(i if i != 7 else None, t, "k", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, kept string, low int").repartition(5)
    got = {}
    for r in repeated_passages(df).collect():
        got[7 if r.doc_id is None else r.doc_id] = (r.n_bytes, sum(b - a for a, b in zip(r.low, r.high)), len(r.low), hashlib.sha256(bytes(r.kept)).hexdigest())
    return [got[i] for i in range(len(texts))]


def test_like_brute_force(spark):
    texts = made()
    assert run(spark, texts) == brute([(t or "").encode() for t in texts])


def test_split_grams_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", 4)
    texts = made(seed=5, n=60)
    assert run(spark, texts) == brute([(t or "").encode() for t in texts])


def test_crowded_grams_at_the_usual_constants(spark):
    """A line in thousands of surroundings is told apart by its surroundings; one passage with thousands of different ends is merged."""
    draw = random.Random(2)
    word = lambda k: "".join(draw.choice("abcdefgh ") for _ in range(k))
    line, passage = word(90), word(199)
    texts = [word(150) + line + word(150) for _ in range(4300)] + [word(6) + passage + word(6) for _ in range(4300)]
    texts += [texts[3][20:330], texts[4400], texts[4500][1:], texts[7]]
    assert len(texts) > 2 * suffix_dedup.SHARD_CONTEXTS
    assert run(spark, texts) == brute([t.encode() for t in texts])


def test_texts_of_several_blocks(spark):
    long = "".join(chr(97 + (i * i // 7) % 26) + str(i % 97) for i in range(2_200_000))
    assert len(long) > suffix_dedup.BLOCK
    cut = long[suffix_dedup.BLOCK - 300 : suffix_dedup.BLOCK + 300]
    (n, gone, runs, _), other = run(spark, [long, "x" + cut + "y"])
    assert n == len(long) and gone >= 600 and runs >= 1 and other[1] == 600 and other[2] == 1


def test_odd_rows(odd_docs, no_docs):
    got = repeated_passages(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.doc_id: r.n_bytes for r in got}[3] == 0
    assert repeated_passages(no_docs).count() == 0


def test_suffix_array_and_common_prefixes():
    draw = random.Random(9)
    contexts = ["".join(draw.choice("ab") for _ in range(40)) * 8 for _ in range(3)] + ["ab" * 150, "a" * 300, "a" * 250]
    contexts = [c.encode()[:330] for c in contexts]
    data = b"".join(contexts)
    order, _ = suffix_array(_words(np.frombuffer(data, np.uint8)), len(data))
    assert sorted(order.tolist()) == list(range(len(data)))
    cut = [data[i : i + LENGTH] for i in order]
    assert cut == sorted(cut)
    shard = Shard(contexts)
    windows = [data[i : i + LENGTH] for i in shard.order]
    assert [int(g) for g in shard.group] == np.cumsum([1] + [a != b for a, b in zip(windows, windows[1:])]).tolist() or (shard.group == np.cumsum([0] + [a != b for a, b in zip(windows, windows[1:])])).all()
