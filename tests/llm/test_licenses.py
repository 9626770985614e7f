import random
import re
from fractions import Fraction

from paperloom.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, templates=L.TEMPLATES, contained=L.CONTAINED):
    found, step = words(text), max(len(t.split()) for _, t in templates)
    base = sorted((k, label) for k in range(len(found)) for phrase, label in L.PHRASES if found[k : k + len(phrase.split())] == phrase.split())
    labels, score = {b for _, b in base}, 1.0 if base else 0.0
    for first in range(0, max(1, len(found)), step):
        block = set(found[first : first + 2 * step])
        for label, t in templates:
            n = set(t.split())
            if Fraction(len(block & n), len(n)) >= contained:
                labels.add(label)
                score = max(score, len(block & n) / len(n))
    return len(found), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), score


def texts(seed, n=300):
    draw = random.Random(seed)
    own = [w for _, t in L.TEMPLATES for w in t.split()]
    out = []
    for _ in range(n):
        found = [draw.choice(own if draw.random() < 0.4 else ["lorem", "İpsum", "Ärger", "the", "of"]) for _ in range(draw.randrange(0, 130))]
        for _ in range(draw.randrange(0, 3)):
            notice = draw.choice(L.TEMPLATES)[1].split()
            if draw.random() < 0.6:
                notice[draw.randrange(len(notice))] = draw.choice(["xyz", "cc", "all"])
            if draw.random() < 0.3:
                draw.shuffle(notice)
            at = draw.randrange(len(found) + 1)
            found[at:at] = notice
        out.append(draw.choice([" ", "\n", "-", ", ", "'"]).join(w.upper() if draw.random() < 0.2 and w.isascii() else w for w in found))
    return out + ["All Rights\tReserved. all rights rights reserved", "cc by cc by", "General public\x00License", "", None, "CC-BY " * 60_000, "é" * 5000]


def test_scan_against_every_block_and_template(spark):
    given = list(enumerate(texts(1)))
    got = {r.doc_id: tuple(r)[1:] for r in L.scan(spark.createDataFrame(given, "doc_id bigint, text string").repartition(5)).collect()}
    assert got == {i: brute(t) for i, t in given} and any(v[4] != v[5] for v in got.values())


def test_lower_thresholds_lose_nothing(spark):
    given = list(enumerate(texts(2, 80)))
    for contained in (Fraction(1, 2), Fraction(3, 4), Fraction(1)):
        rows = L.matched_blocks(spark.createDataFrame(given, "doc_id bigint, text string"), contained=contained).collect()
        for i, text in given:
            own = [r for r in rows if r.doc_id == i]
            labels = brute(text, contained=contained)[5].split(",")
            assert {r.label for r in own} == {b for b in labels if b and b in dict(L.TEMPLATES)}
            for r in own:
                block = set(words(text)[r.first_word : r.first_word + r.n_words])
                t = set(dict(L.TEMPLATES)[r.label].split())
                assert r.containment == len(block & t) / len(t) >= contained


def test_order_is_rarest_first():
    index = L.Index([("a", "x y z"), ("b", "x q")], {b"x": 9, b"y": 1, b"z": 4, b"q": 1}, Fraction(2, 3))
    assert sorted(index.rank, key=index.rank.get) == [b"q", b"y", b"z", b"x"]
    assert index.needs == [2, 2] and set(index.prefixes) == {b"y", b"z", b"q"}


def test_odd_rows(odd_docs, no_docs):
    assert L.scan(no_docs).collect() == [] and L.matched_blocks(no_docs).collect() == []
    got = sorted((r.doc_id or -1, r.n_words) for r in L.scan(odd_docs).collect())
    assert got == sorted((r.doc_id or -1, len(words(r.text))) for r in odd_docs.collect())
