"""License scans by an exact set-similarity join of text blocks with license templates.

Words are runs of letters, digits and characters beyond ASCII, lower-cased in ASCII.  A block is a window of twice the
longest template's words; windows overlap by half, so that every run of a template's length lies whole in one.  A template
is found in a block that holds at least CONTAINED of its distinct words, whatever their order.

The join is exact.  Tokens are put in one global order, rarest first by their count over all documents.  If a block holds
k of a template's n words, one of the template's first n - k + 1 words by that order is among the block's first m - k + 1,
of the m words that the block has of any template: only those are looked up.  Blocks of less than k such words are left
out by their length, candidates by what the places of their first common words leave possible, and what remains is
counted.  Templates are configuration, some hundred at most; documents stay where they are, and only counts of the
templates' own words are shuffled.

Labels come from templates and from phrases, which are found wherever their words stand side by side.

Defined results: a null text is empty; a document without words has zeros, empty labels and null places; null ids and
repeated rows are reported as they are; texts are read whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import documents, python_map

#: Least share of a template's distinct words.
CONTAINED = Fraction(9, 10)

# fixed values: phrases with their labels, and notices of well-known licenses with theirs
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Bytes of a text -> the same in lower case, with blanks for what belongs to no word.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_FOLD).split()


def stride_of(templates) -> int:
    return max((len(words_of(text.encode())) for _, text in templates), default=1)


class Index:
    """Templates by the prefix of their words in global order."""

    def __init__(self, templates, counts: dict[bytes, int], contained: Fraction = CONTAINED):
        self.stride = stride_of(templates)
        self.sets = [frozenset(words_of(text.encode())) for _, text in templates]
        order = sorted(frozenset().union(*self.sets), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(order)}
        self.needs = [-(-contained.numerator * len(s) // contained.denominator) for s in self.sets]
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        for t, (words, need) in enumerate(zip(self.sets, self.needs)):
            for place, w in enumerate(sorted(words, key=self.rank.get)[: len(words) - need + 1]):
                self.prefixes.setdefault(w, []).append((t, place))
        self.least = min(self.needs, default=1)

    def matches(self, block: set[bytes]) -> Iterator[tuple[int, int]]:
        """(template, words in common) of every template that the block holds."""
        own = sorted((w for w in block if w in self.rank), key=self.rank.get)
        common: Counter = Counter()
        for place, w in enumerate(own[: max(0, len(own) - self.least + 1)]):
            for t, at in self.prefixes.get(w, ()):
                need = self.needs[t]
                if len(own) >= need and common[t] >= 0:
                    if common[t] + 1 + min(len(self.sets[t]) - at - 1, len(own) - place - 1) >= need:
                        common[t] += 1
                    else:
                        common[t] = -1  # not enough words are left behind this place
        for t, seen in common.items():
            if seen > 0 and (both := len(self.sets[t] & block)) >= self.needs[t]:
                yield t, both

    def blocks(self, words: list[bytes], places: list[int]) -> Iterator[tuple[int, int, int]]:
        """(first word of the block, template, words in common), for the blocks that hold a word of a prefix."""
        step = self.stride
        last = max(0, -(-len(words) // step) - 2)  # windows behind it are part of this one
        for b in sorted({min(k, last) for p in places for k in (p // step - 1, p // step) if k >= 0}):
            for t, both in self.matches(set(words[b * step : (b + 2) * step])):
                yield b * step, t, both


def _counted(vocabulary: frozenset[bytes]):
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()):
                counts.update([w for w in words_of(raw.as_py()) if w in vocabulary])
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return run


def word_counts(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> dict[bytes, int]:
    """How often each word of the templates stands in all documents: as many numbers as the templates have words."""
    vocabulary = frozenset(w for _, text in templates for w in words_of(text.encode()))
    counts = python_map(docs.select(F.col(text_col).cast("string")), _counted(vocabulary), "word binary, n bigint")
    return {bytes(r.word): r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _places(words: list[bytes], wanted: frozenset[bytes]) -> list[int]:
    return [k for k, w in enumerate(words) if w in wanted]


_SPANS = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())])


def matched_blocks(docs: DataFrame, templates=TEMPLATES, contained: Fraction = CONTAINED, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, label, first_word and n_words of the block, containment: a row for every block and template that meet."""
    index = Index(templates, word_counts(docs, templates, text_col), contained)
    labels, wanted = [label for label, _ in templates], frozenset(index.prefixes)

    def run(batches):
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = words_of(raw.as_py())
                for first, t, both in index.blocks(words, _places(words, wanted)):
                    rows.append((doc, labels[t], first, min(2 * index.stride, len(words) - first), both / len(index.sets[t])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 5, _SPANS)], schema=_SPANS)

    return python_map(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), run, "doc_id bigint, label string, first_word bigint, n_words bigint, containment double")


REPORT = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
_REPORT = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[k]) for n, k in (p.split() for p in REPORT.split(","))])


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, contained: Fraction = CONTAINED, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a document: its words, the phrases' places, labels of phrases and of all, and the greatest containment (a phrase stands whole: 1)."""
    index = Index(templates, word_counts(docs, templates, text_col), contained)
    names, sizes = [label for label, _ in templates], [len(s) for s in index.sets]
    said = [(words_of(text.encode()), label) for text, label in phrases]
    probes = frozenset(index.prefixes)
    wanted = probes | {p[0] for p, _ in said}

    def one(words):
        places = _places(words, wanted)
        spots, base = [], set()
        for k in places:
            for phrase, label in said:
                if words[k] == phrase[0] and words[k : k + len(phrase)] == phrase:
                    spots.append(k)
                    base.add(label)
        found, score = set(base), 1.0 if base else 0.0
        for _, t, both in index.blocks(words, [k for k in places if words[k] in probes]):
            found.add(names[t])
            score = max(score, both / sizes[t])
        return len(words), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(base)), ",".join(sorted(found)), score

    def run(batches):
        for batch in batches:
            rows = [(doc, *one(words_of(raw.as_py()))) for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 8, _REPORT)], schema=_REPORT)

    return python_map(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), run, REPORT)


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def sql(templates=TEMPLATES, phrases=PHRASES, contained: Fraction = CONTAINED) -> str:
    """Every block against every template, without order or filters."""
    listed = lambda text: "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"
    step = stride_of(templates)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), phrases(label, p) AS (VALUES {', '.join(f"('{label}', {listed(text)})" for text, label in phrases)}
), starts AS (
  SELECT rid, w, unnest(range(0, len(w))) AS k FROM d
), base AS (
  SELECT rid, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS found
  FROM starts JOIN phrases ON w[k + 1] = p[1] AND w[k + 1:k + len(p)] = p GROUP BY rid
), templates(label, t) AS (SELECT label, list_distinct(t) FROM (VALUES {', '.join(f"('{label}', {listed(text)})" for label, text in templates)}) v(label, t)
), blocks AS (
  SELECT rid, list_distinct(w[b * {step} + 1:(b + 2) * {step}]) AS words FROM (SELECT rid, w, unnest(range(0, greatest(1, CAST(ceil(len(w) / {step}.0) AS BIGINT) - 1))) AS b FROM d)
), met AS (
  SELECT rid, list(DISTINCT label) AS found, max(share) AS share FROM (SELECT rid, label, len(list_intersect(words, t)) / CAST(len(t) AS DOUBLE) AS share, len(list_intersect(words, t)) * {contained.denominator} >= len(t) * {contained.numerator} AS holds FROM blocks, templates) WHERE holds GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.found, []), coalesce(met.found, [])))), ',') AS labels, greatest(CASE WHEN n_base > 0 THEN 1 ELSE 0 END, coalesce(share, 0)) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN met USING (rid)
"""


QUERIES = {"op12_license_scan": op12_license_scan}
ORACLES = {"op12_license_scan": sql()}
