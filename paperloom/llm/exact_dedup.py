"""Exact deduplication by Grace hashing.

Records are hashed into an open-addressing table that compares complete contents.  A table that outgrows
its budget is partitioned on further hash bits into spill files, and each file is read into a table of its
own, recursively.  It runs twice: in every input partition, so that a hot group leaves each of them as one
record, and again after the shuffle by content hash.  Memory is bounded by the budget and the longest text.

Defined results: a null text counts as empty; a null id sorts after every other id; an empty input gives an
empty output; rows with the same id and text stay or go together; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import SPACE_BYTES, documents, python_map, spill_dir

FAN_OUT_BITS = 4
HASH_BITS = 64


class GraceTable:
    """Distinct contents with their best row and count; spills when its contents outgrow ``budget`` bytes."""

    def __init__(self, budget: int, level: int = 0):
        self.budget, self.level = budget, level
        self.slots, self.mask = [-1] * 1024, 1023
        self.entries: list[list] = []
        self.bytes = 0
        self.folder = None
        self.files: list = []

    def add(self, key: int, content: bytes, digest: bytes, length: int, row: int | None, count: int) -> None:
        if self.files:
            return self._spill((key, content, digest, length, row, count))
        at = (key >> 7) & self.mask
        slots, entries = self.slots, self.entries
        while (found := slots[at]) >= 0:
            entry = entries[found]
            if entry[0] == key and entry[1] == content:
                if (-length, row is None, row or 0) < (-entry[3], entry[4] is None, entry[4] or 0):
                    entry[3], entry[4] = length, row
                entry[5] += count
                return None
            at = (at + 1) & self.mask
        slots[at] = len(entries)
        entries.append([key, content, digest, length, row, count])
        self.bytes += len(content) + 400  # with what Python adds to an entry
        if len(entries) * 2 > self.mask:
            self._grow()
        if self.bytes > self.budget and len(entries) > 1 and (self.level + 1) * FAN_OUT_BITS <= HASH_BITS:
            self._open()
        return None

    def _grow(self) -> None:
        self.mask = self.mask * 2 + 1
        self.slots = [-1] * (self.mask + 1)
        for i, entry in enumerate(self.entries):
            at = (entry[0] >> 7) & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = i

    def _open(self) -> None:
        self.folder = spill_dir("grace-")
        self.files = [open(os.path.join(self.folder, str(i)), "w+b") for i in range(1 << FAN_OUT_BITS)]
        entries, self.entries, self.slots = self.entries, [], []
        for entry in entries:
            self._spill(entry)

    def _spill(self, record) -> None:
        part = record[0] >> (HASH_BITS - (self.level + 1) * FAN_OUT_BITS) & ((1 << FAN_OUT_BITS) - 1)
        pickle.dump(tuple(record), self.files[part], protocol=5)

    def drain(self) -> Iterator[list]:
        if not self.files:
            yield from self.entries
            return
        try:
            for file in self.files:
                end = file.tell()
                file.seek(0)
                inner = GraceTable(self.budget, self.level + 1)
                while file.tell() < end:
                    inner.add(*pickle.load(file))
                file.close()
                yield from inner.drain()
        finally:
            self.close()

    def close(self) -> None:
        for file in self.files:
            file.close()
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


SCHEMA = "digest string, content binary, length bigint, id bigint, n bigint"
_ARROW = pa.schema([("digest", pa.string()), ("content", pa.binary()), ("length", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])


def _emit(table: GraceTable, with_content: bool, chunk_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    try:
        for _, content, digest, length, row, n in table.drain():
            rows.append((digest.hex(), content if with_content else None, length, row, n))
            held += len(content) + 100
            if held > chunk_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
    finally:
        table.close()


def _within_partition(budget: int):
    def run(batches):
        table = GraceTable(budget)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                content = text.encode("utf-8").translate(None, SPACE_BYTES)
                digest = hashlib.sha256(content).digest()
                table.add(int.from_bytes(digest[:8], "big"), content, digest, len(text), row, 1)
        yield from _emit(table, True)

    return run


def _between_partitions(budget: int):
    def run(batches):
        table = GraceTable(budget)
        for batch in batches:
            for digest, content, length, row, n in zip(*(batch.column(i) for i in range(5))):
                digest = bytes.fromhex(digest.as_py())
                table.add(int.from_bytes(digest[:8], "big"), content.as_py(), digest, length.as_py(), row.as_py(), n.as_py())
        yield from _emit(table, False)

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 96 << 20) -> DataFrame:
    """One row for each distinct content: digest, the id and length of the row that stays, and the group's size."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    partial = python_map(rows, _within_partition(budget), SCHEMA)
    merged = python_map(partial.repartition("digest"), _between_partitions(budget), SCHEMA)
    return merged.select("digest", F.col("id").alias("keep_id"), F.col("length").alias("keep_length"), F.col("n").alias("group_size"))


def content_digest(text):
    """SHA-256 of the text without separator characters, as lowercase hex."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACE_BYTES.decode(), ""), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 96 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256, and the columns to carry.

    The join back to the documents is on the digest; a hot digest is a skewed side that AQE splits.
    """
    slim = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), content_digest(F.col(text_col)).alias("text_sha256"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("_length"), *carry,
    )
    groups = exact_groups(docs, id_col, text_col, budget)
    return slim.join(groups, slim["text_sha256"] == groups["digest"]).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_length") == F.col("keep_length"))).alias("kept"), "text_sha256", *carry,
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id NULLS LAST) AS keep_id
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k
"""

QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {"op6_exact_dedup": SQL}
