"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; runs of anything but letters become one space; the n-grams of one to three characters
are hashed to ``BUCKETS`` features with weight (1 + log tf) * idf, scaled to unit length.  Document frequencies
are counted over every learnable row.  The regression is trained by follow-the-regularised-leader with L1 and
L2 penalties on a sample of at most ``SAMPLE_ROWS`` labelled rows, alike for each language (those of least
hash), and a temperature fitted on the sample's calibration fold makes its scores probabilities.

Defined results: text that is null or has no letter is ``und`` with score 0, and so is every text if there is
no labelled row; ties of the score go to the language first by code point; rows with null language are
predicted but never learned from; more than ``LANGUAGES`` different labels raise; a null id counts as the empty text
for the fold; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import appended, documents, python_map

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SAMPLE_ROWS, LANGUAGES = 4000, 1000
CALIBRATION_SHARE = 5  # one sampled row in this many
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 2e-4, 1e-4
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def term_counts(text: str | None) -> np.ndarray | None:
    """How often each feature occurs in the text; None if it has no letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character after a run of letters stands for the gap
    code = np.where(letter, code, np.uint32(32))[keep]
    code = np.concatenate([[32], code, [32]]).astype(np.uint32)
    one = code * _A
    two = (one[:-1] ^ (code[1:] * _B)) * _A
    three = (two[:-1] ^ (code[2:] * _B)) * _A
    grams = np.concatenate([one ^ np.uint32(1), two ^ np.uint32(2), three ^ np.uint32(3)])
    grams ^= grams >> np.uint32(15)
    return np.bincount((grams * _B) >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (BUCKETS + 1, languages); the last row is the bias
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        value = (1 + np.log(counts[at])) * self.idf[at]
        norm = np.sqrt(value @ value)
        return at, value / norm if norm > 0 else value

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = term_counts(text) if self.languages else None
        if counts is None:
            return "und", 0.0
        at, value = self.features(counts)
        p = _softmax((value @ self.weights[at] + self.weights[-1]) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def follow_the_regularised_leader(rows, classes: int, seed: int = 7) -> np.ndarray:
    """Weights from rows of (indices, values, class), by the per-coordinate proximal update."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            at, value, label = rows[k]
            at, value = np.append(at, BUCKETS), np.append(value, 1.0)
            w = weights(at)
            error = _softmax(value @ w)
            error[label] -= 1
            gradient = value[:, None] * error[None, :]
            seen = n[at]
            grown = seen + gradient * gradient
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(seen)) / ALPHA * w
            n[at] = grown
    return weights(slice(None))


def fitted_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels]))

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    for _ in range(40):
        if loss(a) < loss(b):
            high, b = b, a
            a = high - ratio * (high - low)
        else:
            low, a = a, b
            b = low + ratio * (high - low)
    return float(np.exp((low + high) / 2))


def _document_frequency(batches):
    seen, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            if (counts := term_counts(text.as_py())) is not None:
                seen += counts > 0
                n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[at], n))], ["bucket", "n"])


def _sparse_rows(batches):
    for batch in batches:
        index, value = [], []
        for text in batch.column(2):
            counts = term_counts(text.as_py())
            at = np.flatnonzero(counts) if counts is not None else np.zeros(0, np.int64)
            index.append(at.astype(np.uint16).tobytes())
            value.append(counts[at].astype(np.int32).tobytes() if len(at) else b"")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["lang", "h", "at", "tf"])


def train(learnable: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """learnable (doc_id, text, lang) -> a calibrated model.

    The driver holds one number a bucket, one a language, and the sparse counts of the sampled rows.
    """
    learnable = learnable.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_language = {r["lang"]: r["n"] for r in learnable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    languages = sorted(per_language)
    if len(languages) > LANGUAGES:
        raise ValueError(f"{len(languages)} different values of lang are no languages; {LANGUAGES} at most")
    if not languages:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS + 1, 0)))
    df = python_map(learnable.select("text"), _document_frequency, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = {r["bucket"]: r["n"] for r in df}
    idf = np.full(BUCKETS, np.log(1 + seen.get(-1, 0)) + 1)
    for bucket, n in seen.items():
        if bucket >= 0:
            idf[bucket] = np.log((1 + seen[-1]) / (1 + n)) + 1
    quota = max(1, sample_rows // len(languages))
    h = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 40))
    share = F.create_map(*[x for lang, n in per_language.items() for x in (F.lit(lang), F.lit(min(1.0, quota / n)))])
    drawn = learnable.select("lang", h.alias("h"), "text").where(F.col("h") <= share[F.col("lang")] * float(1 << 40))
    # at most the quota of each language: what a threshold drew beyond it is a few rows, since equal rows count once
    drawn = drawn.distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    drawn = drawn.withColumn("at", first).where(F.col("at") <= quota).select("lang", "h", "text")
    rows = python_map(drawn, _sparse_rows, "lang string, h bigint, at binary, tf binary").collect()
    rows.sort(key=lambda r: (r["h"], r["lang"]))
    model, fit, held = Model(languages, idf, np.zeros((BUCKETS + 1, len(languages)))), [], []
    for k, r in enumerate(rows):
        counts = np.zeros(BUCKETS, np.int64)
        counts[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["tf"], np.int32)
        if counts.any():
            (held if k % CALIBRATION_SHARE == 0 and len(rows) >= 50 else fit).append((*model.features(counts), languages.index(r["lang"])))
    model.weights = follow_the_regularised_leader(fit, len(languages)).astype(np.float32)
    logits = np.array([v @ model.weights[at] + model.weights[-1] for at, v, _ in held]).reshape(len(held), len(languages))
    model.temperature = fitted_temperature(logits, np.array([y for *_, y in held], int))
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Documents with the predicted language and its score, under the given names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language
    fields = [(names[0], T.StringType(), pa.string()), (names[1], T.DoubleType(), pa.float64())]
    return appended(docs, text_col, fields, lambda text: shared.value.predict(text))


def held_out():
    """True for rows that are never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def language_model(docs: DataFrame) -> Model:
    return train(docs.where(~held_out()).select("doc_id", "text", "lang"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of documents, by a model of the rows that are not held out."""
    found = predict(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


QUERIES = {"op3_language_id": op3_language_id}
ORACLES = {}
