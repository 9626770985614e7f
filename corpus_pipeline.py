"""A corpus from documents: language ID, exact and near deduplication, mixing, and token ids.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns the columns
of documents; the last returns doc_id, source, lang and the digests of the token ids.  A document that the
mixture takes several times is as many rows from there on.

Defined results of every stage: a null column is a value like others, and rows are kept or dropped one by one;
texts are read whole, however long; ties go as the stage's operator says, the same way in every run; repeated rows
are treated alike (of equal texts one stays); an empty table gives an empty table; extra columns pass through,
whatever their names, but for names with two underscores on both sides, which the stages use themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, exact_dedup, langid, minhash, mixing
from paperloom.llm.common import documents, scope, small, staged

#: A language is accepted if its calibrated probability is at least this; text without letters has none.
LEAST_SCORE = 0.5
#: Pieces that a worker remembers while it encodes: fewer than alone, since executors hold what earlier stages left.
PIECES = 60_000


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds 128 bits of the text's digest: with the id, they tell rows apart that the operators may mark differently."""
    return docs.withColumn("__text__", F.unhex(F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), 1, 32)))


def _without(docs: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """The documents whose keys are not those of a row that is marked as not kept."""
    gone = marked.where("not kept").select(*[F.col(k).alias(f"__gone_{k}__") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__gone_{k}__")) for k in keys])
    return docs.join(small(staged(gone, "gone")), same, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the classifier is sure of go: null texts, texts without letters, scores below LEAST_SCORE."""
    found = langid.predict(docs, langid.language_model(docs), names=("__lang__", "__score__"))
    return found.where((F.col("__lang__") != "und") & (F.col("__score__") >= LEAST_SCORE)).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal contents stays: the longest as written, then that of the smallest id (null last); null texts equal empty ones."""
    keyed = _keyed(docs)
    return _without(keyed, exact_dedup.exact_dedup(keyed, carry=("__text__",)), ["doc_id", "__text__"]).drop("__text__")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id.  Rows of one id are one node there; null ids stay."""
    return _without(docs, minhash.near_duplicates(docs), ["doc_id"])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; the null source is a source, and texts without words are not taken."""
    mixed = mixing.mix(staged(mixing.sized(docs), "mix-sizes"))
    copies = mixed.groupBy(F.col("doc_id").alias("__id__"), F.col("source").alias("__source__")).agg(F.max("copies").cast("int").alias("__copies__")).where("__copies__ > 0")
    same = F.col("doc_id").eqNullSafe(F.col("__id__")) & F.col("source").eqNullSafe(F.col("__source__"))
    taken = docs.join(small(staged(copies, "copies")), same)
    return taken.withColumn("__copy__", F.explode(F.sequence(F.lit(1), F.col("__copies__")))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids_sha256, decoded_sha256 of every row; a null text has no tokens."""
    return bpe.digests(docs, ["source", "lang"], PIECES)


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates), ("mixing", mixture), ("byte_bpe", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before returns is a table in the shared folder, deleted once the next is written."""
    with scope() as release:
        docs = documents(spark, sf_dir)
        for name, stage in STAGES[:-1]:
            docs = staged(stage(spark, docs, sf_dir), name)
            release(docs)
        return STAGES[-1][1](spark, docs, sf_dir)
