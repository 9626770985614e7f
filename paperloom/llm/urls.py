"""URL filter by a ratio of character language models.

URLs that a rule decides are the labelled ones: allowed URLs train the accepting model, blocked URLs the
rejecting one.  Both are variable-order Markov models of bytes: the probability of a byte after a context of up
to ORDER bytes is interpolated with that after the next shorter context by Witten and Bell's weights, down to
the uniform distribution.  A URL that no rule decides is scored by the difference of log-likelihoods a byte;
the difference is calibrated by a logistic curve that is fitted on labelled URLs kept out of the counts then, and
probabilities of acceptance of one half or more allow the URL.

Counts cover every labelled URL.  A gram is a byte after the ORDER bytes before it, in
exact form: 9 bits a byte, 256 before the start; what is counted grows with the URLs and stays a table.  Counts of
shorter contexts are sums over it, and the models become one number for each gram that occurs in a URL: the
difference of its log-probabilities.  URLs are scored by joining their grams to that table, which is broadcast
only if it has at most BROADCAST_GRAMS rows by count.  The calibration takes BINS counts a class to the driver.

Defined results: a url that is null or has no ``://`` has an empty host and path and fits no rule; null is
scored as the empty url, whose difference is 0; if either class has no labelled URL, what no rule decides is
allowed; other columns are ignored and repeated rows are judged alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import python_map, small, staged

ORDER = 4
BYTE_BITS = 9
BROADCAST_GRAMS = 1_000_000  # at 16 bytes
CHUNK_BYTES = 1 << 20
BINS, SPAN = 512, 4.0
FOLDS = 5
#: (rule, verdict): a host and, from its first slash, the start of a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host and path."""
    rest = F.when(F.instr(F.col(url_col), "://") > 0, F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^(?s)([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^(?s)[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", host).withColumn("path", path)


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Add the longest rule that fits, and its verdict (null: none fits)."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):  # the longest is tried first: it is the outermost
        name, slash, start = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _chunks(urls: list):
    """The URLs' bytes, in lists of bounded size (of one URL at least)."""
    held, size = [], 0
    for url in urls:
        held.append((url or "").encode("utf-8"))
        size += len(held[-1])
        if size > CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all URLs in turn, the last byte in the lowest bits; and the URLs' lengths."""
    lengths = np.fromiter(map(len, urls), np.int64, len(urls))
    data = np.frombuffer(b"".join(urls), np.uint8).astype(np.int64)
    at = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = data.copy()
    for k in range(1, ORDER + 1):
        before = np.full(len(data), 256, np.int64)
        inside = np.flatnonzero(at >= k)
        before[inside] = data[inside - k]
        out |= before << np.int64(BYTE_BITS * k)
    return out, lengths


def _count(batches):
    for batch in batches:
        label = np.array([-1 if x is None else x for x in batch.column(1).to_pylist()], np.int64)
        at = 0
        for urls in _chunks(batch.column(0).to_pylist()):
            gram, lengths = grams(urls)
            of = np.repeat(label[at : at + len(urls)], lengths)
            at += len(urls)
            key, where = np.unique(gram, return_inverse=True)
            n = [np.bincount(where[of == k], minlength=len(key)).astype(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n[0]), pa.array(n[1])], ["gram", "n0", "n1"])


def gram_counts(urls: DataFrame) -> DataFrame:
    """urls (url, label 1, 0 or null) -> gram, n0, n1 of every gram of every URL; those without a label count 0."""
    counted = python_map(urls.select("url", "label"), _count, "gram bigint, n0 bigint, n1 bigint")
    return counted.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def weights(counted: DataFrame) -> DataFrame:
    """gram, delta: the log-probability of each gram in the accepting model less that in the rejecting one."""
    tables = [counted]
    for order in range(ORDER - 1, -1, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << BYTE_BITS * (order + 1)) - 1))
        tables.append(staged(tables[-1].groupBy(suffix.alias("gram")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams"))
    known = None
    for order, table in enumerate(reversed(tables)):
        table = table.withColumn("ctx", F.shiftright("gram", BYTE_BITS))
        seen = [F.sum(f"n{k}").alias(f"t{k}") for k in (0, 1)] + [F.count_if(F.col(f"n{k}") > 0).alias(f"d{k}") for k in (0, 1)]
        rows = table.join(table.groupBy("ctx").agg(*seen), "ctx")
        if known is None:
            rows = rows.withColumn("q0", F.lit(1 / 256)).withColumn("q1", F.lit(1 / 256))
        else:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << BYTE_BITS * order) - 1))
            rows = rows.withColumn("shorter", shorter).join(known, "shorter")
        p = [F.when(F.col(f"t{k}") > 0, (F.col(f"n{k}") + F.col(f"d{k}") * F.col(f"q{k}")) / (F.col(f"t{k}") + F.col(f"d{k}"))).otherwise(F.col(f"q{k}")) for k in (0, 1)]
        known = staged(rows.select(F.col("gram").alias("shorter"), p[0].alias("q0"), p[1].alias("q1")), "grams")
    return staged(known.select(F.col("shorter").alias("gram"), (F.log("q1") - F.log("q0")).alias("delta")), "weights")


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, both classes weighing alike, with a weak ridge."""
    w = np.where(y == 1, w / max(w[y == 1].sum(), 1e-9), w / max(w[y == 0].sum(), 1e-9))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + 1e-3 * a, (w * (p - y)).sum() + 1e-3 * b])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def train(rows: DataFrame) -> tuple[DataFrame | None, float, float]:
    """rows (url, label 1, 0 or null) -> weights of all their grams (None: a class is empty), and slope and offset.

    The calibration is fitted with models that leave its fold out; the weights are those of all labelled URLs.
    """
    counted = staged(gram_counts(rows), "grams")
    if not _both(counted):
        return None, 1.0, 0.0
    fold = F.pmod(F.xxhash64(F.lit("calibration"), "url"), F.lit(FOLDS))
    return weights(counted), *_calibration(rows.where((fold == 0) & F.col("label").isNotNull()), rows.withColumn("label", F.when(fold != 0, F.col("label"))))


def _both(counted: DataFrame) -> bool:
    sums = counted.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    return bool(sums["n0"] and sums["n1"])


def _calibration(held_out: DataFrame, rest: DataFrame) -> tuple[float, float]:
    """Slope and offset; 1 and 0 if either part has no URL of a class."""
    counted = staged(gram_counts(rest), "grams")
    if not _both(counted):
        return 1.0, 0.0
    bins = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("difference") + SPAN) / (2 * SPAN) * BINS))).cast("int")
    seen = differences(held_out, weights(counted)).groupBy("label", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    if seen["label"].nunique() < 2:
        return 1.0, 0.0
    x = (seen["bin"].to_numpy(float) + 0.5) / BINS * 2 * SPAN - SPAN
    return _logistic(x, seen["label"].to_numpy(float), seen["n"].to_numpy(float))


def differences(df: DataFrame, delta: DataFrame | None) -> DataFrame:
    """df with the difference of its url; an empty url or class gives 0."""
    if delta is None:
        return df.withColumn("difference", F.lit(0.0))
    n = delta.count()
    if n > BROADCAST_GRAMS:
        return _joined(df, delta)
    table = delta.toPandas().sort_values("gram")
    shared = df.sparkSession.sparkContext.broadcast((table["gram"].to_numpy(np.int64), table["delta"].to_numpy(np.float64)))

    def run(batches):
        known, value = shared.value
        for batch in batches:
            made = [np.zeros(0)]
            for urls in _chunks(batch.column(batch.schema.get_field_index("url")).to_pylist()):
                gram, lengths = grams(urls)
                total = np.bincount(np.repeat(np.arange(len(urls)), lengths), value[np.searchsorted(known, gram)] if len(gram) else None, len(urls))
                made.append(total / np.maximum(lengths, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(made), pa.float64())], [*batch.schema.names, "difference"])

    return python_map(df, run, T.StructType([*df.schema.fields, T.StructField("difference", T.DoubleType())]))


def _exploded(batches):
    for batch in batches:
        at = 0
        for urls in _chunks(batch.column(2).to_pylist()):
            gram, lengths = grams(urls)
            keys = [np.repeat(batch.column(k).to_numpy()[at : at + len(urls)], lengths) for k in (0, 1)]
            at += len(urls)
            yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(np.repeat(lengths, lengths)), pa.array(gram)], ["u1", "u2", "length", "gram"])


def _joined(df: DataFrame, delta: DataFrame) -> DataFrame:
    """The same by shuffled joins: each distinct url's grams meet the table, and their sums meet the rows."""
    keys = [F.xxhash64("url").alias("u1"), F.xxhash64(F.lit("second"), "url").alias("u2")]
    each = python_map(df.select("url").where("url is not null").distinct().select(*keys, "url"), _exploded, "u1 bigint, u2 bigint, length bigint, gram bigint")
    sums = each.join(delta, "gram").groupBy("u1", "u2").agg((F.sum("delta") / F.max("length")).alias("difference"))
    rows = df.select("*", *keys).join(small(staged(sums, "differences")), ["u1", "u2"], "left").drop("u1", "u2")
    return rows.withColumn("difference", F.coalesce("difference", F.lit(0.0)))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, difference, acceptance of every page."""
    rows = with_rule(with_parts(pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"))), rules)
    delta, slope, offset = train(rows.select("url", F.when(F.col("rule").isNotNull(), (F.col("rule_verdict") == "allow").cast("int")).alias("label")))
    scored = differences(rows, delta)
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("difference") * slope + offset))
    scored = scored.withColumn("acceptance", 1 / (1 + F.exp(-z)))
    learned = F.when((F.col("acceptance") >= 0.5) | F.lit(delta is None), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", learned).alias("verdict"), "difference", "acceptance")


def op5_url_ratio(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_url_ratio": op5_url_ratio}
ORACLES = {}
