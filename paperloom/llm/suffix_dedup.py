"""Repeated passages by suffix arrays: every byte that a 200-byte string starting elsewhere too covers.

Only strings that may repeat reach a suffix array.  Each 200-byte window picks the least hash of the 32-byte
grams inside it, a choice that depends on the window's bytes alone; so equal windows pick equal grams, and a
gram that occurs once in the corpus rules out all windows that picked it.  The windows that picked one gram
occurrence are consecutive; the bytes they span are its context.  Contexts of equal 128-bit digests (and equal
grams) are one context with a count.

Contexts of every gram that occurs twice are dealt to shards by gram.  A shard builds the suffix array of its
contexts by Larsson and Sadakane's refinement (ranks double their depth each round, and only groups that are still
tied are sorted again), takes common prefixes of neighbours by Kasai's walk, a lane for each context, and marks
windows whose neighbour shares ``LENGTH`` bytes or whose context counts more than once.

A gram with more than ``SHARD_CONTEXTS`` contexts is a short passage in many surroundings.  Its windows are told apart
by how far into them the gram begins, ``STEP`` places together, and by the bytes that all windows of such a range
have: equal windows agree in both.  What is still too large for a shard is split over several, and each pair of
those is merged by binary search of one's windows in the other's array.

Defined results: null text is empty; texts shorter than the window lose nothing; strings never cross documents;
repeated rows are copies of each other; rows with a null id are treated like others; extra columns are ignored;
an empty input gives an empty output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, documents, python_map, small, staged

LENGTH = 200
GRAM = 32
SHARD_BYTES = 2 << 20
SHARD_CONTEXTS = 4000
STEP = 8
BLOCK = 1 << 22  # bytes of a text looked at together; positions in a block take 24 bits
_DRAW = np.random.default_rng(11)
_TABLE = _DRAW.integers(0, 1 << 63, 256, dtype=np.uint64)
_STEP = _DRAW.integers(0, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def _ordered_grams(data: np.ndarray) -> np.ndarray:
    """For each 32-byte gram, 40 hash bits and its position, so that the least is the leftmost of the least."""
    h, width, k = _TABLE[data], 1, 0
    while width < GRAM:
        h = h[:-width] * _STEP[k] + h[width:]
        width, k = 2 * width, k + 1
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)


def anchors(data: bytes):
    """(gram position, gram hash, first and last start of the windows that picked it) of one text."""
    grams = LENGTH - GRAM + 1
    for begin in range(0, len(data) - LENGTH + 1, BLOCK):
        block = np.frombuffer(data, np.uint8, min(BLOCK + LENGTH - 1, len(data) - begin), begin)
        least, width = _ordered_grams(block), 1
        while 2 * width <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if grams > width:
            least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
        picked = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
        last = np.append(first[1:], len(picked)) - 1
        yield picked[first] + begin, (least[first] >> np.uint64(24)).astype(np.int64), first + begin, last + begin


CONTEXT = ["gram", "context", "context2"]
ANCHORS = "doc_id bigint, text_hash bigint, gram bigint, context bigint, context2 bigint, first int, last int"


def _anchors(batches):
    for batch in batches:
        rows, columns = [np.zeros(0, np.int64)], [[np.zeros(0, np.int64)] for _ in range(5)]
        for k, text in enumerate(batch.column(2)):
            data = (text.as_py() or "").encode("utf-8")
            for at, _, first, last in anchors(data) if len(data) >= LENGTH else ():
                view = memoryview(data)
                spans = zip(at.tolist(), first.tolist(), last.tolist())
                whole = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[f : t + LENGTH], a - f) for a, f, t in spans]), np.int64).reshape(-1, 2)
                rows.append(np.full(len(at), k))
                gram = np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + GRAM]) for a in at.tolist()), np.uint64, len(at)).view(np.int64)
                for column, values in zip(columns, (gram, whole[:, 0], whole[:, 1], first, last)):
                    column.append(values)
        row, made = pa.array(np.concatenate(rows).astype(np.int64)), [np.concatenate(c) for c in columns]
        arrays = [*map(pa.array, made[:3]), *(pa.array(c.astype(np.int32)) for c in made[3:])]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *arrays], ["doc_id", "text_hash", *CONTEXT, "first", "last"])


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(LENGTH + 16, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):
        padded = (padded[:-shift] << np.uint64(8 * shift)) | padded[shift:]
    return padded


def suffix_array(words: np.ndarray, n: int, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of their suffixes' first ``depth`` bytes at least, and each position's rank group."""
    order = np.argsort(words[:n], kind="stable")
    key = words[:n][order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    h = 8
    while h < depth:
        tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
        if not len(tied):
            break
        at = order[tied]
        second = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        again = np.argsort(key, kind="stable")
        at, key = at[again], key[again]
        order[tied] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[tied] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
        h *= 2
    return order, rank


def _common(words: np.ndarray, i: np.ndarray, j: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at i and j, of which h bytes are known to agree, up to LENGTH."""
    h = h.copy()
    active = np.flatnonzero(h < LENGTH)
    while len(active):
        differs = words[i[active] + h[active]] ^ words[j[active] + h[active]]
        same = differs == 0
        stop, bits = active[~same], differs[~same]
        more = np.zeros(len(stop), np.int64)
        for k in range(1, 8):
            more += bits < np.uint64(1 << (64 - 8 * k))
        h[stop] += more
        active = active[same]
        h[active] += 8
        active = active[h[active] < LENGTH]
    return np.minimum(h, LENGTH)


class Shard:
    """The windows of some contexts, in suffix order, with the common prefix of each with the one before; a context may count for several."""

    def __init__(self, contexts: list[bytes], counts: list[int] | None = None):
        sizes = np.array([len(c) for c in contexts], np.int64)
        self.base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.windows = sizes - LENGTH + 1
        data = np.frombuffer(b"".join(contexts), np.uint8)
        self.n = len(data)
        self.words = _words(data)
        order, rank = suffix_array(self.words, self.n)
        starts = np.zeros(self.n + 1, np.int64)
        starts[self.base] += 1
        starts[self.base + self.windows] -= 1
        self.is_start = np.cumsum(starts)[: self.n] > 0
        self.order = order[self.is_start[order]]
        before = np.full(self.n, -1, np.int64)
        before[self.order[1:]] = self.order[:-1]
        common = self._kasai(before, rank)[self.order]
        self.group = np.cumsum(common < LENGTH) - 1  # windows of equal bytes
        self.heads = np.flatnonzero(common < LENGTH)
        self.counts = np.ones(len(contexts)) if counts is None else np.array(counts, float)

    def _kasai(self, before: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Along each context, a window shares at least one byte less with its neighbour than the last one did."""
        out = np.zeros(self.n, np.int64)
        lanes = np.arange(len(self.base))
        h = np.zeros(len(lanes), np.int64)
        for step in range(int(self.windows.max(initial=0))):
            keep = step < self.windows[lanes]
            lanes, h = lanes[keep], h[keep]
            i = self.base[lanes] + step
            j = before[i]
            there = j >= 0
            tied = there & (rank[i] == rank[np.maximum(j, 0)])
            h = np.where(tied, LENGTH, np.where(there, h, 0))
            h = np.where(there, _common(self.words, i, np.maximum(j, 0), h), 0)
            out[i] = h
            # the bound carries over if the neighbour's next window is one too and their order was decided
            follows = there & ~tied & (h < LENGTH) & self.is_start[np.minimum(np.maximum(j, 0) + 1, self.n - 1)]
            h = np.where(follows, np.maximum(h - 1, 0), 0)
        return out

    def repeated(self) -> np.ndarray:
        """Groups of more than one window."""
        of = self.counts[np.searchsorted(self.base, self.order, "right") - 1]
        return np.bincount(self.group, of, minlength=len(self.heads)) > 1

    def search(self, other: Shard) -> tuple[np.ndarray, np.ndarray]:
        """Which groups of this shard and of the other have equal bytes: other's windows by binary search here."""
        wanted = other.order[other.heads]
        own = self.order[self.heads]
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(own), np.int64)
        found = np.full(len(wanted), -1, np.int64)
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) // 2
            way = self._compare(own[middle], other.words, wanted[active])
            found[active[way == 0]] = middle[way == 0]
            low[active[way < 0]] = middle[way < 0] + 1
            high[active[way > 0]] = middle[way > 0]
            active = active[(way != 0) & (low[active] < high[active])]
        mine, theirs = np.zeros(len(own), bool), found >= 0
        mine[found[theirs]] = True
        return mine, theirs

    def _compare(self, i: np.ndarray, words: np.ndarray, j: np.ndarray) -> np.ndarray:
        way, active = np.zeros(len(i), np.int64), np.arange(len(i))
        for h in range(0, LENGTH, 8):
            a, b = self.words[i[active] + h], words[j[active] + h]
            way[active[a < b]], way[active[a > b]] = -1, 1
            active = active[a == b]
            if not len(active):
                break
        return way

    def spans(self, marked: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each context, the byte runs (from its start) that windows of the marked groups cover."""
        hit = np.zeros(self.n, bool)
        hit[self.order[marked[self.group]]] = True
        at = np.flatnonzero(hit)
        lane = np.searchsorted(self.base, at, "right") - 1
        out: list[list[tuple[int, int]]] = [[] for _ in self.base]
        for k, start in zip(lane.tolist(), (at - self.base[lane]).tolist()):
            if out[k] and start <= out[k][-1][1]:
                out[k][-1] = (out[k][-1][0], start + LENGTH)
            else:
                out[k].append((start, start + LENGTH))
        return out


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


RESOLVED = "gram bigint, context bigint, context2 bigint, low array<int>, high array<int>"


def _solve(rows: list[dict], pair: tuple[int, int]):
    """The rows' contexts, of one shard or of two parts to be merged."""
    def shard(some):
        return Shard([r["data"] for r in some], [r["n"] for r in some])

    if pair[0] == pair[1]:
        whole = shard(rows)
        results = [(rows, whole.spans(whole.repeated()))]
    else:
        halves = [[r for r in rows if r["part"] == part] for part in pair]
        if not all(halves):
            return
        one, two = map(shard, halves)
        mine, theirs = one.search(two)
        results = [(halves[0], one.spans(mine)), (halves[1], two.spans(theirs))]
    for half, spans in results:
        for r, runs in zip(half, spans):
            if runs:
                yield r["gram"], r["context"], r["context2"], [a + r["shift"] for a, _ in runs], [b + r["shift"] for _, b in runs]


def _solved_batch(rows, pair) -> pa.RecordBatch:
    columns = list(zip(*_solve(rows, pair or (0, 0)))) or [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*CONTEXT, "low", "high"])


def _solve_all(batches):
    """Rows come sorted by (key, i, j): whole keys are packed into shards; a pair of parts stands alone."""
    held, size, current, pair = [], 0, None, None
    for batch in batches:
        for r in batch.to_pylist():
            own = (r["key"], r["i"], r["j"])
            if held and current != own and (size > SHARD_BYTES or r["split"] or pair):
                yield _solved_batch(held, pair)
                held, size = [], 0
            current, pair = own, own[1:] if r["split"] else None
            held.append(r)
            size += len(r["data"])
    if held:
        yield _solved_batch(held, pair)


PIECES = "key bigint, gram bigint, context bigint, context2 bigint, n bigint, shift int, data binary"
_PIECES = pa.schema([*[(k, pa.int64()) for k in ("key", *CONTEXT, "n")], ("shift", pa.int32()), ("data", pa.binary())])


def _cut(batches):
    """Contexts' bytes: rows (text, contexts with their counts and places) of a document."""
    for batch in batches:
        made = []
        for text, rows in zip(batch.column(0), batch.column(1).to_pylist()):
            whole = (text.as_py() or "").encode("utf-8")
            made += [{"key": r["gram"], **{k: r[k] for k in (*CONTEXT, "n")}, "shift": 0, "data": whole[r["first"] : r["last"] + LENGTH]} for r in rows]
        yield pa.RecordBatch.from_pylist(made, _PIECES)


def _refine(batches):
    """Contexts of a frequent gram in ranges of windows, under keys of the range and of the bytes that its windows share."""
    for batch in batches:
        made = []
        for r in batch.to_pylist():
            data = r["data"]
            grams = (k for k in range(len(data) - GRAM + 1) if xxhash.xxh3_64_intdigest(data[k : k + GRAM]) == r["gram"] % (1 << 64))
            at = next(grams)  # the leftmost is the one that the windows picked
            last = len(data) - LENGTH
            for place in range((at - last) // STEP, at // STEP + 1):
                low, high = max(0, at - STEP * place - STEP + 1), min(last, at - STEP * place)
                shared = xxhash.xxh3_64_intdigest(data[at - STEP * place : at - STEP * place - STEP + 1 + LENGTH], place)
                key = (shared * 0x9E3779B97F4A7C15 + r["gram"]) % (1 << 64) - (1 << 63)
                made.append(r | {"key": key, "shift": low, "data": data[low : high + LENGTH]})
        yield pa.RecordBatch.from_pylist(made, _PIECES)


def _remove(batches):
    for batch in batches:
        sizes, low, high, kept = [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            data = (text.as_py() or "").encode("utf-8")
            runs = merged((s["low"], s["high"]) for s in spans or ())
            parts, at = [], 0
            for a, b in runs:
                parts.append(data[at:a])
                at = b
            parts.append(data[at:])
            sizes.append(len(data))
            low.append([a for a, _ in runs])
            high.append([b for _, b in runs])
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(low, pa.list_(pa.int32())), pa.array(high, pa.list_(pa.int32())), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "low", "high", "kept"],
        )


def _solved(repeated: DataFrame, docs: DataFrame) -> DataFrame:
    """gram, context, context2, low, high: what the suffix arrays find in the contexts of repeated grams."""
    one = repeated.groupBy(*CONTEXT).agg(F.min(F.struct("doc_id", "text_hash", "first", "last")).alias("o"), F.count(F.lit(1)).alias("n"))
    one = staged(one.select(*CONTEXT, "n", "o.*"), "contexts")
    per_doc = one.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*CONTEXT, "n", "first", "last")).alias("rows"))
    per_doc = per_doc.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
    ids = one.select(F.col("text_hash").alias("_wanted")).distinct()
    texts = docs.join(small(ids), F.col("text_hash") == F.col("_wanted"), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    found = texts.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("text", "rows")
    pieces = python_map(found, _cut, PIECES)
    crowded = staged(one.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SHARD_CONTEXTS).select("gram"), "crowded")
    if not crowded.isEmpty():
        pieces = staged(pieces, "pieces")
        crowded = small(crowded)
        fine = staged(python_map(pieces.join(crowded, "gram", "left_semi"), _refine, PIECES), "pieces")
        alone = staged(fine.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "keys")
        pieces = pieces.join(crowded, "gram", "left_anti").unionByName(fine.join(small(alone), "key", "left_semi").select(*pieces.columns))
        sizes = fine.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SHARD_CONTEXTS).cast("int").alias("parts")).where("parts > 1")
        pieces = pieces.join(small(staged(sizes, "parts")), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        pieces = pieces.withColumn("parts", F.lit(1))
    pieces = pieces.withColumn("part", F.pmod("context", "parts").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")))
    dealt = pieces.withColumn("ij", F.explode(others)).select("key", *CONTEXT, "n", "shift", "part", "ij.i", "ij.j", (F.col("parts") > 1).alias("split"), "data")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return python_map(dealt, _solve_all, RESOLVED)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, low and high (the removed byte runs), kept (the bytes that stay) of every document."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    picked = staged(python_map(docs.select("doc_id", "text_hash", "text"), _anchors, ANCHORS), "anchors")
    grams = staged(picked.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    repeated = staged(picked.join(small(grams), "gram", "left_semi"), "repeated")  # of two tables: a frequent gram may be split
    discard(picked)
    solved = staged(_solved(repeated, docs), "solved")
    spans = repeated.select(*CONTEXT, "doc_id", "text_hash", "first").join(solved, CONTEXT)
    spans = spans.select("doc_id", "text_hash", "first", F.explode(F.arrays_zip("low", "high")).alias("s"))
    spans = spans.select("doc_id", "text_hash", F.struct((F.col("first") + F.col("s.low")).alias("low"), (F.col("first") + F.col("s.high")).alias("high")).alias("span"))
    spans = spans.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans"))
    spans = spans.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
    marked = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select("doc_id", "text", "spans")
    return python_map(marked, _remove, "doc_id bigint, n_bytes bigint, low array<int>, high array<int>, kept binary")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_passages(documents(spark, sf_dir))
    removed = F.aggregate(F.zip_with("low", "high", lambda a, b: b - a), F.lit(0), lambda total, x: total + x)
    return found.select("doc_id", "n_bytes", removed.cast("bigint").alias("n_removed"), F.size("low").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLES = {}
