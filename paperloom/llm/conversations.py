"""Conversation repair by error-correcting Earley parsing.

A conversation should read ``(s?(ua)+)?``: perhaps a system turn, then pairs of user and assistant.  The grammar below
is left-linear and carries weighted error productions: a turn is kept (cost 0), given another role (3), deleted (4) or
inserted without text (3); keeping or reroling a truncated turn costs 3 more, and blank or repeated turns can only be
deleted.  Chart items keep the least (cost, audit), where the audit spells the edits (D, I, K, R); the completed chart's
item for the start symbol is the repair.  All items but those of single turns begin in column 0, so that a column has a
bounded number of them and the chart is read in one direction: two columns are held, and what all items' audits have in
common is put aside.  Columns that differ only by that are the same column, and what follows from them is remembered.

Conversations of up to LONG turns and LONG_BYTES are shuffled whole and parsed in their task.  Longer ones are counted
out first (conversations are told long by a count, which changes the plan, not the result): equal rows are aggregated,
turns are dealt out by range, every range is parsed from each state that it may be entered in, the ranges' charts are
composed, and one task streams the repaired text of a conversation into its digest without holding it.

Defined results: a null role, text, turn or id counts as one space (null ids are one conversation, null turns come
first); rows of one turn are taken by role, then by the text's md5; equal rows are adjacent; a role without a first
character cannot be kept; of a conversation without rows only the id is known, with zeros, an empty audit and the digest
of nothing; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import CACHES, SPACE_BYTES, python_map, small, staged

#: What is longer is parsed in ranges.
LONG, LONG_BYTES = 2000, 64 << 20

SPACES = SPACE_BYTES.decode()
CLEAN, FATAL, TRUNCATED = 0, 1, 2

# nothing yet, after the system's turn, after a user's, after an assistant's
OPEN, BRIEFED, ASKED, ANSWERED = STATES = ("open", "briefed", "asked", "answered")
#: head -> bodies; lower-case words in quotes below are kinds of turns, whose productions are the edits
GRAMMAR = {
    "talk": ((OPEN,), (ANSWERED,)),
    OPEN: ((OPEN, "gone"),),
    BRIEFED: ((OPEN, "system"), (BRIEFED, "gone")),
    ASKED: ((OPEN, "user"), (BRIEFED, "user"), (ANSWERED, "user"), (ASKED, "gone")),
    ANSWERED: ((ASKED, "assistant"), (ANSWERED, "gone")),
}
KINDS = ("system", "user", "assistant", "gone")
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3


def readings(kind: str, initial: str, fault: int) -> list[tuple[int, str]]:
    """(cost, edit) of each production by which a turn of this initial and fault reads as the kind."""
    if kind == "gone":
        return [(DELETE, "D")]
    if fault == FATAL:
        return []
    cut = CUT if fault == TRUNCATED else 0
    kept = [(cut, "K")] if initial == kind[0] else []
    return kept + ([(REROLE + cut, "R")] if kind != "system" else [])


def _add(a: tuple[int, str], b: tuple[int, str]) -> tuple[int, str]:
    return a[0] + b[0], a[1] + b[1]


class Chart:
    """Earley's chart over the turns of one conversation, or of a range of it that is entered in a given state."""

    _columns: dict = {}  # (column, turn) -> (next column, cost and audit put aside)

    def __init__(self, entry: str = OPEN):
        # column 0: every head is predicted, and the entry state is complete before any turn
        self.origin = [(head, body) for head, bodies in GRAMMAR.items() for body in bodies]
        self.cost, self.audit = 0, []
        self.column = self._settle({}, [(entry, (0, ""))])

    def _settle(self, waiting: dict, complete: list) -> tuple:
        """The column with everything that follows from its complete heads: completions, predictions, and insertions."""
        done: dict[str, tuple[int, str]] = {}
        agenda = list(complete)
        while agenda:
            head, weight = agenda.pop()
            if head in done and done[head] <= weight:
                continue
            done[head] = weight
            for parent, body in self.origin:  # items of column 0 that wait for this head
                if body[0] != head:
                    continue
                if len(body) == 1:
                    agenda.append((parent, weight))
                    continue
                item = (parent, body)
                if item in waiting and waiting[item] <= weight:
                    continue
                waiting[item] = weight
                if body[1] in ("user", "assistant"):  # predicted here and complete here: an inserted turn
                    agenda.append((parent, _add(weight, (INSERT, "I"))))
        return tuple(sorted(done.items())), tuple(sorted(waiting.items()))

    def read(self, initial: str, fault: int) -> None:
        """Scan one turn."""
        key = (self.column, initial if initial in ("s", "u", "a") else "", fault)
        known = self._columns.get(key)
        if known is None:
            complete = []
            for (head, body), weight in self.column[1]:
                for reading in readings(body[1], key[1], fault):
                    complete.append((head, _add(weight, reading)))
            done, waiting = self._settle({}, complete)
            least = min(w[0] for _, w in done)
            common = os.path.commonprefix([w[1] for _, w in done + waiting])
            cut = len(common)
            column = tuple(tuple((k, (w[0] - least, w[1][cut:])) for k, w in part) for part in (done, waiting))
            known = column, least, common
            if len(self._columns) > 100_000:
                self._columns.clear()
            self._columns[key] = known
        self.column, least, common = known
        self.cost += least
        if common:
            self.audit.append(common)

    def exits(self) -> dict[str, tuple[int, str]]:
        """state -> (cost, audit) of the cheapest edits that lead to it; "talk" is the whole conversation."""
        before = "".join(self.audit)
        return {head: (self.cost + w[0], before + w[1]) for head, w in self.column[0]}


CACHES["conversations"] = Chart._columns.clear


class Facts:
    """What is counted over the turns in order."""

    def __init__(self):
        self.faults = [0, 0, 0]  # blank, duplicate, truncated
        self.illegal, self.turns, self.rows = 0, 0, 0
        self.first = self.last = None  # initials
        self.low = self.high = None

    def note(self, turn: int | None, role: str, which: int | None) -> None:
        if which is not None:
            self.faults[which] += 1
        initial = role[:1]
        if self.rows and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if not self.rows:
            self.first = initial
        self.last = initial
        self.rows += 1
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.turns += 1
                self.high = turn

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def judged(text: str, seen: bool) -> tuple[int | None, int]:
    """(index of the first fault or None, what the parser is told)."""
    body = text.rstrip(SPACES)
    if not body:
        return 0, FATAL
    if seen:
        return 1, FATAL
    return (None, CLEAN) if body[-1] in ".!?" else (2, TRUNCATED)


class Repaired:
    """The repaired turns in order: fed with original turns, it follows the audit's edits."""

    def __init__(self, audit: str):
        self.edits, self.at, self.last = audit, 0, ""

    def _role(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            role = self._role()
            self.at, self.last = self.at + 1, role[0]
            yield role, "", "I"

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit != "D":
            role = role if edit == "K" else self._role()
            self.last = role[:1]
            yield role, text, edit


class Digest:
    """SHA-256 of the repaired lines, joined by line feeds."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.hash.update((f"\n{role}:{text}" if self.any else f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True


def _grouped(batches) -> Iterator[tuple[bool, tuple]]:
    """(begins a conversation, row) for rows that come sorted by conversation."""
    last = ()
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            yield row[:1] != last, row
            last = row[:1]


def _whole(batches) -> Iterator[tuple[int | None, list[tuple]]]:
    """Conversations with all their rows (turn, role, text)."""
    current, rows = None, []
    for begins, (conv, turn, role, text, n) in _grouped(batches):
        if begins:
            if current:
                yield current[0], rows
            current, rows = (conv,), []
        rows += [(turn, role, text)] * n
    if current:
        yield current[0], rows


def _tables(schema: pa.Schema, rows: Iterator[tuple], chunk: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(v) for v in row if isinstance(v, str))
        if size > chunk:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(","))])


COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
REPORT = f"conv_id bigint, {COUNTS}, repaired_sha256 string"
TURNS = "conv_id bigint, place bigint, role string, text string, edit string"


def _parse(rows: list[tuple]) -> tuple[Facts, int, str]:
    facts, chart, seen = Facts(), Chart(), set()
    for turn, role, text in rows:
        which, told = judged(text, (role, text) in seen)
        seen.add((role, text))
        facts.note(turn, role, which)
        chart.read(role[:1], told)
    return facts, *chart.exits()["talk"]


def _edited(rows: list[tuple], audit: str) -> Iterator[tuple[str, str, str]]:
    made = Repaired(audit)
    for _, role, text in rows:
        yield from made.turn(role, text)
    yield from made.inserted()


def _short_report(batches):
    def rows():
        for conv, turns in _whole(batches):
            facts, cost, audit = _parse(turns)
            digest = Digest()
            for role, text, _ in _edited(turns, audit):
                digest.add(role, text)
            yield conv, facts.gaps(), *facts.faults, facts.illegal, cost, audit, digest.hash.hexdigest()

    return _tables(_arrow(REPORT), rows())


def _short_turns(batches):
    def rows():
        for conv, turns in _whole(batches):
            audit = _parse(turns)[2]
            for place, (role, text, edit) in enumerate(_edited(turns, audit)):
                yield conv, place, role, text, edit

    return _tables(_arrow(TURNS), rows())


SEGMENT = (
    "conv_id bigint, turn bigint, role string, digest string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, n bigint, "
    "first string, last string, low bigint, high bigint, turns bigint, state string, exit string, cost bigint, audit string"
)


def _segments(batches):
    """For each conversation's part of this partition, a row for each state it may be entered in and left in."""

    def made(start, facts, charts):
        conv, turn, role, digest = start
        for state, chart in charts.items():
            for leave, (cost, audit) in chart.exits().items():
                yield conv, turn, role, digest, *facts.faults, facts.illegal, facts.rows, facts.first, facts.last, facts.low, facts.high, facts.turns, state, leave, cost, audit

    def rows():
        start = None
        for begins, (conv, turn, role, text, n, digest, seen) in _grouped(batches):
            if begins:
                if start:
                    yield from made(start, facts, charts)
                start, facts, charts = (conv, turn, role, digest), Facts(), {s: Chart(s) for s in STATES}
            for k in range(n):
                which, told = judged(text, seen or k > 0)
                facts.note(turn, role, which)
                for chart in charts.values():
                    chart.read(role[:1], told)
        if start:
            yield from made(start, facts, charts)

    return _tables(_arrow(SEGMENT), rows())


def _composed(batches):
    """Charts of a conversation's ranges in order -> its counts, cost and audit."""
    names = [part.split()[0] for part in SEGMENT.split(",")]

    def finish(conv, total, paths):
        cost, audit = paths["talk"]
        return conv, total.gaps(), *total.faults, total.illegal, cost, audit

    def rows():
        conv, total, paths, part, place = None, None, None, {}, None

        def close():
            nonlocal paths, part
            step: dict = {}
            for (state, leave), weight in part.items():
                if state in paths:
                    reached = _add(paths[state], weight)
                    if leave not in step or reached < step[leave]:
                        step[leave] = reached
            paths, part = step, {}

        for begins, row in _grouped(batches):
            r = dict(zip(names, row))
            key = (r["turn"], r["role"], r["digest"])
            if begins:
                if total:
                    close()
                    yield finish(conv, total, paths)
                conv, total, paths, part, place = r["conv_id"], Facts(), {OPEN: (0, "")}, {}, None
            if begins or key != place:
                if not begins:
                    close()
                place = key
                total.faults = [a + r[b] for a, b in zip(total.faults, ("blank", "duplicate", "truncated"))]
                if r["n"]:
                    total.illegal += r["illegal"] + (total.rows > 0 and total.last + r["first"] not in ("su", "ua", "au"))
                    total.rows, total.last = total.rows + r["n"], r["last"]
                if r["low"] is not None:
                    total.turns += r["turns"] - (total.high == r["low"])
                    total.low, total.high = r["low"] if total.low is None else total.low, r["high"]
            part[r["state"], r["exit"]] = (r["cost"], r["audit"])
        if total:
            close()
            yield finish(conv, total, paths)

    return _tables(_arrow(f"conv_id bigint, {COUNTS}"), rows())


def _followed(batches):
    """Rows of a conversation behind a row that has its audit, one by one -> the repaired turns; edit is null at the end."""
    made, place, conv = None, 0, None
    for begins, (conv_id, _, role, text, n, head) in _grouped(batches):
        if begins:
            if made:
                for role_, text_, edit in made.inserted():
                    yield conv, place, role_, text_, edit
                    place += 1
                yield conv, place, "", "", None
            conv, made, place = conv_id, Repaired(text if head else ""), 0
            if head:
                continue
        for _ in range(n):
            for role_, text_, edit in made.turn(role, text):
                yield conv, place, role_, text_, edit
                place += 1
    if made:
        for role_, text_, edit in made.inserted():
            yield conv, place, role_, text_, edit
            place += 1
        yield conv, place, "", "", None


def _long_digest(batches):
    def rows():
        digest = Digest()
        for conv, _, role, text, edit in _followed(batches):
            if edit:
                digest.add(role, text)
            else:
                yield conv, digest.hash.hexdigest()
                digest = Digest()

    return _tables(_arrow("conv_id bigint, repaired_sha256 string"), rows())


def _long_turns(batches):
    return _tables(_arrow(TURNS), (row for row in _followed(batches) if row[4]))


#: A column of this name tells how often a row counts; without it, once.
COPIES = "__copies__"


def _prepared(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: nulls of role and text as one space; n is how often a row counts."""
    n = (F.col(COPIES) if COPIES in rows.columns else F.lit(1)).cast("bigint")
    space = F.lit(" ")
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), n.alias("n"))


ORDER = ("conv_id", "turn", "role")  # nulls come first


def _split(rows: DataFrame, long: int, long_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of short conversations, and of long ones if there are any."""
    size = rows.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sum(F.octet_length("text") * F.col("n")).alias("bytes"))
    ids = staged(size.where((F.col("n") > long) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("_long")), "long-conversations")
    if ids.isEmpty():
        return rows, None
    ids, same = small(ids), F.col("conv_id").eqNullSafe(F.col("_long"))
    return rows.join(ids, same, "left_anti"), rows.join(ids, same, "left_semi")


def _whole_rows(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(*ORDER, F.md5("text"))


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, cost and audit of each long conversation; its rows behind one that has the audit)."""
    keys = ["conv_id", "turn", "role"]
    rows = rows.groupBy(*keys, "text").agg(F.sum("n").alias("n")).withColumn("digest", F.md5("text"))
    # a role and text at several turns: later ones are repeats, also of ranges that do not see the first
    content = ["conv_id", "role", F.sha2(F.col("text"), 256).alias("content")]
    at = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)).alias("t"))
    repeated = rows.where("n > 0").groupBy(*content).agg(F.min(at).alias("_first"), F.max(at).alias("_last")).where("_first < _last")
    repeated = repeated.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("content").alias("_t"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.sha2(F.col("text"), 256) == F.col("_t"))
    rows = staged(rows.join(repeated, same, "left").withColumn("seen", F.coalesce(at > F.col("_first"), F.lit(False))).select(*keys, "text", "n", "digest", "seen"), "long-turns")
    dealt = rows.repartitionByRange(*ORDER, "digest").sortWithinPartitions(*ORDER, "digest")
    parts = python_map(dealt, _segments, SEGMENT, "conversations")
    parts = parts.repartition("conv_id").sortWithinPartitions(*ORDER, "digest")
    found = staged(python_map(parts, _composed, f"conv_id bigint, {COUNTS}", "conversations"), "long-repairs")
    head = found.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("bigint").alias("n"), F.lit("").alias("digest"), F.lit(True).alias("head"))
    body = rows.select(*keys, "text", "n", "digest", F.lit(False).alias("head"))
    ordered = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), *ORDER[1:], "digest")
    return found, ordered.select(*keys, "text", "n", "head")


def repair(rows: DataFrame, long: int = LONG, long_bytes: int = LONG_BYTES) -> DataFrame:
    """rows (conv_id, turn, role, text) -> one row a conversation: counts of faults, the repair's cost and audit, and the digest of its text."""
    short, rest = _split(_prepared(rows), long, long_bytes)
    out = python_map(_whole_rows(short), _short_report, REPORT, "conversations")
    if rest is None:
        return out
    found, ordered = _long(rest)
    digests = python_map(ordered, _long_digest, "conv_id bigint, repaired_sha256 string").withColumnRenamed("conv_id", "_c")
    return out.unionByName(found.join(digests, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c"))


def repaired_turns(rows: DataFrame, long: int = LONG, long_bytes: int = LONG_BYTES) -> DataFrame:
    """rows (conv_id, turn, role, text) -> the repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I)."""
    short, rest = _split(_prepared(rows), long, long_bytes)
    out = python_map(_whole_rows(short), _short_turns, TURNS, "conversations")
    return out if rest is None else out.unionByName(python_map(_long(rest)[1], _long_turns, TURNS))


def damaged(rows: DataFrame) -> DataFrame:
    """The test damage: by a checksum of id and turn a row goes (COPIES is 0), loses its text or its stops, is repeated (2), or becomes the user's."""
    space = F.lit(" ")
    draw = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), draw.alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_d") == 0, 0).when(F.col("_d") == 3, 2).otherwise(1).alias(COPIES))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(list_concat([n], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d
  FROM conversations, crc
), hit AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM base WHERE d <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM hit
), judged AS (
  SELECT *, substr(role, 1, 1) AS i, coalesce(lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au'), FALSE) AS illegal, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM placed
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM judged GROUP BY conv_id
), scan AS (
  SELECT conv_id, pos, i, CASE WHEN fault = 'truncated' THEN 3 WHEN fault IS NULL THEN 0 ELSE 1000000 END AS k FROM judged
), dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {'c': 0, 't': ''} AS o, {'c': 1000000, 't': ''} AS b, {'c': 3, 't': 'I'} AS q, {'c': 6, 't': 'II'} AS a FROM counts
  UNION ALL
  SELECT conv_id, pos, o, b, list_min([q, {'c': o.c + 3, 't': o.t || 'I'}, {'c': b.c + 3, 't': b.t || 'I'}, {'c': a.c + 3, 't': a.t || 'I'}]),
    list_min([a, {'c': list_min([q.c, o.c + 3, b.c + 3, a.c + 3]) + 3, 't': list_min([q, {'c': o.c + 3, 't': o.t || 'I'}, {'c': b.c + 3, 't': b.t || 'I'}, {'c': a.c + 3, 't': a.t || 'I'}]).t || 'I'}])
  FROM (
    SELECT s.conv_id, s.pos, {'c': o.c + 4, 't': o.t || 'D'} AS o, list_min([{'c': b.c + 4, 't': b.t || 'D'}, {'c': o.c + CASE WHEN i = 's' THEN k ELSE 1000000 END, 't': o.t || 'K'}]) AS b,
      list_min([{'c': q.c + 4, 't': q.t || 'D'}, {'c': o.c + k + 3, 't': o.t || 'R'}, {'c': b.c + k + 3, 't': b.t || 'R'}, {'c': a.c + k + 3, 't': a.t || 'R'}, {'c': o.c + CASE WHEN i = 'u' THEN k ELSE 1000000 END, 't': o.t || 'K'},
        {'c': b.c + CASE WHEN i = 'u' THEN k ELSE 1000000 END, 't': b.t || 'K'}, {'c': a.c + CASE WHEN i = 'u' THEN k ELSE 1000000 END, 't': a.t || 'K'}]) AS q,
      list_min([{'c': a.c + 4, 't': a.t || 'D'}, {'c': q.c + k + 3, 't': q.t || 'R'}, {'c': q.c + CASE WHEN i = 'a' THEN k ELSE 1000000 END, 't': q.t || 'K'}]) AS a
    FROM dp JOIN scan s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.pos = dp.pos + 1)
), ended AS (
  SELECT c.*, list_min([dp.o, dp.a]) AS best FROM counts c JOIN dp ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.n = dp.pos
), edits AS (
  SELECT conv_id, substr(best.t, CAST(spot AS INTEGER), 1) AS e, spot FROM (SELECT conv_id, best, unnest(range(1, length(best.t) + 1)) AS spot FROM ended)
), numbered AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER w AS pos, count(*) FILTER (e <> 'D') OVER w AS nth FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY spot)
), lined AS (
  SELECT n.conv_id, n.spot, n.e, n.nth, j.role, j.text, bool_or(n.e = 'K' AND n.nth = 1 AND j.i = 's') OVER (PARTITION BY n.conv_id) AS briefed
  FROM numbered n LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM n.conv_id AND j.pos = n.pos AND n.e <> 'I' WHERE n.e <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (nth % 2 = 1) <> briefed THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY spot) AS body FROM lined GROUP BY conv_id
)
SELECT ids.conv_id, coalesce(e.gaps, 0) AS gaps, coalesce(e.blank, 0) AS blank, coalesce(e.duplicate, 0) AS duplicate, coalesce(e.truncated, 0) AS truncated, coalesce(e.illegal, 0) AS illegal,
  CAST(coalesce(e.best.c, 0) AS BIGINT) AS cost, coalesce(e.best.t, '') AS audit, sha256(coalesce(t.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM base) ids LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES = {"op11_conversation_repair": SQL}
