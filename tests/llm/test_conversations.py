import hashlib
import heapq
import random
import re
import zlib

import pytest

from paperloom.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_chars int, cost string, digest string, n int"
VALID, PREFIX = re.compile("(s?(ua)+)?"), re.compile("(s|s?(ua)*u?)?")


def damage(conv, turn, role, text):
    draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = (" " if role is None else role), (" " if text is None else text)
    if draw == 0:
        return []
    text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
    return [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)


def cheapest(tokens):
    """Uniform-cost search over all edits, apart from the grammar."""
    heap, best = [(0, "", 0, "")], None
    while heap:
        cost, audit, at, made = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if at == len(tokens) and VALID.fullmatch(made):
            best = min(best or (cost, audit), (cost, audit))
        options = [(3, "I", at, made + r) for r in "ua"] if len(made) < 2 * len(tokens) + 2 else []
        if at < len(tokens):
            initial, fatal, cut = tokens[at]
            options.append((4, "D", at + 1, made))
            if not fatal:
                options += [(3 * cut, "K", at + 1, made + initial)] * bool(initial) + [(3 + 3 * cut, "R", at + 1, made + r) for r in "ua"]
        for more, edit, place, text in options:
            if PREFIX.fullmatch(text):
                heapq.heappush(heap, (cost + more, audit + edit, place, text))
    return best


def brute(rows, hit=damage):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).extend(hit(conv, turn, role, text))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults, tokens = set(), [0, 0, 0], []
        for _, role, text in turns:
            body = text.strip(" \t\n\v\f\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            tokens.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(tokens, tokens[1:]))
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit = cheapest(tokens)
        lines, left, last = [], list(turns), ""
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else left.pop(0)
            if edit != "D":
                role = role if edit == "K" else "assistant" if last == "u" else "user"
                last = role[:1]
                lines.append(f"{role}:{text}")
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed, convs=60, longest=6):
    draw, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "why", "  ", "", "Well, then?  \n", "same thing.", "naïve – 🙂", None]
    for conv in range(convs):
        for k in range(draw.randrange(1, longest + 1)):
            rows.append((conv if conv else None, draw.choice([k, k, k, k + 2, None, 1]), draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), draw.choice(texts)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", "d", 7) for r in rows], SCHEMA)


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("long", [C.LONG, 3])
def test_against_a_search_over_all_edits(spark, long):
    """Short conversations whole, and the same in ranges."""
    rows = made(1)
    assert got(C.repair(C.damaged(frame(spark, rows)), long)) == brute(rows)


def test_ranges_of_one_long_conversation(spark):
    draw = random.Random(5)
    rows = [(7, k // 2, draw.choice(["user", "assistant", "system"]), draw.choice(["a.", "b.", "c", f"n{k}.", f"m{k}"])) for k in range(900)] + [(8, 1, "user", "Hi."), (8, 2, "assistant", "x" * 100_000 + ".")]
    whole, parts = got(C.repair(frame(spark, rows))), got(C.repair(frame(spark, rows).repartition(9), 100))
    assert parts == whole and len(whole[7][6]) >= 900
    assert got(C.repair(frame(spark, rows), 2000, 1000)) == whole  # long by bytes


def test_repaired_turns_are_a_conversation(spark):
    rows = made(2)
    for long in (C.LONG, 2):
        turns = {}
        for r in sorted(C.repaired_turns(C.damaged(frame(spark, rows)), long).collect(), key=lambda r: (r.conv_id or -1, r.place)):
            turns.setdefault(r.conv_id, []).append(r)
        want = brute(rows)
        for conv, lines in turns.items():
            assert VALID.fullmatch("".join(r.role[:1] for r in lines)) and [r.place for r in lines] == list(range(len(lines)))
            assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == want[conv][7]


def test_empty_and_vanished(spark):
    assert C.repair(C.damaged(frame(spark, []))).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    for long in (C.LONG, -1):
        assert got(C.repair(C.damaged(frame(spark, [(5, gone, "user", "Hi.")])), long)) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
