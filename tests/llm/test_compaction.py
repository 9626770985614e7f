import datetime
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from paperloom.llm import compaction as C

SCHEMA = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, client_id bigint, kind string, value double, props string, rows int, part_day string, place string, path string"
EPOCH = datetime.datetime(1970, 1, 1)


def naive(sizes, capacity):
    groups = []
    for at, size in enumerate(sizes):
        for group in groups:
            if sum(sizes[k] for k in group) + size <= capacity:
                group.append(at)
                break
        else:
            groups.append([at])
    return groups


def test_groups_are_those_of_first_fit():
    draw = random.Random(3)
    for _ in range(400):
        sizes = sorted((draw.randrange(1, draw.choice([4, 30])) for _ in range(draw.randrange(0, 60))), reverse=True)
        capacity = draw.randrange(30, 70)
        assert C.first_fit(sizes, capacity) == naive(sizes, capacity)
    assert C.first_fit([9, 9, 2, 1], 5) == [[0], [1], [2, 3]]


def rows(seed, n):
    draw, out = random.Random(seed), []
    for k in range(n):
        day = draw.choice([0, 0, 0, 1, 2, 3, -1])
        at = EPOCH + datetime.timedelta(days=19000 + day, microseconds=draw.randrange(86_400_000_000) // draw.choice([1, 10**9]) * draw.choice([1, 1000]))
        value = draw.choice([None, 1.005, -2.675, 0.125, draw.uniform(-5, 5), float("nan"), float("inf")])
        out.append((draw.choice([k, k, k, 7, None]), at, at if draw.random() < 0.97 else None, draw.randrange(3), "view", value, "{}", k, "x", "y", "z"))
    return out + out[: n // 10]


def expected(table):
    """Brute force: final file -> facts, from the rows alone."""
    total = len(table)
    limit = lambda x: 1 + total // x
    by_day = defaultdict(list)
    for r in table:
        by_day[None if r[2] is None else (r[2] - EPOCH).days].append(r)
    out = {}
    for day, found in by_day.items():
        files = defaultdict(list)
        for r in found:
            h = zlib.crc32(("" if r[0] is None else str(r[0])).encode())
            files[h // 16 % (1 + len(found) // limit(200)), min(h % 4, h // 4 % 4)].append(r)
        for f in files.values():
            f.sort(key=lambda r: (r[2] is not None, r[2] or EPOCH, r[0] is not None, r[0] or 0))
        order = sorted(files, key=lambda k: (-len(files[k]), *k))
        little = [k for k in order if len(files[k]) < limit(750)]
        groups = [[k] for k in order if k not in little] + [[little[i] for i in g] for g in naive([len(files[k]) for k in little], limit(300))]
        for group in groups:
            held = [r for k in group for r in files[k]]
            ids = [r[0] for r in held]
            cents = sum(math.floor(100 * r[5] + 0.5) for r in held if r[5] is not None and math.isfinite(r[5]))
            known = [i for i in ids if i is not None]
            out[(day, *group[0])] = (
                len(held), min(known, default=None), max(known, default=None), cents, ",".join(f"{a}-{b}" for a, b in group),
                hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest(), len(group) > 1, [r[7] for r in held],
            )
    return out


def run(spark, table, tmp_path, monkeypatch):
    sf = str(tmp_path / "sf")
    spark.createDataFrame(table, SCHEMA).repartition(5).write.parquet(f"{sf}/clicks.parquet")
    kept = {}
    first = C.starting_files

    def watched(*args):
        total = first(*args)
        kept.update({str(p): p.read_bytes() for p in files_of(args[1])})
        return total

    monkeypatch.setattr(C, "starting_files", watched)
    return C.op13_compact_clicks(spark, sf).collect(), kept


def files_of(folder):
    return list(Path(re.sub("^file:/*", "/", folder)).rglob("*.parquet"))


@pytest.mark.parametrize("n", [40, 3000])
def test_against_brute_force(spark, tmp_path, monkeypatch, n):
    table = rows(n, n)
    got, kept = run(spark, table, tmp_path, monkeypatch)
    want = expected(table)
    names = SCHEMA.replace(" bigint", "").replace(" timestamp_ntz", "").replace(" string", "").replace(" double", "").replace(" int", "").replace(", ", ",")
    assert {(r.day, r.lot, r.piece): (r.n_rows, r.min_click_id, r.max_click_id, r.cents, r.sources, r.ids_sha256, r.rewritten) for r in got} == {k: v[:-1] for k, v in want.items()}
    assert {r["columns"] for r in got} == {names} and (n < 100 or len({r.rewritten for r in got}) == 2)  # 40 rows make no small file
    paths = {re.sub("^file:/*", "/", r.path): r for r in got}
    folder = next(iter(paths)).split("/part_day")[0]
    assert {str(p) for p in files_of(folder)} == set(paths)  # and no other file
    for path, r in paths.items():
        table_ = pq.ParquetFile(path).read()
        assert ",".join(table_.column_names) == names
        if not r.rewritten:
            assert Path(path).read_bytes() == kept[path]
        order, held = want[r.day, r.lot, r.piece][-1], table_["rows"].to_pylist()
        assert sorted(held) == sorted(order)


def test_empty_table(spark, tmp_path, monkeypatch):
    assert run(spark, [], tmp_path, monkeypatch)[0] == []
