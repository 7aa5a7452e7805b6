"""Log parsing, routing and visitor operators on small hand-made inputs."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillhouse.operators import routing, visits
from rillhouse.operators.skew import find_hot_keys
from rillhouse.plans.traffic import log_outputs
from rillhouse.sources.records import parse_log, split_log

DAY = 24 * 3600 * 1000
PAGES = "mid string, last_page_id string, ts bigint, seq bigint"


def raw(spark, *texts):
    return spark.createDataFrame(
        [(t if isinstance(t, str) else json.dumps(t), i) for i, t in enumerate(texts)],
        "value string, seq bigint",
    )


def record(mid="a", is_new="0", ts=0, **parts):
    return {"common": {"mid": mid, "is_new": is_new, "os": "x"}, "ts": ts, **parts}


def keys(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_dirty_records(spark):
    bad = ["{bad", "", "[1]", "null", '{"page":{}}', '{"common":{"mid":"a"}}', '{"common":null,"ts":1}']
    log, dirty = split_log(parse_log(raw(spark, *bad, record())))
    assert sorted(r.value for r in dirty.collect()) == sorted(bad)
    assert log.count() == 1


def flags(spark, *rows):
    texts = [record(is_new=flag, ts=ts) for flag, ts in rows]
    log, _ = split_log(parse_log(raw(spark, *texts)))
    fixed = visits.fix_is_new(log)
    common = F.try_variant_get("common", "$.is_new", "string").alias("c")
    rows = fixed.select("seq", "is_new", common).orderBy("seq").collect()
    assert all(r.is_new == r.c for r in rows)
    return [r.is_new for r in rows]


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([("1", 0), ("1", 5)], ["1", "1"]),
        ([("1", 0), ("1", DAY)], ["1", "0"]),
        ([("0", DAY), ("1", DAY + 1)], ["0", "0"]),
        ([("1", 0), ("0", 1), ("1", 2), ("1", 3 * DAY)], ["1", "0", "1", "0"]),
    ],
)
def test_new_visitor_flag(spark, rows, expected):
    assert flags(spark, *rows) == expected


def test_flag_repair_keeps_unknown_fields(spark):
    out = log_outputs(raw(spark, record(is_new="0", ts=DAY), record(is_new="1", ts=DAY + 1, page={"n": 1.5})))
    rows = {json.loads(r.value)["ts"]: json.loads(r.value) for r in routing.as_json(out["page"]).collect()}
    assert rows[DAY + 1] == {
        "common": {"mid": "a", "is_new": "0", "os": "x"}, "page": {"n": 1.5}, "ts": DAY + 1
    }


def test_router_start_with_error(spark):
    out = log_outputs(
        raw(spark, record(err={"code": 1}, start={"entry": "icon"}, displays=[{"i": 1}, {"i": 2}]))
    )
    assert {k: v.count() for k, v in out.items()} == {
        "page": 0, "start": 1, "display": 0, "action": 0, "error": 1, "dirty": 0
    }
    error = json.loads(routing.as_json(out["error"]).first().value)
    assert error["err"] == {"code": 1} and error["start"] and len(error["displays"]) == 2
    start = json.loads(routing.as_json(out["start"]).first().value)
    assert "err" not in start and start["start"] == {"entry": "icon"}


def test_router_page_with_error(spark):
    out = log_outputs(
        raw(spark, record(err={"c": 1}, page={"p": "x"}, displays=[{"i": 1}, {"i": 2}], actions=[{"a": 1}]))
    )
    assert {k: v.count() for k, v in out.items()} == {
        "page": 1, "start": 0, "display": 2, "action": 1, "error": 1, "dirty": 0
    }
    page = json.loads(routing.as_json(out["page"]).first().value)
    assert set(page) == {"common", "page", "ts"}
    display = sorted(
        json.dumps(json.loads(r.value)["display"]) for r in routing.as_json(out["display"]).collect()
    )
    assert display == ['{"i": 1}', '{"i": 2}']


def test_router_null_parts_and_no_page(spark):
    out = log_outputs(raw(spark, record(err=None, start=None, displays=None)))
    assert {k: v.count() for k, v in out.items()} == {
        "page": 1, "start": 0, "display": 0, "action": 0, "error": 0, "dirty": 0
    }


def pages(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], PAGES)


def test_unique_visitor(spark):
    hour = 3600 * 1000
    df = pages(
        spark,
        ("a", "p", 8 * hour),
        ("a", None, 9 * hour),
        ("a", None, 10 * hour),
        ("a", None, DAY + 9 * hour),
    )
    assert keys(visits.unique_visitor(df), "seq") == [(1,), (3,)]


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([("a", None, 0), ("a", None, 5000), ("a", "p", 8000)], [0]),
        ([("a", None, 0), ("a", "p", 10_000)], [0]),
        ([("a", None, 0), ("a", "p", 9_999)], []),
        ([("a", None, 0)], [0]),
        ([("a", None, 0), ("b", "p", 1000)], [0]),
        ([("a", "p", 0)], []),
    ],
)
def test_user_jump(spark, rows, expected):
    assert keys(visits.user_jump(pages(spark, *rows)), "seq") == [(e,) for e in expected]


def jumps_by_hand(rows, within):
    out, by_mid = [], {}
    for mid, last, ts, seq in rows:
        by_mid.setdefault(mid, []).append((ts, seq, last is None))
    for line in by_mid.values():
        line.sort()
        for i, (ts, seq, entry) in enumerate(line):
            after = line[i + 1] if i + 1 < len(line) else None
            if entry and (after is None or after[2] or after[0] - ts >= within):
                out.append((seq,))
    return sorted(out)


@pytest.mark.parametrize("burst", [False, True])
def test_user_jump_with_hot_device(spark, burst):
    """One device holds a third of the rows, or all its rows share few times."""
    rng = random.Random(7)
    rows = []
    for seq in range(6000):
        mid = "hot" if rng.random() < 0.4 else f"m{rng.randrange(300)}"
        ts = rng.randrange(5) * 700 if burst else rng.randrange(3_000_000)
        rows.append((mid, None if rng.random() < 0.6 else "p", ts, seq))
    df = spark.createDataFrame(rows, PAGES)
    hot = find_hot_keys(pages=(df, F.col("mid")))["pages"]
    assert set(hot) == {"hot"}
    expected = jumps_by_hand(rows, 1000)
    assert keys(visits.user_jump(df, 1000), "seq") == expected
    both = keys(visits.user_jump(df, 1000, "match"), "seq") + keys(
        visits.user_jump(df, 1000, "timeout"), "seq"
    )
    assert sorted(both) == expected


@pytest.mark.parametrize("step", [10, 0])
def test_hot_device_is_sliced_evenly(spark, step):
    """Also when all its rows carry one event time."""
    rows = [("hot", None, 7 + i * step, i) for i in range(4000)] + [
        (f"m{i}", None, i, i) for i in range(8000)
    ]
    df = spark.createDataFrame(rows, PAGES)
    hot = find_hot_keys(pages=(df, F.col("mid")))["pages"]
    sizes = [
        r["count"] for r in visits._sliced(df, hot).where("mid = 'hot'").groupBy("_slice").count().collect()
    ]
    assert len(sizes) >= 3 and max(sizes) < 2000


def test_flag_repair_with_hot_device(spark):
    rng = random.Random(3)
    texts, state, expected = [], {}, []
    for i in range(1500):
        mid = "hot" if rng.random() < 0.4 else f"m{rng.randrange(100)}"
        flag, ts = rng.choice("01"), i * 3_600_000
        texts.append(record(mid=mid, is_new=flag, ts=ts))
        day = ts // DAY
        first = state.setdefault(mid, day if flag == "1" else day - 1)
        expected.append((i, "0" if flag == "1" and first != day else flag))
    log, _ = split_log(parse_log(raw(spark, *texts)))
    assert keys(visits.fix_is_new(log), "seq", "is_new") == expected


def test_slices_are_found_by_binary_search():
    """All cut points count, also many at one time, and the cost does not grow with them."""
    rng = np.random.default_rng(1)
    points = sorted({(int(t), int(s)) for t, s in rng.integers(0, 40, (300, 2))} | {(7, -(2**63))})
    cuts = np.array(points, [("ts", np.int64), ("seq", np.int64)])
    ts, seq = rng.integers(-2, 44, 500), rng.integers(-2, 44, 500)
    expected = [sum(p <= (t, s) for p in points) for t, s in zip(ts.tolist(), seq.tolist())]
    assert visits._passed(cuts, ts, seq).tolist() == expected
