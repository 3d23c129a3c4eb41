"""Step functions against a plain sweep."""

import random
from datetime import datetime

from meldspark.llm import concurrency

SCHEMA = "key int, start long, stop long, value long, span int"


def swept(rows):
    """By definition, moment by moment."""
    out = set()
    live = [(-1 if k is None else k, a, b, v or 0) for k, a, b, v, _ in rows if a is not None and (b is None or b > a)]
    for key in {x[0] for x in live} | ({-2} if live else set()):
        mine = [x for x in live if key in (-2, x[0])]
        at = sorted({x[1] for x in mine} | {x[2] for x in mine if x[2] is not None})
        state = {t: (sum(a <= t and (b is None or b > t) for _, a, b, _ in mine), sum(v for _, a, b, v in mine if a <= t and (b is None or b > t))) for t in at}
        moments, last = [], (0, 0)
        for t in at:
            if state[t] != last:
                moments.append(t)
            last = state[t]
        peak = max((state[t][1] for t in moments), default=None)
        high = None
        for i, t in enumerate(moments):
            n, v = state[t]
            high = n if high is None else max(n, high)
            out.add((key, t, moments[i + 1] if i + 1 < len(moments) else None, n, v, high, v == peak))
    return out


def test_equals_a_plain_sweep(spark, monkeypatch):
    monkeypatch.setattr(concurrency, "FAN", 2)  # several rounds
    rnd = random.Random(5)
    rows = []
    for _ in range(400):
        a = rnd.choice([rnd.randrange(300_000), rnd.randrange(40), None if rnd.random() < 0.1 else 65536])
        b = None if a is None or rnd.random() < 0.1 else a + rnd.choice([0, -3, 1, 10, 65536, rnd.randrange(200_000)])
        rows.append((rnd.choice([0, 0, 1, 7, None]), a, b, rnd.choice([None, 0, 5, 5, -5, rnd.randrange(1000)]), 9))
    rows += rows[:30]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(13)
    got = [tuple(r) for r in concurrency.concurrency(df).collect()]
    assert len(got) == len(set(got)) and set(got) == swept(rows)


def test_pieces_of_a_partition_are_split_by_rows(spark, monkeypatch):
    rows = [(i % 3, i, i + 40, i, 0) for i in range(500)]
    want = swept(rows)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    assert {tuple(r) for r in concurrency.concurrency(df).collect()} == want
    # functions of few rows, batches of few points
    monkeypatch.setattr(concurrency, "FAN", 3)
    got = list(concurrency._function([__import__("pyarrow").RecordBatch.from_pylist([{"key": 1, "start": 5, "stop": 9, "value": 2}])], 4))
    assert [b.to_pydict() for b in got] == [{"key": [-2, 1], "span": [0, 0], "slot": [4, 4], "t": [[5, 9], [5, 9]], "n": [[1, -1], [1, -1]], "v": [[2, -2], [2, -2]]}]


def test_changes_that_cancel_are_no_rows(spark):
    rows = [(1, 0, 10, 5, 0), (1, 10, 20, 5, 0), (2, 0, 10, 5, 0), (2, 10, None, 6, 0)]
    got = {tuple(r) for r in concurrency.concurrency(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {r for r in got if r[0] == 1} == {(1, 0, 20, 1, 5, 1, True), (1, 20, None, 0, 0, 1, False)}
    assert got == swept(rows)


def test_sales_edge_cases(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    noon = datetime(2024, 1, 2)
    sales = spark.createDataFrame(
        [(1, 1, 1.005, at(0)), (2, None, None, at(0)), (3, 9, float("nan"), at(1)), (None, 2, 2.0, at(2)), (4, 1, 1.0, None), (5, 2, 3.0, datetime(2024, 3, 1)), (1, 1, 1.005, at(0))],
        "sale_id long, client_id long, total double, sold_at timestamp_ntz",
    )
    lines = spark.createDataFrame([(1, noon, 1), (1, None, 1), (1, datetime(2024, 1, 9), 1), (2, None, 1), (5, noon, 1), (None, noon, 1)], "sale_id long, shipped_at timestamp_ntz, total int")
    clients = spark.createDataFrame([(1, 3), (2, None), (2, 8), (2, 9), (None, 4)], "client_id long, nation_id int")
    base = 1704067200
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # times without a zone are UTC all the same
    try:
        got = sorted(map(tuple, concurrency.sale_intervals(sales, lines, clients).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == sorted([(3, base, base + 2 * 86400, 100), (3, base, base + 2 * 86400, 100), (None, base, None, 0), (None, base + 1, None, 0), (8, base + 2, None, 200), (8, 1709251200, base + 2 * 86400, 300)], key=str)
    assert concurrency.open_sales(sales.limit(0), lines, clients).collect() == []
    rows = concurrency.open_sales(sales, lines.limit(0), clients.limit(0), unit=60).collect()
    assert {(r.nation_id, r.from_s, r.n_open) for r in rows} == {(k, t, n) for k in (-1, -2) for t, n in ((base, 5), (1709251200, 6))}
