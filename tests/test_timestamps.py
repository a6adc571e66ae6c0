from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from conftest import pandas_of
from pyspark.sql import functions as F

from tidegrid.functions.timestamps import add_candidates, best_in_range, greedy, parse_date_and_hour
from tidegrid.operators.layout import Series
from tidegrid.operators.recover import resolve_blocks
from tidegrid.sources import csv_tasks

CASES = {
    "112001 1:00": [datetime(2001, 1, 1, 1), datetime(2001, 11, 20, 1)],
    "122001 0:00": [datetime(2001, 1, 2), datetime(2001, 12, 20)],
    "9302010 20:00": [datetime(2010, 9, 30, 20)],
    "1012010 0:00": [datetime(2010, 10, 1), datetime(2010, 1, 1)],
    "1112011 1:00": [datetime(2011, 11, 1, 1), datetime(2011, 1, 11, 1)],
    "1212011 1:00": [datetime(2011, 12, 1, 1), datetime(2011, 1, 21, 1)],
    "2302010 5:00": [],
    "2292012 5:00": [datetime(2012, 2, 29, 5)],
    "  9302010 20:00\n": [datetime(2010, 9, 30, 20)],
    "9302010": [],
    "9302010 24:00": [],
    "abc 1:00": [],
    "": [],
}


def brute(text: str) -> list[datetime]:
    """Readings found by trying every cut of the digits."""
    parts = text.strip().split(" ")
    if len(parts) < 2 or not parts[0].isdigit() or not parts[1].split(":")[0].isdigit():
        return []
    digits, hour, out = parts[0], int(parts[1].split(":")[0]), []
    for cut in (4, 2):
        front, year = digits[:-cut], int(digits[-cut:])
        year += 2000 if cut == 2 else 0
        if cut == 4 and not 2000 <= year <= 2030:
            continue
        for m in (2, 1):
            month, day = front[:m], front[m:]
            if 2 <= len(front) <= 4 and len(month) == m and 1 <= len(day) <= 2:
                try:
                    out.append(datetime(year, int(month), int(day), hour))
                except ValueError:
                    pass
    return list(dict.fromkeys(out))


def test_candidates(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "raw string")
    got = {r["raw"]: r["cands"] for r in add_candidates(df, "raw").collect()}
    assert got == CASES


def test_candidates_of_every_day_equal_trying_all_cuts(spark):
    days = [datetime(2009, 12, 25) + timedelta(days=d) for d in range(800)]
    texts = [f"{d.month}{d.day}{d.year} {i % 24}:00" for i, d in enumerate(days)]
    texts += [f"{d.month:02d}{d.day:02d}{d.year} 7:00" for d in days] + [f"{d.month}{d.day}{d.year % 100:02d} 7:00" for d in days]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    for r in add_candidates(df, "raw").collect():
        assert r["cands"] == brute(r["raw"]), r["raw"]


def test_choice_by_range(spark):
    df = add_candidates(spark.createDataFrame([("112001 1:00",)], "raw string"), "raw")

    def pick(low, high):
        a, b = [F.lit(x).cast("timestamp_ntz") for x in (low, high)]
        return df.select(best_in_range(F.col("cands"), a, b)).first()[0]

    assert pick("2001-10-01", "2001-12-31") == datetime(2001, 11, 20, 1)
    assert pick("2000-12-01", "2001-02-01") == datetime(2001, 1, 1, 1)
    assert pick("2005-01-01", "2006-01-01") == datetime(2001, 11, 20, 1)  # nearest edge
    assert pick(None, None) == df.select(greedy(F.col("cands"))).first()[0] == datetime(2001, 1, 1, 1)


def test_solution_dates(spark):
    df = spark.createDataFrame([("12/1/2011", 1), ("2/30/2011", 1), ("x", 2)], "d string, h int")
    assert [r[0] for r in df.select(parse_date_and_hour("d", "h")).collect()] == [datetime(2011, 12, 1, 1), None, None]


def resolve_brute(rows: list[list[datetime]]) -> list[datetime | None]:
    """The block rule, row by row in a list."""
    out: list[datetime | None] = [c[0] if c else None for c in rows]
    if not any(len(c) == 1 for c in rows):
        return out
    i = 0
    while i < len(rows):
        j = i
        while j + 1 < len(rows) and len(rows[i]) > 1 and len(rows[j + 1]) == len(rows[i]):
            j += 1
        if len(rows[i]) > 1:
            low = next((rows[k][0] for k in range(i - 1, -1, -1) if len(rows[k]) == 1), None)
            high = next((rows[k][0] for k in range(j + 1, len(rows)) if len(rows[k]) == 1), None)

            def gap(k):
                head = 0 if low is None else (rows[i][k] - low).total_seconds()  # noqa: B023
                tail = 0 if high is None else (high - rows[j][k]).total_seconds()  # noqa: B023
                return float("inf") if head < 0 or tail < 0 else head + tail

            best = min(range(len(rows[i])), key=lambda k: (gap(k), k))
            for k in range(i, j + 1):
                out[k] = rows[k][best]
        i = j + 1
    return out


@pytest.mark.parametrize("chunk", [10, 1000])
def test_blocks_equal_the_plain_rule(spark, chunk):
    rows = []
    for key, start, hours in ((1, datetime(2010, 10, 20), 2400), (2, datetime(2011, 1, 1), 700), (3, datetime(2011, 11, 1), 9)):
        for h in range(hours):
            t = start + timedelta(hours=h)
            raw = "?" if h % 97 == 13 else f"{t.month}{t.day}{t.year} {t.hour}:00"
            rows.append((key, h, raw))
    df = add_candidates(spark.createDataFrame(rows, "series int, pos long, raw string"), "raw", seconds=True)
    out = pandas_of(resolve_blocks(df, Series(chunk=chunk)), "series", "pos")
    for key, group in out.groupby("series"):
        expected = resolve_brute([brute(r[2]) for r in rows if r[0] == key])
        got = [None if str(t) == "NaT" else t.to_pydatetime() for t in group["ts"]]
        assert got == expected


def test_blocks_need_no_sorting_aggregates(spark):
    df = add_candidates(spark.createDataFrame([(1, 0, "112001 1:00")], "series int, pos long, raw string"), "raw", seconds=True)
    plan = spark._jvm.PythonSQLUtils.explainString(resolve_blocks(df, Series())._jdf.queryExecution(), "formatted")
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_rows_of_blocks_move_once(spark):
    """One shuffle of the rows, read by the rows and by the summary of their chunks, in code that is short enough to be compiled."""
    rows = spark.createDataFrame([(1, 0, "112001 1:00")], "series int, pos long, raw string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = resolve_blocks(add_candidates(rows, "raw", seconds=True), Series())._jdf.queryExecution()
        text = spark._jvm.PythonSQLUtils.explainString(plan, "formatted")
        code = spark._jvm.PythonSQLUtils.explainString(plan, "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)
    assert len([columns for columns in moved if "cands#" in columns]) == 1 and "ReusedExchange" in text
    assert "lambda" not in text.lower()
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000


@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_blocks_of_any_shape_over_chunks(spark, chunk):
    """Runs of 0 to 4 readings, shorter and longer than a chunk, series without a certain row, a NULL key."""
    rng, start = random.Random(chunk), datetime(2011, 1, 1)
    rows, expected = [], {}
    for key in (1, 2, 3, None):
        series: list[list[datetime]] = []
        while len(series) < 120:
            n = rng.choice((2, 3, 0) if key == 2 else (0, 1, 1, 2, 2, 3, 4))
            for _ in range(rng.choice((1, 2, 7, 20))):
                at = start + timedelta(hours=len(series))
                series.append([at + timedelta(days=d) for d in rng.sample((-300, -40, -3, 0, 2, 25, 200), n)])
        expected[key] = resolve_brute(series)
        rows += [(key, p, [int((t - datetime(1970, 1, 1)).total_seconds()) for t in c]) for p, c in enumerate(series)]
    seconds = rows[0][2] or [5]
    rows += [(1, None, seconds), (1, None, []), (1, None, None)]
    df = spark.createDataFrame(rows, "series int, pos long, cands array<bigint>").repartition(5)
    got = resolve_blocks(df, Series(chunk=chunk)).collect()
    assert len(got) == len(rows)
    for key, times in expected.items():
        assert [r["ts"] for r in sorted((r for r in got if r["series"] == key and r["pos"] is not None), key=lambda r: r["pos"])] == times
    spare = [r for r in got if r["pos"] is None]
    assert [r["ts"] for r in spare if r["cands"]] == [datetime(1970, 1, 1) + timedelta(seconds=seconds[0])]
    assert [r["ts"] for r in spare if not r["cands"]] == [None, None]


def test_candidates_of_any_digits_equal_trying_all_cuts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("0112239") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    texts += [f"{d}20{y:02d}" for d in range(10000) for y in (0, 1, 20, 30, 31)]
    df = spark.createDataFrame([(f"{t} {i % 25}:00",) for i, t in enumerate(texts)], "raw string")
    for seconds in (False, True):
        for r in add_candidates(df, "raw", seconds=seconds).collect():
            right = brute(r["raw"]) if not r["raw"].endswith(" 24:00") else []
            assert r["cands"] == ([int((t - datetime(1970, 1, 1)).total_seconds()) for t in right] if seconds else right), r["raw"]


def test_readings_beyond_the_format_end_the_job(spark):
    df = spark.createDataFrame([(1, p, list(range(0, 3600 * n, 3600))) for p, n in enumerate((1, 5, 1))], "series int, pos long, cands array<bigint>")
    with pytest.raises(Exception, match="more than 4 readings"):
        resolve_blocks(df, Series()).collect()
    # five readings are allowed here; the block fits best between its neighbours with the first
    assert [r["ts"].hour for r in resolve_blocks(df, Series(), most=5).orderBy("pos").collect()] == [0, 0, 0]


def test_lines_move_once_and_after_the_recovery(spark, tmp_path):
    """Where no summary may be broadcast, only the join of lines and times moves more than timestamps."""
    (tmp_path / "L1-train.csv").write_text("ZONEID,TIMESTAMP,LOAD,w1\n1,912010 1:00,5,2\n1,912010 2:00,6,3\n")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = csv_tasks.scan_train_csv(spark, f"{tmp_path}/L1-train.csv", ["w1"])
        plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
        moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: (\w+)\((\w+)#", plan)
        assert len(moved) > 3
        assert [key for columns, _, key in moved if {"LOAD", "w1"} & {c.split("#")[0] for c in columns.split(", ")}] == ["__id"]
        assert out.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_training_file_over_many_splits(spark, tmp_path):
    """Splits of a few kilobytes: line numbers and times must not depend on them."""
    start = datetime(2010, 9, 1)
    for task in (1, 12):
        folder = tmp_path / f"Task {task}"
        folder.mkdir()
        lines = ["ZONEID,TIMESTAMP,LOAD,w1,w2"]
        for h in range(1500):
            t = start + timedelta(hours=h)
            raw = "bad" if h == 700 else f"{t.month}{t.day}{t.year} {t.hour}:00"
            lines.append(f"{task},{raw},{'' if h % 10 == 0 else h},{h / 2},x")
        (folder / f"L{task}-train.csv").write_text("\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = csv_tasks.read_in_file_order(spark, f"{tmp_path}/Task */L*-train.csv", ["ZONEID", "TIMESTAMP", "LOAD", "w1", "w2"])
        assert lines.rdd.getNumPartitions() > 4
        numbered = pandas_of(lines.where("LOAD is not null and task_id = 12"), "pos")
        assert (numbered["pos"] == numbered["LOAD"].astype(int)).all()
        out = pandas_of(csv_tasks.scan_all_tasks(spark, str(tmp_path), ["w1", "w2"], chunk=100), "task_id", "ts")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert out.groupby("task_id").size().to_dict() == {1: 1499, 12: 1499}
    one = out[out["task_id"] == 12]
    expected = [start + timedelta(hours=h) for h in range(1500) if h != 700]
    assert [t.to_pydatetime() for t in one["ts"]] == expected
    assert one["LOAD"].isna().sum() == 149 and one["w2"].isna().all()
    bad = csv_tasks.scan_quarantine(spark, str(tmp_path / "Task 1"), ["w1", "w2"])
    assert [r["TIMESTAMP"] for r in bad.collect()] == ["bad"]
