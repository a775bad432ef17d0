"""The metric log as a data source: ranges, checks, filters, and streams that wait for torn lines."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.sources import metric_source as M
from ledgerlark.streaming import runs as R


def log(lines):
    return "".join(json.dumps(x) + "\n" if not isinstance(x, str) else x for x in lines)


@pytest.fixture
def some(tmp_path):
    folder = tmp_path / "log"
    (folder / "rank1").mkdir(parents=True)
    (folder / "_hidden").write_text("no log")
    (folder / "a.jsonl").write_text(log([{"step": i, "loss": i / 4, "é": "ü" * (i % 9), "on": i % 2 == 0} for i in range(50)] + ["\n  \n"]))
    (folder / "rank1" / "b.jsonl").write_text(log([{"step": i, "loss": -i, "none": None} for i in range(5)]) + '{"step": 5, "loss": 1}')
    return folder


def test_rows_of_any_split(spark, some):
    whole = {tuple(r) for r in M.metric_rows(spark, str(some)).collect()}
    assert len(whole) == 50 * 3 + 5 * 2 + 1
    assert {(r[2], r[4]) for r in whole if r[0].endswith("b.jsonl") and r[3] == "loss"} == {(0, 0.0), (1, -1.0), (2, -2.0), (3, -3.0), (4, -4.0), (5, 1.0)}
    assert {r[5] for r in whole if r[3] == "on"} == {"true", "false"} and {r[5] for r in whole if r[3] == "none"} == {"null"}
    for split in (700, 100):
        df = M.metric_rows(spark, f"file://{some}", splitBytes=split)
        assert df.rdd.getNumPartitions() >= 5
        assert {tuple(r) for r in df.collect()} == whole


def test_every_line_is_in_one_range():
    r = random.Random(4)
    for _ in range(50):
        text = b"".join(b"x" * r.randint(0, 9) + b"\n" for _ in range(r.randint(0, 12))) + b"y" * r.randint(0, 3)
        want, at = [], 0
        for line in text.splitlines(keepends=True):
            want.append((at, line, line.endswith(b"\n")))
            at += len(line)
        for split in (1, 2, 5, 100):
            got = [x for a in range(0, len(text), split) for x in M.lines(io.BytesIO(text), M.Range("p", a, min(a + split, len(text)), False))]
            assert got == want


@pytest.mark.parametrize("bad", ["[1]\n", "{}\n", '{"step": 1.0}\n', '{"step": true}\n', '{"step": "1"}\n', "nonsense\n", '{"step": 1\n{"step": 2}\n'])
def test_lines_against_the_contract(spark, tmp_path, bad):
    (tmp_path / "l.jsonl").write_text('{"step": 0, "x": 1}\n' + bad)
    with pytest.raises(Exception, match="byte 20"):
        M.metric_rows(spark, str(tmp_path)).collect()


def test_empty_logs_and_numbers_that_are_not_finite(spark, tmp_path):
    for path in (tmp_path, tmp_path / "none"):
        with pytest.raises(Exception, match="no metrics"):
            M.metric_rows(spark, str(path)).collect()
    (tmp_path / "l.jsonl").write_text('{"step": 0, "x": NaN}\n{"step": 1, "x": 1e999}\n{"step": 2, "x"')
    assert M.metric_rows(spark, str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="has x"):
        M.metric_rows(spark, str(tmp_path), finite=True).collect()


def test_filters_reach_the_reader(spark, some):
    df = M.metric_rows(spark, str(some)).where("step >= 10 AND step < 12 AND metric IN ('loss', 'on') AND value > 2.5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "step" not in plan.split("Filter")[1].split("\n")[0] and "value" in plan.split("Filter")[1].split("\n")[0]
    assert [tuple(r) for r in df.select("step", "metric", "value").collect()] == [(11, "loss", 2.75)]
    every = M.metric_rows(spark, str(some))
    plain = spark.createDataFrame(every.collect(), every.schema)
    for where in ("step = 7", "step > 48", "step <= 0", "step IN (1, 3)", "metric = 'é'", "step IS NULL", "step = NULL", "NOT step = 3", "step = 1 OR metric = 'on'"):
        assert every.where(where).count() == plain.where(where).count()


def test_a_stream_waits_for_torn_lines(spark, tmp_path):
    source, folder = tmp_path / "log", str(tmp_path / "run")
    source.mkdir()
    first = log([{"step": i, "loss": i} for i in range(30)])
    (source / "a.jsonl").write_text(first + '{"step": 30, "lo')

    def go(resume):
        R.run(spark, M.metric_stream(spark, str(source), splitBytes=64), lambda b: b, folder, {}, resume=resume)
        (tmp_path / "run" / R.COMPLETE).unlink()
        (tmp_path / "run" / f".{R.COMPLETE}.crc").unlink(missing_ok=True)
        return sorted((r["step"], r["value"]) for r in R.batches(spark, folder).collect())

    assert go(False) == [(i, float(i)) for i in range(30)]
    (source / "a.jsonl").write_text(first + log([{"step": i, "loss": i} for i in range(30, 33)]))
    (source / "b.jsonl").write_text(log([{"step": 99, "loss": 0}]))
    assert go(True) == [(i, float(i)) for i in range(33)] + [(99, 0.0)]
    assert go(True) == [(i, float(i)) for i in range(33)] + [(99, 0.0)]
    (source / "a.jsonl").write_text(first)
    (source / "b.jsonl").write_text(log([{"step": 99, "loss": 0}]) * 2)
    with pytest.raises(Exception, match="no longer there|offset"):
        go(True)


def test_ends_of_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(M, "BACK", 3)
    for text, known, want in ((b"", 0, 0), (b"abc", 0, 0), (b"abc\n", 0, 4), (b"a\nbcdefgh", 0, 2), (b"a\nbcdefgh", 2, 2), (b"a\nb\nc", 2, 4)):
        (tmp_path / "f").write_bytes(text)
        system, path = M.arrow_file(str(tmp_path / "f"))
        with system.open_input_file(path) as f:
            assert M.end_of_lines(f, len(text), known) == want


def test_union_of_keys(spark, some):
    got = M.metric_rows(spark, str(some)).groupBy("metric").agg(F.count("*").alias("n")).collect()
    assert {tuple(r) for r in got} == {("loss", 56), ("é", 50), ("on", 50), ("none", 5)}
