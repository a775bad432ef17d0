"""Streams that stop between batches and resume under their frozen configuration."""

import os
import signal
import threading

import pytest
from pyspark.sql import functions as F

from ledgerlark.sinks import files
from ledgerlark.streaming import runs as R

CONFIG = {"rate": 1.0, "model": {"name": "é", "layers": [1, 2]}, "_config_path": "/a"}


@pytest.fixture
def source(spark, tmp_path):
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    return lambda: spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))


def ids(spark, folder):
    return sorted(r["id"] for r in R.batches(spark, folder).collect())


def test_stopped_and_resumed_between_batches(spark, tmp_path, source):
    folder = str(tmp_path / "run")
    seen = []
    assert R.run(spark, source(), lambda b: b, folder, CONFIG, stop=R.Stop(after_batch=1), each=seen.append) == "stopped"
    assert ids(spark, folder) == list(range(20))
    assert R.run(spark, source(), lambda b: b, folder, CONFIG | {"_config_path": "/b"}, resume=True, stop=R.Stop(after_batch=2)) == "stopped"
    assert ids(spark, folder) == list(range(30))
    assert R.run(spark, source(), lambda b: b, folder, CONFIG, resume=True) == "complete"
    assert ids(spark, folder) == list(range(40))
    assert all(set(b) == {"batch", "rows", "at"} for b in seen)
    with pytest.raises(R.ResumeError, match="complete"):
        R.run(spark, source(), lambda b: b, folder, CONFIG, resume=True)


def test_a_batch_that_dies_is_written_once(spark, tmp_path, source):
    folder, tries = str(tmp_path / "run"), []

    def dies_once(rows):
        tries.append(1)
        if len(tries) == 3:
            raise ValueError("lost")
        return rows

    with pytest.raises(Exception, match="lost"):
        R.run(spark, source(), dies_once, folder, CONFIG)
    assert R.run(spark, source(), dies_once, folder, CONFIG, resume=True) == "complete"
    assert ids(spark, folder) == list(range(40)) and len(tries) == 5


def test_a_batch_whose_output_was_written_but_not_noted(spark, tmp_path, source):
    """A run killed after the sink and before the commit writes the same folder again."""
    folder = str(tmp_path / "run")
    assert R.run(spark, source(), lambda b: b, folder, CONFIG, stop=R.Stop(after_batch=1)) == "stopped"
    commits = tmp_path / "run" / "state" / "commits"
    newest = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    newest.unlink()
    (commits / f".{newest.name}.crc").unlink(missing_ok=True)
    assert R.run(spark, source(), lambda b: b, folder, CONFIG, resume=True) == "complete"
    assert ids(spark, folder) == list(range(40))


def test_signals_ask_to_stop(spark, tmp_path, source):
    stop, folder = R.Stop(), str(tmp_path / "run")
    before = signal.getsignal(signal.SIGUSR1)

    def signalled(rows):
        os.kill(os.getpid(), signal.SIGUSR1)
        return rows

    with stop.on(signal.SIGUSR1):
        threading.Event().wait(0)
        assert R.run(spark, source(), signalled, folder, CONFIG, stop=stop) == "stopped"
    assert signal.getsignal(signal.SIGUSR1) == before
    assert R.run(spark, source(), lambda b: b, folder, CONFIG, resume=True) == "complete"
    assert ids(spark, folder) == list(range(40))


@pytest.mark.parametrize(
    ("changed", "named"),
    [({"rate": 2.0}, "rate"), ({"model": {"name": "é", "layers": [2, 1]}}, "model.layers"), ({"more": None}, "more"), ({"rate": 1}, "rate")],
)
def test_any_other_setting_is_refused(spark, tmp_path, changed, named):
    folder = str(tmp_path / "run")
    R.claim(spark, folder, CONFIG, resume=False)
    with pytest.raises(R.ResumeError, match=f"frozen ones: {named}$"):
        R.claim(spark, folder, CONFIG | changed, resume=True)
    R.claim(spark, folder, dict(reversed(CONFIG.items())), resume=True)


def test_folders_that_are_not_as_expected(spark, tmp_path):
    with pytest.raises(R.ResumeError, match="no run"):
        R.claim(spark, str(tmp_path / "none"), CONFIG, resume=True)
    R.claim(spark, str(tmp_path / "run"), CONFIG, resume=False)
    with pytest.raises(R.ResumeError, match="in use"):
        R.claim(spark, str(tmp_path / "run"), CONFIG, resume=False)
    frozen = tmp_path / "run" / R.FROZEN
    frozen.write_text(frozen.read_text().replace("1.0", "1.5"))
    (tmp_path / "run" / f".{R.FROZEN}.crc").unlink(missing_ok=True)
    with pytest.raises(R.ResumeError, match="damaged"):
        R.claim(spark, str(tmp_path / "run"), CONFIG, resume=True)


def test_documents_are_created_once(spark, tmp_path):
    path = str(tmp_path / "sub" / "x.json")
    files.create(spark, path, "first é")
    with pytest.raises(FileExistsError):
        files.create(spark, path, "second")
    assert files.read_text(spark, path) == "first é" and files.sizes(spark, str(tmp_path / "sub"))["x.json"] == 8
    assert files.sizes(spark, str(tmp_path / "none")) == {}
    assert files.opened(files.sealed({"a": 1})) == {"a": 1}
    assert [files.opened(t) for t in ("", "[]", "{}", files.sealed({"a": 1})[:-4], files.sealed({"a": 1}).replace("1", "2", 1))] == [None] * 5


def test_rows_of_a_run_are_plain_tables(spark, tmp_path, source):
    folder = str(tmp_path / "run")
    R.run(spark, source(), lambda b: b.groupBy((F.col("id") % 2).alias("odd")).count(), folder, {})
    assert [tuple(r) for r in R.batches(spark, folder).groupBy("odd").agg(F.sum("count")).orderBy("odd").collect()] == [(0, 20), (1, 20)]
