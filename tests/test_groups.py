"""Groups whose completions come in several micro-batches, against those of the whole table."""

import math
import time

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import scoring as S
from ledgerlark.streaming import groups as G
from ledgerlark.streaming import runs as R

ROWS = [(f"e{i % 5}" if i % 11 else None, f"text {i * i % 7}" if i % 13 else None, math.nan if i == 17 else None if i == 18 else (i * 37 % 10) / 10) for i in range(120)]
ROWS += [("same", "x", 0.3)] * 9 + [("alone", "y", 1.0)]
SCHEMA = "example string, text string, reward double"


@pytest.fixture
def arrive(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    df.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(4, F.xxhash64("at")).drop("at").write.parquet(str(tmp_path / "src"))

    def stream(files):
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "src"))

    return stream


def followed(spark, stream, folder, **options):
    return G.follow(spark, stream, folder, {"a": 1}, F.col("example"), F.col("text"), F.col("reward"), **options)


def whole(spark):
    value = F.coalesce(F.nanvl("reward", F.lit(0.0)), F.lit(0.0))
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({"reward": value, "text": F.coalesce("text", F.lit(""))})
    return S.duplicate_fraction(df, "example", F.col("text")).first().asDict() | S.group_variance(df, "example", F.col("reward")).first().asDict()


@pytest.mark.parametrize("files", [1, 100])
def test_any_cut_into_batches_gives_the_whole(spark, tmp_path, arrive, files):
    batches = []
    assert followed(spark, arrive(files), str(tmp_path / "run"), each=batches.append) == "complete"
    assert G.metrics(spark, str(tmp_path / "run")).first().asDict() == pytest.approx(whole(spark))
    assert spark.conf.get(G.PROVIDER) != G.ROCKSDB


def test_groups_after_a_restart(spark, tmp_path, arrive):
    folder = str(tmp_path / "run")
    assert followed(spark, arrive(1), folder, stop=R.Stop(after_batch=1)) == "stopped"
    some = G.metrics(spark, folder).first()["n"]
    assert 0 < some < len(ROWS)
    with pytest.raises(R.ResumeError):
        G.follow(spark, arrive(1), folder, {"a": 2}, F.col("example"), F.col("text"), F.col("reward"), resume=True)
    assert followed(spark, arrive(1), folder, resume=True) == "complete"
    assert G.metrics(spark, folder).first().asDict() == pytest.approx(whole(spark))
    rows = {r["example_id"]: r for r in G.groups(spark, folder).collect()}
    assert (rows["same"]["n"], rows["same"]["duplicates"], rows["alone"]["variance"]) == (9, 8, 0.0) and None in rows


def test_number_of_parts_changes_nothing(spark, tmp_path, arrive):
    for salts in (1, 5):
        followed(spark, arrive(2), str(tmp_path / f"run{salts}"), salts=salts)
        assert G.metrics(spark, str(tmp_path / f"run{salts}")).first().asDict() == pytest.approx(whole(spark))


def test_idle_parts_are_closed_and_begin_anew(spark, tmp_path):
    source, folder = str(tmp_path / "src"), str(tmp_path / "run")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    one = spark.createDataFrame([("a", "x", 0.0), ("a", "x", 1.0)], SCHEMA).coalesce(1)
    one.write.parquet(source)
    def until(seen):
        """Processing-time timers make batches without new rows, so the stream is never done; wait for what is due."""
        for _ in range(60):
            time.sleep(0.5)
            if any(tmp_path.glob("run/sink/*/_SUCCESS")) and any(tmp_path.glob("run/sink/*/*.parquet")) and (rows := R.batches(spark, folder).orderBy("batch").collect()) and seen(rows):
                return
        raise AssertionError("nothing came")

    with G.map_state(spark):
        made = G.parts(stream(), F.col("example"), F.col("text"), F.col("reward"), salts=1, idle_ms=500)

        def write(rows, n):
            if not rows.isEmpty():
                rows.write.mode("overwrite").parquet(f"{folder}/sink/batch={n}")

        query = made.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/state").start()
        try:
            until(lambda rows: any(r["closed"] for r in rows))
            one.write.mode("append").parquet(source)
            until(lambda rows: sum(not r["closed"] for r in rows) == 2)
        finally:
            query.stop()
    rows = R.batches(spark, folder).where("n > 0").orderBy("batch").collect()
    assert [r["closed"] for r in rows[:2]] == [False, True] and len({r["since"] for r in rows}) == 2
    # The second two came after their group was forgotten: no more duplicates than within each.
    assert tuple(G.groups(spark, folder).select("n", "duplicates").first()) == (4, 2)


def test_parts_that_last_are_one_aggregation(spark, tmp_path, arrive):
    """A processor in Python asks the state store for every text; it is left to groups that time closes."""
    columns = (F.col("example"), F.col("text"), F.col("reward"))
    plan = G.parts(arrive(1), *columns)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "Aggregate" in plan
    assert "TransformWithState" in G.parts(arrive(1), *columns, ttl_ms=1000)._jdf.queryExecution().analyzed().toString()
    followed(spark, arrive(1), str(tmp_path / "run"))
    rows = R.batches(spark, str(tmp_path / "run")).groupBy("example_id", "text_hash").count().collect()
    # One part with moments of every example, and the texts that came again.
    repeated = spark.createDataFrame(ROWS, SCHEMA).groupBy("example", F.coalesce("text", F.lit(""))).count().where("count > 1").count()
    assert sum(r["text_hash"] is None for r in rows) == len({e for e, _, _ in ROWS}) and sum(r["text_hash"] is not None for r in rows) == repeated


def test_a_batch_of_the_query_is_many_files(spark, sf_dir, monkeypatch):
    from ledgerlark import catalogue

    folders, follow = [], G.follow
    monkeypatch.setattr(catalogue.groups, "follow", lambda s, stream, folder, *a, **b: folders.append(folder) or follow(s, stream, folder, *a, **b))
    catalogue.QUERIES["stream_groups"](spark, sf_dir)
    cores, at = spark.sparkContext.defaultParallelism, folders[0].rsplit("/", 1)[0]
    files = spark.read.parquet(f"{at}/events").inputFiles()
    assert len(folders) == 2 and len(files) == 4 * cores
    batches = spark.read.parquet(f"{folders[0]}/sink").select("batch").distinct().count()
    assert batches == 4
