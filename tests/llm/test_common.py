from pyspark.sql import functions as F

from lorebed.llm import common


def test_durable_tables_are_in_the_shared_folder(spark):
    df = common.durable(spark.range(5).withColumn("x", F.rand()), "test")
    assert df.collect() == df.collect()  # drawn once
    path = df.inputFiles()[0]
    assert common.shared_dir(spark).replace("file:", "") in path.replace("file://", "")


def test_samples_are_the_least_by_their_hash(spark):
    rows = spark.range(20_000)
    h = F.xxhash64("id")
    whole = sorted((r.h & (1 << 64) - 1) >> 1 for r in rows.select(h.alias("h")).collect())
    for size in (0, 1, 100, 30_000):
        got = common.sampled(rows, h, size).select(h.alias("h")).collect()
        assert sorted((r.h & (1 << 64) - 1) >> 1 for r in got) == whole[:size]


def test_small_sides_are_counted_before_they_are_broadcast(spark, capsys):
    left, right = spark.range(100), spark.range(10)
    left.join(common.small(right, 10), "id").explain("extended")
    assert "strategy=broadcast" in capsys.readouterr().out
    left.join(common.small(right, 9), "id").explain("extended")
    assert "strategy=broadcast" not in capsys.readouterr().out


def test_tables_are_removed_from_a_mark_on(spark):
    import os

    def there(df):
        return os.path.exists(df.inputFiles()[0].replace("file://", ""))

    first = common.durable(spark.range(3), "first")
    mark = common.written()
    second, third = common.durable(spark.range(3), "second"), common.durable(spark.range(3), "third")
    paths = [df.inputFiles()[0].replace("file://", "") for df in (first, second, third)]
    common.drop_written(mark, last=1)
    assert [os.path.exists(p) for p in paths] == [True, False, True] and third.count() == 3
    common.drop_written(mark)
    assert [os.path.exists(p) for p in paths] == [True, False, False] and there(first)


def test_a_session_s_own_batch_size_stays(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "77")
        common.bound_batches(spark)
        assert spark.conf.get(key) == "77"
        spark.conf.set(key, "10000")
        common.bound_batches(spark)
        assert spark.conf.get(key) == str(common.DOCUMENTS_PER_BATCH)
    finally:
        spark.conf.set(key, before)
