"""A batch of a stream is worked on by all cores, however few files it has."""

from pyspark.sql import functions as F

from sangloc.sources import sinks
from sangloc.streaming import moderation


def test_a_batch_of_one_file_is_dealt_out(spark, monkeypatch, tmp_path):
    seen = []

    def ruled(batch, *_):
        seen.append((batch.rdd.getNumPartitions(), batch.count()))
        return batch

    monkeypatch.setattr(moderation, "rule_posts", ruled)
    monkeypatch.setattr(moderation, "judge", lambda ruled, *_: ruled)
    monkeypatch.setattr(moderation, "removed", lambda *_: None)
    rows = spark.range(100).withColumnRenamed("id", "post_id")
    rows.coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    moderation.moderate_stream(
        stream, None, str(tmp_path / "out"), str(tmp_path / "state"), object(), lambda df: df
    ).awaitTermination()
    cores = spark.sparkContext.defaultParallelism
    assert [n for n, _ in seen] == [cores, cores] and sum(n for _, n in seen) == 100
    assert sorted(r.post_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(100))


def test_a_table_of_many_splits_stays(spark):
    many = spark.range(100).repartition(spark.sparkContext.defaultParallelism + 1)
    assert sinks.dealt_out(many) is many


def test_splits_without_rows_do_not_count(spark):
    cores = spark.sparkContext.defaultParallelism
    one_full = spark.range(0, 1000 * cores, 1, cores).where("id < 1000")
    assert one_full.rdd.getNumPartitions() == cores
    dealt = sinks.dealt_out(one_full, per_core=2)
    held = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == cores and sum(held) == 1000
