"""Streams give the batch operators' results."""

from pyspark.sql import functions as F

from dialume.operators import intervals as I
from dialume.operators import sets as S
from dialume.plans import views as V
from dialume.streaming import stateful

SF = "/root/testdata/sf0.001"


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_units(spark, tmp_path):
    w = V.words_ref(spark, SF).withColumn("end_ms", F.col("start_ms") + 350).select("clip_id", "wid", F.col("speaker").alias("spk"), "start_ms", "end_ms")
    last = w.groupBy("clip_id").agg(F.max("wid").alias("wid")).select("clip_id", F.col("wid") + 1, F.lit(None).cast("string").alias("spk"), F.lit(0).cast("long").alias("start_ms"), F.lit(0).cast("long").alias("end_ms"))
    path = str(tmp_path / "words")
    for part in (w.filter("wid < 2000000"), w.filter("wid >= 2000000"), last):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(w.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    drain(stateful.units_stream(stream), "units_out", "append")
    batch = I.pause_units(w, 500).groupBy("clip_id", "unit", "spk").agg(F.count(F.lit(1)).alias("n_words"))
    got = spark.table("units_out").select("clip_id", "unit", "spk", "n_words")
    assert got.count() == batch.count() and got.exceptAll(batch.select(got.columns)).isEmpty()


def test_latest_and_activity(spark, tmp_path):
    V.manifest(spark, SF).repartition(3).write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema("key long, seq long, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    drain(stateful.latest_stream(log), "latest_out", "complete")
    assert spark.table("latest_out").exceptAll(S.latest(V.manifest(spark, SF)).select("key", "seq", "status")).isEmpty()
    events = V.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    drain(stateful.activity_stream(stream), "activity_out", "append")
    assert spark.table("activity_out").agg(F.sum("n")).first()[0] > 0
