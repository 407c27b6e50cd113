from datetime import datetime

from pyspark.sql import functions as F

from loomline.streaming import events

SCHEMA = "user_id string, item_id string, ts timestamp, price double, channel int"


def test_replay(spark, tmp_path):
    at = lambda d, h=12: datetime(2020, 9, d, h)
    rows = [("u", "1", at(1), 0.1, 1), ("u", "1", at(1, 13), 0.1, 1), ("u", "2", at(2), 0.1, 1), ("v", "1", at(20), 0.1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "in"))

    def replay(make, mode):
        name = f"t{abs(hash(make))}"
        q = make(events.transaction_stream(spark, str(tmp_path / "in"), SCHEMA)).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = {(x.user_id, x.item_id, str(x.date)): x.quantity for x in replay(events.daily_quantities, "complete").collect()}
    batch = df.groupBy("user_id", "item_id", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    assert got == {(x.user_id, x.item_id, str(x.date)): x.n for x in batch.collect()}
    assert replay(events.distinct_purchases, "append").count() == 3
    assert replay(events.sliding_popularity, "complete").agg(F.max("n")).first()[0] == 2
    assert replay(lambda s: events.sessions(s, "2 hours"), "complete").count() == 3
