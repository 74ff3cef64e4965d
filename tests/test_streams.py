"""A stream that has read a whole table returns what its batch twin does."""

import tempfile

import pytest
from pyspark.sql import functions as F

from artifactgate.operators import approve
from artifactgate.plans.fixtures import frame
from artifactgate.streaming import approvals, buckets, rates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scans(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    # Each state partition of each batch has files of its own: few of them, for small tables.
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = frame(spark, SF, "scans").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(2, "ts").write.mode("overwrite").parquet(path)
    yield rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def drained(df, mode="append", each=None, **trigger):
    writer = df.writeStream.outputMode(mode).trigger(**(trigger or {"availableNow": True})).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    q = (writer.foreachBatch(each) if each else writer.format("memory").queryName("drained")).start()
    q.awaitTermination()
    return None if each else df.sparkSession.table("drained")


def key(rows):
    return sorted(map(str, (r.asDict() for r in rows)))


@pytest.mark.parametrize("make", [rates.per_minute, rates.block_ratio, *(lambda s, late="10 minutes", m=m: rates.alerts_of(s, m, late) for m in (5, 10, 15))])
def test_windows(scans, make):
    batch, stream = scans
    got, want = drained(make(stream, late="3650 days"), "complete").collect(), make(batch).collect()
    assert key(got) == key(want)


def test_once(spark, scans):
    batch, stream = scans
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    batch.unionByName(batch.where("scan_id % 3 = 0")).coalesce(1).write.mode("overwrite").parquet(path)
    twice = spark.readStream.schema(batch.schema).parquet(path)
    assert drained(rates.once(twice, "3650 days")).count() == batch.count()


def test_approvals_follow_the_stream(spark, scans):
    batch, stream = scans
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    drained(stream, each=approvals.Approvals(spark, folder).apply)
    want = {r.digest for r in approve.current_approvals(batch).collect()}
    # Another object, as after a restart, knows what the first one has written.
    held = approvals.Approvals(spark, folder)
    assert {r.digest for r in held.current().collect()} == want and len(held.epochs()) == 2
    before = held.state.count()
    held.apply(batch, 99)  # delivered again
    held.apply(batch, 99)
    assert held.state.count() == before and {r.digest for r in held.current().collect()} == want and held.epochs() == [1, 99]


def test_deny_feed_takes_effect_between_batches(spark, scans):
    _, stream = scans
    seen, feeds = [], []

    def feed():
        feeds.append(1)
        return spark.createDataFrame([], "digest string") if len(feeds) == 1 else frame(spark, SF, "scans").select("digest").distinct()

    drained(stream, each=approvals.denied_in_batch(feed, lambda df, epoch: seen.append(df.count())))
    assert seen[0] == 0 and all(seen[1:]) and len(seen) > 1


def test_token_buckets(spark):
    times = [0, 0, 0, 10, 31, 31]
    rows = spark.createDataFrame([("a", t) for t in times] + [("b", 5)], "client string, s long").select("client", F.timestamp_seconds("s").alias("ts"))
    out = [(r.client, r.allowed, round(r.retry_after, 3)) for r in buckets.limited(rows, per_minute=2).orderBy("client", "ts").collect()]
    assert out == [("a", True, 0.0), ("a", True, 0.0), ("a", False, 30.0), ("a", False, 20.0), ("a", True, 0.0), ("a", False, 29.0), ("b", True, 0.0)]


def test_token_bucket_stream(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 0, 0, 10, 31, 31)], "client string, s long").select("client", F.timestamp_seconds("s").alias("ts"))
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows.coalesce(1).write.mode("overwrite").parquet(path)
    # States that wait for their timeout ask for batch after batch: one is enough.
    got = drained(buckets.limited_stream(spark.readStream.schema(rows.schema).parquet(path), per_minute=2), once=True)
    assert key(got.collect()) == key(buckets.limited(rows, per_minute=2).collect())


def test_approval_rules(spark):
    def row(k, verdict, digest, errors=0):
        return (k, verdict, digest, errors)

    rows = spark.createDataFrame([row(1, "PASS", "1"), row(2, "PASS", "2"), row(3, "FAIL", "2"), row(4, "WARN", "1"), row(5, "ERROR", "1"), row(6, "PASS", "3", 1)], "scan_id long, verdict string, digest string, errors int").withColumn("ts", F.timestamp_seconds("scan_id"))
    assert [r.digest for r in approve.current_approvals(rows).collect()] == ["1"]
    gone = rows.unionByName(spark.createDataFrame([row(7, "BLOCKED", "1")], "scan_id long, verdict string, digest string, errors int").withColumn("ts", F.timestamp_seconds("scan_id")))
    assert approve.current_approvals(gone).isEmpty()
