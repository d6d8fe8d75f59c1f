"""Event-time windows over events. On a table they give what a stream of the same rows gives at its end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from loxodrome.plans.base import Registry, table
from loxodrome.session import scratch_path
from loxodrome.streaming import windows

REGISTRY = Registry()
query = REGISTRY.query


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _out(df):
    return df.withColumn("start", F.unix_seconds("start")).withColumn("end", F.unix_seconds("end"))


def _sums():
    return F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")


@query("""
select epoch_us(ts) // 1000000 // 3600 * 3600 as start, epoch_us(ts) // 1000000 // 3600 * 3600 + 3600 as "end", event_type, count(*) as n, round(sum(value), 4) as total from events group by all
""")
def tumbling(spark, sf_dir):
    return _out(windows.tumbling(_events(spark, sf_dir), "1 hour", ["event_type"], *_sums()))


@query("""
select (epoch_us(ts) // 1000000 // 1800 - i) * 1800 as start, (epoch_us(ts) // 1000000 // 1800 - i) * 1800 + 3600 as "end", event_type, count(*) as n, round(sum(value), 4) as total from events, (values (0), (1)) as t(i) group by all
""")
def sliding(spark, sf_dir):
    return _out(windows.sliding(_events(spark, sf_dir), "1 hour", "30 minutes", ["event_type"], *_sums()))


@query("""
with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts, event_id) as s from g)
select epoch_us(min(ts)) // 1000000 as start, epoch_us(max(ts)) // 1000000 + 21600 as "end", user_id, count(*) as n, round(sum(value), 4) as total from s group by user_id, s
""")
def session(spark, sf_dir):
    return _out(windows.sessions(_events(spark, sf_dir), "6 hours", ["user_id"], *_sums()))


@query("select user_id, event_type from events group by all")
def dedup(spark, sf_dir):
    return windows.deduplicated(_events(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"])


@query("""
select epoch_us(ts) // 1000000 // 86400 * 86400 as start, epoch_us(ts) // 1000000 // 86400 * 86400 + 86400 as "end", event_type, count(*) as n, round(sum(value), 4) as total from events group by all
""")
def stream_tumbling(spark, sf_dir):
    """The events replayed as a stream of files."""
    source = table(spark, sf_dir, "events")
    stream = windows.stream_of(spark, f"{sf_dir}/events.parquet*", source.schema)
    agg = windows.tumbling(windows.watermarked(stream), "1 day", ["event_type"], *_sums())
    return _out(windows.replayed(agg, f"w{uuid.uuid4().hex}", "complete"))


@query("select user_id, count(*) as n, round(sum(value), 4) as total from events group by user_id")
def stream_state(spark, sf_dir):
    """Running totals of a stream by state of its own, at its end."""
    source = table(spark, sf_dir, "events")
    stream = windows.stream_of(spark, f"{sf_dir}/events.parquet*", source.schema)
    out = windows.replayed(windows.running_totals(stream, "user_id", "value"), f"s{uuid.uuid4().hex}", "update")
    last = out.groupBy("user_id").agg(F.max(F.struct("n", "total")).alias("m"))
    return last.select("user_id", F.col("m.n").alias("n"), F.round("m.total", 4).alias("total"))


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type")
def stream_to_database(spark, sf_dir):
    """A stream handed batch by batch to a database table (an embedded one, in a folder of the driver's own), and that table's sums, which the database adds up."""
    source = table(spark, sf_dir, "events")
    name = f"e{uuid.uuid4().hex[:12]}"
    url = f"jdbc:derby:directory:{tempfile.mkdtemp(prefix='loxodrome-')}/{name};create=true"
    stream = windows.stream_of(spark, f"{sf_dir}/events.parquet*", source.schema).select("event_type", "value")
    windows.to_batches(stream, windows.embedded_sink(url, "events"), scratch_path(spark, name), availableNow=True).awaitTermination()
    rows = windows.embedded_rows(spark, url, 'select "event_type", cast(count(*) as bigint), sum("value") from events group by "event_type"')
    return spark.createDataFrame(rows, "event_type string, n bigint, total double").withColumn("total", F.round("total", 4))
