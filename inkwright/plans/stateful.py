"""Queries whose state depends on their own decisions."""

from pyspark.sql import functions as F

from inkwright.operators.folds import Progress
from inkwright.operators.ordered import stream_by_key
from inkwright.operators.scale import scratch
from inkwright.plans.registry import CORE
from inkwright.sources.tables import table, table_stream
from inkwright.streaming.rate_limit import decide, decide_stream


def seconds(c):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000


LIMIT_SQL = """with recursive e as (select user_id, event_id, epoch_us(ts) / 1000000.0::double as t, row_number() over (partition by user_id order by ts, event_id) as n from events where user_id is not null and ts is not null),
r(user_id, n, event_id, allowed, wait, day, week) as (select user_id, n, event_id, true, 0, [t], [t] from e where n = 1
  union all select user_id, n, event_id, len(d) < 3 and len(w) < 12, cast(case when len(d) >= 3 then greatest(floor(86400 - (t - d[1])) + 1, 1) when len(w) >= 12 then greatest(floor(604800 - (t - w[1])) + 1, 1) else 0 end as int),
    case when len(d) < 3 and len(w) < 12 then list_append(d, t) else d end, case when len(d) < 3 and len(w) < 12 then list_append(w, t) else w end
  from (select e.user_id, e.n, e.event_id, e.t, list_filter(r.day, lambda x: x > e.t - 86400) as d, list_filter(r.week, lambda x: x > e.t - 604800) as w from r join e on e.user_id = r.user_id and e.n = r.n + 1))
select user_id, event_id, allowed, wait from r"""


@CORE.query("rate_limit_batch", LIMIT_SQL)
def rate_limit_batch(spark, sf_dir):
    """Which requests of each user are let through: 3 a day, 12 a week; one that is refused doesn't count later."""
    return decide(table(spark, sf_dir, "events").select("user_id", "event_id", seconds("ts").alias("t")))


@CORE.query("rate_limit_stream", LIMIT_SQL)
def rate_limit_stream(spark, sf_dir):
    """The same from a stream of the table's files, run until all that is there is read."""
    e = table_stream(spark, sf_dir, "events")
    out, check = scratch(spark, "decisions"), scratch(spark, "decisions-state")
    q = decide_stream(e.select("user_id", "event_id", seconds("ts").alias("t"))).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("user_id long, event_id long, allowed boolean, wait int").parquet(out)


@CORE.query("progress_throttle_eta", """with recursive s as (select distinct paper_id, epoch_us(updated_at) / 1000000.0::double as t, progress from translation_jobs where paper_id is not null and updated_at is not null and progress is not null),
e as (select paper_id, t, least(1.0, greatest(0.0, progress / 100)) as share, row_number() over (partition by paper_id order by t, progress) as n from s),
r(paper_id, n, t, share, shown, seconds_left, last, rate, s0, t0, begun) as (select paper_id, 0::bigint, t, 0.0::double, false, 0::bigint, 0.0::double, 0.0::double, 0.0::double, t, t from e where n = 1
  union all select paper_id, n, t, share, shown, cast(case when shown and share > 0 and share < 1 and speed > 0 then greatest(0, floor((1 - share) / speed)) else 0 end as bigint), case when shown then share else last end, rate2, case when moves then share else s0 end, case when moves then t else t0 end, begun
  from (select *, case when rate2 > 0 then rate2 when t > begun then share / (t - begun) else 0 end as speed from (select *, case when moves then case when rate <= 0 then (share - s0) / greatest(0, t - t0) else rate * 0.65 + (share - s0) / greatest(0, t - t0) * 0.35 end else rate end as rate2
    from (select e.paper_id, e.n, e.t, e.share, r.last, r.rate, r.s0, r.t0, r.begun, not (e.share - r.last < 0.01 and e.share < 1) as shown, not (e.share - r.last < 0.01 and e.share < 1) and e.share > 0 and e.share < 1 and e.share - r.s0 > 0 and greatest(0, e.t - r.t0) >= 0.5 as moves from r join e on e.paper_id = r.paper_id and e.n = r.n + 1))))
select paper_id, t, round(share, 6) as share, seconds_left from r where shown""")
def progress_throttle_eta(spark, sf_dir):
    """The states of each paper's jobs as samples of its progress: those that are reported, with the time left."""
    j = table(spark, sf_dir, "translation_jobs", "paper_id", "updated_at", "progress").dropna().distinct()

    def start(paper):
        progress = Progress()
        return lambda r: [(paper, t, round(share, 6), left) for t, share, left in progress.offer(r.t, r.progress / 100)]

    samples = j.select("paper_id", seconds("updated_at").alias("t"), "progress")
    return stream_by_key(samples, "paper_id", ["t", "progress"], "paper_id string, t double, share double, seconds_left long", start)
