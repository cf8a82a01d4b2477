"""Queries of time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as G
from ..operators import timeline as S
from ..registry import query
from . import domain as D

_START, _STOP = 1_704_067_200 + 1_000, 1_704_067_200 + 40 * 86_400
_SUMS = "sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(requests)::BIGINT AS requests, count(*) AS n"
_MEASURES = ["prompt_tokens", "completion_tokens", "requests"]


def _tumbling(interval: str):
    def run(spark, d):
        u = D.token_use(spark, d)
        return u.groupBy(S.bucket(F.col("created_s"), interval).alias("bucket_s")).agg(*[F.sum(m).cast("long").alias(m) for m in _MEASURES], F.count(F.lit(1)).alias("n"))

    run.__doc__ = f"T14: tumbling buckets of {interval}."
    return run


for _name, _sql in {
    "1min": "created_s // 60 * 60", "5min": "created_s // 300 * 300", "15min": "created_s // 900 * 900", "1h": "created_s // 3600 * 3600", "24h": "created_s // 86400 * 86400",
    "1w": "epoch(date_trunc('week', to_timestamp(created_s) AT TIME ZONE 'UTC'))::BIGINT", "1m": "epoch(date_trunc('month', to_timestamp(created_s) AT TIME ZONE 'UTC'))::BIGINT",
}.items():
    query(D.with_(D.TOKEN_USE) + f"SELECT {_sql} AS bucket_s, {_SUMS} FROM token_use GROUP BY 1", f"time_tumbling_{_name}")(_tumbling(_name))


@query(D.with_(D.TOKEN_USE) + f""", s AS (SELECT unnest(range({_START}, {_STOP}, 3600)) AS bucket_s), u AS (SELECT {_START} + (created_s - {_START}) // 3600 * 3600 AS bucket_s, {_SUMS} FROM token_use WHERE created_s >= {_START} AND created_s < {_STOP} GROUP BY 1)
SELECT s.bucket_s, coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens, coalesce(requests, 0) AS requests, coalesce(n, 0) AS n FROM s LEFT JOIN u USING (bucket_s)""")
def time_anchored_complete(spark, d):
    """Buckets anchored at the range start, zeros in the gaps."""
    return S.timeline(D.token_use(spark, d), "1h", _START, _STOP, _MEASURES)


@query(D.with_(D.TOKEN_USE) + f"SELECT {_START} + (created_s - {_START}) // 604800 * 604800 AS bucket_s, {_SUMS} FROM token_use WHERE created_s >= {_START} AND created_s < {_STOP} GROUP BY 1")
def time_anchored_used(spark, d):
    """Only buckets in use."""
    return S.timeline(D.token_use(spark, d), "1w", _START, _STOP, _MEASURES, complete=False)


@query(D.with_(D.TOKEN_USE) + f""", s AS (SELECT epoch(unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-10', INTERVAL 1 MONTH)))::BIGINT AS bucket_s), u AS (SELECT epoch(date_trunc('month', to_timestamp(created_s) AT TIME ZONE 'UTC'))::BIGINT AS bucket_s, {_SUMS} FROM token_use WHERE created_s >= {_START} AND created_s < {_STOP} GROUP BY 1)
SELECT s.bucket_s, coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens, coalesce(requests, 0) AS requests, coalesce(n, 0) AS n FROM s LEFT JOIN u USING (bucket_s)""")
def time_anchored_months(spark, d):
    """Calendar months."""
    return S.timeline(D.token_use(spark, d), "1m", _START, _STOP, _MEASURES)


@query(D.with_(D.TOKEN_USE) + ", b AS (SELECT created_s // 3600 * 3600 AS bucket_s, sum(total_tokens)::BIGINT AS total FROM token_use GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total, bucket_s) AS k, count(*) OVER () AS n FROM b)\nSELECT bucket_s, total FROM r WHERE k = greatest(1, ceil(n * 0.9)::BIGINT)")
def time_p90_usage(spark, d):
    """The bucket at the nearest rank of 90 %."""
    b = D.token_use(spark, d).groupBy(S.bucket(F.col("created_s"), "1h").alias("bucket_s")).agg(F.sum("total_tokens").alias("total"))
    return G.nearest_rank(b, "total", 0.9, ["bucket_s"])


@query(D.with_(D.TOKEN_USE) + "SELECT job_id, created_s // 600 * 600 AS slot, event_id FROM token_use QUALIFY row_number() OVER (PARTITION BY job_id, created_s // 600 ORDER BY created_s, event_id) = 1")
def time_cadence_slots(spark, d):
    """One sample per job and slot."""
    s = D.token_use(spark, d).select("job_id", "event_id", F.col("created_s").alias("sampled_s"))
    return S.dedupe_slots(s, ["job_id"], 600).select("job_id", F.col("slot").cast("long").alias("slot"), "event_id")


@query(D.with_(D.TOKEN_USE) + """, p(preset, length, width) AS (VALUES ('5m', 300, 30), ('15m', 900, 30), ('1h', 3600, 60), ('24h', 86400, 900), ('3d', 259200, 3600))
SELECT event_id, preset, created_s // width * width - length AS start_s, created_s // width * width AS end_s, width::BIGINT AS width FROM token_use, p""")
def time_aligned_presets(spark, d):
    """Ranges of all presets as seen from each event, ends floored to their bucket."""
    ranges = F.array(*[F.struct(F.lit(p).alias("preset"), *S.aligned_columns(p, F.col("created_s"))) for p in S.PRESETS])
    return D.token_use(spark, d).select("event_id", F.inline(ranges))


@query(D.with_(D.TOKEN_USE) + """, x AS (SELECT created_s // 3600 * 3600 AS bucket_s, created_s, CASE WHEN event_id % 3 = 0 THEN (event_id % 101)::DOUBLE ELSE (event_id % 40) * 100.0 / nullif(event_id % 50, 0) END AS fill, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'behind' WHEN 2 THEN 'ahead' ELSE NULL END AS state, CASE WHEN event_id % 5 > 0 THEN event_type END AS bn FROM token_use),
m AS (SELECT bucket_s, round(min(fill), 4) AS fill_min, round(avg(fill), 4) AS fill_avg, round(max(fill), 4) AS fill_max, CASE max(CASE state WHEN 'behind' THEN 3 WHEN 'ahead' THEN 2 WHEN 'ok' THEN 1 END) WHEN 3 THEN 'behind' WHEN 2 THEN 'ahead' WHEN 1 THEN 'ok' END AS worst_state FROM x GROUP BY 1),
o AS (SELECT bucket_s, bn, count(*) AS n, max(created_s) AS last FROM x WHERE bn IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY bucket_s ORDER BY count(*) DESC, max(created_s) DESC, bn) = 1)
SELECT m.*, o.bn AS bottleneck FROM m LEFT JOIN o USING (bucket_s)""")
def time_utilisation(spark, d):
    """Fill, adherence and bottleneck by bucket."""
    i = F.col("event_id")
    s = D.token_use(spark, d).select(
        F.col("created_s").alias("sampled_s"), F.when(i % 3 == 0, (i % 101).cast("double")).alias("fill_pct"), (i % 40).alias("leased"), (i % 50).cast("double").alias("capacity"),
        F.when(i % 4 == 0, "ok").when(i % 4 == 1, "behind").when(i % 4 == 2, "ahead").alias("state"), F.when(i % 5 > 0, F.col("event_type")).alias("bottleneck"),
    )
    return S.utilisation(s, 3600, {"behind": 3, "ahead": 2, "ok": 1})


@query(D.with_(D.TOKEN_USE) + "SELECT event_id, total_tokens // requests AS per_request FROM token_use ORDER BY total_tokens // requests DESC, event_id LIMIT 5")
def time_largest_requests(spark, d):
    """The five largest single requests."""
    return D.token_use(spark, d).select("event_id", F.floor(F.col("total_tokens") / F.col("requests")).alias("per_request")).orderBy(F.desc("per_request"), "event_id").limit(5)


@query(D.with_(D.TOKEN_USE) + "SELECT job_id, created_s, event_id FROM token_use WHERE failed ORDER BY created_s DESC, event_id DESC LIMIT 10 OFFSET 10")
def time_failed_requests(spark, d):
    """A page of failed requests, latest first."""
    return D.token_use(spark, d).where("failed").select("job_id", "created_s", "event_id").orderBy(F.desc("created_s"), F.desc("event_id")).offset(10).limit(10)
