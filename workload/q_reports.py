"""Operational reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.plans import reports as rp
from feedloom.plans import spend as sp
from workload.adapter import Tables, as_of
from workload.oracle import AS_OF, AS_OF_US, half_up, sql, ts_text
from workload.q_insight import ts
from workload.registry import query

c = F.col


@query(
    "sla_percentiles", "Q20 A14",
    sql("items", f"""SELECT q AS quantile, round(v, 6) AS queue_age_seconds FROM (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS q,
      unnest(quantile_cont(({AS_OF_US} - epoch_us(created_at))::DOUBLE / 1000000, [0.5, 0.95, 0.99]) FILTER (status IN ('raw','embedded','queued','processing'))) AS v FROM items)"""),
)
def _(t: Tables):
    return rp.sla_percentiles(t.items(), as_of=as_of()).select("quantile", F.round("queue_age_seconds", 6).alias("queue_age_seconds"))


@query(
    "sla", "Q20 A14",
    sql("items sources", f"""SELECT * FROM (SELECT round(({AS_OF_US} - epoch_us(max(created_at) FILTER (status = 'processed')))::DOUBLE / 3600000000, 6) AS newest_item_age_hours,
      count(*) FILTER (status = 'processed' AND created_at >= {AS_OF} - INTERVAL 24 HOUR) AS items_last_24h,
      count(*) FILTER (status = 'processed' AND created_at >= {AS_OF} - INTERVAL 7 DAY) AS items_last_7d,
      count(*) FILTER (status = 'failed' AND created_at >= {AS_OF} - INTERVAL 24 HOUR) AS failed_items_last_24h,
      quantile_cont(({AS_OF_US} - epoch_us(created_at))::DOUBLE / 1000000, 0.5) FILTER (status IN ('raw','embedded','queued','processing')) AS queue_age_seconds FROM items),
      (SELECT count(*) FILTER (is_active AND consecutive_errors = 0) AS healthy, count(*) FILTER (consecutive_errors >= 3) AS degraded,
        count(*) FILTER (NOT is_active) AS dead, count(*) AS total,
        round(count(*) FILTER (is_active AND consecutive_errors = 0)::DOUBLE / count(*), 6) AS coverage_score FROM sources)"""),
)
def _(t: Tables):
    return rp.sla(t.items(), t.sources(), as_of=as_of())


@query(
    "status_summary", "Q20 A15",
    sql("items sources", f"""SELECT count(*) AS total_sources, count(*) FILTER (is_active) AS active_sources, count(*) FILTER (consecutive_errors > 0) AS erroring_sources,
      CASE WHEN coalesce((SELECT max(created_at) FROM items WHERE status = 'processed') < {AS_OF} - INTERVAL 24 HOUR, true) THEN 'degraded' ELSE 'healthy' END AS health FROM sources"""),
)
def _(t: Tables):
    return rp.status_summary(t.items(), t.sources(), as_of=as_of())


@query("source_type_counts", "A15", sql("sources", "SELECT type, count(*) AS n FROM sources GROUP BY 1"))
def _(t: Tables):
    return rp.source_type_counts(t.sources())


@query(
    "report_erroring_sources", "Q21 A16",
    sql("sources", f"SELECT id, name, type, consecutive_errors, {ts_text('last_successful_poll')} AS last_successful_poll FROM sources WHERE is_active AND consecutive_errors > 3 ORDER BY consecutive_errors DESC, id LIMIT 20"),
)
def _(t: Tables):
    return rp.erroring_sources(t.sources()).withColumn("last_successful_poll", ts("last_successful_poll"))


@query(
    "report_stale_sources", "Q21 A16",
    sql("sources", f"SELECT id, name, type, {ts_text('last_successful_poll')} AS last_successful_poll FROM sources WHERE is_active AND (last_successful_poll < {AS_OF} - INTERVAL 7 DAY OR last_successful_poll IS NULL) ORDER BY last_successful_poll NULLS FIRST, id LIMIT 20"),
)
def _(t: Tables):
    return rp.stale_sources(t.sources(), as_of=as_of()).withColumn("last_successful_poll", ts("last_successful_poll"))


@query(
    "report_top_producers", "Q21 A16",
    sql("items sources", f"""SELECT i.source_id, s.name, s.type, count(*) AS item_count FROM items i JOIN sources s ON s.id = i.source_id
      WHERE i.created_at > {AS_OF} - INTERVAL 7 DAY GROUP BY 1, 2, 3 ORDER BY item_count DESC, i.source_id LIMIT 5"""),
)
def _(t: Tables):
    return rp.top_producers(t.sources(), t.items(), as_of=as_of())


@query("report_source_counts", "Q21 A16", sql("sources", "SELECT count(*) FILTER (NOT is_active) AS dead, count(*) FILTER (is_active) AS active FROM sources"))
def _(t: Tables):
    return rp.source_health_counts(t.sources())


@query(
    "daily_digest_top", "Q21 A17",
    sql("items", f"""SELECT id, significance, quality_score, source_name, CASE significance WHEN 'breaking' THEN 1 WHEN 'major' THEN 2 WHEN 'moderate' THEN 3 ELSE 4 END AS severity
      FROM items WHERE status = 'processed' AND created_at > {AS_OF} - INTERVAL 24 HOUR ORDER BY severity, quality_score DESC, id LIMIT 5"""),
)
def _(t: Tables):
    return rp.digest_top_items(t.items(), as_of=as_of()).select("id", "significance", "quality_score", "source_name", "severity")


@query("daily_digest_new_sources", "Q21 A17", sql("sources", f"SELECT id, name, type FROM sources WHERE created_at > {AS_OF} - INTERVAL 24 HOUR"))
def _(t: Tables):
    return rp.digest_new_sources(t.sources(), as_of=as_of())


@query("daily_digest_status", "Q21 A17", sql("items", f"SELECT status, count(*) AS n FROM items WHERE created_at > {AS_OF} - INTERVAL 24 HOUR GROUP BY 1"))
def _(t: Tables):
    return rp.digest_status_counts(t.items(), as_of=as_of())


@query(
    "daily_digest_quality", "Q21 A17",
    sql("items", f"""SELECT coalesce({half_up('avg(quality_score)', 2)}, 0) AS avg_quality, count(*) FILTER (quality_score < 0.3) AS low_quality_count,
      count(*) AS total_processed FROM items WHERE status = 'processed' AND created_at > {AS_OF} - INTERVAL 24 HOUR"""),
)
def _(t: Tables):
    return rp.digest_quality(t.items(), as_of=as_of())


@query(
    "user_activity", "Q21 A18",
    sql("users api_keys items", f"""SELECT (SELECT count(*) FROM users WHERE is_active) AS active_users, (SELECT count(*) FROM users) AS total_users,
      (SELECT CAST(sum(usage_count) AS BIGINT) FROM api_keys) AS total_requests,
      (SELECT count(DISTINCT user_id) FROM api_keys WHERE last_used_at >= {AS_OF} - INTERVAL 24 HOUR) AS users_active_24h,
      (SELECT CAST(coalesce(sum(usage_count), 0) AS BIGINT) FROM api_keys WHERE last_used_at >= {AS_OF} - INTERVAL 24 HOUR) AS requests_24h,
      (SELECT count(*) FROM items WHERE status = 'processed') AS total_items, (SELECT count(*) FROM items WHERE created_at >= {AS_OF} - INTERVAL 24 HOUR) AS items_24h"""),
)
def _(t: Tables):
    return rp.user_activity(t.users(), t.api_keys(), t.items(), as_of=as_of())


@query(
    "top_users", "Q21 A18 F48",
    sql("users api_keys", f"""SELECT CASE WHEN length(e) > 3 THEN substr(e, 1, 3) || '***' ELSE '***' END AS "user", requests, {ts_text('last_active')} AS last_active FROM (
      SELECT coalesce(email, 'anon') AS e, CAST(sum(usage_count) AS BIGINT) AS requests, max(last_used_at) AS last_active FROM users u JOIN
      (SELECT * FROM api_keys WHERE last_used_at >= {AS_OF} - INTERVAL 24 HOUR) k ON k.user_id = u.id GROUP BY email ORDER BY requests DESC, email NULLS FIRST LIMIT 5)"""),
)
def _(t: Tables):
    return rp.top_users(t.users(), t.api_keys(), as_of=as_of()).withColumn("last_active", ts("last_active"))


@query(
    "new_users", "Q21 A18",
    sql("users", f"SELECT id, CASE WHEN length(email) > 3 THEN substr(email, 1, 3) || '***' ELSE '***' END AS \"user\" FROM users WHERE created_at >= {AS_OF} - INTERVAL 24 HOUR"),
)
def _(t: Tables):
    return rp.new_users(t.users(), as_of=as_of())


@query(
    "user_usage", "A19 J18",
    sql("users api_keys", f"""SELECT u.id, u.email, count(k.id) AS key_count, CAST(coalesce(sum(k.usage_count), 0) AS BIGINT) AS usage, {ts_text('max(k.last_used_at)')} AS last_used
      FROM users u LEFT JOIN api_keys k ON k.user_id = u.id AND k.is_active GROUP BY u.id, u.email"""),
)
def _(t: Tables):
    return rp.user_usage(t.users(), t.api_keys()).withColumn("last_used", ts("last_used"))


@query(
    "coverage_gaps", "Q21 A20",
    sql("feedback", f"""SELECT keyword, count(*) AS n FROM (SELECT trim(lower(CASE WHEN starts_with(notes, '{{') THEN json_extract_string(notes, '$.query') ELSE notes END)) AS keyword
      FROM feedback WHERE created_at > {AS_OF} - INTERVAL 7 DAY) WHERE keyword <> '' GROUP BY 1 HAVING count(*) >= 3"""),
)
def _(t: Tables):
    return rp.coverage_gaps(t.feedback(), as_of=as_of())


@query(
    "growth_forecast", "Q21 A21",
    sql("items", f"""SELECT total_items, recent_items, current_bytes, round(current_bytes / 10000000.0::DOUBLE * 100, 4) AS pct,
      CASE WHEN recent_items > 0 AND current_bytes < 10000000 THEN CAST(floor((10000000 - current_bytes) / (recent_items * (current_bytes::DOUBLE / total_items) / 7)) AS BIGINT) END AS days_until_full,
      CASE WHEN current_bytes / 10000000.0::DOUBLE * 100 >= 90 THEN 'critical' WHEN current_bytes / 10000000.0::DOUBLE * 100 >= 80 THEN 'warn' ELSE 'ok' END AS level
      FROM (SELECT count(*) AS total_items, count(*) FILTER (created_at > {AS_OF} - INTERVAL 7 DAY) AS recent_items, CAST(sum(length(content)) AS BIGINT) AS current_bytes FROM items)"""),
)
def _(t: Tables):
    return rp.growth_forecast(t.items(), as_of=as_of(), limit_bytes=10_000_000)


@query(
    "query_log_report", "A33",
    sql("query_logs", """SELECT query_type, strftime(date_trunc('day', created_at), '%Y-%m-%d %H:%M:%S') AS day, count(*) AS queries, round(avg(result_count), 4) AS mean_results,
      count(*) FILTER (result_count = 0) AS empty FROM query_logs GROUP BY 1, 2"""),
)
def _(t: Tables):
    return rp.query_log_report(t.query_logs()).withColumn("day", ts("day"))


@query("query_log_by_key", "A33", sql("query_logs", "SELECT api_key_id, count(*) AS queries, round(avg(result_count), 4) AS mean_results FROM query_logs GROUP BY 1"))
def _(t: Tables):
    return rp.query_log_by_key(t.query_logs())


@query(
    "eval_set_checks", "A32",
    sql("items", """SELECT r.c AS "check", r.p AS passed, r.d AS detail FROM (SELECT unnest([
      {'c': 'count', 'p': n = 200, 'd': n}, {'c': 'unique_urls', 'p': urls = n, 'd': urls}, {'c': 'required_fields', 'p': blank = 0, 'd': blank},
      {'c': 'valid_types', 'p': bad = 0, 'd': bad}, {'c': 'tags_are_lists', 'p': no_tags = 0, 'd': no_tags}, {'c': 'min_per_type', 'p': rarest >= 30, 'd': rarest}]) AS r
      FROM (SELECT count(*) AS n, count(DISTINCT url) AS urls, count(*) FILTER (trim(title) = '' OR trim(content) = '' OR trim(url) = '') AS blank, 0::BIGINT AS bad,
        count(*) FILTER (tags IS NULL) AS no_tags, least(count(*) FILTER (primary_type = 'skill'), count(*) FILTER (primary_type = 'tool'), count(*) FILTER (primary_type = 'update'),
        count(*) FILTER (primary_type = 'practice'), count(*) FILTER (primary_type = 'docs')) AS rarest FROM items))"""),
)
def _(t: Tables):
    rows = t.items().select("url", "title", "content", c("primary_type").alias("expected_type"), c("tags").alias("expected_tags"))
    return rp.eval_set_checks(rows, expected_count=200)


LEDGER = """l AS (SELECT *, CAST(date_trunc('day', ts) AS DATE) AS day, CASE WHEN c0 = 0 AND cost > 0 THEN 1 ELSE c0 END AS cents FROM
  (SELECT *, CAST(round_even(cost * 100, 0) AS BIGINT) AS c0 FROM (SELECT *, (in_tokens * CASE model WHEN 'haiku' THEN 1.00::DOUBLE ELSE 0.15::DOUBLE END
   + out_tokens * CASE model WHEN 'haiku' THEN 5.00::DOUBLE ELSE 0.60::DOUBLE END) / 1000000 AS cost FROM spend)))"""


@query(
    "spend_by_day", "A22 F51",
    sql("spend", """SELECT strftime(day, '%Y-%m-%d') AS day, CAST(sum(cents) AS BIGINT) AS spent_cents, count(*) AS calls,
      CAST(greatest(0, 25 - sum(cents)) AS BIGINT) AS remaining_cents, sum(cents) >= 25 AS limit_reached FROM l GROUP BY day""", LEDGER),
)
def _(t: Tables):
    out = sp.spend_by_day(sp.ledger(t.spend(), sp.price_table(t.spark)), limit_cents=25)
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "spend_by_user", "A22",
    sql("spend", "SELECT strftime(day, '%Y-%m-%d') AS day, user_id, CAST(sum(cents) AS BIGINT) AS spent_cents, count(*) AS calls FROM l GROUP BY day, user_id", LEDGER),
)
def _(t: Tables):
    return sp.spend_by_user(sp.ledger(t.spend(), sp.price_table(t.spark))).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "spend_first_breach", "A22",
    sql("spend", """SELECT strftime(day, '%Y-%m-%d') AS day, min(call_id) AS call_id, min(run) AS running_cents FROM
      (SELECT day, call_id, CAST(sum(cents) OVER (PARTITION BY day ORDER BY call_id) AS BIGINT) AS run FROM l) WHERE run > 25 GROUP BY day""", LEDGER),
)
def _(t: Tables):
    entries = sp.ledger(t.spend(), sp.price_table(t.spark))
    out = sp.first_breach(entries, limit_cents=25, bucket=F.floor(c("call_id") / 10_000))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
