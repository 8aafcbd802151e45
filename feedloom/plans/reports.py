"""Operational reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom import vocab
from feedloom.functions import scores as sc
from feedloom.functions import text as tx
from feedloom.operators import filters as fl
from feedloom.operators.order_stats import exact_quantiles

c = F.col
HOUR_US = 3_600_000_000


def _age(ts: Column, as_of: Column, unit_us: int) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(float(unit_us))


def queue_ages(items: DataFrame, as_of: Column, quantiles: list[float]) -> list[float | None]:
    """Quantiles of the seconds that items under way have waited."""
    return exact_quantiles(items.where(c("status").isin(*vocab.IN_FLIGHT)), _age(c("created_at"), as_of, 1_000_000), quantiles)


def sla_percentiles(items: DataFrame, *, as_of: Column, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(quantile, queue_age_seconds), all from the same passes."""
    values = queue_ages(items, as_of, list(quantiles))
    return items.sparkSession.createDataFrame(list(zip(map(float, quantiles), values)), "quantile double, queue_age_seconds double")


def sla(items: DataFrame, sources: DataFrame, *, as_of: Column) -> DataFrame:
    """Freshness and source health in one row: one pass over each table, and a few for the exact median queue age."""
    made, done = c("created_at"), fl.processed()
    a = items.agg(
        sc.stable(_age(F.max(F.when(done, made)), as_of, HOUR_US)).alias("newest_item_age_hours"),
        F.count_if(done & fl.recent(as_of, 1, made)).alias("items_last_24h"),
        F.count_if(done & fl.recent(as_of, 7, made)).alias("items_last_7d"),
        F.count_if((c("status") == "failed") & fl.recent(as_of, 1, made)).alias("failed_items_last_24h"),
    )
    a = a.withColumn("queue_age_seconds", F.lit(queue_ages(items, as_of, [0.5])[0]).cast("double"))
    h = sources.agg(
        F.count_if(c("is_active") & (c("consecutive_errors") == 0)).alias("healthy"),
        F.count_if(c("consecutive_errors") >= 3).alias("degraded"), F.count_if(~c("is_active")).alias("dead"),
        F.count(F.lit(1)).alias("total"),
    )
    row = h.select(F.struct("healthy", "degraded", "dead", "total").alias("h")).scalar()
    out = a.withColumn("h", row).select("*", "h.*").drop("h")
    return out.withColumn("coverage_score", F.when(c("total") > 0, sc.stable(c("healthy") / c("total"))).otherwise(0.0))


def status_summary(items: DataFrame, sources: DataFrame, *, as_of: Column) -> DataFrame:
    s = sources.agg(
        F.count(F.lit(1)).alias("total_sources"), F.count_if("is_active").alias("active_sources"),
        F.count_if(c("consecutive_errors") > 0).alias("erroring_sources"),
    )
    newest = items.where(fl.processed()).agg(F.max("created_at").alias("m")).scalar()
    late = newest.isNull() | (newest < fl.days_back(as_of, 1))
    return s.withColumn("health", F.when(late, F.lit("degraded")).otherwise(F.lit("healthy")))


def source_type_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def erroring_sources(sources: DataFrame, *, min_errors: int = 3, limit: int = 20) -> DataFrame:
    rows = sources.where(c("is_active") & (c("consecutive_errors") > min_errors))
    return rows.select("id", "name", "type", "consecutive_errors", "last_successful_poll").orderBy(
        F.desc("consecutive_errors"), "id"
    ).limit(limit)


def stale_sources(sources: DataFrame, *, as_of: Column, days: int = 7, limit: int = 20) -> DataFrame:
    last = c("last_successful_poll")
    rows = sources.where(c("is_active") & (last.isNull() | (last < fl.days_back(as_of, days))))
    return rows.select("id", "name", "type", "last_successful_poll").orderBy(
        last.asc_nulls_first(), "id"
    ).limit(limit)


def top_producers(sources: DataFrame, items: DataFrame, *, as_of: Column, days: int = 7, limit: int = 5) -> DataFrame:
    n = items.where(c("created_at") > fl.days_back(as_of, days)).groupBy("source_id").agg(F.count(F.lit(1)).alias("item_count"))
    j = n.join(sources.select(c("id").alias("source_id"), "name", "type"), "source_id")
    return j.orderBy(F.desc("item_count"), "source_id").limit(limit)


def source_health_counts(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count_if(~c("is_active")).alias("dead"), F.count_if("is_active").alias("active"))


def digest_top_items(items: DataFrame, *, as_of: Column, limit: int = 5) -> DataFrame:
    rows = items.where(fl.processed() & (c("created_at") > fl.days_back(as_of, 1)))
    sig = c("significance")
    sev = F.when(sig == "breaking", 1).when(sig == "major", 2).when(sig == "moderate", 3).otherwise(4)
    return rows.select("id", "title", "url", "significance", "quality_score", "source_name", "primary_type", sev.alias("severity")).orderBy(
        "severity", F.desc("quality_score"), "id"
    ).limit(limit)


def digest_new_sources(sources: DataFrame, *, as_of: Column) -> DataFrame:
    return sources.where(c("created_at") > fl.days_back(as_of, 1)).select("id", "name", "type")


def digest_status_counts(items: DataFrame, *, as_of: Column) -> DataFrame:
    return items.where(c("created_at") > fl.days_back(as_of, 1)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def digest_quality(items: DataFrame, *, as_of: Column, low: float = 0.3) -> DataFrame:
    return items.where(fl.processed() & (c("created_at") > fl.days_back(as_of, 1))).agg(
        F.coalesce(sc.half_up(F.avg("quality_score"), 2), F.lit(0.0)).alias("avg_quality"),
        F.count_if(c("quality_score") < low).alias("low_quality_count"), F.count(F.lit(1)).alias("total_processed"),
    )


def user_activity(users: DataFrame, keys: DataFrame, items: DataFrame, *, as_of: Column) -> DataFrame:
    used = c("last_used_at") >= fl.days_back(as_of, 1)
    u = users.agg(F.count_if("is_active").alias("active_users"), F.count(F.lit(1)).alias("total_users"))
    k = keys.agg(
        F.struct(
            F.sum("usage_count").alias("total_requests"),
            F.countDistinct(F.when(used, c("user_id"))).alias("users_active_24h"),
            F.coalesce(F.sum(F.when(used, c("usage_count"))), F.lit(0)).alias("requests_24h"),
        ).alias("k")
    ).scalar()
    i = items.agg(
        F.struct(
            F.count_if(fl.processed()).alias("total_items"),
            F.count_if(c("created_at") >= fl.days_back(as_of, 1)).alias("items_24h"),
        ).alias("i")
    ).scalar()
    return u.withColumn("k", k).withColumn("i", i).select("active_users", "total_users", "k.*", "i.*")


def top_users(users: DataFrame, keys: DataFrame, *, as_of: Column, limit: int = 5) -> DataFrame:
    """Busiest users of the last day, addresses masked."""
    per_user = keys.where(c("last_used_at") >= fl.days_back(as_of, 1)).groupBy("user_id").agg(
        F.sum("usage_count").alias("requests"), F.max("last_used_at").alias("last_active")
    )
    j = per_user.join(users.select(c("id").alias("user_id"), "email"), "user_id")
    # users without an address form one group, like any other address
    g = j.groupBy("email").agg(F.sum("requests").alias("requests"), F.max("last_active").alias("last_active"))
    page = g.orderBy(F.desc("requests"), c("email").asc_nulls_first()).limit(limit)
    return page.select(tx.mask_email(F.coalesce("email", F.lit("anon"))).alias("user"), "requests", "last_active")


def new_users(users: DataFrame, *, as_of: Column) -> DataFrame:
    return users.where(c("created_at") >= fl.days_back(as_of, 1)).select("id", tx.mask_email(c("email")).alias("user"))


def user_usage(users: DataFrame, keys: DataFrame) -> DataFrame:
    k = keys.where("is_active").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("key_count"), F.sum("usage_count").alias("usage"), F.max("last_used_at").alias("last_used")
    )
    j = users.join(k, c("id") == c("user_id"), "left").drop("user_id")
    return j.select(
        "id", "email", F.coalesce("key_count", F.lit(0)).alias("key_count"), F.coalesce("usage", F.lit(0)).alias("usage"), "last_used"
    )


def coverage_gaps(feedback: DataFrame, *, as_of: Column, days: int = 7, min_count: int = 3) -> DataFrame:
    """Queries that often found nothing; notes are JSON with a query, or plain text."""
    rows = feedback.where((c("report_type") == "auto_miss") & (c("created_at") > fl.days_back(as_of, days)))
    # an object without a query asked for nothing; anything that is no JSON object is the query itself
    is_object = F.from_json("notes", "map<string,string>")
    query = F.when(F.ltrim(c("notes")).startswith("{") & is_object.isNotNull(), F.get_json_object("notes", "$.query")).otherwise(c("notes"))
    keyword = F.trim(F.lower(query))
    g = rows.select(keyword.alias("keyword")).where(c("keyword") != "").groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    return g.where(c("n") >= min_count)


def growth_forecast(
    items: DataFrame, *, as_of: Column, limit_bytes: int, size: Column | None = None, warn_pct: float = 80.0,
    critical_pct: float = 90.0,
) -> DataFrame:
    size = F.length(F.coalesce("content", F.lit(""))).cast("long") if size is None else size
    a = items.agg(
        F.count(F.lit(1)).alias("total_items"), F.count_if(c("created_at") > fl.days_back(as_of, 7)).alias("recent_items"),
        F.sum(size).alias("current_bytes"),
    )
    left = F.lit(limit_bytes) - c("current_bytes")
    daily = c("recent_items") * (c("current_bytes") / c("total_items")) / 7.0
    days = F.when((c("recent_items") > 0) & (left > 0), F.floor(left / F.nullif(daily, F.lit(0.0))))
    pct = c("current_bytes") / F.lit(float(limit_bytes)) * 100.0
    level = F.when(pct >= critical_pct, "critical").when(pct >= warn_pct, "warn").otherwise("ok")
    return a.select("*", sc.stable(pct, 4).alias("pct"), days.alias("days_until_full"), level.alias("level"))


def alert_status(rules: DataFrame, deliveries: DataFrame, *, as_of: Column) -> DataFrame:
    last = deliveries.groupBy("alert_rule_id").agg(F.max("delivered_at").alias("last_fired_at"))
    j = rules.where("is_active").join(last, c("id") == c("alert_rule_id"), "left")
    until = F.timestamp_micros(F.unix_micros("last_fired_at") + c("cooldown_minutes").cast("long") * 60_000_000)
    return j.select("id", "last_fired_at", F.coalesce(as_of < until, F.lit(False)).alias("on_cooldown"))


def query_log_report(logs: DataFrame) -> DataFrame:
    day = F.date_trunc("day", c("created_at"))
    return logs.groupBy("query_type", day.alias("day")).agg(
        F.count(F.lit(1)).alias("queries"), sc.stable(F.avg("result_count"), 4).alias("mean_results"),
        F.count_if(c("result_count") == 0).alias("empty"),
    )


def query_log_by_key(logs: DataFrame) -> DataFrame:
    return logs.groupBy("api_key_id").agg(
        F.count(F.lit(1)).alias("queries"), sc.stable(F.avg("result_count"), 4).alias("mean_results")
    )


def eval_set_checks(
    rows: DataFrame, *, expected_count: int, min_per_type: int = 30, types=vocab.PRIMARY_TYPES
) -> DataFrame:
    """One (check, passed, detail) row per rule a labelled set of (url, title, content, expected_type, expected_tags) must keep."""
    blank = fl.any_of(*[F.trim(F.coalesce(c(k), F.lit(""))) == "" for k in ("url", "title", "content")])
    per_type = {t: F.count_if(c("expected_type") == t) for t in types}
    a = rows.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"), F.count_if(blank).alias("blank"),
        F.count_if(~F.coalesce(c("expected_type").isin(*types), F.lit(False))).alias("bad_type"),
        F.count_if(c("expected_tags").isNull()).alias("no_tags"), F.least(*per_type.values()).alias("rarest"),
    )
    checks = [
        ("count", c("n") == expected_count, c("n")), ("unique_urls", c("urls") == c("n"), c("urls")),
        ("required_fields", c("blank") == 0, c("blank")), ("valid_types", c("bad_type") == 0, c("bad_type")),
        ("tags_are_lists", c("no_tags") == 0, c("no_tags")), ("min_per_type", c("rarest") >= min_per_type, c("rarest")),
    ]
    packed = F.array(*[
        F.struct(F.lit(n).alias("check"), p.alias("passed"), d.cast("long").alias("detail")) for n, p, d in checks
    ])
    return a.select(F.explode(packed).alias("r")).select("r.*")
