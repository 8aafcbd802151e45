"""Structured Streaming twins. State is keyed and small; every sink is a file table, so a replayed batch is harmless."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from feedloom import vocab
from feedloom.functions import text as tx
from feedloom.functions import urls as ux
from feedloom.operators import filters as fl
from feedloom.plans import dedup as dd
from feedloom.plans.alerts import active_keywords, cooldown_seconds, keyword_finder
from feedloom.session import cut_lineage, ensure_checkpoint_dir
from feedloom.sources.history import KeyedHistory

c = F.col


# ---- running -----------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, *, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available into a file table and return it."""
    spark = stream.sparkSession
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


# ---- ingest ------------------------------------------------------------------------------


def dedup_stream(rows: DataFrame, *, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First row per key; a key is forgotten once the watermark has passed it by ``delay``."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def dedup_landed(rows: DataFrame, *, delay: str = "7 days") -> DataFrame:
    return dedup_stream(rows.withColumn("url_hash", ux.url_hash(c("url"))), keys=["url_hash"], ts="created_at", delay=delay)


def replay_guard(messages: DataFrame, *, ts: str = "received_at", ttl: str = "5 minutes") -> DataFrame:
    """Mail tokens seen within the last minutes are dropped."""
    return dedup_stream(messages, keys=["token"], ts=ts, delay=ttl)


def append_unseen(path: str, key: Callable[[Column], Column] = ux.url_hash) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler: rows whose key the whole history does not have yet are added to it.

    The batch writes to its own folder, named by its number, and history excludes that folder: running a batch again
    after a failure overwrites its own output instead of dropping it.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        b = batch.withColumn("url_key", key(c("url")))
        row = F.struct(*[c(x) for x in b.columns])
        first = b.groupBy("url_key").agg(F.min_by(row, F.struct("created_at", "id")).alias("r")).select("r.*")
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(root):
            known = spark.read.option("basePath", path).schema(b.schema.add("batch", "long")).parquet(path)
            first = first.join(known.where(c("batch") != batch_id).select("url_key").distinct(), "url_key", "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def append_unseen_keys(history: KeyedHistory, path: str, key: Callable[[Column], Column] = ux.url_hash) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler as ``append_unseen``, on a bucketed history: a batch opens only the key files whose filter may
    hold one of its keys. Rows without a key are added as they are. Rows are written before their keys are committed, so
    a batch that failed half way writes the same rows again."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        b = cut_lineage(batch.withColumn("key", key(c("url"))))
        row = F.struct(*[c(x) for x in b.columns])
        first = b.where(c("key").isNotNull()).groupBy("key").agg(F.min_by(row, F.struct("created_at", "id")).alias("r")).select("r.*")
        new = first.join(history.known(b.select("key").where(c("key").isNotNull()), skip=batch_id), "key", "left_anti")
        target = f"{path}/batch={batch_id}"
        new.select(*b.columns).unionByName(b.where(c("key").isNull())).write.mode("overwrite").parquet(target)
        history.add(b.sparkSession.read.schema(b.schema).parquet(target).select("key").where(c("key").isNotNull()), batch_id)

    return handle


def append_new_items(history: KeyedHistory, path: str, *, as_of: Column, **settings) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler: items that repeat no url and no text of the history or of their batch are added to it."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        b = cut_lineage(batch)
        new = dd.dedup_items(b, b.where(F.lit(False)), as_of=as_of, vectors=False, history=history, skip=batch_id, **settings)
        target = f"{path}/batch={batch_id}"
        new.where(c("reason").isNull()).drop("reason").write.mode("overwrite").parquet(target)
        history.add(dd.history_keys(b.sparkSession.read.schema(b.schema).parquet(target)), batch_id)

    return handle


def drain_batches(stream: DataFrame, handle, *, checkpoint: str) -> None:
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def split_late(rows: DataFrame, marks: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    """(on time, late): late rows are not newer than their source's watermark (source_id, last_poll_ts in seconds)."""
    j = rows.join(marks.select("source_id", c("last_poll_ts").alias("_mark")), "source_id", "left")
    late = F.coalesce(F.unix_seconds(ts) <= c("_mark"), F.lit(False))
    return j.where(~late).drop("_mark"), j.where(late).drop("_mark")


def advance_watermarks(marks: DataFrame, rows: DataFrame, ts: str) -> DataFrame:
    new = rows.groupBy("source_id").agg(F.max(F.unix_seconds(ts)).alias("last_poll_ts"))
    return marks.select("source_id", "last_poll_ts").unionByName(new).groupBy("source_id").agg(F.max("last_poll_ts").alias("last_poll_ts"))


# ---- alerts ------------------------------------------------------------------------------


def _cooldown_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps one number per rule: the first second it may fire again."""
    first: dict[int, tuple] = {}
    wait = 0
    for pdf in batches:
        # one candidate per second is enough, whatever the batch holds
        pdf = pdf.sort_values(["ts", "item_id"]).drop_duplicates("second")
        for s, ts, item, w in zip(pdf["second"], pdf["ts"], pdf["item_id"], pdf["cooldown_seconds"]):
            wait = int(w)
            if s not in first or (ts, item) < first[s]:
                first[s] = (ts, item)
    ready = state.get[0] if state.exists else -(2**62)
    out = []
    for s in sorted(first):
        if s >= ready:
            out.append((key[0], first[s][1], first[s][0]))
            ready = s + max(wait, 1)
    state.update((int(ready),))
    if out:
        yield pd.DataFrame(out, columns=["rule_id", "item_id", "ts"])


def _delivery_state(patience_ms: int):
    """State of a rule: the second it may fire again, the alert under way, those that wait behind it, and results known."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ready, current, waiting, results = state.get if state.exists else (-(2**62), None, [], [])
        queue = [tuple(w) for w in waiting]
        known = {r[0]: bool(r[1]) for r in results}
        tried = [] if current is None else [tuple(current)]
        out = []
        now = state.getCurrentWatermarkMs()
        for pdf in batches if not state.hasTimedOut else ():
            for kind, item, us, wait, good in zip(pdf["kind"], pdf["item_id"], pdf["ts_us"], pdf["cooldown_seconds"], pdf["delivered"]):
                if kind == "result":
                    known[item] = known.get(item, False) or bool(good)
                else:
                    queue.append((int(us), item, int(wait)))
        queue.sort()
        while True:
            if tried:
                us, item, wait = tried[0]
                late = now > 0 and us // 1000 + patience_ms <= now
                if item not in known and not late:
                    break  # the result is still to come
                if known.pop(item, False):
                    ready = us // 1_000_000 + max(wait, 1)
                tried = []
            while queue and queue[0][0] // 1_000_000 < ready:
                known.pop(queue.pop(0)[1], None)
            if not queue:
                break
            tried = [queue.pop(0)]
            out.append((key[0], tried[0][1], pd.Timestamp(tried[0][0], unit="us")))
        state.update((int(ready), tried[0] if tried else None, queue, sorted(known.items())))
        if tried:
            state.setTimeoutTimestamp(max(tried[0][0] // 1000 + patience_ms, now) + 1)
        if out:
            yield pd.DataFrame(out, columns=["rule_id", "item_id", "ts"])

    return run


def delivery_stream(items: DataFrame, rules: DataFrame, outcomes: DataFrame, *, delay: str = "0 seconds", patience: float = 600.0) -> DataFrame:
    """(rule_id, item_id, ts): deliveries to try, where only one that succeeded starts the rule's cooldown.

    ``outcomes`` is the stream of results (rule_id, item_id, delivered, ts) that comes back from the channels. A rule has
    one alert under way; later matches wait for its result. After a failure the next one is tried at once, after a
    delivery those inside the cooldown are dropped. An alert without a result ``patience`` seconds of event time after it
    counts as failed (an event-time timer releases those behind it). Matches come in order of event time.
    """
    sides = rule_hits(items, rules).select(
        "rule_id", "item_id", "ts", F.lit("match").alias("kind"), "cooldown_seconds", F.lit(False).alias("delivered")
    ).distinct(), outcomes.select("rule_id", "item_id", "ts", F.lit("result").alias("kind"), F.lit(0).cast("long").alias("cooldown_seconds"), "delivered")
    both = sides[0].withWatermark("ts", delay).unionByName(sides[1].withWatermark("ts", delay)).withColumn("ts_us", F.unix_micros("ts"))
    return both.groupBy("rule_id").applyInPandasWithState(
        _delivery_state(int(patience * 1000)), "rule_id string, item_id string, ts timestamp",
        "ready long, current struct<us:long,item:string,wait:long>, waiting array<struct<us:long,item:string,wait:long>>, results array<struct<item:string,good:boolean>>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def alert_stream(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Streamed items against static rules with a cooldown per rule, in order of event time within a batch."""
    hits = rule_hits(items, rules).withColumn("second", F.unix_seconds("ts"))
    return hits.groupBy("rule_id").applyInPandasWithState(
        _cooldown_state, "rule_id string, item_id string, ts timestamp", "ready long", "append", GroupStateTimeout.NoTimeout
    )


def rule_hits(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, item_id, ts, cooldown_seconds): streamed items that match static rules; once for each matching trigger."""
    active = rules.where("is_active")
    kw = active.select(c("id").alias("rule_id"), F.explode("keywords").alias("_k")).select("rule_id", F.lower("_k").alias("trigger")).where(c("trigger") != "")
    sig = active.select(c("id").alias("rule_id"), F.explode("significance_trigger").alias("_s")).select(
        "rule_id", F.concat(F.lit("significance:"), "_s").alias("trigger")
    )
    wait = active.select(c("id").alias("rule_id"), cooldown_seconds().alias("cooldown_seconds"))
    triggers = kw.unionByName(sig).distinct().join(wait, "rule_id")
    words = active_keywords(rules)
    found = keyword_finder(words)(F.lower(fl.alert_haystack())) if words else F.array().cast("array<string>")
    marks = F.concat(found, F.array(F.concat(F.lit("significance:"), F.coalesce("significance", F.lit("")))))
    e = items.select(c("id").alias("item_id"), c("created_at").alias("ts"), F.explode(marks).alias("trigger"))
    return e.join(triggers, "trigger").select("rule_id", "item_id", "ts", "cooldown_seconds")


# ---- repositories ------------------------------------------------------------------------


#: Keys of a stream share this many states: a call of Python takes all keys of one bucket, as columns.
STATE_BUCKETS = 256


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def _packed(rows: pd.DataFrame) -> bytes:
    """Rows as one value of a state."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(value))).read_all().to_pandas()


def _together(frames: list[pd.DataFrame]) -> pd.DataFrame:
    frames = [f for f in frames if len(f)] or frames[:1]
    return pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0].reset_index(drop=True)


POLL = ["repo", "ts_us", "stars", "commits", "description_hash", "file_hash"]


def _with_previous(ordered: bool):
    """Snapshots with those before them. State of a bucket: the last snapshot of each of its repositories, and with
    ``ordered`` those that the watermark has not passed yet."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [pdf[POLL].assign(last=False) for pdf in batches] if not state.hasTimedOut else []
        if state.exists:
            rows.insert(0, _unpacked(state.get[0]))
        rows = _together(rows)
        code = pd.factorize(rows["repo"], use_na_sentinel=False)[0]
        at, last = rows["ts_us"].to_numpy(), rows["last"].to_numpy(dtype=bool)
        mark = state.getCurrentWatermarkMs() * 1000 if ordered else 0
        due, held = np.ones(len(rows), bool), np.zeros(len(rows), bool)
        if ordered:
            # a snapshot that is older than one released before comes too late
            released = np.full(len(rows), np.iinfo(np.int64).min)
            released[code[last]] = at[last]
            held = ~last & (at > mark)
            due = last | (~held & (at > released[code]))
        texts = [pd.factorize(rows[x], sort=True, use_na_sentinel=False)[0] for x in POLL[:3:-1]]
        order = np.lexsort((*texts, rows["commits"], rows["stars"], at, ~last, code))
        order = order[due[order]]
        code, new = code[order], ~last[order]
        again = np.r_[False, code[1:] == code[:-1]] if len(code) else new
        end = order[np.r_[code[1:] != code[:-1], True]] if len(code) else order
        kept = rows.take(np.r_[end, np.flatnonzero(held)])
        state.update((_packed(kept.assign(last=np.r_[np.ones(len(end), bool), np.zeros(held.sum(), bool)])),))
        if held.any():
            state.setTimeoutTimestamp(int(max(at[held].min() // 1000 + 1, mark // 1000 + 1)))
        if new.any():
            place = np.flatnonzero(new)
            out, before = rows.take(order[place])[POLL], rows.take(order[np.maximum(place - 1, 0)])
            for column in POLL[2:]:
                out[f"prev_{column}"] = before[column].to_numpy()
            yield out.assign(seen=again[place])

    return run


def _events(polls: DataFrame, milestones: list[int], threshold: int) -> DataFrame:
    def before(column: str, first) -> Column:
        return F.when(c("seen"), F.coalesce(f"prev_{column}", F.lit(first))).otherwise(F.lit(first))

    def event(name: str, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("event"), detail.cast("string").alias("detail"))

    def changed(column: str) -> Column:
        return c("seen") & ~c(column).eqNullSafe(c(f"prev_{column}"))

    crossed = F.filter(F.array(*map(F.lit, milestones)), lambda m: (before("stars", 0) < m) & (m <= c("stars")))
    burst = (c("commits") > threshold) & (c("commits") > before("commits", 0) * 2)
    one = F.array(
        F.when(burst, event("commit_burst", c("commits"))),
        F.when(changed("description_hash"), event("description_changed", c("description_hash"))),
        F.when(changed("file_hash"), event("file_changed", c("file_hash"))),
    )
    found = F.concat(F.coalesce(F.transform(crossed, lambda m: event("star_milestone", m)), F.array().cast("array<struct<event:string,detail:string>>")), F.array_compact(one))
    e = polls.select("repo", F.timestamp_micros("ts_us").alias("ts"), F.explode(found).alias("e"))
    return e.select("repo", "ts", "e.event", "e.detail")


def repo_event_stream(
    snapshots: DataFrame, *, milestones=vocab.STAR_MILESTONES, threshold: int = 20, delay: str | None = None, buckets: int = STATE_BUCKETS
) -> DataFrame:
    """(repo, ts, event, detail) with the last snapshot of each repository as state.

    With ``delay`` snapshots may come out of order by as much: they wait in the state until the watermark has passed them,
    and are then taken in order of time (an event-time timer releases the last ones). Without it they are taken in the
    order of the batches. The repositories of a bucket share one state and one call, so a task's work is that of its rows
    and not of its keys; a batch rewrites the states of the buckets it touches.
    """
    s = snapshots if delay is None else snapshots.withWatermark("ts", delay)
    s = s.select(
        bucket_of("repo", buckets), "repo", "ts", F.unix_micros("ts").alias("ts_us"), "stars", "commits",
        tx.short_hash(c("description")).alias("description_hash"), F.substring(F.sha2("file_text", 256), 1, 8).alias("file_hash"),
    )
    timer = GroupStateTimeout.NoTimeout if delay is None else GroupStateTimeout.EventTimeTimeout
    values = "stars long, commits long, description_hash string, file_hash string"
    both = f"repo string, ts_us long, {values}, prev_{values.replace(', ', ', prev_')}, seen boolean"
    polls = s.groupBy("bucket").applyInPandasWithState(_with_previous(delay is not None), both, "snapshots binary", "append", timer)
    return _events(polls, list(milestones), threshold)


def silence_stream(heartbeats: DataFrame, *, hours: float = 4.0, delay: str = "0 seconds", buckets: int = STATE_BUCKETS) -> DataFrame:
    """(source_id, last_seen): each silence of more than ``hours`` after a heartbeat (source_id, ts), once: as soon as the
    watermark has moved that far past it, or when the next heartbeat tells of it. The sources of a bucket share a state."""
    gap = int(hours * 3_600_000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [pdf[["source_id", "ts_ms"]].assign(last=False, told=False) for pdf in batches] if not state.hasTimedOut else []
        if state.exists:
            rows.insert(0, _unpacked(state.get[0]))
        rows = _together(rows)
        rows["code"] = pd.factorize(rows["source_id"], use_na_sentinel=False)[0]
        # a heartbeat that is not newer than the last one known tells nothing
        known = rows["code"].map(rows[rows["last"]].set_index("code")["ts_ms"])
        rows = rows[rows["last"] | known.isna() | (rows["ts_ms"] > known)].sort_values(["code", "ts_ms"]).drop_duplicates(["code", "ts_ms"])
        mark = state.getCurrentWatermarkMs()
        ends = ~rows.duplicated("code", keep="last")
        until = rows["ts_ms"].shift(-1).where(~ends, mark)
        silent = ~rows["told"] & (until - rows["ts_ms"] > gap)
        last = rows[ends].assign(last=True, told=rows["told"] | silent)
        state.update((_packed(last[["source_id", "ts_ms", "last", "told"]]),))
        waiting = last.loc[~last["told"], "ts_ms"]
        if len(waiting):
            state.setTimeoutTimestamp(int(max(waiting.min() + gap, mark + 1)))
        if silent.any():
            found = rows.loc[silent, ["source_id", "ts_ms"]]
            yield pd.DataFrame({"source_id": found["source_id"], "last_seen": pd.to_datetime(found["ts_ms"], unit="ms", utc=True)})

    h = heartbeats.withWatermark("ts", delay).select(bucket_of("source_id", buckets), "source_id", "ts", F.unix_millis("ts").alias("ts_ms"))
    return h.groupBy("bucket").applyInPandasWithState(
        run, "source_id string, last_seen timestamp", "heartbeats binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def sessions(events: DataFrame, *, keys: list[str], gap: str, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """(keys, session_start, session_end, events): runs of events of a key no further apart than ``gap``; the end is the
    last event's time plus the gap. Batch and stream: with ``delay`` rows that come later than the watermark are left out,
    and a session appears once the watermark has passed its end."""
    rows = events if delay is None else events.withWatermark(ts, delay)
    g = rows.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return g.select(*keys, c("w.start").alias("session_start"), c("w.end").alias("session_end"), "events")
