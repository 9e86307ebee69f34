"""Streaming forms: page arrival, TTL caches, host rates; and the batch forms of the caches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import normalise

TTL_SECONDS = 300


def cache_live(entries: DataFrame, as_of: Column) -> DataFrame:
    """The newest entry of each key that hasn't expired at `as_of`; `entries` has (key, value, stored_at, ttl_seconds)."""
    rows = entries.withColumn("expires_at", F.col("stored_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ttl_seconds")))
    newest = rows.groupBy("key").agg(F.max_by(F.struct("value", "stored_at", "expires_at"), "stored_at").alias("e")).select("key", "e.*")
    return newest.where(F.col("expires_at") > as_of)


def live_answers(fetched: DataFrame, as_of: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Of `fetched` (with fetched_at) the newest 200 answer of each normalised URL that is still alive at `as_of`: a cache that an
    Engine can read as its pages. A URL that can't be normalised is its own key."""
    key = F.coalesce(normalise(F.col("url")), F.col("url"))
    entries = fetched.where("status = 200").select(key.alias("key"), F.struct(*fetched.columns).alias("value"), F.col("fetched_at").alias("stored_at"), F.lit(ttl_seconds).alias("ttl_seconds"))
    return cache_live(entries, as_of).select("value.*")


def cacheable(status: Column, mime: Column, size: Column, limit: int) -> Column:
    """Whether an answer is stored: status 200, and not cut at `limit` (paged documents never are)."""
    return F.coalesce((status == 200) & ((size <= limit) | (mime == "application/pdf")), F.lit(False))


def _serve(stamps: list, stores: list, stored: int | None, ttl: int) -> tuple[list[bool], int | None]:
    """Whether each request of a key, in order, is a hit, and when the live answer was stored. A hit doesn't renew its answer."""
    hits = []
    for at, store in zip(stamps, stores, strict=True):
        hit = stored is not None and at <= stored + ttl
        if not hit:
            stored = at if store else None
        hits.append(hit)
    return hits, stored


def _replayed(ttl: int):
    def run(batches):
        last, stored = None, None
        for batch in batches:
            hits = []
            for key, at, store in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if key != last:
                    last, stored = key, None
                one, stored = _serve([at], [store and key is not None], stored, ttl)
                hits += one
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.bool_())], names=["request_id", "key", "hit"])

    return run


def cached_fetches(log: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """request_id, key, hit of each fetch in `log` (request_id, key, ts, cacheable): a miss that is cacheable is stored, and serves
    the key until ttl_seconds have passed. Ties go by request_id; null keys are never stored; a null cacheable is false.

    Rows stream through each task in order of key and time, so no key is held in memory. For robots files the key is the origin.
    """
    rows = log.select("request_id", F.col("key").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("cacheable", F.lit(False)).alias("store"))
    rows = rows.repartition("key").sortWithinPartitions("key", "at", "request_id")
    kind = rows.schema["request_id"].dataType.simpleString()
    return rows.mapInArrow(_replayed(ttl_seconds * 1_000_000), f"request_id {kind}, key string, hit boolean")


def cached_fetch_stream(log: DataFrame, ttl_seconds: int = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """cached_fetches over a stream, as requests arrive. State is one time for each live key, dropped when the watermark passes its end;
    requests of a key within one micro-batch are put in order of time, so maxFilesPerTrigger bounds what a task holds."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    ttl = ttl_seconds * 1_000_000

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["at", "request_id"])
        hits, stored = _serve(rows["at"].tolist(), rows["store"].tolist(), state.get[0] if state.exists else None, ttl)
        end = 0 if stored is None else (stored + ttl) // 1000 + 1
        if end > state.getCurrentWatermarkMs():
            state.update((stored,))
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"request_id": rows["request_id"], "key": key[0], "hit": hits})

    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).where("key IS NOT NULL")
    rows = rows.select("request_id", F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at"), F.coalesce("cacheable", F.lit(False)).alias("store"))
    kind = rows.schema["request_id"].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(step, f"request_id {kind}, key string, hit boolean", "stored long", "append", GroupStateTimeout.EventTimeTimeout)


def read_pages(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    """A stream of page rows from Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def first_arrivals(pages: DataFrame, event_time: str, within: str = "5 minutes", url_col: str = "url") -> DataFrame:
    """Each normalised URL's first row; a URL is forgotten once the watermark is `within` behind it."""
    keyed = pages.withColumn("cache_key", normalise(F.col(url_col))).withWatermark(event_time, within)
    return keyed.dropDuplicatesWithinWatermark(["cache_key"])


def host_rates(log: DataFrame, event_time: str = "ts", host: str = "host", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests per host and window; late rows count until the watermark passes."""
    return log.withWatermark(event_time, late).groupBy(F.window(event_time, width).alias("w"), host).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), host, "n")
