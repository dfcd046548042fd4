"""Structured Streaming forms of change detection, deduplication, fact sinks, health and staleness.

Sources are streams of observations, facts or runs with an event time.  Each stream gives, up to
its watermark, what the batch operator of the same name gives, whatever order rows come in.
Changes and staleness are state machines on RocksDB (value and map state, event-time timers), a
few values a key; late rows are counted by ``observation_ledger``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia.functions.ids import sql_hashed
from evidentia.operators.facts import add_facts, with_fact_id
from evidentia.operators.ingest import _SNAP, content_changes, snapshot_observations
from evidentia.plans.storage import shared_dir, through_files
from evidentia.sources.staging import view, with_views

DAY = 86_400_000_000  # microseconds
CHANGE = "document_id string, old_sha256 string, new_sha256 string, micros long"


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class ContentChanges(StatefulProcessor):
    """Per document: the hash that holds, and the observations that the watermark has not passed.

    An observation waits in a map under (time, id), so repeats fall together whatever the order
    they come in.  There is one timer a document, for its first waiting observation; when it
    fires, all that the watermark has passed is taken in order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sha256 string, at long, id long")
        self.waiting = handle.getMapState("waiting", "at long, id long", "sha256 string")
        self.timer = handle.getValueState("timer", "due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            for at, i, sha in zip(frame["micros"].tolist(), frame["observation_id"].tolist(), frame["sha256"]):
                self.waiting.updateValue((at, i), (sha,))
                first = at if first is None else min(first, at)
        if first is not None:
            self._wake(first)
        yield pd.DataFrame(columns=["document_id", "old_sha256", "new_sha256", "micros"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        old, after = (lambda v: (v[0], (v[1], v[2])))(self.last.get()) if self.last.exists() else (None, None)
        ready, rest, out = [], None, []
        for (at, i), (sha,) in self.waiting.iterator():
            if at <= passed:
                ready.append((at, i, sha))
            else:
                rest = at if rest is None else min(rest, at)
        for at, i, sha in sorted(ready):
            self.waiting.removeKey((at, i))
            if after is not None and (at, i) <= after:
                continue
            if old is not None and sha != old:
                out.append((key[0], old, sha, at))
            old, after = sha, (at, i)
        if ready:
            self.last.update((old, *after))
        if rest is not None:
            self._wake(rest)
        yield pd.DataFrame(out, columns=["document_id", "old_sha256", "new_sha256", "micros"])

    def _wake(self, at: int) -> None:
        due = -(-at // 1000)
        if self.timer.exists():
            held = self.timer.get()[0]
            if held <= due:
                return
            self.handle.deleteTimer(held)
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def close(self) -> None:
        pass


def stream_content_changes(snapped: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Changes of hash of each document in the order of (retrieved_at, observation_id), whatever order rows come in.

    A change is told when the watermark, the latest time less ``delay``, passes the observation
    that shows it; so the rows are those of ``content_changes`` up to the watermark, without
    collapsing repeats of one change.  Rows later than the watermark are dropped by the engine;
    ``observation_ledger`` counts them.
    """
    # times go as numbers: pandas would shift them by the session's time zone
    rows = snapped.select("document_id", "sha256", "retrieved_at", F.col("observation_id").cast("long").alias("observation_id"), F.unix_micros("retrieved_at").alias("micros"))
    rows = rows.filter("document_id IS NOT NULL AND retrieved_at IS NOT NULL").withWatermark("retrieved_at", delay)
    found = rows.groupBy("document_id").transformWithStateInPandas(ContentChanges(), CHANGE, "Append", "EventTime")
    return found.select("document_id", "old_sha256", "new_sha256", F.timestamp_micros("micros").alias("detected_at"))


def stream_observation_dedupe(obs: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each observation_id once within the watermark."""
    return obs.withWatermark("retrieved_at", delay).dropDuplicatesWithinWatermark(["observation_id"])


def observation_ledger(folder: str, delay: str = "7 days"):
    """A writer of batches (for ``foreachBatch``) that deals observations out as kept, repeated or late.

    A row is late if it is older than the latest time of the batches before by more than
    ``delay``; of the others the first of an id is kept (by time), unless a batch before kept one
    that is no older than twice the delay, and the rest are repeats.  Each batch writes its own
    folders (late and kept as rows, repeats as times an id) and the ids that may still be
    repeated; a batch that is run again starts from the one before and overwrites them.
    ``read_ledger`` reads all.
    """

    def deal(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        span = spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {delay})").first()[0]
        before = spark.read.parquet(f"{folder}/latest/{number - 1}").first()[0] if number > 0 else None
        passed = None if before is None else before - span
        rows = through_files(batch.withColumn("micros", F.unix_micros("retrieved_at")))
        late = F.lit(False) if passed is None else F.coalesce(F.col("micros") < passed, F.lit(False))
        rows.filter(late).drop("micros").write.mode("overwrite").parquet(f"{folder}/late/{number}")
        own = [c for c in rows.columns if c not in ("observation_id", "micros")]
        first = rows.filter(~late).groupBy("observation_id").agg(F.min(F.struct("micros", *own)).alias("f"), F.count("*").alias("n"))
        first = first.select("observation_id", "f.micros", *(f"f.{c}" for c in own), "n")
        if number > 0:
            seen = spark.read.parquet(f"{folder}/seen/{number - 1}").select("observation_id", F.lit(True).alias("known"))
            first = first.join(seen, "observation_id", "left")
        else:
            first = first.withColumn("known", F.lit(None).cast("boolean"))
        first = through_files(first)
        kept = first.filter("known IS NULL")
        kept.select(batch.columns).write.mode("overwrite").parquet(f"{folder}/kept/{number}")
        again = first.select("observation_id", (F.col("n") - F.when(F.col("known").isNull(), 1).otherwise(0)).alias("times"))
        again.filter("times > 0").write.mode("overwrite").parquet(f"{folder}/repeated/{number}")
        latest = rows.agg(F.max("micros")).first()[0]
        latest = max((x for x in (latest, before) if x is not None), default=None)
        seen = kept.select("observation_id", "micros")
        if number > 0:
            seen = seen.unionByName(spark.read.parquet(f"{folder}/seen/{number - 1}"))
        if latest is not None:
            seen = seen.filter(F.col("micros") >= latest - 2 * span)
        seen.write.mode("overwrite").parquet(f"{folder}/seen/{number}")
        spark.createDataFrame([(latest,)], "latest long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/latest/{number}")
        if number > 1:
            _delete(spark, f"{folder}/seen/{number - 2}")

    return deal


def read_ledger(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """kept and late (as the input), repeated (observation_id, times), each with the number of its batch."""
    number = F.regexp_extract(F.input_file_name(), r"/(\d+)/[^/]*$", 1).cast("long")
    return {kind: spark.read.parquet(f"{folder}/{kind}/*").withColumn("batch", number) for kind in ("kept", "repeated", "late")}


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Buckets of the fact table of ``stream_fact_sink``.
SINK_BUCKETS = 64


def stream_fact_sink(facts: DataFrame, folder: str, checkpoint: str):
    """A writer (not started) that upserts facts batch by batch into a bucketed table (see ``read_sink``)."""
    return facts.writeStream.foreachBatch(fact_upsert(folder)).option("checkpointLocation", checkpoint)


def _versions(spark: SparkSession, folder: str, number: int) -> dict[int, int]:
    """The version of each bucket after batch ``number``."""
    if number < 0:
        return {}
    return {r.bucket: r.version for r in spark.read.parquet(f"{folder}/versions/{number}").collect()}


def _read(spark: SparkSession, folder: str, versions: dict[int, int]) -> DataFrame | None:
    paths = [f"{folder}/data/{n}/bucket={b}" for b, n in sorted(versions.items())]
    return spark.read.parquet(*paths) if paths else None


def read_sink(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    """The table after batch ``number``; None where nothing has come."""
    return _read(spark, folder, _versions(spark, folder, number))


def fact_upsert(folder: str):
    """Rewrites the buckets of fact ids that a batch touches, as its version of them; the rest stay as they are.

    A small table tells which version of each bucket holds after a batch.  A repeated batch
    starts from the table before it and overwrites its own files; versions that the batch before
    this one has replaced are deleted.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _versions(spark, folder, number - 1)
        facts = through_files(with_fact_id(batch))
        bucket = F.pmod(F.xxhash64("fact_id"), F.lit(SINK_BUCKETS)).cast("int")
        touched = [r[0] for r in facts.select(bucket).distinct().collect()]
        old = _read(spark, folder, {b: before[b] for b in touched if b in before})
        merged = add_facts(facts.limit(0) if old is None else old, facts.drop("fact_id"))
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/{number}")
        after = before | {b: number for b in touched}
        if after:
            spark.createDataFrame(list(after.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/{number}")
        earlier = _versions(spark, folder, number - 2) if number > 1 else {}
        for b, n in earlier.items():
            if before.get(b) != n:
                _delete(spark, f"{folder}/data/{n}/bucket={b}")

    return upsert


def stream_source_health(runs: DataFrame, width: str = "1 day", delay: str = "1 day", slide: str | None = None) -> DataFrame:
    """Runs, failures and records of each source by day, or by windows that begin every ``slide``."""
    rows = runs.withWatermark("started_at", delay)
    return rows.groupBy(F.window("started_at", width, slide or width).alias("w"), "source_id").agg(
        F.count("*").alias("runs"), F.sum((F.col("status") != "success").cast("long")).alias("failures"), F.sum("record_count").alias("records"),
    ).select("source_id", F.col("w.start").alias("day"), "runs", "failures", "records")


def run_sessions(runs: DataFrame, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Stretches of runs of a source with no pause of ``gap`` or more."""
    rows = runs.withWatermark("started_at", delay)
    return rows.groupBy(F.session_window("started_at", gap).alias("w"), "source_id").agg(F.count("*").alias("runs")).select(
        "source_id", F.col("w.start").alias("started"), "runs"
    )


class Staleness(StatefulProcessor):
    """Per source: its newest observation and when that is out of date; one timer, for that moment."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "newest long, due long, stale boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, due, stale = self.seen.get() if self.seen.exists() else (None, None, False)
        days, out = 0, []
        for frame in rows:
            last = int(frame["micros"].max())
            newest, days = last if newest is None else max(newest, last), int(frame["days"].max())
        until = (newest // DAY + days + 1) * DAY
        if until != due:
            if due is not None and not stale:
                self.handle.deleteTimer(due // 1000)
            late = until // 1000 <= timerValues.getCurrentWatermarkInMs()
            if late != stale:
                out.append((key[0], "stale" if late else "present", newest, until if late else newest))
            if not late:
                self.handle.registerTimer(until // 1000)
            due, stale = until, late
        self.seen.update((newest, due, stale))
        yield _statuses(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, due, _ = self.seen.get()
        self.seen.update((newest, due, True))
        yield _statuses([(key[0], "stale", newest, due)])

    def close(self) -> None:
        pass


def _statuses(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["source_id", "status", "last_seen", "at"])


def stream_staleness(obs: DataFrame, expectations: DataFrame, delay: str = "1 day") -> DataFrame:
    """(source_id, status, last_seen, at): a row when a source becomes stale, and one when it is seen again.

    A source is stale when the watermark's day (UTC) is more than cadence and grace after the day
    of its newest observation, as in ``publication_status``; ``at`` is the first such moment, or
    the time of the observation that ends it.  ``expectations`` (source_id, cadence_days, grace_days) is a static table; sources
    without one are never stale.
    """
    days = expectations.select("source_id", (F.col("cadence_days") + F.col("grace_days")).cast("long").alias("days"))
    rows = obs.filter("retrieved_at IS NOT NULL").withWatermark("retrieved_at", delay).select("source_id", "retrieved_at", F.unix_micros("retrieved_at").alias("micros"))
    found = rows.join(days, "source_id").groupBy("source_id").transformWithStateInPandas(Staleness(), "source_id string, status string, last_seen long, at long", "Append", "EventTime")
    return found.select("source_id", "status", *(F.timestamp_micros(c).alias(c) for c in ("last_seen", "at")))


def stale_sources(statuses: DataFrame) -> DataFrame:
    """Sources that are stale by the statuses told so far: source_id, last_seen, stale_at."""
    newest = statuses.groupBy("source_id").agg(F.max(F.struct("last_seen", F.when(F.col("status") == "stale", 1).otherwise(0).alias("stale"), "at")).alias("s"))
    return newest.filter("s.stale = 1").select("source_id", "s.last_seen", F.col("s.at").alias("stale_at"))


def run_to_end(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns its rows, through files in the shared folder.

    State is kept in RocksDB.  A ``folder`` that an earlier run was given goes on from its checkpoint.
    """
    spark = stream.sparkSession
    folder = folder or shared_dir(spark)
    if mode == "append":
        query = stream.writeStream.format("parquet").outputMode("append")
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"))
    query = query.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    name, provider = STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        running = query.start(f"{folder}/out") if mode == "append" else query.start()
    finally:
        spark.conf.set(name, before)
    running.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return out.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(F.col("event_id").alias("observation_id"), F.col("event_type").alias("source_id"), F.concat(F.lit("u/"), "user_id").alias("url"), F.col("props").alias("body"), F.col("ts").cast("timestamp").alias("retrieved_at"))


def _ran(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.concat(F.lit("src"), F.col("user_id") % 40).alias("source_id"), F.col("ts").cast("timestamp").alias("started_at"), (F.col("event_id") % 7).alias("record_count"),
        F.expr("CASE event_id % 9 WHEN 0 THEN 'blocked' WHEN 1 THEN 'missing' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'http_error' WHEN 4 THEN 'partial' ELSE 'success' END").alias("status"))


def j1_stream_content_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes up to the watermark, an hour before the last event."""
    out = run_to_end(stream_content_changes(snapshot_observations(_observed(spark, sf_dir))))
    return out.groupBy("document_id", "old_sha256", "new_sha256").agg(F.min("detected_at").alias("detected_at"))


def j2_stream_observation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _observed(spark, sf_dir)
    return run_to_end(stream_observation_dedupe(obs.unionByName(obs))).select("observation_id", "source_id", "retrieved_at")


def run_parts(parts: DataFrame, start) -> None:
    """Writes each part (a column) as a file of its own and runs ``start(stream)`` over it to the end, one after the other."""
    spark = parts.sparkSession
    folder = shared_dir(spark)
    rows = through_files(parts)
    for (part,) in rows.select("part").distinct().orderBy("part").collect():
        rows.filter(F.col("part") == part).write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


def j2_observation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept, repeated and late observations of each part that comes in, in runs that go on from one checkpoint."""
    folder = shared_dir(spark)
    rows = view(spark, sf_dir, "arrivals").withColumn("retrieved_at", F.col("retrieved_at").cast("timestamp"))
    deal = observation_ledger(folder, "2 days")
    run_parts(rows, lambda s: s.writeStream.foreachBatch(deal).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    got = read_ledger(spark, folder)
    counts = [got[kind].groupBy("batch").agg((F.sum("times") if kind == "repeated" else F.count("*")).alias("n")).select("batch", F.lit(kind).alias("kind"), "n") for kind in got]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def j2_late_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late rows themselves."""
    folder = shared_dir(spark)
    rows = view(spark, sf_dir, "arrivals").withColumn("retrieved_at", F.col("retrieved_at").cast("timestamp"))
    deal = observation_ledger(folder, "2 days")
    run_parts(rows, lambda s: s.writeStream.foreachBatch(deal).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    return read_ledger(spark, folder)["late"].select("batch", "observation_id", "source_id", "url", F.col("retrieved_at").cast("timestamp_ntz").alias("retrieved_at"))


def j3_stream_fact_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    none = F.lit(None).cast("string")
    facts = e.select(
        F.concat(F.lit("D"), "user_id").alias("document_id"), F.col("event_type").alias("snapshot_id"), F.lit("EVENT").alias("fact_type"), none.alias("subject_id"), F.lit("SAW").alias("predicate"),
        none.alias("object_id"), F.col("props").alias("value_text"), none.alias("locator"), F.concat(F.lit("m"), "event_id").alias("metadata"))
    folder = shared_dir(spark)
    query = stream_fact_sink(facts, folder, f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_sink(spark, folder, query.lastProgress["batchId"]).select("document_id", "snapshot_id", "value_text", "metadata")


def j4_stream_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(stream_source_health(_ran(spark, sf_dir)), "complete")


def j4_sliding_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(stream_source_health(_ran(spark, sf_dir), "2 days", slide="1 day"), "complete")


def j4_run_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(run_sessions(_ran(spark, sf_dir)), "complete")


def j5_stream_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a source that are stale at the last watermark; searches are expected within a day, others within two."""
    obs = _observed(spark, sf_dir).withColumn("source_id", F.concat_ws("/", "source_id", "url"))
    sources = view(spark, sf_dir, "observations").select(F.concat_ws("/", "source_id", "url").alias("source_id")).distinct()
    expected = sources.withColumns({"cadence_days": F.when(F.col("source_id").startswith("s"), 1).otherwise(2), "grace_days": F.when(F.col("source_id").endswith("7"), 1).otherwise(0)})
    return stale_sources(run_to_end(stream_staleness(obs, expected)))


QUERIES = {
    "j1_stream_content_changes": j1_stream_content_changes,
    "j2_stream_observation_dedupe": j2_stream_observation_dedupe,
    "j2_observation_ledger": j2_observation_ledger,
    "j2_late_observations": j2_late_observations,
    "j3_stream_fact_sink": j3_stream_fact_sink,
    "j4_stream_source_health": j4_stream_source_health,
    "j4_run_sessions": j4_run_sessions,
    "j4_sliding_health": j4_sliding_health,
    "j5_stream_staleness": j5_stream_staleness,
}
_DEALT = """WITH w AS (SELECT part, max(newest) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS passed
        FROM (SELECT part, max(retrieved_at) AS newest FROM {arrivals} GROUP BY part)),
      l AS (SELECT a.*, coalesce(retrieved_at < passed, false) AS late FROM {arrivals} a JOIN w USING (part)),
      k AS (SELECT part, observation_id, count(*) AS n, row_number() OVER (PARTITION BY observation_id ORDER BY part) AS nth FROM l WHERE NOT late GROUP BY 1, 2) """
ORACLE = {k: with_views(q) for k, q in {
    "j1_stream_content_changes": f"""WITH c AS (SELECT *, lag(sha256) OVER (PARTITION BY document_id ORDER BY retrieved_at, observation_id) AS old FROM ({_SNAP}))
      SELECT document_id, old AS old_sha256, sha256 AS new_sha256, min(retrieved_at) AS detected_at FROM c
      WHERE old <> sha256 AND retrieved_at <= (SELECT date_trunc('millisecond', max(retrieved_at)) - INTERVAL 1 HOUR FROM {{observations}}) GROUP BY ALL""",
    "j2_observation_ledger": _DEALT + """SELECT part AS batch, 'late' AS kind, count(*) AS n FROM l WHERE late GROUP BY 1
      UNION ALL SELECT part, 'kept', count(*) FROM k WHERE nth = 1 GROUP BY 1
      UNION ALL SELECT part, 'repeated', sum(n - CASE WHEN nth = 1 THEN 1 ELSE 0 END)::BIGINT FROM k GROUP BY 1 HAVING sum(n - CASE WHEN nth = 1 THEN 1 ELSE 0 END) > 0""",
    "j2_late_observations": _DEALT + "SELECT part AS batch, observation_id, source_id, url, retrieved_at FROM l WHERE late",
    "j2_stream_observation_dedupe": "SELECT observation_id, source_id, retrieved_at FROM {observations}",
    "j3_stream_fact_sink": "SELECT 'D' || user_id AS document_id, event_type AS snapshot_id, props AS value_text, max('m' || event_id) AS metadata FROM events GROUP BY ALL",
    "j4_stream_source_health": "SELECT source_id, date_trunc('day', started_at)::TIMESTAMP AS day, count(*) AS runs, count(*) FILTER (status <> 'success') AS failures, sum(record_count)::BIGINT AS records FROM {runs} GROUP BY 1, 2",
    "j4_sliding_health": """SELECT source_id, date_trunc('day', started_at)::TIMESTAMP - to_days(k::INTEGER) AS day, count(*) AS runs, count(*) FILTER (status <> 'success') AS failures, sum(record_count)::BIGINT AS records
      FROM {runs}, range(0, 2) r(k) GROUP BY 1, 2""",
    "j5_stream_staleness": """WITH o AS (SELECT source_id || '/' || url AS source_id, max(retrieved_at) AS last_seen FROM {observations} GROUP BY 1),
      e AS (SELECT *, CASE WHEN starts_with(source_id, 's') THEN 1 ELSE 2 END + CASE WHEN ends_with(source_id, '7') THEN 1 ELSE 0 END AS days FROM o)
      SELECT source_id, last_seen, date_trunc('day', last_seen)::TIMESTAMP + to_days(days + 1) AS stale_at FROM e
      WHERE date_diff('day', last_seen, (SELECT max(retrieved_at) - INTERVAL 1 DAY FROM {observations})) > days""",
    "j4_run_sessions": """WITH g AS (SELECT source_id, started_at, CASE WHEN started_at < lag(started_at) OVER (PARTITION BY source_id ORDER BY started_at) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM {runs}),
      s AS (SELECT *, sum(n) OVER (PARTITION BY source_id ORDER BY started_at ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT source_id, min(started_at) AS started, count(*) AS runs FROM s GROUP BY source_id, k""",
}.items()}
