"""Event logs: appending, folding, gap sessions in batch and stream, labels that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions.text import local_stamp, slugify

GAP, RANGE = 60, 1_000_000


def stamped(events: DataFrame) -> DataFrame:
    """Adds ts, now, in ISO form; the events themselves stay as they are."""
    return events.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))


def append_events(events: DataFrame, path: str) -> None:
    """One JSON line for each event, keys in order; nothing that is there is touched."""
    rows = stamped(events)
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("append").text(path)


def retrieval_events(candidates: DataFrame, queries: DataFrame, plan: str, injected_ids: list[str] | None = None, reranker_id: str | None = None, spaces: tuple[str, ...] = ()) -> DataFrame:
    """An event for each query that has an id, with its candidates in order, and the injected ids."""
    listed = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("fused_rank", "doc_id", "fused_score"))).alias("candidates"))
    strings = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    payload = F.struct(F.col("text").alias("query_text"), F.lit(plan).alias("plan"), F.lit("rrf").alias("fusion"), F.lit(reranker_id).alias("reranker_id"), strings(spaces).alias("spaces"), "candidates", strings(map(str, injected_ids or [])).alias("injected_ids"))
    return queries.filter("query_id is not null").join(listed, "query_id", "left").select("query_id", F.lit("retrieval").alias("event"), payload.alias("payload"))


def fold(events: DataFrame, key: str = "query_id", kind: str = "event", value: str = "payload", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last value of each kind for each key. Also as a stream, in update or complete mode."""
    return events.groupBy(key, kind).agg(F.max_by(value, F.struct(*order)).alias(value))


def folded(events: DataFrame, kinds: list[str], **options: str) -> DataFrame:
    """One row for each key, a column for each kind."""
    key, kind, value = options.get("key", "query_id"), options.get("kind", "event"), options.get("value", "payload")
    return fold(events, key, kind, value, options.get("order", ("ts",))).groupBy(key).pivot(kind, kinds).agg(F.first(value))


def sessions(events: DataFrame, gap: int = GAP, key: str | None = None, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Adds session_id, from 0 in order of time: a new session begins where the time since the event before is more than `gap` seconds. Without a key
    sessions are global. A global order needs no single partition: ranges of time with about RANGE events each are ordered by themselves and joined by what the ranges before end with."""
    order = [ts, *([tie] if tie else [])]
    if key is not None:
        w = Window.partitionBy(key).orderBy(*order)
        new = _starts(ts, F.lag(ts).over(w), gap)
        return events.withColumn("_n", new).withColumn("session_id", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_n")
    at = _seconds(ts).cast("double")
    parts = events.count() // RANGE
    bounds = sorted(set(events.select(at.alias("at")).approxQuantile("at", [i / (parts + 1) for i in range(1, parts + 1)], 0.25 / (parts + 1)))) if parts else []
    placed = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b <= at))
    dated = events.withColumn("_part", F.when(at.isNull(), F.lit(-1)).otherwise(placed))
    w = Window.partitionBy("_part").orderBy(*order)
    within = dated.withColumn("_n", F.when(F.lag(ts).over(w).isNull(), F.lit(0)).otherwise(_starts(ts, F.lag(ts).over(w), gap)))
    per_part = within.groupBy("_part").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.sum("_n").alias("_inside"))
    parts = Window.orderBy("_part")  # a row for each range
    head = _starts("_first", F.lag("_last").over(parts), gap)
    offsets = per_part.withColumn("_head", head).withColumn("_through", F.sum(F.col("_head") + F.col("_inside")).over(parts.rowsBetween(Window.unboundedPreceding, 0)))
    base = offsets.select((F.col("_through") - F.col("_inside") - 1).alias("_base"), F.col("_part").alias("_base_part"))
    counted = within.join(base, F.col("_part") == F.col("_base_part")).drop("_base_part")
    return counted.withColumn("session_id", F.col("_base") + F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_part", "_n", "_base")


def _seconds(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def _starts(ts: str, before: Column, gap: int) -> Column:
    return F.when(before.isNull() | (_seconds(ts) - _seconds(before) > gap * 1_000_000), 1).otherwise(0)


def session_stream(events: DataFrame, gap: int = GAP, late: str = "10 minutes", key: str = "query_id") -> DataFrame:
    """Sessions of a stream, with a watermark. Spark's own session window also joins events exactly `gap` seconds apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", f"{gap} seconds"), key).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def labels(first_events: DataFrame, registry: DataFrame, zone: str = "UTC") -> DataFrame:
    """session_key, label, is_new: a key that the registry (session_key, label) has keeps its label; another gets one of its first query and time."""
    made = F.concat(slugify(F.col("query_text")), F.lit("_"), local_stamp(F.col("ts"), zone))
    known = first_events.join(registry.withColumnRenamed("label", "_known"), "session_key", "left")
    return known.select("session_key", F.coalesce("_known", made).alias("label"), F.col("_known").isNull().alias("is_new"))


def first_events(with_sessions: DataFrame) -> DataFrame:
    """session_id, session_key, query_text, ts of each session's first event."""
    first = with_sessions.groupBy("session_id").agg(F.min_by(F.struct("query_id", "query_text", "ts"), F.struct("ts", "query_id")).alias("f"))
    return first.select("session_id", F.col("f.query_id").alias("session_key"), F.col("f.query_text").alias("query_text"), F.col("f.ts").alias("ts"))


def appearances(with_sessions: DataFrame, item: str, rank: str | None = None) -> DataFrame:
    """session_id, item, n, best_rank: how often an item is in a session."""
    best = F.min(rank) if rank else F.lit(None).cast("int")
    return with_sessions.groupBy("session_id", item).agg(F.count(F.lit(1)).alias("n"), best.alias("best_rank"))


def most_appearing(counts: DataFrame, item: str) -> DataFrame:
    """Each session's most frequent item; the better rank, then the lesser item on ties."""
    w = Window.partitionBy("session_id").orderBy(F.desc("n"), F.asc_nulls_last("best_rank"), item)
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def prune_after(store, table: str, current: DataFrame, key: tuple[str, ...] = ("point_id",)) -> int:
    """Deletes the points that the sources don't give any more; how many there were."""
    from gleaner.sources.store import stale

    gone = stale(store.read(table), current, key)
    n = gone.count()
    if n:
        store.delete(table, gone, key)
    return n


def ingest_stream(stream: DataFrame, store, table: str, checkpoint: str, once: bool = True, order: tuple[str, ...] = (), current: DataFrame | None = None) -> StreamingQuery:
    """Upserts each micro-batch's new or changed points, the last of a key winning; with `current`, the ids that sources have now, others are pruned after each batch."""
    from gleaner.sources.store import changed, last_of

    def upsert(batch: DataFrame, _: int) -> None:
        rows = last_of(batch, ("point_id",), order)
        if store.exists(table):
            rows = changed(rows, store.read(table))
        if not rows.isEmpty():
            store.upsert(table, rows)
        if current is not None and store.exists(table):
            prune_after(store, table, current)

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def register(labelled: DataFrame, store, table: str = "labels") -> int:
    """Appends the new ones of labels() to the stored registry: a label is kept from its first sight on. How many were new."""
    new = labelled.filter("is_new").select("session_key", "label").dropDuplicates(["session_key"])
    new = new.join(store.read(table).select("session_key"), "session_key", "left_anti") if store.exists(table) else new
    n = new.count()
    if n:
        store.upsert(table, new, ("session_key",))
    return n
