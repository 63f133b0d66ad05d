"""Structured Streaming forms of the polling jobs.

Sinks write every micro-batch into its own folder, so a replayed batch overwrites
itself and results stay exact after a restart.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from feedspan.functions.html import sanitize_fields
from feedspan.operators.changes import append_rows, purge_older_than
from feedspan.operators.defaults import complete
from feedspan.operators.keys import highest, is_serial
from feedspan.plans.ingest import (
    POST_TEXT,
    classify_scrape_errors,
    error_counters,
    parse_feed_documents,
    post_rows,
    scrape_error_upsert,
)
from feedspan.sources.storage import read_batches, restaged, sparing_disk, write_batch

#: Ids that each micro-batch of an ingest stream has for itself.
IDS_PER_BATCH = 1 << 32


def table_stream(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One of the given parquet tables as a file stream."""
    schema = spark.read.parquet(f"{root}/{table}.parquet").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{table}.parquet")
        .parquet(root)
    )


def post_counts(
    posts: DataFrame, interval_minutes: int, lateness: str, slide_minutes: int | None = None
) -> DataFrame:
    """Posts per feed and time window; rows later than `lateness` are dropped.

    `posts` needs `feed_id` and a timestamp `created_at`. Partial counts per task come
    before the shuffle, so a hot feed is one row per task.
    """
    sizes = [f"{interval_minutes} minutes"]
    if slide_minutes:
        sizes.append(f"{slide_minutes} minutes")
    return (
        posts.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", *sizes).alias("w"), "feed_id")
        .agg(F.count(F.lit(1)).alias("post_count"))
        .select("feed_id", "post_count", F.col("w.end").alias("created_at"))
    )


def _trigger(every: str | None) -> dict:
    return {"processingTime": every} if every else {"availableNow": True}


def append_to(
    stream: DataFrame, path: str, checkpoint: str, prepare=lambda batch: batch,
    every: str | None = None, mode: str = "append",
) -> StreamingQuery:
    """Write each micro-batch to its own folder: new rows, or with `update` every row that changed.

    Runs over all available input and stops, or keeps running with `every` (as in
    "10 minutes") between micro-batches.
    """
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(**_trigger(every))
        .foreachBatch(lambda batch, batch_id: write_batch(prepare(batch), path, batch_id))
        .start()
    )


def run_new_post_notifications(
    posts: DataFrame, feeds: DataFrame, path: str, checkpoint: str,
    interval_minutes: int = 10, lateness: str = "10 minutes", every: str | None = None, open_windows: bool = False,
) -> StreamingQuery:
    """Append one notification per feed and closed window.

    With `open_windows` a micro-batch writes the count so far of every window it changed, closed or
    not, so a run ends with all windows; `current_notifications` reads the last count of each.
    """
    names = feeds.select(F.col("id").alias("feed_id"), F.col("name").alias("feed_name"))
    counts = post_counts(posts, interval_minutes, lateness)
    mode = "update" if open_windows else "append"
    return append_to(counts, path, checkpoint, lambda batch: batch.join(names, "feed_id"), every, mode)


def current_notifications(spark: SparkSession, path: str) -> DataFrame:
    """The last written count of each feed and window; partial maxima per task come before the shuffle."""
    schema = "feed_id bigint, post_count bigint, created_at timestamp, feed_name string"
    written = read_batches(spark, path, schema, keep_batch=True)
    return written.groupBy("feed_id", "created_at").agg(
        F.max_by("post_count", "batch_id").alias("post_count"), F.max_by("feed_name", "batch_id").alias("feed_name"))


def _first_written(spark: SparkSession, path: str, value) -> int:
    """A number fixed by the first run of a stream; later runs and replays read it back."""
    try:
        return spark.read.schema("n bigint").parquet(path).first()[0]
    except AnalysisException:
        spark.range(1).select(F.lit(value()).cast("bigint").alias("n")).coalesce(1).write.parquet(path)
        return _first_written(spark, path, value)


def _pass_new_links(
    links: DataFrame, checkpoint: str, insert: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Passes links never met on to `insert`; the state store keeps every link for good, and only links."""
    return (
        links.dropDuplicates(["itemurl"])
        .writeStream.option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .foreachBatch(insert)
        .start()
    )


def run_post_ingest(
    bodies: DataFrame, posts: DataFrame, path: str, checkpoint: str,
    strict: bool = False, lateness: str | None = None, every: str | None = None,
) -> StreamingQuery:
    """Insert posts from fetched bodies (feed_id, document_id, body, fetched_at).

    Each micro-batch of bodies is parsed once into a folder that the next one overwrites, and its links
    are appended to another. A second stream reads those links to their end before the micro-batch
    counts as done; links already seen are its state, begun with the links of `posts`, so a micro-batch
    looks up its own links and reads no earlier rows, however long the stream runs. Only links, row
    numbers and ids pass through the look-up and the numbering; the first item of each new link is then
    fetched by its row number, and links that were looked up leave their folder while the next ones are.
    So disk holds the posts, the state and the numbers of all micro-batches, but items and links of one.
    A replay parses the same bodies and appends the same links again, which are known by then or fall
    together, so each still comes once. With `lateness`, repeats inside that time are dropped before
    that. Numeric ids come from a range of each micro-batch's own above those of `posts`; replays give
    the same rows.
    """
    spark = bodies.sparkSession

    def parsed(raw: DataFrame) -> DataFrame:
        items = parse_feed_documents(raw.repartition("document_id"))  # parsing costs far more than the shuffle
        return complete(post_rows(items, F.col("fetched_at")), posts, "posts", F.col("fetched_at"))

    numbered = is_serial(posts, parsed(bodies))
    first = _first_written(spark, f"{path}/_first_id", lambda: highest(posts)) if numbered else None
    links_folder, items_folder, order = f"{path}/_first_items", f"{path}/_parsed_items", ["document_id", "item_no", "__row"]
    known = posts.select("itemurl", F.lit(True).alias("known")).filter("itemurl IS NOT NULL")

    def insert(schema: StructType, batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        with sparing_disk(session):
            # The state is asked once; numbering reads its answer several times.
            links = restaged(batch.filter("NOT known").select("itemurl"), f"{path}/_new_links")
            items = session.read.schema(schema).parquet(items_folder)
            firsts = items.groupBy("itemurl").agg(F.min(F.struct(*order)).alias("__w"))
            new = firsts.join(links, "itemurl", "left_semi").select("__w.*")
            if numbered:
                new = append_rows(posts, new, order, first + batch_id * IDS_PER_BATCH).changed
            fresh = items.join(new.drop("document_id", "item_no"), "__row").drop("__row")
            clean = fresh.withColumn("__s", sanitize_fields({c: F.col(c) for c in POST_TEXT}, strict))
            clean = clean.withColumns({c: F.col(f"__s.{c}") for c in POST_TEXT}).drop("__s")
            write_batch(clean, path, batch_id)

    def admit(batch: DataFrame, batch_id: int) -> None:
        # Parsed once, into a shared folder, so a lost executor costs a re-read.
        with sparing_disk(batch.sparkSession):
            items = (batch if lateness else parsed(batch)).withColumn("__row", F.monotonically_increasing_id())
            items = restaged(items, items_folder)
            links = items.select("itemurl", F.lit(False).alias("known"))
            links = links.unionByName(known) if batch_id == 0 else links
            links.groupBy("itemurl").agg(F.max("known").alias("known")).write.mode("append").parquet(links_folder)
        links = spark.readStream.schema("itemurl string, known boolean").option("cleanSource", "delete").parquet(links_folder)
        _pass_new_links(links, f"{checkpoint.rstrip('/')}-links", partial(insert, items.schema)).awaitTermination()

    stream = bodies
    if lateness:
        stream = parsed(bodies).withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["itemurl"])
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**_trigger(every))
        .foreachBatch(admit)
        .start()
    )


def run_scrape_errors(
    attempts: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Append counters of each micro-batch; `current_errors` adds them up."""
    return append_to(
        attempts, path, checkpoint,
        lambda batch: error_counters(classify_scrape_errors(batch)), every,
    )


def current_errors(logs: DataFrame, counters: DataFrame) -> DataFrame:
    """The error table after all counted micro-batches."""
    at = F.struct("last_ts", "first_id")
    total = counters.groupBy("error_type", "feed_id").agg(
        F.sum("n").alias("n"),
        F.min("first_id").alias("first_id"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.min_by("first_retries", F.struct("first_ts", "first_id")).alias("first_retries"),
        F.max_by("message", at).alias("message"),
        F.max_by("status_code", at).alias("status_code"),
    )
    return scrape_error_upsert(logs, total)


def expired_challenges(
    challenges: DataFrame, resolutions: DataFrame, hours: int = 24, lateness: str = "1 hour"
) -> DataFrame:
    """Challenges nobody resolved in time, emitted once the watermark has passed the limit.

    `challenges`: id, user_id, created_at; `resolutions`: id, resolved_at. A time-bounded
    left outer stream join keeps state only for open challenges, in the JVM.
    """
    opened = challenges.withWatermark("created_at", lateness)
    closed = resolutions.select(F.col("id").alias("__id"), "resolved_at").withWatermark(
        "resolved_at", lateness
    )
    limit = F.expr(f"INTERVAL '{hours}' HOUR")
    in_time = (
        (F.col("id") == F.col("__id"))
        & (F.col("resolved_at") >= F.col("created_at"))
        & (F.col("resolved_at") <= F.col("created_at") + limit)
    )
    return (
        opened.join(closed, in_time, "left_outer")
        .filter(F.col("__id").isNull())
        .select("id", "user_id", F.lit("failed").alias("status"),
                (F.col("created_at") + limit).alias("updated_at"))
    )


def run_timeline_fan_out(
    posts: DataFrame, follows: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Append one row per new post and follower of its feed.

    The join runs inside the micro-batch, where AQE sees the batch's size and splits hot
    feeds. Keep `follows` bucketed by feed_id (`write_bucketed`) to spare its shuffle.
    """
    readers = follows.select("user_id", "feed_id")

    def fan_out(batch: DataFrame) -> DataFrame:
        return batch.join(readers, "feed_id").select(
            "user_id", "feed_id", F.col("id").alias("post_id"), "created_at"
        )

    return append_to(posts, path, checkpoint, fan_out, every)


def purge_stream_table(spark: SparkSession, path: str, schema: str, as_of: Column, minutes_kept: int):
    """Rows of a stream-written table that retention keeps."""
    return purge_older_than(read_batches(spark, path, schema), as_of, minutes_kept).table
