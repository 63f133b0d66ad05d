import glob
import os
import time
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from feedspan.operators.changes import purge_older_than
from feedspan.plans import ingest
from feedspan.sources import storage
from feedspan.sources.documents import read_bodies, stream_bodies
from feedspan.sources.storage import read_batches, sparing_disk, staged, write_batch, write_bucketed, write_by_day
from feedspan.streaming import jobs

from conftest import SF, rows
from test_ingest import ATOM, RSS

NOTES = "feed_id bigint, post_count bigint, created_at timestamp, feed_name string"


def put(spark, folder, data, schema):
    """Add one file of timestamped rows to a stream's input folder."""
    df = spark.createDataFrame(data, schema.replace("timestamp", "string"))
    for field in schema.split(","):
        name, kind = field.split()
        if kind == "timestamp":
            df = df.withColumn(name, F.to_timestamp(name))
    df.coalesce(1).write.mode("append").parquet(str(folder))


def test_windows_match_batch_and_late_rows_drop(spark, tmp_path):
    schema = "feed_id bigint, created_at timestamp"
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    feeds = spark.createDataFrame([(1, "one"), (2, "two")], "id bigint, name string")

    def run():
        stream = spark.readStream.schema(schema).parquet(str(src))
        jobs.run_new_post_notifications(stream, feeds, out, ck).awaitTermination()

    put(spark, src, [(1, "2024-01-01 00:01:00"), (1, "2024-01-01 00:09:59"), (2, "2024-01-01 00:10:00"),
                     (1, "2024-01-01 01:00:00")], schema)
    run()
    first = rows(read_batches(spark, out, NOTES).select("feed_id", "post_count", "feed_name"))
    assert first == [(1, 2, "one"), (2, 1, "two")]
    # A row for a closed window is too late; new windows still close.
    put(spark, src, [(1, "2024-01-01 00:02:00"), (2, "2024-01-01 02:00:00")], schema)
    run()
    assert rows(read_batches(spark, out, NOTES).select("feed_id", "post_count", "feed_name")) == sorted(
        [*first, (1, 1, "one")], key=lambda t: tuple(map(str, t)))


def test_open_windows_end_with_their_last_count(spark, tmp_path):
    schema = "feed_id bigint, created_at timestamp"
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    feeds = spark.createDataFrame([(1, "one"), (2, "two")], "id bigint, name string")

    def run():
        stream = spark.readStream.schema(schema).parquet(str(src))
        jobs.run_new_post_notifications(stream, feeds, out, ck, open_windows=True).awaitTermination()
        got = jobs.current_notifications(spark, out).selectExpr("feed_id", "date_format(created_at, 'HH:mm')", "post_count")
        return rows(got)

    put(spark, src, [(1, "2024-01-01 00:01:00"), (1, "2024-01-01 00:09:59"), (2, "2024-01-01 00:12:00")], schema)
    assert run() == [(1, "00:10", 2), (2, "00:20", 1)]
    put(spark, src, [(2, "2024-01-01 00:13:00"), (1, "2024-01-01 02:00:00")], schema)
    assert run() == [(1, "00:10", 2), (1, "02:10", 1), (2, "00:20", 2)]
    # Too late for its window: what was counted stays.
    put(spark, src, [(2, "2024-01-01 00:14:00")], schema)
    assert run() == [(1, "00:10", 2), (1, "02:10", 1), (2, "00:20", 2)]


def test_ingest_knows_links_without_reading_earlier_rows(spark, tmp_path):
    """Earlier output is gone, the links stay known; ids go on and never meet those of the table."""
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    posts = spark.createDataFrame([(70, "https://atom.example/1")], "id bigint, itemurl string")
    schema = "document_id bigint, feed_id bigint, url string, status int, body string"

    def run(i, body):
        df = spark.createDataFrame([(i, i, "u", 200, body)], schema)
        df.withColumn("fetched_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(src)
        jobs.run_post_ingest(stream_bodies(spark, src), posts, out, ck).awaitTermination()
        return {tuple(r) for r in read_batches(spark, out, "id bigint, itemurl string").collect()}

    new = lambda *n: "".join(
        f"<item><link>https://n.example/{i}</link><pubDate>2006-01-02</pubDate></item>" for i in n)
    rss = "<rss><channel><title>x</title>{}</channel></rss>"
    first = run(0, rss.format(new(1, 2)))
    assert first == {(71, "https://n.example/1"), (72, "https://n.example/2")}
    for name in os.listdir(out):
        if name.startswith("batch_id="):
            spark.createDataFrame([], "id bigint, itemurl string").write.mode("overwrite").parquet(f"{out}/{name}")
    second = run(1, rss.format(new(2, 3, 1)) )
    assert {u for _, u in second} == {"https://n.example/3"} and min(i for i, _ in second) > 72
    assert {u for _, u in run(2, ATOM)} == {"https://n.example/3"}


def test_ingest_is_exact_across_restarts_and_replays(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    posts = spark.createDataFrame([("https://atom.example/1",)], "itemurl string")

    def feed(i, body):
        df = spark.createDataFrame([(i, i, "u", 200, body)],
                                   "document_id bigint, feed_id bigint, url string, status int, body string")
        df.withColumn("fetched_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(src)

    def run():
        jobs.run_post_ingest(stream_bodies(spark, src), posts, out, ck).awaitTermination()
        return rows(read_batches(spark, out, "itemurl string"))

    feed(0, RSS)
    assert run() == [("https://ada.example/1?a=1&b=2",)]
    feed(1, RSS)
    feed(2, ATOM.replace("atom.example/1", "atom.example/new"))
    want = [("https://ada.example/1?a=1&b=2",), ("https://atom.example/new",)]
    assert run() == want
    assert run() == want
    # Replaying a batch overwrites its own folder.
    again = read_batches(spark, out, "itemurl string, item_no int").filter("itemurl LIKE '%new'").cache()
    again.count()
    write_batch(again, out, 1)
    assert run() == want
    assert read_bodies(spark, src).count() == 3


def test_ingest_replays_a_lost_batch_and_keeps_links_outside_python(spark, tmp_path, monkeypatch):
    """A batch lost after its links were appended comes once; the state is the engine's own and holds links only."""
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    posts = spark.createDataFrame([(7, "https://atom.example/1"), (8, None)], "id bigint, itemurl string")
    item = "<item><title>{}</title><link>https://n.example/{}</link><pubDate>2006-01-02</pubDate></item>"

    def feed(*bodies):
        data = [(i, i, "u", 200, f"<rss><channel><title>x</title>{b}</channel></rss>") for i, b in bodies]
        df = spark.createDataFrame(data, "document_id bigint, feed_id bigint, url string, status int, body string")
        df.withColumn("fetched_at", F.current_timestamp()).write.mode("append").parquet(src)

    def run():
        jobs.run_post_ingest(stream_bodies(spark, src), posts, out, ck).awaitTermination()
        got = read_batches(spark, out, "id bigint, document_id bigint, itemurl string, itemtitle string")
        return {r["itemurl"]: r for r in got.collect()}, got.count()

    feed((5, item.format("five", 1)), (3, item.format("three", 1) + item.format("again", 1)), (4, item.format("x", 2)))

    def lost(*_):
        raise RuntimeError("lost")

    for part in ("append_rows", "write_batch"):
        with monkeypatch.context() as m, pytest.raises(Exception, match="lost"):
            m.setattr(jobs, part, lost)
            run()
    got, n = run()
    assert n == len(got) == 2 and got["https://n.example/1"]["itemtitle"] == "three"
    assert {r["id"] for r in got.values()} == {9, 10}
    feed((1, item.format("late", 1) + item.format("y", 3)), (2, ATOM))
    got, n = run()
    assert n == len(got) == 3 and got["https://n.example/1"]["document_id"] == 3
    state = spark.read.format("state-metadata").load(f"{ck}-links").first()
    assert state["operatorName"] == "dedupe"


def test_ingest_keeps_items_once_and_one_batch_of_parsed_ones(spark, tmp_path, monkeypatch):
    """Look-up, state and numbering carry links and row numbers, so items lie in the table and in the last batch's folder."""
    src, out, ck = (str(tmp_path / name) for name in ("in", "out", "ck"))
    monkeypatch.setattr(storage, "shared_dir", lambda spark, purpose: str(tmp_path / f"{purpose}-{uuid.uuid4().hex}"))
    posts = spark.createDataFrame([(7, "https://n.example/0")], "id bigint, itemurl string")
    item = "<item><title>{0}</title><link>https://n.example/{0}</link><pubDate>2006-01-02</pubDate></item>"
    n, batches = 20, 3
    for b in range(batches):
        body = "".join(item.format(i) for i in range(b * n, (b + 1) * n))
        df = spark.createDataFrame([(b, b, "u", 200, f"<rss><channel><title>x</title>{body}</channel></rss>")],
                                   "document_id bigint, feed_id bigint, url string, status int, body string")
        df.withColumn("fetched_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(src)
        jobs.run_post_ingest(stream_bodies(spark, src), posts, out, ck).awaitTermination()
    got = read_batches(spark, out, "id bigint, itemurl string, itemtitle string").collect()
    assert {r["itemtitle"] for r in got} == {str(i) for i in range(1, batches * n)}
    assert len(got) == len({r["id"] for r in got}) == batches * n - 1
    kept = {"items": 0, "links": 0}
    for file in glob.glob(f"{tmp_path}/**/*.parquet", recursive=True):
        held = pq.ParquetFile(file)
        kind = "items" if "itemtitle" in held.schema_arrow.names else "links" if "known" in held.schema_arrow.names else None
        if kind:
            kept[kind] += held.metadata.num_rows
    assert kept["items"] == len(got) + n  # the table and one micro-batch of parsed items
    assert kept["links"] <= n


def test_ingest_takes_a_document_twice_in_a_batch(spark, tmp_path):
    """Two fetches of one document give equal places; each link still comes once, with an id of its own."""
    src, out, ck = (str(tmp_path / name) for name in ("in", "out", "ck"))
    posts = spark.createDataFrame([], "id bigint, itemurl string")
    item = "<item><title>t</title><link>https://n.example/{}</link><pubDate>2006-01-02</pubDate></item>"
    bodies = ["".join(item.format(i) for i in links) for links in ((1, 2), (1, 2), (1, 3))]
    df = spark.createDataFrame([(5, 1, "u", 200, f"<rss><channel><title>x</title>{b}</channel></rss>") for b in bodies],
                               "document_id bigint, feed_id bigint, url string, status int, body string")
    df.withColumn("fetched_at", F.current_timestamp()).write.parquet(src)
    jobs.run_post_ingest(stream_bodies(spark, src), posts, out, ck).awaitTermination()
    got = read_batches(spark, out, "id bigint, itemurl string").collect()
    assert sorted(r["itemurl"][-1] for r in got) == ["1", "2", "3"]
    assert {r["id"] for r in got} == {1, 2, 3}


def test_sparing_disk_drops_shuffle_files_with_the_write(spark, tmp_path):
    """Shuffle files would stay until the driver collects its garbage."""
    disk = spark._jsc.sc().env().blockManager().diskBlockManager()
    codec = spark.conf.get("spark.sql.parquet.compression.codec")

    def added(path):
        before = disk.getAllFiles().size()
        spark.range(1000).repartition(3, "id").write.parquet(path)
        for _ in range(50):  # removal runs beside the driver
            if disk.getAllFiles().size() <= before:
                break
            time.sleep(0.1)
        return disk.getAllFiles().size() - before

    with sparing_disk(spark):
        assert added(str(tmp_path / "spared")) <= 0
    assert spark.conf.get("spark.sql.parquet.compression.codec") == codec
    assert rows(spark.read.parquet(str(tmp_path / "spared"))) == rows(spark.range(1000))
    assert glob.glob(f"{tmp_path}/spared/*.zstd.parquet")


def test_ingest_with_keyed_state_gives_the_same(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    df = spark.createDataFrame([(i, i, "u", 200, RSS) for i in range(5)],
                               "document_id bigint, feed_id bigint, url string, status int, body string")
    df.withColumn("fetched_at", F.to_timestamp(F.lit("2024-01-01"))).write.parquet(src)
    none = spark.createDataFrame([], "itemurl string")
    jobs.run_post_ingest(stream_bodies(spark, src), none, out, ck, lateness="1 hour").awaitTermination()
    assert rows(read_batches(spark, out, "itemurl string")) == [("https://ada.example/1?a=1&b=2",)]


def test_error_counters_equal_batch_over_many_micro_batches(spark, platform, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    attempts = platform.scrape_attempts
    attempts.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.run_scrape_errors(stream, out, ck).awaitTermination()
    schema = ("error_type string, feed_id bigint, n bigint, first_id bigint, first_ts timestamp_ntz,"
              " last_ts timestamp_ntz, first_retries int, message string, status_code int")
    logs = platform.scraper_error_logs.filter("feed_id > 3")
    batch = ingest.scrape_error_upsert(logs, ingest.error_counters(ingest.classify_scrape_errors(attempts)))
    assert rows(jobs.current_errors(logs, read_batches(spark, out, schema))) == rows(batch)


def test_challenges_expire_once_unresolved(spark, tmp_path):
    a, b, out, ck = tmp_path / "a", tmp_path / "b", str(tmp_path / "out"), str(tmp_path / "ck")
    opened, closed = "id bigint, user_id bigint, created_at timestamp", "id bigint, resolved_at timestamp"
    put(spark, a, [(1, 9, "2024-01-01 00:00:00"), (2, 9, "2024-01-01 00:00:00"), (3, 9, "2024-01-01 00:00:00"),
                   (4, 9, "2024-01-09 00:00:00")], opened)
    put(spark, b, [(1, "2024-01-01 12:00:00"), (2, "2024-01-02 00:00:01"), (9, "2024-01-09 00:00:00")], closed)
    left = spark.readStream.schema(opened).parquet(str(a))
    right = spark.readStream.schema(closed).parquet(str(b))
    jobs.append_to(jobs.expired_challenges(left, right), out, ck).awaitTermination()
    assert rows(read_batches(spark, out, "id bigint, status string")) == [(2, "failed"), (3, "failed")]


def test_day_folders_prune_and_retention(spark, platform, tmp_path):
    path = str(tmp_path / "notes")
    write_by_day(platform.notifications, path)
    back = spark.read.parquet(path)
    assert back.count() == platform.notifications.count()
    recent = back.filter(F.col("day") >= F.lit("2024-01-30").cast("date"))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    cut = F.to_timestamp_ntz(F.lit("2024-01-30 00:00:00"))
    done = purge_older_than(platform.notifications, cut, 0)
    assert done.table.count() + done.changed.count() == platform.notifications.count()


def test_bucketed_follows_join_without_shuffling_them(spark, platform, tmp_path):
    write_bucketed(platform.feed_follows, "follows_by_feed", "feed_id", 4, str(tmp_path / "f"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        follows = spark.table("follows_by_feed")
        counts = follows.groupBy("feed_id").count()
        assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE follows_by_feed")


def test_staged(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert rows(staged(df, "t")) == rows(df)


@pytest.mark.parametrize("table", ["events"])
def test_table_stream_reads_only_its_table(spark, table):
    assert jobs.table_stream(spark, SF, table).isStreaming


def test_stream_table_retention(spark, tmp_path):
    notes = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 02:00:00")], "id int, created_at string")
    write_batch(notes.withColumn("created_at", F.to_timestamp("created_at")), str(tmp_path), 0)
    kept = jobs.purge_stream_table(
        spark, str(tmp_path), "id int, created_at timestamp", F.to_timestamp(F.lit("2024-01-01 03:00:00")), 100)
    assert rows(kept.select("id")) == [(2,)]
