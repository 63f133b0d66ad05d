"""Every job bound to the given tables: name -> callable(spark, folder) -> DataFrame.

Outputs use plain types (decimals as doubles, arrays as text, hashes for long text) so
that they compare directly with the SQL in `oracle.py`.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspan.functions import checks, gateway
from feedspan.functions.html import sanitize_html
from feedspan.functions.timestamps import (
    as_ntz,
    format_timestamp,
    parse_any_timestamp,
    plan_end_date,
    refine_interval,
)
from feedspan.operators import changes
from feedspan.operators.summaries import facet_values, numbered_facet
from feedspan.operators.defaults import complete
from feedspan.operators.lookup import key_lookup
from feedspan.operators.paging import page_after, page_at, page_metadata
from feedspan.operators.search import search_all, token_index
from feedspan.plans import discovery, ingest, moderation, notifications, subscriptions
from feedspan.session import configure, shared_dir
from feedspan.sources.documents import page_bodies, rendered_bodies
from feedspan.sources.keyed import KeyedTable, purge_days
from feedspan.sources.platform import EVENTS_AS_OF, ORDERS_AS_OF, Platform
from feedspan.sources.storage import read_batches, sparing_disk, write_by_day
from feedspan.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EVENTS = EVENTS_AS_OF
ORDERS = ORDERS_AS_OF


def query(build: Callable[[Platform], DataFrame]) -> Callable[[Platform], DataFrame]:
    """Register a job under its function name."""
    QUERIES[build.__name__] = lambda spark, folder: plain(build(Platform(configure(spark), folder)))
    return build


def plain(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), ",")
        elif kind == "date":
            c = c.cast("timestamp_ntz")
        elif kind == "timestamp":
            c = F.unix_seconds(c)
        elif f.name == "row_num":
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def outcomes(**parts: DataFrame) -> DataFrame:
    """Frames of one shape stacked, each row tagged with the name of its frame."""
    tagged = [df.withColumn("outcome", F.lit(name)) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged)


def hashed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.md5(c) for c in columns})


# Timelines and discovery


@query
def feed_catalog(p):
    return discovery.feed_catalog(p.feeds, page_size=100)


@query
def feed_catalog_search(p):
    return discovery.feed_catalog(p.feeds, search="PLATE", feed_type="promo", page=1, page_size=10)


@query
def feed_catalog_compat(p):
    return discovery.feed_catalog(
        p.feeds, search="plate", feed_type="promo", page=1, page_size=100, compat=True
    )


@query
def feed_catalog_metadata(p):
    return page_metadata(
        p.feeds.filter("NOT is_hidden AND approval_status = 'approved'"), page=3, page_size=7
    )


@query
def posts_deep_page(p):
    """A page from the middle of all posts, by ranges."""
    return page_at(p.posts, [("created_at", True), ("id", False)], 31, 17).select("id", "created_at", "feed_id", "total_records")


@query
def never_fetched_page(p):
    """A page that begins among dated feeds and ends among those never fetched."""
    return page_at(p.feeds, [("last_fetched_at", True), ("id", True)], 19, 100).select("id", "last_fetched_at", "total_records")


@query
def feed_catalog_page_after(p):
    shown = p.feeds.filter("NOT is_hidden AND approval_status = 'approved'")
    last = as_ntz("1995-06-01 00:00:00")
    return page_after(shown, [("created_at", True), ("id", False)], [last, 100], 50)


@query
def feed_catalog_with_follow_flag(p):
    return discovery.feed_catalog_with_follow_flag(
        p.feeds, p.feed_follows, p.users.select(F.col("id").alias("user_id"))
    ).select("user_id", "feed_id", "row_num", "name", "is_hidden", "is_followed", "follow_id",
             "total_records")


@query
def followed_feeds(p):
    return discovery.followed_feeds(p.feeds, p.feed_follows)


@query
def followed_feeds_search(p):
    return discovery.followed_feeds(
        p.feeds, p.feed_follows, search="ring", page=2, page_size=3, visible_only=True
    )


TIMELINE = ["user_id", "post_id", "feed_id", "row_num", "channeltitle", "itemtitle",
            "itemcontent", "itemurl", "created_at", "is_favorite", "total_records"]


@query
def user_timeline(p):
    rows = discovery.user_timeline(p.posts, p.feed_follows, p.favorites)
    return hashed(rows.select(*TIMELINE), "itemtitle", "itemcontent")


@query
def user_timeline_after(p):
    """The page that follows each user's first one."""
    first = discovery.user_timeline(p.posts, p.feed_follows, p.favorites)
    last = first.groupBy("user_id").agg(F.max_by(F.struct("created_at", "post_id"), "row_num").alias("at"))
    rows = discovery.user_timeline_after(p.posts, p.feed_follows, p.favorites, last.select("user_id", "at.*"))
    return hashed(rows.select(*[c for c in TIMELINE if c != "total_records"]), "itemtitle", "itemcontent")


@query
def user_timeline_from_start(p):
    cursors = p.favorites.selectExpr("user_id", "CAST(NULL AS TIMESTAMP_NTZ) AS created_at", "CAST(NULL AS BIGINT) AS post_id")
    rows = discovery.user_timeline_after(
        p.posts, p.feed_follows, p.favorites, cursors.distinct(), search="the", page_size=7)
    return hashed(rows.select(*[c for c in TIMELINE if c != "total_records"]), "itemtitle", "itemcontent")


@query
def user_timeline_search(p):
    rows = discovery.user_timeline(
        p.posts, p.feed_follows, p.favorites, search="The of", page=2, page_size=3
    )
    return hashed(rows.select(*TIMELINE), "itemtitle", "itemcontent")


@query
def user_timeline_one_feed(p):
    readers = p.favorites.select("user_id")
    rows = discovery.user_timeline(p.posts, p.feed_follows, p.favorites, readers, feed_id=17)
    return hashed(rows.select(*TIMELINE), "itemtitle", "itemcontent")


@query
def favorite_timeline(p):
    rows = discovery.favorite_timeline(p.posts, p.feed_follows, p.favorites)
    return hashed(rows.select(*TIMELINE, "is_followed_feed"), "itemtitle", "itemcontent")


@query
def favorite_refs(p):
    return discovery.favorite_refs(p.favorites, p.comments.select("user_id"))


@query
def post_user_flags(p):
    asked = p.comments.select("user_id", "post_id").union(p.favorites.select("user_id", "post_id"))
    rows = discovery.post_user_flags(p.posts, p.feed_follows, p.favorites, asked)
    return rows.select("user_id", "post_id", "feed_id", "itemurl", "created_at", "is_favorite",
                       "is_followed_feed")


@query
def sample_posts_per_feed(p):
    return discovery.sample_posts_per_feed(p.posts, 3, seed="s1").select("feed_id", "id", "row_num")


@query
def creator_feed_dashboard(p):
    return discovery.creator_feed_dashboard(
        p.feeds, p.feed_follows, p.feed_rejections, p.users
    ).drop("version", "img_url", "last_fetched_at")


@query
def feed_like_stats(p):
    return discovery.feed_like_stats(p.feeds, p.users, p.posts, p.favorites)


@query
def top_followed_feeds(p):
    return discovery.top_followed_feeds(p.feeds, p.feed_follows, 20)


@query
def top_followed_visible_feeds(p):
    return discovery.top_followed_feeds(p.feeds, p.feed_follows, 20, visible_only=True)


def _creators(p, **options):
    rows = discovery.top_feed_creators(
        p.feeds, p.feed_follows, p.posts, p.favorites, p.comments, p.users, **options
    )
    return rows.withColumns(
        {c: F.round(c, 6) for c in ["avg_time_between_feeds", "score"]}
    )


@query
def top_feed_creators(p):
    return _creators(p, page_size=20)


@query
def top_feed_creators_jitter(p):
    return _creators(p, page=2, page_size=10, jitter_seed="j").select("user_id", "score")


@query
def top_feed_creators_by_score(p):
    return _creators(p, page=2, page_size=15, by_score=True)


@query
def comment_threads(p):
    return hashed(discovery.comment_threads(p.comments, p.users, viewer=7), "comment_text")


@query
def facet_feeds(p):
    return facet_values(p.feeds, "id", "name")


@query
def facet_feed_types(p):
    return numbered_facet(p.feeds, "feed_type")


@query
def facet_feed_names(p):
    return numbered_facet(p.feeds, "name")


@query
def facet_priorities(p):
    return numbered_facet(p.feeds, "priority")


@query
def facet_error_types(p):
    return numbered_facet(p.scraper_error_logs, "error_type")


@query
def feed_by_id(p):
    return key_lookup(p.feeds, p.favorites.select(F.col("feed_id").alias("id")), ["id"])


@query
def comment_by_id_and_owner(p):
    keys = p.raw("conversations").selectExpr(
        "conv_id * 100 + turn AS id", "(conv_id + 1) % 150 AS user_id"
    )
    return hashed(key_lookup(p.comments, keys, ["id", "user_id"]), "comment_text")


@query
def plan_by_id(p):
    keys = p.subscriptions.select(F.col("plan_id").alias("id"))
    return key_lookup(p.payment_plans, keys, ["id"], where=F.col("status") == "active")


@query
def admin_plan_by_id(p):
    return key_lookup(p.payment_plans, p.subscriptions.select(F.col("plan_id").alias("id")), ["id"])


@query
def error_log_by_id(p):
    found = key_lookup(p.scraper_error_logs, p.scrape_attempts.select("id"), ["id"])
    return moderation.error_log_detail(found, p.feeds)


@query
def user_by_email(p):
    keys = p.raw("supplier").selectExpr(
        "upper('customer#' || lpad(CAST(s_suppkey * 7 AS STRING), 9, '0') || '@example.com') AS email"
    )
    return key_lookup(p.users, keys, ["email"], ignore_case=True)


@query
def search_feeds(p):
    searches = p.feeds.select(F.col("name").alias("search_id"), F.col("name").alias("search_text"))
    return search_all(p.feeds, searches.distinct(), "id", "name", rows_per_slice=500)


@query
def post_title_tokens(p):
    return token_index(p.posts, "id", "itemtitle")


@query
def page_tokens(p):
    """Tokens of raw web pages, which hold addresses, hyphens, signs, entities and markup."""
    return token_index(p.raw("pages"), "page_id", "html")


# Moderation and platform


@query
def moderation_queue(p):
    return moderation.moderation_queue(p.feeds, p.users, as_ntz(EVENTS), page_size=100).drop(
        "version", "img_url", "feed_description", "last_fetched_at")


@query
def moderation_queue_compat(p):
    return moderation.moderation_queue(
        p.feeds, p.users, as_ntz(EVENTS), search="plate", page=2, page_size=5, compat=True
    ).drop("version", "img_url", "feed_description", "last_fetched_at")


@query
def feed_admin_board(p):
    return moderation.feed_admin_board(p.feeds, p.users, p.feed_follows, page_size=100).drop(
        "version", "img_url", "feed_description")


@query
def feed_admin_board_filtered(p):
    return moderation.feed_admin_board(
        p.feeds, p.users, p.feed_follows, search="ring", feed_type="large", hidden=False,
        priority="normal", page_size=100, compat=True,
    ).drop("version", "img_url", "feed_description")


@query
def user_directory(p):
    return moderation.user_directory(p.users, p.users_permissions, p.permissions, page=None)


@query
def user_directory_page(p):
    return moderation.user_directory(
        p.users, p.users_permissions, p.permissions, search="customer", page=3, page_size=15
    )


@query
def permission_grants(p):
    return moderation.permission_grants(p.users, p.users_permissions, p.permissions)


@query
def permission_codes(p):
    return moderation.permission_codes(p.permissions)


@query
def user_permission_codes(p):
    codes = moderation.user_permission_codes(p.users, p.users_permissions, p.permissions)
    return codes.withColumn("is_admin", moderation.includes(F.col("permissions"), "nation_3:read"))


@query
def platform_statistics(p):
    return moderation.platform_statistics(p.users, p.subscriptions, p.comments, as_ntz(EVENTS))


@query
def scraper_error_board(p):
    return moderation.scraper_error_board(p.scraper_error_logs, p.feeds, page_size=100)


@query
def scraper_error_board_filtered(p):
    return moderation.scraper_error_board(
        p.scraper_error_logs, p.feeds, error_type="FeedType", page=2, page_size=20
    )


@query
def unread_announcements(p):
    return moderation.unread_announcements(p.announcements, p.announcement_reads, 15)


@query
def unread_unexpired_announcements(p):
    return moderation.unread_announcements(
        p.announcements, p.announcement_reads, 15, as_ntz(EVENTS)
    )


@query
def unread_inbox(p):
    return moderation.unread_inbox(p.users.select(F.col("id").alias("user_id")), p.announcements, p.announcement_reads)


@query
def announcement_list(p):
    return moderation.announcement_list(p.announcements)


@query
def usage_quota(p):
    return moderation.usage_quota(
        p.users, p.feed_follows, p.feeds, p.comments, as_ntz(EVENTS)
    )


# Subscriptions and revenue


@query
def plan_catalog(p):
    return subscriptions.plan_catalog(p.payment_plans)


@query
def plan_catalog_all(p):
    return subscriptions.plan_catalog(p.payment_plans, active_only=False)


@query
def running_subscriptions(p):
    return subscriptions.running_subscriptions(p.subscriptions, as_ntz(ORDERS))


@query
def current_subscription(p):
    return subscriptions.current_subscription(p.subscriptions, p.payment_plans, as_ntz(ORDERS))


@query
def subscription_history(p):
    return subscriptions.subscription_history(p.subscriptions, p.payment_plans, page=1, page_size=5)


@query
def all_subscriptions(p):
    return subscriptions.all_subscriptions(
        p.subscriptions, p.payment_plans, p.challenged_transactions, page=None
    )


@query
def all_subscriptions_page(p):
    return subscriptions.all_subscriptions(
        p.subscriptions, p.payment_plans, p.challenged_transactions, page=2, page_size=50
    )


@query
def renewal_candidates(p):
    return subscriptions.renewal_candidates(
        p.subscriptions, p.users, p.challenged_transactions, as_ntz(ORDERS)
    )


@query
def next_renewals(p):
    return subscriptions.next_renewals(
        subscriptions.renewal_candidates(
            p.subscriptions, p.users, p.challenged_transactions, as_ntz(ORDERS)
        )
    )


@query
def pending_challenges_by_user(p):
    return subscriptions.pending_challenges(
        p.challenged_transactions, p.users_permissions, "user_id"
    )


@query
def pending_challenges_by_subscription(p):
    keys = p.subscriptions.filter("status = 'active'").select(
        F.col("id").alias("referenced_subscription_id")
    )
    return subscriptions.pending_challenges(
        p.challenged_transactions, keys, "referenced_subscription_id"
    )


@query
def pending_challenges_by_reference(p):
    keys = p.raw("part").selectExpr("'ref-' || p_partkey * 6 AS reference")
    return subscriptions.pending_challenges(p.challenged_transactions, keys, "reference")


@query
def challenge_detail(p):
    return subscriptions.challenge_detail(p.challenged_transactions, p.subscriptions, p.users)


def _kpis(p, compat):
    rows = subscriptions.subscription_kpis(
        p.subscriptions, p.challenged_transactions, p.failed_transactions, as_ntz(ORDERS), compat
    )
    return rows.withColumns(
        {c: F.round(c, 4) for c in ["churn_rate", "average_revenue_per_user", "average_duration",
                                    "challenged_rate"]}
    )


@query
def subscription_kpis(p):
    return _kpis(p, False)


@query
def subscription_kpis_compat(p):
    return _kpis(p, True)


@query
def revenue_by_plan(p):
    return subscriptions.revenue_by_plan(p.subscriptions, p.payment_plans)


@query
def challenge_outcomes(p):
    return subscriptions.challenge_outcomes(p.challenged_transactions)


@query
def revenue_by_payment_method(p):
    return subscriptions.revenue_by_payment_method(p.subscriptions)


@query
def subscriptions_over_time(p):
    return subscriptions.subscriptions_over_time(p.subscriptions, as_ntz(ORDERS))


@query
def new_vs_cancelled(p):
    return subscriptions.new_vs_cancelled(p.subscriptions, as_ntz(ORDERS))


@query
def subscriptions_by_currency(p):
    return subscriptions.subscriptions_by_currency(p.subscriptions)


@query
def subscription_report(p):
    """All parts of the report as (part, name, value)."""
    parts = subscriptions.subscription_report(
        p.subscriptions, p.payment_plans, p.challenged_transactions, p.failed_transactions,
        as_ntz(ORDERS),
    )
    one_row = [parts.pop("kpis"), parts.pop("new_vs_cancelled")]
    def pair(f):
        """A column of a one-row part; a text becomes part of the name."""
        if f.dataType.simpleString() == "string":
            return F.struct(F.concat(F.lit(f"{f.name}="), F.col(f.name)).alias("name"), F.lit(1.0).alias("value"))
        return F.struct(F.lit(f.name).alias("name"), F.round(F.col(f.name).cast("double"), 4).alias("value"))

    rows = [
        df.select(F.lit(part).alias("part"), F.inline(F.array(*[pair(f) for f in df.schema.fields])))
        for part, df in zip(["kpis", "new_vs_cancelled"], one_row, strict=True)
    ] + [
        df.select(
            F.lit(part).alias("part"), F.col(df.columns[0]).cast("string").alias("name"),
            F.col(df.columns[1]).cast("double").alias("value"),
        )
        for part, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, rows)


# Notifications


@query
def new_post_notifications(p):
    return notifications.new_post_notifications(p.post_arrivals, p.feeds, as_ntz(EVENTS), 1440)


@query
def notification_rows(p):
    counts = notifications.new_post_notifications(p.post_arrivals, p.feeds, as_ntz(EVENTS), 100)
    new = notifications.notification_rows(counts, as_ntz(EVENTS), p.notifications)
    return changes.append_rows(p.notifications, new).table


@query
def user_notifications(p):
    return notifications.user_notifications(p.notifications, p.feed_follows, as_ntz(EVENTS), 100)


@query
def comment_notifications(p):
    rows = notifications.comment_notifications(
        p.comment_notifications, p.comments, p.posts, p.favorites, F.lit(-1).cast("bigint")
    )
    return hashed(rows, "post_title")


@query
def notifications_bundle(p):
    rows = notifications.notifications_bundle(
        notifications.user_notifications(p.notifications, p.feed_follows, as_ntz(EVENTS), 100),
        notifications.comment_notifications(
            p.comment_notifications, p.comments, p.posts, p.favorites, F.lit(-1).cast("bigint")
        ),
    )
    return hashed(rows, "subject")


@query
def purge_notifications(p):
    done = changes.purge_older_than(p.notifications, as_ntz(EVENTS), 10000)
    return outcomes(kept=done.table, purged=done.changed)


@query
def purge_notification_days(p):
    path = shared_dir(p.spark, "notification-days")
    write_by_day(p.notifications, path)
    purge_days(p.spark, path, p.notifications.schema, datetime.fromisoformat(EVENTS), 10000)
    return p.spark.read.schema(p.notifications.schema).parquet(path).select(*p.notifications.columns)


@query
def append_comment_notifications(p):
    new = notifications.comment_notification_rows(p.comments, p.comment_notifications)
    return changes.append_rows(p.comment_notifications, new, ["comment_id"]).table


@query
def delete_read_comment_notifications(p):
    done = changes.delete_by_keys(p.comment_notifications, p.favorites.select("post_id"), ["post_id"])
    return outcomes(kept=done.table, deleted=done.changed)


@query
def delete_own_comment_notifications(p):
    read = p.favorites.select("post_id", "user_id")
    return changes.delete_by_keys(p.comment_notifications, read, ["post_id", "user_id"]).table


# Ingest


@query
def fetch_schedule(p):
    return ingest.fetch_schedule(p.feeds, 50).select("id", "url", "last_fetched_at")


@query
def mark_fetched(p):
    picked = ingest.fetch_schedule(p.feeds, 50)
    return ingest.mark_fetched(p.feeds, picked, as_ntz(EVENTS)).table.select("id", "last_fetched_at")


@query
def parse_feed_documents(p):
    rows = ingest.parse_feed_documents(rendered_bodies(p))
    return hashed(rows, "item_title", "item_description").drop("item_image_url")


POST_COLUMNS = ["id", "document_id", "item_no", "feed_id", "channeltitle", "channelurl",
                "channeldescription", "channellanguage", "itemtitle", "itemdescription", "itemcontent",
                "itemurl", "img_url", "itempublished_at", "created_at", "updated_at"]


@query
def ingest_posts(p):
    done = ingest.ingest_posts(rendered_bodies(p), p.posts, as_ntz(EVENTS))
    refused = done.rejected.select(*POST_COLUMNS, F.col("reason").alias("outcome"))
    rows = outcomes(accepted=done.changed.select(*POST_COLUMNS)).unionByName(refused)
    # Duplicates are not sanitised, so their text stays out of the comparison.
    kept = F.col("outcome") == "accepted"
    return rows.withColumns(
        {c: F.when(kept, F.md5(c)) for c in ["itemtitle", "itemdescription"]}
    )


@query
def sanitized_pages(p):
    rows = ingest.sanitize_items(ingest.parse_feed_documents(page_bodies(p)))
    return rows.select("document_id", "item_link", "item_content")


@query
def sanitized_pages_strict(p):
    return p.raw("pages").select(
        "page_id", F.md5(sanitize_html(F.col("html"), strict=True)).alias("text")
    )


@query
def sanitized_documents_strict(p):
    return p.posts.select("id", F.md5(sanitize_html(F.col("itemcontent"), strict=True)).alias("text"))


@query
def classify_scrape_errors(p):
    return ingest.classify_scrape_errors(p.scrape_attempts)


def _known_errors(p):
    """The error table as it was after four days."""
    return p.scraper_error_logs.filter("occurred_at < TIMESTAMP_NTZ'2024-01-05 00:00:00'")


@query
def scrape_error_upsert(p):
    known = _known_errors(p)
    counted = ingest.error_counters(ingest.classify_scrape_errors(p.scrape_attempts))
    return ingest.scrape_error_upsert(known, counted).drop("resolution_notes")


# Change jobs


def _split(done: changes.Change, *columns: str) -> DataFrame:
    return done.judged.select(*columns, F.col("__state").alias("outcome"))


@query
def insert_feeds(p):
    batch = p.raw("orders").selectExpr(
        "o_orderkey AS seq", "'https://feeds.example.com/' || (o_orderkey DIV 2) AS url",
        "o_custkey AS user_id",
    )
    return _split(changes.insert_unique(p.feeds, complete(batch, p.feeds, "feeds", as_ntz(EVENTS)), ["url"], ["seq"]), "id", "seq", "url", "user_id")


@query
def insert_feeds_table(p):
    batch = p.raw("orders").selectExpr(
        "o_orderkey AS seq", "'https://feeds.example.com/' || (o_orderkey DIV 2) AS url",
        "o_custkey AS user_id",
    )
    batch = complete(batch, p.feeds, "feeds", as_ntz(EVENTS))
    done = changes.insert_unique(p.feeds, batch, ["url"], ["seq"])
    return done.table.select(
        "id", "url", "user_id", "version", "img_url", "feed_type", "feed_description", "is_hidden",
        "approval_status", "priority", "created_at", "last_fetched_at",
    )


def _event_pairs(p, target):
    return p.raw("events").selectExpr(
        "event_id AS seq", "user_id", f"CAST(floor(value) AS BIGINT) AS {target}"
    )


@query
def insert_feed_follows(p):
    done = changes.insert_unique(
        p.feed_follows, complete(_event_pairs(p, "feed_id"), p.feed_follows, "feed_follows", as_ntz(EVENTS)), ["user_id", "feed_id"], ["seq"]
    )
    return _split(done, "id", "seq", "user_id", "feed_id", "created_at")


@query
def new_follow_ids(p):
    done = changes.insert_unique(
        p.feed_follows, complete(_event_pairs(p, "feed_id"), p.feed_follows, "feed_follows", as_ntz(EVENTS)), ["user_id", "feed_id"], ["seq"]
    )
    return done.changed.select(
        "id", "user_id", "feed_id"
    )


@query
def insert_favorites(p):
    done = changes.insert_unique(
        p.favorites, complete(_event_pairs(p, "post_id"), p.favorites, "favorites", as_ntz(EVENTS)), ["user_id", "post_id"], ["seq"]
    )
    return _split(done, "id", "seq", "user_id", "post_id", "created_at")


@query
def insert_subscriptions(p):
    batch = p.raw("events").selectExpr(
        "event_id AS seq", "user_id", "event_id DIV 3 AS transaction_id",
        "CASE WHEN event_id % 7 > 1 THEN 'AUTH_' || (event_id DIV 3 + event_id % 2) END AS authorization_code",
    )
    done = changes.insert_unique(
        p.subscriptions, complete(batch, p.subscriptions, "subscriptions", as_ntz(EVENTS)), ["transaction_id", "authorization_code"], ["seq"]
    )
    return _split(done, "id", "seq", "transaction_id", "authorization_code", "currency", "start_date")


@query
def insert_permissions(p):
    batch = p.raw("supplier").selectExpr(
        "s_suppkey AS seq", "'nation_' || (s_suppkey % 40) || ':read' AS code"
    )
    return _split(changes.insert_unique(p.permissions, complete(batch, p.permissions, "permissions", as_ntz(EVENTS)), ["code"], ["seq"]), "id", "seq", "code")


@query
def insert_plans(p):
    regions = p.raw("region").selectExpr("r_regionkey AS k", "r_name")
    batch = p.raw("nation").join(regions, F.col("n_regionkey") == F.col("k")).selectExpr(
        "n_nationkey AS seq", "CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE n_name END AS name"
    )
    return _split(changes.insert_unique(p.payment_plans, complete(batch, p.payment_plans, "payment_plans", as_ntz(EVENTS)), ["name"], ["seq"]), "id", "seq", "name", "duration", "status", "version")


@query
def insert_users(p):
    batch = p.raw("supplier").selectExpr(
        "s_suppkey AS seq",
        "'CUSTOMER#' || lpad(CAST((s_suppkey DIV 2) * 40 AS STRING), 9, '0')"
        " || CASE WHEN s_suppkey % 2 = 0 THEN '@EXAMPLE.com' ELSE '@example.COM' END AS email",
    )
    done = changes.insert_unique(p.users, complete(batch, p.users, "users", as_ntz(EVENTS)), ["email"], ["seq"], ignore_case=True)
    return _split(done, "id", "seq", "email", "activated", "version", "created_at")


@query
def grant_permissions(p):
    asked = p.raw("supplier").selectExpr(
        "s_suppkey AS user_id",
        "explode(array('nation_' || s_nationkey || ':read', 'nation_' || (s_nationkey + 1) % 25"
        " || ':read', 'missing:read')) AS code",
    )
    known = p.permissions.select(F.col("id").alias("permission_id"), "code")
    batch = asked.join(known, "code")
    done = changes.insert_unique(
        p.users_permissions, batch, ["user_id", "permission_id"], ["code"]
    )
    return _split(done, "user_id", "permission_id")


@query
def append_comments(p):
    batch = p.raw("events").filter("event_type = 'purchase'").selectExpr(
        "event_id AS seq", "event_id % 200 AS post_id", "user_id", "props AS comment_text", "ts AS created_at", "1 AS version",
    )
    return hashed(changes.append_rows(p.comments, batch, ["seq"]).table, "comment_text")


@query
def append_challenges(p):
    batch = p.subscriptions.filter("status = 'expired'").selectExpr(
        "user_id", "id AS referenced_subscription_id", "'new-' || (id DIV 8) AS reference",
        "'pending' AS status", "end_date AS created_at",
    )
    return changes.append_rows(p.challenged_transactions, complete(batch, p.challenged_transactions, "challenged_transactions", as_ntz(ORDERS)), ["referenced_subscription_id"]).table


@query
def append_failed_transactions(p):
    batch = p.subscriptions.filter("status = 'cancelled'").selectExpr(
        "user_id", "id AS subscription_id", "'new-' || (id DIV 8) AS reference",
        "'Declined' AS failure_reason", "end_date AS attempt_date",
    )
    return changes.append_rows(p.failed_transactions, complete(batch, p.failed_transactions, "failed_transactions", as_ntz(ORDERS)), ["subscription_id"]).table


@query
def append_announcements(p):
    batch = p.raw("nation").selectExpr(
        "n_nationkey AS seq", "n_name AS title", "'hello' AS message", "n_nationkey % 2 = 0 AS is_active", "'low' AS urgency",
    )
    batch = complete(batch, p.announcements, "announcements", as_ntz(EVENTS))
    return changes.append_rows(p.announcements, batch, ["seq"]).table


@query
def append_announcement_reads(p):
    batch = p.raw("events").filter("event_type = 'view'").selectExpr(
        "event_id AS seq", "user_id", "event_id % 5 AS announcement_id", "ts AS read_at"
    )
    return changes.append_rows(p.announcement_reads, batch, ["seq"]).table


def _feed_edits(p):
    return p.raw("orders").selectExpr(
        "o_orderkey AS seq", "o_orderkey DIV 4 AS id", "(o_orderkey DIV 4) % 97 AS user_id",
        "1 + o_orderkey % 3 AS version", "'name ' || o_orderkey AS name",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'PROMO' END AS feed_type",
    )


def _update_outcome(done, table_columns, change_columns):
    """Rows of the table, those updated once more, and rejected changes; the table is judged once."""
    width = max(len(table_columns), len(change_columns))
    pad = lambda cols: [
        *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)],
        *[F.lit(None).cast("string").alias(f"c{i}") for i in range(len(cols), width)],
    ]
    both = F.when(F.col("__state") == "changed", F.array(F.lit("table"), F.lit("updated"))).otherwise(F.array(F.lit("table")))
    rows = done.judged.select(*pad(table_columns), F.explode(both).alias("outcome"))
    return rows.unionByName(done.rejected.select(*pad(change_columns), F.lit("conflict").alias("outcome")))


@query
def update_feeds(p):
    edits = ingest.merge_partial_input(_feed_edits(p), p.feeds)
    done = changes.versioned_update(
        p.feeds, edits, ["id", "user_id"], ["name", "feed_type"], ["seq"],
        fixed={"approval_status": F.lit("pending")},
    )
    return _update_outcome(
        done, ["id", "version", "name", "feed_type", "approval_status"], ["seq", "id", "version"]
    )


def _in_folders(p, name, key):
    """A table of the platform, kept in folders by its key on the shared storage."""
    table = getattr(p, name)
    return KeyedTable(p.spark, shared_dir(p.spark, name), table.schema, key, folders=16).create(table)


@query
def update_feeds_in_folders(p):
    feeds = _in_folders(p, "feeds", ["id"])
    edits = ingest.merge_partial_input(_feed_edits(p), p.feeds)
    feeds.update_versions(
        edits, ["name", "feed_type"], ["seq"], {"approval_status": F.lit("pending")}, on=["id", "user_id"])
    return feeds.read().select("id", "version", "name", "feed_type", "approval_status")


@query
def insert_feeds_in_folders(p):
    feeds = _in_folders(p, "feeds", ["url"])
    batch = p.raw("orders").selectExpr(
        "o_orderkey AS seq", "'https://feeds.example.com/' || (o_orderkey DIV 2) AS url", "o_custkey AS user_id")
    feeds.insert(complete(batch, p.feeds, "feeds", as_ntz(EVENTS)), ["seq"])
    return feeds.read().select("id", "url", "user_id", "version", "feed_type", "is_hidden", "priority", "created_at")


@query
def delete_follows_in_folders(p):
    follows = _in_folders(p, "feed_follows", ["id"])
    doomed = p.raw("events").selectExpr("user_id || '-' || CAST(floor(value) AS BIGINT) AS id", "user_id")
    follows.delete(doomed, on=["id", "user_id"])
    return follows.read().select("id", "user_id")


@query
def admin_update_feeds(p):
    edits = _feed_edits(p).selectExpr(
        "*", "CASE WHEN seq % 2 = 0 THEN 'approved' ELSE 'rejected' END AS approval_status",
        "'high' AS priority",
    )
    edits = ingest.merge_partial_input(edits, p.feeds, admin=True)
    done = changes.versioned_update(
        p.feeds, edits, ["id", "user_id"], ["name", "feed_type", "approval_status", "priority"],
        ["seq"],
    )
    return _update_outcome(
        done, ["id", "version", "name", "feed_type", "approval_status", "priority"],
        ["seq", "id", "version"],
    )


@query
def update_comments(p):
    edits = p.raw("conversations").selectExpr(
        "conv_id * 100 + turn AS seq", "conv_id * 100 + turn AS id",
        "(conv_id + CASE WHEN role = 'user' THEN turn ELSE 0 END) % 150 AS user_id",
        "1 + CAST(turn % 3 AS INT) AS version", "role || ' edit' AS comment_text",
    )
    done = changes.versioned_update(p.comments, edits, ["id", "user_id"], ["comment_text"], ["seq"])
    return hashed(
        _update_outcome(done, ["id", "version", "comment_text"], ["seq", "id", "version"]), "c2"
    )


@query
def update_plans(p):
    edits = p.raw("nation").selectExpr(
        "n_nationkey AS seq", "CAST(n_regionkey AS BIGINT) AS id",
        "1 + n_nationkey % 2 AS version", "n_name AS name", "'inactive' AS status",
    )
    done = changes.versioned_update(p.payment_plans, edits, ["id"], ["name", "status"], ["seq"])
    return _update_outcome(done, ["id", "version", "name", "status"], ["seq", "id", "version"])


@query
def update_users(p):
    edits = p.raw("customer").selectExpr(
        "c_custkey AS seq", "c_custkey AS id", "1 + CAST(c_custkey % 2 AS INT) AS version",
        "'user ' || c_custkey AS name", "c_mktsegment = 'BUILDING' AS activated",
    )
    done = changes.versioned_update(p.users, edits, ["id"], ["name", "activated"], ["seq"])
    return _update_outcome(done, ["id", "version", "name", "activated"], ["seq", "id", "version"])


@query
def update_error_logs(p):
    edits = p.raw("events").selectExpr(
        "event_id AS id", "true AS admin_notified", "value > 100 AS resolved",
        "'value ' || CAST(floor(value) AS BIGINT) AS resolution_notes",
    )
    done = changes.keyed_update(
        p.scraper_error_logs, edits, ["id"], ["admin_notified", "resolved", "resolution_notes"], ["id"]
    )
    return done.table.select("id", "admin_notified", "resolved", "resolution_notes")


@query
def update_subscription_status(p):
    edits = p.raw("lineitem").filter("l_returnflag = 'R'").selectExpr(
        "l_orderkey AS id", "l_linestatus", "l_partkey", "l_suppkey", "l_shipdate",
        "CASE WHEN l_linestatus = 'F' THEN 'cancelled' ELSE 'renewed' END AS status",
    ).join(p.raw("orders").selectExpr("o_orderkey AS id", "o_custkey AS user_id"), "id")
    done = changes.keyed_update(
        p.subscriptions, edits, ["id", "user_id"], ["status"],
        ["l_shipdate", "l_partkey", "l_suppkey", "l_linestatus"], {"updated_at": as_ntz(ORDERS)},
    )
    return done.table.select("id", "user_id", "status", "updated_at")


@query
def update_challenge_status(p):
    edits = p.raw("orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS user_id",
        "CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'successful' END AS status",
    )
    done = changes.keyed_update(
        p.challenged_transactions, edits, ["id", "user_id"], ["status"], ["id"],
        {"updated_at": as_ntz(ORDERS)},
    )
    return outcomes(
        table=done.table.select("id", "user_id", "status"),
        unknown=done.rejected.select("id", "user_id", "status"),
    )


@query
def rename_permissions(p):
    edits = p.raw("region").selectExpr(
        "CAST(r_regionkey AS BIGINT) * 3 AS id", "lower(r_name) || ':write' AS code"
    )
    return changes.keyed_update(p.permissions, edits, ["id"], ["code"], ["id"]).table


@query
def expire_subscriptions(p):
    done = changes.expire_subscriptions(p.subscriptions, as_ntz(ORDERS))
    columns = ["id", "user_id", "status", "updated_at"]
    return outcomes(table=done.table.select(*columns), changed=done.changed.select(*columns))


@query
def expire_challenges(p):
    done = changes.expire_challenges(p.challenged_transactions, as_ntz(ORDERS))
    columns = ["id", "user_id", "status", "updated_at"]
    return outcomes(table=done.table.select(*columns), changed=done.changed.select(*columns))


@query
def delete_feed_follows(p):
    doomed = p.raw("events").selectExpr(
        "user_id || '-' || CAST(floor(value) AS BIGINT) AS id", "user_id"
    )
    done = changes.delete_by_keys(p.feed_follows, doomed, ["id", "user_id"])
    rows = done.judged.select("id", "user_id", F.col("__state").alias("outcome"))
    return rows.unionByName(done.rejected.withColumn("outcome", F.lit("unknown")))


@query
def delete_comments(p):
    doomed = p.raw("conversations").selectExpr(
        "conv_id * 100 + turn AS id", "(conv_id + CASE WHEN role = 'user' THEN turn ELSE 0 END) % 150 AS user_id"
    )
    done = changes.delete_by_keys(p.comments, doomed, ["id", "user_id"])
    return done.table.select("id", "user_id", "parent_comment_id")


@query
def delete_favorites(p):
    doomed = p.raw("events").selectExpr("CAST(floor(value) AS BIGINT) AS post_id", "user_id")
    return changes.delete_by_keys(p.favorites, doomed, ["post_id", "user_id"]).table


@query
def revoke_permissions(p):
    asked = p.raw("customer").selectExpr(
        "c_custkey AS user_id", "'nation_' || c_nationkey || ':read' AS code"
    )
    doomed = asked.join(p.permissions.select(F.col("id").alias("permission_id"), "code"), "code")
    return changes.delete_by_keys(p.users_permissions, doomed, ["user_id", "permission_id"]).table


@query
def delete_error_logs(p):
    doomed = p.raw("events").filter("value > 60").selectExpr("event_id AS id")
    return changes.delete_by_keys(p.scraper_error_logs, doomed, ["id"]).table.select(
        "id", "error_type", "feed_id")


#: What names a row of a table without an id.
ROW_KEYS = {"users_permissions": ["user_id", "permission_id"], "feed_rejections": ["feed_id"]}


def _cascade(p, root, names, doomed):
    """Table, state and id of every row of every table, each table judged in one pass."""
    done = changes.cascade_delete({n: getattr(p, n) for n in [root, *names]}, root, doomed)
    return reduce(DataFrame.unionByName, [
        change.judged.select(
            F.lit(name).alias("table_name"), F.col("__state").alias("state"),
            F.concat_ws("-", *[F.col(c).cast("string") for c in ROW_KEYS.get(name, ["id"])]).alias("id"))
        for name, change in done.items()
    ])


@query
def delete_announcements(p):
    doomed = p.announcements.filter("urgency = 'low'").select("id")
    return _cascade(p, "announcements", ["announcement_reads"], doomed)


@query
def delete_permissions(p):
    doomed = p.raw("region").selectExpr("CAST(r_regionkey AS BIGINT) * 3 AS id")
    return _cascade(p, "permissions", ["users_permissions"], doomed)


@query
def delete_feeds(p):
    doomed = p.feeds.filter("approval_status = 'rejected'").select("id")
    return _cascade(
        p, "feeds",
        ["feed_follows", "posts", "favorites", "comments", "comment_notifications",
         "notifications", "scraper_error_logs", "feed_rejections"], doomed,
    )


# Row logic


@query
def plan_end_dates(p):
    kinds = p.raw("orders").selectExpr(
        "o_orderkey AS id", "o_orderdate",
        "CASE o_orderkey % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'week' WHEN 2 THEN 'month'"
        " WHEN 3 THEN 'year' ELSE 'once' END AS duration",
    )
    return kinds.withColumn("end_date", plan_end_date(F.col("duration"), F.col("o_orderdate")))


@query
def refined_intervals(p):
    asked = p.raw("events").selectExpr(
        "event_id", "CASE WHEN event_type <> 'view' THEN CAST(floor(value) AS BIGINT) - 10 END AS asked"
    )
    return asked.withColumn("minutes", refine_interval(F.col("asked"), 10, 100).cast("bigint"))


@query
def formatted_timestamps(p):
    shown = p.raw("events").selectExpr(
        "event_id",
        "CASE event_type WHEN 'view' THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS\") || 'Z'"
        " WHEN 'click' THEN date_format(ts, 'yyyy-MM-dd')"
        " WHEN 'error' THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") || '+02:00'"
        " WHEN 'signup' THEN 'on ' || date_format(ts, 'yyyy-MM-dd') ELSE '' END AS shown",
    )
    return shown.select("event_id", format_timestamp(F.col("shown")).alias("formatted"))


@query
def parsed_timestamps(p):
    """Moments written in 37 layouts: 22 to the second, 4 to the minute, 9 to the day, month, year."""
    formats = [
        "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss",
        "EEE, dd MMM yyyy HH:mm:ss '+0000'", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "d MMM yyyy HH:mm:ss 'UTC'",
        "EEEE, dd-MMM-yy HH:mm:ss 'UTC'", "EEE, dd MMM yy HH:mm:ss '+0000'", "EEE MMM d HH:mm:ss yyyy",
        "EEE MMM d HH:mm:ss 'UTC' yyyy", "EEE MMM dd HH:mm:ss '+0000' yyyy", "yyyy-MM-dd HH:mm:ss'+00:00'",
        "yyyy-MM-dd HH:mm:ss.SSS '+0000 UTC'", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "M/d/yyyy HH:mm:ss",
        "MMMM d, yyyy h:mm:ss a", "yyyyMMddHHmmss", "yyyy-MM-dd hh:mm:ss a",
        "EEE MMM dd yyyy HH:mm:ss 'GMT+0000 (Coordinated Universal Time)'", "yyyy-MM-dd HH:mm:ss',000'",
        "EEE, dd MMM yy HH:mm 'GMT'", "M/d/yy HH:mm", "d MMM yyyy, HH:mm", "MMMM d, yyyy 'at' h:mma 'PST-00'",
        "yyyy'年'MM'月'dd'日'", "yyyy-MM-dd", "dd-MMM-yyyy", "yyyy.MM.dd", "yyyyMMdd", "MMM d, yyyy", "d MMMM yyyy", "M/d/yyyy", "yyyy-MMM-dd",
        "yyyy-MM", "yyyy",
    ]
    # The second is cut first: a fraction in a layout is zero.
    at = F.date_trunc("second", "ts")
    shown = F.concat(F.lit("in "), F.col("value").cast("string"))
    for k, layout in enumerate(formats):
        shown = F.when(F.col("event_id") % (len(formats) + 1) == k, F.date_format(at, layout)).otherwise(shown)
    return p.raw("events").select("event_id", parse_any_timestamp(shown).alias("seconds"))


@query
def merged_feed_edits(p):
    return ingest.merge_partial_input(_feed_edits(p), p.feeds)


def _errors(df, key, rules):
    """Validation result as one row per (key, field)."""
    checked = checks.validate_rows(df, rules)
    return checked.select(key, F.explode("errors").alias("field", "message"))


@query
def validate_feeds(p):
    rows = p.raw("part").selectExpr(
        "p_partkey AS id",
        "CASE WHEN p_size > 40 THEN '' WHEN p_size > 30 THEN repeat('é', 251) ELSE p_name END AS name",
        "CASE WHEN p_size % 3 = 0 THEN 'feeds.example.com/x' WHEN p_size % 3 = 1 THEN ''"
        " ELSE 'https://feeds.example.com/' || p_partkey END AS url",
        "CASE WHEN p_size < 20 THEN 'https://img.example.com/a.png' END AS img_url",
        "p_type AS feed_type", "p_brand AS feed_description",
    )
    return _errors(rows, "id", checks.feed_rules())


@query
def validate_comments(p):
    rows = p.raw("conversations").selectExpr(
        "conv_id * 100 + turn AS id",
        "CASE turn WHEN 0 THEN '00000000-0000-0000-0000-000000000000' WHEN 1 THEN 'abcd123342123'"
        " WHEN 2 THEN NULL ELSE '7a467466-e92c-44ed-a206-3a460c867f3b' END AS post_id",
        "text AS comment_text",
    )
    return _errors(rows, "id", checks.comment_rules())


@query
def validate_users(p):
    rows = p.raw("customer").selectExpr(
        "c_custkey AS id",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_name END AS name",
        "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'no at sign' ELSE lower(c_name) || '@example.com'"
        " END AS email",
        "CASE WHEN c_acctbal > 0 THEN 'x.png' END AS user_img",
    )
    return _errors(rows, "id", checks.user_rules())


@query
def validate_permissions(p):
    rows = p.raw("supplier").selectExpr(
        "s_suppkey AS id", "CASE WHEN s_acctbal < 3000 THEN '' WHEN s_acctbal < 6000 THEN 'feed:read'"
        " ELSE lower(s_name) || ':read' END AS code"
    )
    return _errors(rows, "id", checks.permission_rules())


@query
def validate_plans(p):
    rows = p.raw("nation").selectExpr(
        "n_nationkey AS id", "n_name AS name", "'' AS description", "'month' AS duration",
        "CAST(n_regionkey AS DECIMAL(10,2)) AS price",
        "CASE WHEN n_nationkey % 2 = 0 THEN array('x') END AS features",
        "CASE WHEN n_nationkey % 3 = 0 THEN 'paused' ELSE 'active' END AS status",
    )
    return _errors(rows, "id", checks.plan_rules())


@query
def validate_announcements(p):
    rows = p.announcements.selectExpr("id", "title", "message", "created_by", "expires_at",
                                      "CASE WHEN urgency = 'high' THEN 'urgent' ELSE urgency END AS urgency")
    return _errors(rows, "id", checks.announcement_rules())


@query
def validate_moderation(p):
    rows = p.raw("part").selectExpr(
        "p_partkey AS id", "CASE WHEN p_size < 10 THEN '' ELSE 'approved' END AS approval_status",
        "lower(p_type) AS priority",
    )
    return _errors(rows, "id", checks.feed_moderation_rules())


@query
def validate_paging(p):
    rows = p.raw("events").selectExpr(
        "event_id AS id", "CAST(floor(value) AS BIGINT) - 5 AS page", "event_id % 150 AS page_size",
        "CASE WHEN event_type = 'view' THEN 'name' ELSE '-id' END AS sort",
    )
    return _errors(rows, "id", checks.paging_rules(sortable=["id", "-id"]))


@query
def validate_statuses(p):
    rows = p.challenged_transactions.selectExpr(
        "id", "CASE WHEN status = 'failed' THEN 'open' ELSE status END AS status"
    )
    return _errors(rows, "id", checks.challenge_rules())


_UUID = "regexp_replace(md5(CAST(event_id AS STRING)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5')"


def _event_errors(p, rules, **columns):
    """Rule errors of rows made from events; the kind of event decides what is wrong with a row."""
    rows = p.raw("events").selectExpr("event_id AS id", *[f"{e} AS {name}" for name, e in columns.items()])
    return _errors(rows, "id", rules)


def _by_kind(default, **kinds):
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in kinds.items()) + f" ELSE {default} END"


@query
def validate_follows(p):
    return _event_errors(
        p, checks.feed_follow_rules(), feed_id=_by_kind(_UUID, view=f"'{checks.NIL_UUID}'", click="'x'"))


@query
def validate_favorites(p):
    return _event_errors(
        p, checks.favorite_rules(), post_id=_by_kind(_UUID, view="'x'"), feed_id=_by_kind(_UUID, click="'y'"))


@query
def validate_comment_updates(p):
    return _event_errors(
        p, checks.comment_update_rules("comment"), comment=_by_kind(_UUID, view="'x'"),
        comment_text=_by_kind("'text'", click="''"), version=_by_kind("1", purchase="0"))


@query
def validate_subscription_statuses(p):
    return _event_errors(
        p, checks.subscription_status_rules("subscription"), subscription=_by_kind(_UUID, view="'x'"),
        status=_by_kind("'cancelled'", click="''", purchase="'active'"))


@query
def validate_charges(p):
    return _event_errors(p, checks.charge_rules(), amount=_by_kind("5", view="0"), plan_id=_by_kind("1", click="0"))


@query
def validate_verifications(p):
    return _event_errors(
        p, checks.verification_rules(), reference=_by_kind("'r'", view="''"), plan_id=_by_kind("1", click="0"))


@query
def validate_announcement_reads(p):
    return _event_errors(p, checks.announcement_read_rules(), announcement_id="event_id % 5")


@query
def validate_grants(p):
    return _event_errors(
        p, checks.grant_rules(), codes=_by_kind("array('a:b')", view="NULL", click="array()"),
        user_id=_by_kind("1", purchase="0"))


@query
def validate_revokes(p):
    return _event_errors(p, checks.revoke_rules(), code=_by_kind("'a:b'", view="''"), user_id=_by_kind("1", click="0"))


@query
def validate_error_notes(p):
    return _event_errors(p, checks.error_log_rules(), resolution_notes=_by_kind("'done'", view="NULL", click="''"))


@query
def valid_page_urls(p):
    rows = p.raw("pages").selectExpr(
        "page_id", "CASE WHEN page_id % 3 = 0 THEN substring_index(url, '//', -1) ELSE url END AS url"
    )
    return rows.select("page_id", checks.is_valid_url(F.col("url")).alias("valid"))


def _gateway_bodies(p):
    """One charge reply per order, some of them unusable."""
    state = "CASE o_orderstatus WHEN 'F' THEN 'success' ELSE 'declined' END"
    extra = "CASE WHEN o_orderkey % 11 = 0 THEN ',\"surprise\":1' ELSE '' END"
    return p.raw("orders").selectExpr(
        "o_orderkey AS subscription_id",
        "CASE WHEN o_orderkey % 13 = 0 THEN '{\"status\":' ELSE"
        " '{\"status\":true,\"message\":\"ok\",\"data\":{\"id\":' || o_orderkey ||"
        f" ',\"status\":\"' || {state} || '\",\"paused\":' ||"
        " CASE WHEN o_orderkey % 7 = 0 THEN 'true' ELSE 'false' END ||"
        " ',\"reference\":\"r-' || o_orderkey || '\",\"gateway_response\":\"' ||"
        f" {state} || '\",\"message\":\"m' || o_orderkey % 3 || '\",\"channel\":\"card\",'"
        " || '\"authorization_url\":\"https://pay.example.com/' || o_orderkey || '\",'"
        " || '\"split\":{\"a\":1},\"authorization\":{\"last4\":\"4081\",\"reusable\":true}'"
        f" || {extra} || '}}}}' END AS body",
    )


@query
def gateway_payloads(p):
    parsed = gateway.parse_gateway_payloads(_gateway_bodies(p))
    d = F.col("reply.data")
    return parsed.select(
        "subscription_id", "problem", d["status"].alias("gateway_status"), d["paused"].alias("paused"),
        d["reference"].alias("reference"), d["id"].alias("transaction_id"),
        d["authorization"]["last4"].alias("last4"), d["split"]["a"].alias("split_a"),
    )


def _replies(p):
    parsed = gateway.parse_gateway_payloads(_gateway_bodies(p)).filter("problem IS NULL")
    d = F.col("reply.data")
    return parsed.select(
        "subscription_id", d["paused"].alias("paused"), d["status"].alias("gateway_status"),
        d["gateway_response"].alias("gateway_response"), d["message"].alias("message"),
        d["reference"].alias("reference"), d["id"].alias("transaction_id"),
        d["authorization_url"].alias("authorization_url"), d["channel"].alias("channel"),
        d["authorization"]["last4"].alias("card_last4"), d["authorization"]["exp_month"].alias("card_exp_month"),
        d["authorization"]["exp_year"].alias("card_exp_year"), d["authorization"]["card_type"].alias("card_type"),
    )


def _renewals(p):
    due = subscriptions.renewal_candidates(
        p.subscriptions, p.users, p.challenged_transactions, as_ntz(ORDERS)
    )
    return due, _replies(p)


@query
def renewal_routes(p):
    due, replies = _renewals(p)
    routed = subscriptions.route_renewals(due, replies, p.payment_plans, as_ntz(ORDERS))
    return routed.select("subscription_id", "user_id", "plan_id", "outcome", "price", "new_end")


@query
def renewal_actions(p):
    due, replies = _renewals(p)
    done = subscriptions.renewal_actions(due, replies, p.payment_plans, p.subscriptions, as_ntz(ORDERS))
    columns = ["user_id", "subscription_id", "reference", "status", "card_last4"]
    shown = lambda name, df, *cols: df.select(
        F.lit(name).alias("part"), *[F.expr(c).cast("string").alias(n) for c, n in zip(cols, columns, strict=True)])
    parts = [
        shown("challenged", done.challenged, "user_id", "referenced_subscription_id", "reference", "status", "NULL"),
        shown("renewed", done.renewed, "user_id", "NULL", "transaction_id", "status", "card_last4"),
        shown("failed", done.failed, "user_id", "subscription_id", "reference", "failure_reason", "NULL"),
        shown("rejected", done.rejected, "user_id", "subscription_id", "reference", "NULL", "NULL"),
        shown("marked", done.subscriptions.changed, "user_id", "id", "NULL", "status", "NULL"),
    ]
    return reduce(DataFrame.unionByName, parts)


# Streams: run over all available input, then read what was written


def _stream(spark, name):
    root = shared_dir(spark, name)
    return f"{root}/table", f"{root}/checkpoint"


@query
def stream_new_post_notifications(p):
    views = jobs.table_stream(p.spark, p.root, "events").filter("event_type = 'view'").selectExpr(
        "user_id AS feed_id", "CAST(ts AS TIMESTAMP) AS created_at"
    )
    path, checkpoint = _stream(p.spark, "notifications")
    jobs.run_new_post_notifications(
        views, p.feeds, path, checkpoint, interval_minutes=60, lateness="10 minutes", open_windows=True
    ).awaitTermination()
    return jobs.current_notifications(p.spark, path)


@query
def stream_scrape_errors(p):
    errors = jobs.table_stream(p.spark, p.root, "events").filter("event_type = 'error'").selectExpr(
        "event_id AS id", "user_id AS feed_id", "ts",
        "CASE WHEN value < 50 THEN 'unable to detect the feed type in the url'"
        " WHEN value < 150 THEN 'timeout exceeded while fetching feeds'"
        " ELSE 'connection refused' END AS message",
        "CASE WHEN value < 50 THEN 200 WHEN value < 100 THEN 0 ELSE 408 END AS status_code",
        "3 AS retry_attempts",
    )
    path, checkpoint = _stream(p.spark, "scrape-errors")
    jobs.run_scrape_errors(errors, path, checkpoint).awaitTermination()
    schema = (
        "error_type string, feed_id bigint, n bigint, first_id bigint, first_ts timestamp_ntz,"
        " last_ts timestamp_ntz, first_retries int, message string, status_code int"
    )
    known = _known_errors(p)
    return jobs.current_errors(known, read_batches(p.spark, path, schema)).drop("resolution_notes")


@query
def stream_post_ingest(p):
    """Bodies arrive in three parts, each read by a new run of the stream, so later ones meet earlier links."""
    root = shared_dir(p.spark, "bodies")
    path, checkpoint = _stream(p.spark, "ingest")
    bodies = rendered_bodies(p).withColumn("fetched_at", F.lit(EVENTS_AS_OF).cast("timestamp"))
    last = bodies.agg(F.max("document_id")).first()[0]
    for part in range(3):
        here = (F.col("document_id") * 3 >= last * part) & (F.col("document_id") * 3 < last * (part + 1) + (part == 2))
        with sparing_disk(p.spark):
            bodies.filter(here).write.mode("append").parquet(root)
        # Files of a part that is done go while the next one is read.
        stream = p.spark.readStream.schema(bodies.schema).option("cleanSource", "delete").parquet(root)
        jobs.run_post_ingest(stream, p.posts, path, checkpoint).awaitTermination()
    columns = [c for c in POST_COLUMNS if c != "id"]
    schema = ("id bigint, document_id bigint, item_no int, feed_id bigint, itempublished_at timestamp, created_at timestamp,"
              " updated_at timestamp, " + ", ".join(f"{c} string" for c in columns if c[:4] in ("chan", "item", "img_")
                                                    and c not in ("item_no", "itempublished_at")))
    rows = hashed(read_batches(p.spark, path, schema), "itemtitle", "itemdescription")
    # A shared id would lose a row here and show in n.
    one = rows.groupBy("id").agg(F.max(F.struct(*columns)).alias("row"), F.count(F.lit(1)).alias("n"))
    return one.select("row.*", "n")


@query
def stream_expired_challenges(p):
    """Signups stand for challenges; a purchase among the same ten events resolves one."""
    events = lambda kind: jobs.table_stream(p.spark, p.root, "events").filter(
        F.col("event_type") == kind
    )
    opened = events("signup").selectExpr(
        "event_id DIV 10 AS id", "user_id", "CAST(ts AS TIMESTAMP) AS created_at"
    )
    closed = events("purchase").selectExpr(
        "event_id DIV 10 AS id", "CAST(ts AS TIMESTAMP) AS resolved_at"
    )
    path, checkpoint = _stream(p.spark, "challenges")
    jobs.append_to(
        jobs.expired_challenges(opened, closed, hours=24, lateness="1 hour"), path, checkpoint
    ).awaitTermination()
    return read_batches(
        p.spark, path, "id bigint, user_id bigint, status string, updated_at timestamp"
    )


@query
def stream_timeline(p):
    views = jobs.table_stream(p.spark, p.root, "events").filter("event_type = 'view'").selectExpr(
        "event_id AS id", "user_id AS feed_id", "ts AS created_at"
    )
    path, checkpoint = _stream(p.spark, "timeline")
    jobs.run_timeline_fan_out(views, p.feed_follows, path, checkpoint).awaitTermination()
    return read_batches(
        p.spark, path, "user_id bigint, feed_id bigint, post_id bigint, created_at timestamp_ntz"
    )
