"""Moderation boards, users and permissions, platform statistics, announcements, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspan.functions.text import token_match
from feedspan.functions.timestamps import interval_seconds
from feedspan.operators.paging import check_page, count_of, page_of, top_per_key
from feedspan.operators.summaries import count_where, most_common, numbered_facet, one_row

# Label of a user without permissions, and the free-plan quotas.
NO_PERMISSIONS = "normal user"
MAX_FEEDS_CREATED = 5
MAX_FEEDS_FOLLOWED = 5
MAX_COMMENTS_TODAY = 10


def _status_counts(feeds: DataFrame, *more: Column) -> Column:
    status = F.col("approval_status")
    return one_row(
        feeds,
        count_where(status == "pending", "total_pending_feeds"),
        count_where(status == "approved", "total_approved_feeds"),
        count_where(status == "rejected", "total_rejected_feeds"),
        *more,
    )


def _owner(users: DataFrame) -> DataFrame:
    return users.select(
        F.col("id").alias("user_id"), F.col("name").alias("user_name"),
        F.col("email").alias("user_email"), "user_img",
    )


def moderation_queue(
    feeds: DataFrame,
    users: DataFrame,
    as_of: Column,
    search: str = "",
    feed_type: str = "",
    page: int = 1,
    page_size: int = 20,
    compat: bool = False,
) -> DataFrame:
    """Pending feeds, oldest first, with status counts and the pending load per priority and owner.

    The page is cut first; only its rows meet the owner, priority and load figures.
    `compat` takes the age of the oldest feed over all feeds, not the pending ones.
    """
    pending = feeds.filter("approval_status = 'pending'")
    known = pending.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    keep = known.filter(token_match(F.col("name"), search))
    if feed_type:
        keep = keep.filter(F.col("feed_type") == feed_type)
    rows = page_of(keep, [F.asc("created_at"), F.asc("id")], page, page_size)
    aged = F.col("created_at") if compat else F.when(
        F.col("approval_status") == "pending", F.col("created_at")
    )
    stats = _status_counts(feeds, F.min(aged).alias("oldest"))
    by_priority = pending.groupBy("priority").agg(F.count(F.lit(1)).alias("total_by_priority"))
    by_owner = pending.groupBy("user_id").agg(F.count("id").alias("pending_feeds_count"))
    days = F.floor(interval_seconds(as_of - F.col("s.oldest")) / 86400.0)
    return (
        rows.withColumn("s", stats)
        .withColumn("oldest_pending_days", days)
        .select("*", "s.total_pending_feeds", "s.total_approved_feeds", "s.total_rejected_feeds")
        .drop("s")
        .join(_owner(users), "user_id")
        .join(by_priority, "priority", "left")
        .join(by_owner, "user_id", "left")
        .orderBy(F.asc("created_at"), F.asc("id"))
    )


def feed_admin_board(
    feeds: DataFrame,
    users: DataFrame,
    follows: DataFrame,
    search: str = "",
    feed_type: str = "",
    hidden: bool | None = None,
    priority: str = "",
    page: int = 1,
    page_size: int = 20,
    compat: bool = False,
) -> DataFrame:
    """All feeds by priority then newest, with platform counts, pending load and followers.

    `compat` ranks only 'high' first and lets 'normal' and 'low' tie.
    """
    known = feeds.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    keep = known.filter(token_match(F.col("name"), search))
    if feed_type:
        keep = keep.filter(F.col("feed_type") == feed_type)
    if hidden is not None:
        keep = keep.filter(F.col("is_hidden") == hidden)
    if priority:
        keep = keep.filter(F.col("priority") == priority)
    second = F.col("priority") == ("medium" if compat else "normal")
    rank = F.when(F.col("priority") == "high", 1).when(second, 2).otherwise(3)
    order = [rank, F.desc("created_at"), F.asc("id")]
    rows = page_of(keep, order, page, page_size)
    stats = _status_counts(
        feeds,
        F.count(F.lit(1)).alias("total_feeds"),
        count_where(F.col("priority") == "high", "total_high_priority_feeds"),
        count_where(F.col("is_hidden"), "total_hidden_feeds"),
    )
    pending = feeds.filter("approval_status = 'pending'")
    by_priority = pending.groupBy("priority").agg(F.count(F.lit(1)).alias("total_by_priority"))
    by_owner = pending.groupBy("user_id").agg(F.count(F.lit(1)).alias("pending_feeds_count"))
    followers = follows.groupBy(F.col("feed_id").alias("id")).agg(
        F.count(F.lit(1)).alias("follow_count")
    )
    return (
        rows.withColumn("s", stats)
        .withColumn("most_common_feed_type", most_common(feeds, "feed_type"))
        .select("*", "s.*")
        .drop("s")
        .join(_owner(users), "user_id")
        .join(by_priority, "priority", "left")
        .join(by_owner, "user_id", "left")
        .join(followers, "id", "left")
        .withColumn("pending_feeds_count", F.coalesce("pending_feeds_count", F.lit(0)))
        .withColumn("follow_count", F.coalesce("follow_count", F.lit(0)))
        .orderBy(*order)
    )


def _codes_per_user(grants: DataFrame, permissions: DataFrame) -> DataFrame:
    """Ordered codes of every user; a grant counts once, so the list is at most all codes."""
    held = grants.select("user_id", "permission_id").distinct()
    coded = held.join(
        permissions.select(F.col("id").alias("permission_id"), "code"), "permission_id"
    )
    return coded.groupBy("user_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("permission_id", "code"))), lambda p: p["code"]
        ).alias("permissions")
    )


def user_directory(
    users: DataFrame,
    grants: DataFrame,
    permissions: DataFrame,
    search: str = "",
    page: int | None = 1,
    page_size: int = 20,
) -> DataFrame:
    """Users, newest first, with their ordered permission codes. `page=None` gives everybody."""
    found = users.filter(token_match(F.col("name"), search))
    if page is None:
        rows = found.withColumn("total_records", count_of(found))
    else:
        rows = page_of(found, [F.desc("created_at"), F.asc("id")], page, page_size)
    codes = _codes_per_user(grants, permissions).withColumnRenamed("user_id", "id")
    return rows.join(codes, "id", "left").withColumn(
        "permissions", F.coalesce("permissions", F.array(F.lit(NO_PERMISSIONS)))
    )


def permission_grants(users: DataFrame, grants: DataFrame, permissions: DataFrame) -> DataFrame:
    """One row per user and granted permission."""
    return (
        grants.join(permissions.select(F.col("id").alias("permission_id"), F.col("code").alias("permission_code")), "permission_id")
        .join(users.select(F.col("id").alias("user_id"), "name", "user_img"), "user_id")
        .select("user_id", "name", "user_img", "permission_id", "permission_code")
    )


def permission_codes(permissions: DataFrame) -> DataFrame:
    return permissions.select("id", "code")


def user_permission_codes(users: DataFrame, grants: DataFrame, permissions: DataFrame) -> DataFrame:
    """The permission codes of each user as an array; test one with `includes`."""
    known = grants.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return _codes_per_user(known, permissions)


def includes(codes: Column, code: str) -> Column:
    return F.coalesce(F.array_contains(codes, code), F.lit(False))


def platform_statistics(
    users: DataFrame, subscriptions: DataFrame, comments: DataFrame, as_of: Column
) -> DataFrame:
    """One row of platform totals; each table is read once for its counts."""
    recent = F.col("created_at") >= as_of - F.expr("INTERVAL '7' DAY")
    status = F.col("status")
    money = one_row(
        subscriptions,
        F.coalesce(F.sum("price"), F.lit(0)).alias("total_revenue"),
        count_where(status == "active", "active_subscriptions"),
        count_where(status == "cancelled", "cancelled_subscriptions"),
        count_where(status == "expired", "expired_subscriptions"),
    )
    talk = one_row(
        comments, F.count(F.lit(1)).alias("total_comments"), count_where(recent, "recent_comments")
    )
    return (
        users.agg(
            F.count(F.lit(1)).alias("total_users"),
            count_where(F.col("activated"), "active_users"),
            count_where(recent, "new_signups"),
        )
        .withColumn("m", money)
        .withColumn("t", talk)
        .withColumn(
            "most_used_payment_method",
            F.coalesce(most_common(subscriptions, "payment_method"), F.lit("N/A")),
        )
        .select("*", "m.*", "t.*")
        .drop("m", "t")
    )


def scraper_error_board(
    logs: DataFrame,
    feeds: DataFrame,
    error_type: str = "",
    page: int = 1,
    page_size: int = 20,
) -> DataFrame:
    """Scraper errors, most frequent first, with feed detail joined to the page."""
    known = logs.join(feeds.select(F.col("id").alias("feed_id")), "feed_id", "left_semi")
    if error_type:
        known = known.filter(F.col("error_type") == error_type)
    order = [F.desc("occurrence_count"), F.asc("id")]
    rows = page_of(known, order, page, page_size)
    return rows.join(_feed_detail(feeds), "feed_id").orderBy(*order)


def _feed_detail(feeds: DataFrame) -> DataFrame:
    return feeds.select(
        F.col("id").alias("feed_id"), F.col("name").alias("feed_name"),
        F.col("url").alias("feed_url"), F.col("img_url").alias("feed_img_url"),
    )


def error_log_detail(logs: DataFrame, feeds: DataFrame) -> DataFrame:
    return logs.join(_feed_detail(feeds), "feed_id")


def unread_announcements(
    announcements: DataFrame, reads: DataFrame, user_id: int, as_of: Column | None = None
) -> DataFrame:
    """Active announcements one user has not read. `as_of` also drops expired ones."""
    active = announcements.filter("is_active")
    if as_of is not None:
        active = active.filter(F.col("expires_at") > as_of)
    seen = reads.filter(F.col("user_id") == user_id)
    return active.join(
        seen.select(F.col("announcement_id").alias("__a")), F.col("id") == F.col("__a"), "left_anti"
    )


def unread_inbox(
    asked: DataFrame, announcements: DataFrame, reads: DataFrame, page_size: int = 20
) -> DataFrame:
    """First page of unread active announcements of each asked user (column `user_id`), in id order.

    Who has read s active announcements finds a page of n unread ones among the first s + n, so
    only those pairs are made: together as many as there are reads and page rows.
    """
    limit, _ = check_page(1, page_size)
    active = announcements.filter("is_active").select(F.col("id").alias("announcement_id"))
    ranked = numbered_facet(active, "announcement_id", "__rank")
    seen = reads.select("user_id", "announcement_id").distinct().join(active, "announcement_id", "left_semi")
    read = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("__read"))
    reach = asked.select("user_id").distinct().join(read, "user_id", "left").select(
        "user_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("__read", F.lit(0)) + limit)).alias("__rank"))
    unread = reach.join(ranked, "__rank").join(seen, ["user_id", "announcement_id"], "left_anti")
    return top_per_key(
        unread.select("user_id", "announcement_id"), ["user_id"], [F.asc("announcement_id")], limit, rank="row_num")


def announcement_list(announcements: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    return page_of(announcements, [F.desc("created_at"), F.asc("id")], page, page_size)


def usage_quota(
    users: DataFrame,
    follows: DataFrame,
    feeds: DataFrame,
    comments: DataFrame,
    as_of: Column,
    max_created: int = MAX_FEEDS_CREATED,
    max_followed: int = MAX_FEEDS_FOLLOWED,
    max_comments: int = MAX_COMMENTS_TODAY,
) -> DataFrame:
    """Followed feeds, created feeds and today's comments per user, and whether a quota is used up.

    Three counts joined per user: no fan-out between follows, feeds and comments.
    """
    # A range on the bare column reaches the scan; a date cast on it would not.
    midnight = F.date_trunc("day", as_of).cast("timestamp_ntz")
    today = (F.col("created_at") >= midnight) & (
        F.col("created_at") < midnight + F.expr("INTERVAL '1' DAY")
    )
    followed = follows.select("user_id", "feed_id").distinct().groupBy("user_id").agg(
        F.count(F.lit(1)).alias("followed_feeds")
    )
    created = feeds.groupBy("user_id").agg(F.count("id").alias("created_feeds"))
    said = comments.filter(today).groupBy("user_id").agg(F.count("id").alias("comments_today"))
    counted = users.select(F.col("id").alias("user_id"))
    for part in (followed, created, said):
        counted = counted.join(part, "user_id", "left")
    names = ["followed_feeds", "created_feeds", "comments_today"]
    counted = counted.select("user_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    over = (
        (F.col("created_feeds") >= max_created)
        | (F.col("followed_feeds") >= max_followed)
        | (F.col("comments_today") >= max_comments)
    )
    return counted.withColumn("over_limit", over)
