"""New-post and comment notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspan.functions.timestamps import minutes
from feedspan.operators.defaults import complete

# Notification kinds and the length of a comment snippet.
ON_FAVORITE = "Comment on Favorited Post"
ON_REPLY = "Reply to Your Comment"
SNIPPET = 20


def new_post_notifications(
    posts: DataFrame, feeds: DataFrame, as_of: Column, interval_minutes: int
) -> DataFrame:
    """Posts per feed in the last n minutes, both ends included; counted before the join."""
    since = as_of - minutes(interval_minutes)
    counts = (
        posts.filter(F.col("created_at").between(since, as_of))
        .groupBy("feed_id")
        .agg(F.count("id").alias("post_count"))
    )
    return counts.join(
        feeds.select(F.col("id").alias("feed_id"), F.col("name").alias("feed_name")), "feed_id"
    ).select("feed_id", "feed_name", "post_count")


def notification_rows(counts: DataFrame, as_of: Column, notifications: DataFrame) -> DataFrame:
    """Rows to append to the notifications table: one per feed and run, with an id."""
    return complete(counts.withColumn("created_at", as_of), notifications, "notifications", as_of)


def user_notifications(
    notifications: DataFrame, follows: DataFrame, as_of: Column, interval_minutes: int
) -> DataFrame:
    """Recent notifications of followed feeds, for all users."""
    recent = notifications.filter(F.col("created_at") >= as_of - minutes(interval_minutes))
    return recent.select(
        F.col("id").alias("notification_id"), "feed_id", "feed_name", "post_count", "created_at"
    ).join(follows.select("user_id", "feed_id"), "feed_id")


def comment_notification_rows(comments: DataFrame, notifications: DataFrame) -> DataFrame:
    """One notification per new comment, replies included, carrying the commenter."""
    rows = comments.select("user_id", "post_id", F.col("id").alias("comment_id"), "created_at")
    return complete(rows, notifications, "comment_notifications", F.col("created_at"))


def comment_notifications(
    notifications: DataFrame,
    comments: DataFrame,
    posts: DataFrame,
    favorites: DataFrame,
    no_parent: Column,
) -> DataFrame:
    """For every viewer: comments on favourited posts, and replies to own comments.

    One event can reach a viewer in both ways, and own comments are included. Events fan out as
    keys, straight from a shuffle on both sides, so Spark can split a hot post; snippet and title
    join afterwards on the notification, which no post makes hot.
    """
    event = notifications.select(
        F.col("id").alias("notification_id"), "post_id", "comment_id", "created_at"
    ).join(
        comments.select(F.col("id").alias("comment_id"), F.col("post_id").alias("__post"), "parent_comment_id"),
        "comment_id",
    )
    snippet = F.left("comment_text", F.lit(SNIPPET)).alias("comment_snippet")
    texts = (
        notifications.select(F.col("id").alias("notification_id"), F.col("comment_id").alias("__comment"))
        .join(comments.select(F.col("id").alias("__comment"), F.col("post_id").alias("__on"), snippet), "__comment")
        .join(posts.select(F.col("id").alias("__on"), F.col("itemtitle").alias("post_title")), "__on")
        .select("notification_id", "comment_snippet", "post_title")
    )
    fans = favorites.select(F.col("user_id").alias("viewer_id"), F.col("post_id").alias("__post"))
    on_favorite = event.join(fans.distinct(), "__post").withColumn(
        "notification_type", F.lit(ON_FAVORITE)
    )
    authors = comments.select(
        F.col("id").alias("parent_comment_id"), F.col("user_id").alias("viewer_id")
    )
    on_reply = event.join(authors, "parent_comment_id").withColumn(
        "notification_type", F.lit(ON_REPLY)
    )
    keys = ["viewer_id", "notification_id", "post_id", "notification_type", "comment_id", "parent_comment_id", "created_at"]
    reached = on_favorite.select(*keys).unionByName(on_reply.select(*keys))
    return reached.join(texts, "notification_id").select(
        "viewer_id", "notification_id", "post_id", "notification_type", "comment_id",
        F.coalesce("parent_comment_id", no_parent).alias("replied_comment_id"),
        "comment_snippet", "post_title", "created_at",
    )


def notifications_bundle(post_events: DataFrame, comment_events: DataFrame) -> DataFrame:
    """Post and comment notifications of all users in one frame with a kind column."""
    posts = post_events.select(
        "user_id", F.lit("post").alias("kind"), F.col("notification_id").cast("string").alias("id"),
        F.col("feed_name").alias("subject"), "created_at",
    )
    talk = comment_events.select(
        F.col("viewer_id").alias("user_id"), F.col("notification_type").alias("kind"),
        F.col("notification_id").cast("string").alias("id"), F.col("post_title").alias("subject"),
        "created_at",
    )
    return posts.unionByName(talk)
