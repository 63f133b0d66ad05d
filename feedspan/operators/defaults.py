"""Ids and column defaults of inserted rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspan.functions.ids import stable_uuid
from feedspan.operators.keys import numbered

# What makes a row of a table unique besides its id, in columns that are never NULL.
NATURAL_KEYS = {
    "feeds": ("url",),
    "feed_follows": ("user_id", "feed_id"),
    "posts": ("itemurl",),
    "favorites": ("user_id", "post_id"),
    "notifications": ("feed_id", "created_at"),
    "comment_notifications": ("comment_id", "user_id"),
    "permissions": ("code",),
    "payment_plans": ("name",),
    "users": ("email",),
}

# Defaults of columns that an insert leaves out. NOW stands for the time of the insert.
NOW = object()
DEFAULTS = {
    "feeds": {
        "created_at": NOW, "updated_at": NOW, "version": 1, "is_hidden": False, "approval_status": "pending",
        "priority": "normal", "feed_type": "general",
        "feed_description": "An interesting take on modern and latest changes in this field",
        "img_url": "https://cdn.pixabay.com/photo/2017/06/25/14/38/rss-2440955_960_720.png",
    },
    "feed_follows": {"created_at": NOW, "updated_at": NOW},
    "posts": {"created_at": NOW, "updated_at": NOW, "channellanguage": "en"},
    "favorites": {"created_at": NOW},
    "notifications": {"created_at": NOW},
    "comments": {"created_at": NOW, "updated_at": NOW, "version": 1},
    "comment_notifications": {"created_at": NOW},
    "users": {
        "created_at": NOW, "activated": False, "version": 1,
        "user_img": "https://i.ibb.co/5ntJp5C/defaultrobot2.png",
    },
    "payment_plans": {
        "created_at": NOW, "updated_at": NOW, "duration": "free", "status": "active", "version": 1,
        "image": "https://img.freepik.com/free-vector/subscriber-concept-illustration_114360-27827.jpg?t=st=1722672381"
        "~exp=1722675981~hmac=7f023cd2ad6bd97625fdeefdefa53d070ab5c4ed659db78d5570c883b5bddc27&w=740",
    },
    "subscriptions": {"created_at": NOW, "updated_at": NOW, "start_date": NOW, "currency": "USD"},
    "challenged_transactions": {"created_at": NOW, "updated_at": NOW, "status": "pending"},
    "failed_transactions": {"created_at": NOW, "updated_at": NOW, "attempt_date": NOW},
    "scraper_error_logs": {
        "occurred_at": NOW, "last_occurrence": NOW, "created_at": NOW, "updated_at": NOW, "retry_attempts": 0,
        "admin_notified": False, "resolved": False, "occurrence_count": 1,
    },
    "announcements": {"created_at": NOW, "updated_at": NOW, "is_active": True},
    "announcement_reads": {"read_at": NOW},
    "feed_rejections": {"rejected_at": NOW},
}


def complete(batch: DataFrame, table: DataFrame, name: str, now: Column, order: Sequence[str] = ()) -> DataFrame:
    """The batch with the defaults of table `name`, for columns of `table` it leaves out, and text ids.

    Numeric ids are numbers above the table's and come with the insert (`insert_unique`,
    `append_rows`). A text id is a hash of the row's natural key, or, where a table has no key that
    is unique and never NULL, of the time of the insert and the row's number in `order`. So a rerun
    gives the same row the same id. Columns that the batch has, NULL or not, stay as they are.
    """
    given = {}
    for column, value in DEFAULTS.get(name, {}).items():
        if column in table.columns and column not in batch.columns:
            given[column] = (now if value is NOW else F.lit(value)).cast(table.schema[column].dataType)
    out = batch.withColumns(given) if given else batch
    if "id" not in table.columns or "id" in batch.columns or table.schema["id"].dataType.simpleString() != "string":
        return out
    if name in NATURAL_KEYS:
        return out.withColumn("id", stable_uuid(F.lit(name), *[F.col(k) for k in NATURAL_KEYS[name]]))
    return numbered(out, order).withColumn("id", stable_uuid(F.lit(name), now, F.col("__n"))).drop("__n")
