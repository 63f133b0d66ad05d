"""The platform's tables as views over a TPC-H-like data set.

Each table is a fixed projection, join or grouping of the given parquet tables, so
it grows with them. Times are zone-less UTC. Left joins here are on unique keys, so
Catalyst drops those whose columns a job does not read.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS_AS_OF = "2001-08-01 00:00:00"
EVENTS_AS_OF = "2024-01-30 12:00:00"


class Platform:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    # People

    @cached_property
    def users(self) -> DataFrame:
        first = self.raw("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("since"))
        c = self.raw("customer")
        return c.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").selectExpr(
            "c_custkey AS id",
            "c_name AS name",
            "lower(c_name) || '@example.com' AS email",
            "c_acctbal > 0 AS activated",
            "1 AS version",
            "'https://img.example.com/u/' || c_custkey || '.png' AS user_img",
            "coalesce(since, TIMESTAMP_NTZ'1995-01-01 00:00:00') AS created_at",
        )

    @cached_property
    def permissions(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "CAST(n_nationkey AS BIGINT) AS id", "lower(n_name) || ':read' AS code"
        )

    @cached_property
    def users_permissions(self) -> DataFrame:
        return (
            self.raw("customer")
            .filter("c_acctbal > 5000")
            .selectExpr(
                "c_custkey AS user_id",
                "explode(array(c_nationkey, (c_nationkey + 1) % 25)) AS permission_id",
            )
            .selectExpr("user_id", "CAST(permission_id AS BIGINT) AS permission_id")
        )

    # Feeds

    @cached_property
    def feeds(self) -> DataFrame:
        shipped = (
            self.raw("lineitem")
            .groupBy("l_partkey")
            .agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
        )
        p = self.raw("part")
        return p.join(shipped, F.col("p_partkey") == F.col("l_partkey"), "left").selectExpr(
            "p_partkey AS id",
            "p_name AS name",
            "'https://feeds.example.com/' || p_partkey AS url",
            "p_partkey % 97 AS user_id",
            "1 + p_partkey % 3 AS version",
            "'https://img.example.com/f/' || p_partkey || '.png' AS img_url",
            "lower(p_type) AS feed_type",
            "p_brand || ' ' || p_name AS feed_description",
            "p_partkey % 7 = 0 AS is_hidden",
            "CASE p_partkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' ELSE 'approved' END"
            " AS approval_status",
            "CASE WHEN p_size <= 10 THEN 'high' WHEN p_size <= 35 THEN 'normal' ELSE 'low' END"
            " AS priority",
            "coalesce(first_ship, TIMESTAMP_NTZ'1995-01-01 00:00:00') AS created_at",
            "CASE WHEN p_partkey % 11 <> 0 THEN last_ship END AS last_fetched_at",
        )

    @cached_property
    def feed_follows(self) -> DataFrame:
        o, li = self.raw("orders"), self.raw("lineitem")
        return (
            o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("feed_id"))
            .agg(F.min("o_orderdate").alias("created_at"))
            .selectExpr("user_id || '-' || feed_id AS id", "user_id", "feed_id", "created_at")
        )

    @cached_property
    def feed_rejections(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .filter("l_returnflag = 'R'")
            .selectExpr(
                "l_partkey AS feed_id",
                "l_shipdate AS rejected_at",
                "l_suppkey AS rejected_by",
                "'returned by order ' || l_orderkey AS reason",
            )
        )

    # Posts

    @cached_property
    def posts(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id AS id",
            "doc_id % 200 AS feed_id",
            "source AS channeltitle",
            "'https://' || source || '.example.com' AS channelurl",
            "source || ' channel' AS channeldescription",
            "lang AS channellanguage",
            "split_part(text, '\\n', 1) AS itemtitle",
            "text AS itemcontent",
            "'https://posts.example.com/' || doc_id AS itemurl",
            "TIMESTAMP_NTZ'2024-01-01 00:00:00' + INTERVAL '1' MINUTE * doc_id AS created_at",
        )

    @cached_property
    def post_arrivals(self) -> DataFrame:
        return (
            self.raw("events")
            .filter("event_type = 'view'")
            .selectExpr("event_id AS id", "user_id AS feed_id", "ts AS created_at")
        )

    @cached_property
    def favorites(self) -> DataFrame:
        n = self.raw("documents").agg(F.count(F.lit(1)).alias("n")).scalar()
        return (
            self.raw("events")
            .filter("event_type = 'click'")
            .select("event_id", "ts", "user_id", ((F.col("event_id") * 7) % n).alias("post_id"))
            .groupBy("user_id", "post_id")
            .agg(F.min("event_id").alias("id"), F.min("ts").alias("created_at"))
            .selectExpr("id", "post_id", "post_id % 200 AS feed_id", "user_id", "created_at")
        )

    @cached_property
    def comments(self) -> DataFrame:
        turns = self.raw("conversations").filter("role <> 'system'")
        before = turns.selectExpr("conv_id AS b_conv", "turn + 1 AS b_turn")
        return turns.join(
            before,
            (F.col("conv_id") == F.col("b_conv")) & (F.col("turn") == F.col("b_turn")),
            "left",
        ).selectExpr(
            "conv_id * 100 + turn AS id",
            "conv_id % 200 AS post_id",
            "(conv_id + turn) % 150 AS user_id",
            "CASE WHEN b_conv IS NOT NULL THEN conv_id * 100 + turn - 1 END AS parent_comment_id",
            "text AS comment_text",
            "1 AS version",
            "TIMESTAMP_NTZ'2024-01-21 00:00:00' + INTERVAL '1' DAY * (conv_id % 10)"
            " + INTERVAL '1' MINUTE * turn AS created_at",
        )

    @cached_property
    def comment_notifications(self) -> DataFrame:
        return self.comments.selectExpr(
            "id", "user_id", "post_id", "id AS comment_id", "created_at"
        )

    @cached_property
    def notifications(self) -> DataFrame:
        """What a 10-minute notification run would have stored."""
        slots = (
            self.post_arrivals.groupBy(
                "feed_id",
                F.expr("date_trunc('hour', created_at) + INTERVAL '10' MINUTE *"
                       " floor(minute(created_at) / 10)").alias("slot"),
            )
            .agg(F.count("id").alias("post_count"))
        )
        return slots.join(
            self.feeds.selectExpr("id AS f_id", "name AS feed_name"), F.col("feed_id") == F.col("f_id")
        ).selectExpr(
            "feed_id || '@' || date_format(slot, 'yyyyMMddHHmm') AS id",
            "feed_id",
            "feed_name",
            "post_count",
            "CAST(slot + INTERVAL '10' MINUTE AS TIMESTAMP_NTZ) AS created_at",
        )

    # Money

    @cached_property
    def payment_plans(self) -> DataFrame:
        return self.raw("region").selectExpr(
            "CAST(r_regionkey AS BIGINT) AS id",
            "r_name AS name",
            "'https://img.example.com/p/' || r_regionkey || '.png' AS image",
            "'Plan ' || r_name AS description",
            "CASE WHEN r_regionkey <= 2 THEN 'month' ELSE 'year' END AS duration",
            "CAST(10 * (r_regionkey + 1) AS DECIMAL(10,2)) AS price",
            "array('read', lower(r_name)) AS features",
            "CASE WHEN r_regionkey = 3 THEN 'inactive' ELSE 'active' END AS status",
            "1 AS version",
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id",
            "o_custkey AS user_id",
            "o_orderkey % 5 AS plan_id",
            "o_orderdate AS start_date",
            "CASE WHEN o_orderkey % 5 <= 2 THEN o_orderdate + INTERVAL '30' DAY"
            " ELSE o_orderdate + INTERVAL '365' DAY END AS end_date",
            "CAST(o_totalprice AS DECIMAL(12,2)) AS price",
            "CASE o_orderstatus WHEN 'F' THEN 'expired' WHEN 'O' THEN 'active' ELSE 'cancelled' END"
            " AS status",
            "o_orderkey AS transaction_id",
            "o_orderpriority AS payment_method",
            "'AUTH_' || o_orderkey AS authorization_code",
            "right('0000' || o_orderkey, 4) AS card_last4",
            "CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'KES' END AS currency",
            "o_orderdate AS updated_at",
        )

    @cached_property
    def challenged_transactions(self) -> DataFrame:
        returned = (
            self.raw("lineitem")
            .filter("l_returnflag = 'R'")
            .groupBy("l_orderkey")
            .agg(F.min("l_linestatus").alias("line"), F.max("l_shipdate").alias("at"))
        )
        return returned.join(
            self.raw("orders").select("o_orderkey", "o_custkey"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        ).selectExpr(
            "l_orderkey AS id",
            "o_custkey AS user_id",
            "l_orderkey AS referenced_subscription_id",
            "'https://pay.example.com/' || l_orderkey AS authorization_url",
            "'ref-' || l_orderkey AS reference",
            "CASE WHEN l_orderkey % 3 = 0 THEN 'pending' WHEN line = 'F' THEN 'successful'"
            " ELSE 'failed' END AS status",
            "at AS created_at",
            "at AS updated_at",
        )

    @cached_property
    def failed_transactions(self) -> DataFrame:
        return self.challenged_transactions.filter("status = 'failed'").selectExpr(
            "id", "user_id", "referenced_subscription_id AS subscription_id", "reference",
            "'declined' AS failure_reason", "created_at AS attempt_date",
        )

    # Operations

    @cached_property
    def scrape_attempts(self) -> DataFrame:
        """Failed fetches, with the message the fetcher saw."""
        return (
            self.raw("events")
            .filter("event_type = 'error'")
            .selectExpr(
                "event_id AS id",
                "user_id AS feed_id",
                "ts",
                "CASE WHEN value < 50 THEN 'unable to detect the feed type in the url'"
                " WHEN value < 150 THEN 'timeout exceeded while fetching feeds'"
                " ELSE 'connection refused' END AS message",
                "CASE WHEN value < 50 THEN 200 WHEN value < 100 THEN 0 ELSE 408 END AS status_code",
                "3 AS retry_attempts",
            )
        )

    @cached_property
    def scraper_error_logs(self) -> DataFrame:
        return (
            self.raw("events")
            .filter("event_type = 'error'")
            .groupBy(
                F.expr("CASE WHEN value < 50 THEN 'FeedType' ELSE 'FeedContextExceeded' END").alias(
                    "error_type"
                ),
                F.col("user_id").alias("feed_id"),
            )
            .agg(
                F.min("event_id").alias("id"),
                F.count(F.lit(1)).alias("occurrence_count"),
                F.min("ts").alias("occurred_at"),
                F.max("ts").alias("last_occurrence"),
            )
            .selectExpr(
                "id", "error_type", "feed_id", "'seen before' AS message", "504 AS status_code",
                "3 AS retry_attempts", "false AS admin_notified", "false AS resolved",
                "CAST(NULL AS STRING) AS resolution_notes", "occurrence_count", "occurred_at",
                "last_occurrence",
            )
        )

    @cached_property
    def announcements(self) -> DataFrame:
        return self.raw("region").selectExpr(
            "CAST(r_regionkey AS BIGINT) AS id",
            "'News from ' || r_name AS title",
            "'Service in ' || r_name AS message",
            "TIMESTAMP_NTZ'2024-01-01 00:00:00' + INTERVAL '1' DAY * r_regionkey AS created_at",
            "TIMESTAMP_NTZ'2024-01-15 00:00:00' + INTERVAL '10' DAY * r_regionkey AS expires_at",
            "CAST(r_regionkey AS BIGINT) AS created_by",
            "r_regionkey <> 2 AS is_active",
            "CASE r_regionkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS urgency",
        )

    @cached_property
    def announcement_reads(self) -> DataFrame:
        return (
            self.raw("events")
            .filter("event_type = 'signup'")
            .selectExpr(
                "event_id AS id", "user_id", "event_id % 5 AS announcement_id", "ts AS read_at"
            )
        )
