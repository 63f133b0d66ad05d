"""Plans, subscriptions, challenges, renewals and the revenue reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspan.functions.timestamps import interval_seconds, plan_end_date
from feedspan.operators.summaries import count_where, most_common, one_row
from feedspan.operators.changes import Change, keyed_update
from feedspan.operators.paging import check_page, count_of, page_of, top_per_key

MONTH = "INTERVAL '30' DAY"


def plan_catalog(plans: DataFrame, active_only: bool = True) -> DataFrame:
    if active_only:
        return plans.filter("status = 'active'").orderBy("price", "id")
    return plans.orderBy("status", "price", "id")


def _plan_detail(plans: DataFrame) -> DataFrame:
    return plans.select(
        F.col("id").alias("plan_id"), F.col("name").alias("plan_name"),
        F.col("image").alias("plan_image"), F.col("duration").alias("plan_duration"),
    )


def running_subscriptions(subscriptions: DataFrame, as_of: Column) -> DataFrame:
    """Active and unexpired; the newest one of each user."""
    live = subscriptions.filter((F.col("status") == "active") & (F.col("end_date") > as_of))
    return top_per_key(live, ["user_id"], [F.desc("start_date"), F.asc("id")], 1)


def current_subscription(subscriptions: DataFrame, plans: DataFrame, as_of: Column) -> DataFrame:
    """Each user's latest subscription that is active, or cancelled but not ended."""
    usable = subscriptions.filter(
        (F.col("status") == "active")
        | ((F.col("status") == "cancelled") & (F.col("end_date") > as_of))
    )
    planned = usable.join(_plan_detail(plans), "plan_id")
    return top_per_key(planned, ["user_id"], [F.desc("start_date"), F.asc("id")], 1)


def subscription_history(
    subscriptions: DataFrame, plans: DataFrame, page: int = 1, page_size: int = 20
) -> DataFrame:
    """One page per user, newest first, with the user's total."""
    limit, offset = check_page(page, page_size)
    planned = subscriptions.join(_plan_detail(plans), "plan_id")
    totals = planned.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_records"))
    order = [F.desc("start_date"), F.asc("id")]
    return top_per_key(planned, ["user_id"], order, limit, offset, "row_num").join(totals, "user_id")


def all_subscriptions(
    subscriptions: DataFrame,
    plans: DataFrame,
    challenges: DataFrame,
    page: int | None = 1,
    page_size: int = 20,
) -> DataFrame:
    """All subscriptions, newest first, flagged where a challenge exists. `page=None` gives all."""
    planned = subscriptions.join(_plan_detail(plans), "plan_id")
    if page is not None:
        planned = page_of(planned, [F.desc("start_date"), F.asc("id")], page, page_size)
    challenged = challenges.select(F.col("referenced_subscription_id").alias("id")).distinct()
    flagged = planned.join(challenged.withColumn("__c", F.lit(True)), "id", "left")
    return flagged.withColumn(
        "has_challenged_transactions", F.coalesce("__c", F.lit(False))
    ).drop("__c")


def pending_challenges(
    challenges: DataFrame, keys: DataFrame | None = None, on: str | None = None
) -> DataFrame:
    """Pending challenges, all or those whose `on` column occurs in `keys`."""
    pending = challenges.filter("status = 'pending'")
    return pending if keys is None else pending.join(keys.select(on), on, "left_semi")


def renewal_candidates(
    subscriptions: DataFrame, users: DataFrame, challenges: DataFrame, as_of: Column
) -> DataFrame:
    """Expired subscriptions with payer, without those that wait for a challenge."""
    due = subscriptions.filter((F.col("status") == "expired") & (F.col("end_date") < as_of))
    waiting = pending_challenges(challenges).select(
        F.col("referenced_subscription_id").alias("subscription_id")
    )
    payer = users.select(F.col("id").alias("user_id"), "email", "name")
    return (
        due.select(
            F.col("id").alias("subscription_id"), "authorization_code", "plan_id", "price",
            "currency", "user_id", "end_date",
        )
        .join(waiting, "subscription_id", "left_anti")
        .join(payer, "user_id")
    )


def next_renewals(candidates: DataFrame, page: int | None = None, page_size: int = 5) -> DataFrame:
    """The renewals one run handles, longest expired first: all that are due, or one page of them."""
    order = [F.asc("end_date"), F.asc("subscription_id")]
    if page is None:
        return candidates.withColumn("total_records", count_of(candidates)).orderBy(*order)
    return page_of(candidates, order, page, page_size)


def challenge_detail(challenges: DataFrame, subscriptions: DataFrame, users: DataFrame) -> DataFrame:
    """Challenges with subscription and payer detail."""
    subs = subscriptions.select(
        F.col("id").alias("referenced_subscription_id"), "plan_id", "price", "start_date", "end_date"
    )
    payer = users.select(
        F.col("id").alias("user_id"), F.col("name").alias("user_name"),
        F.col("email").alias("user_email"), "user_img",
    )
    return (
        challenges.withColumnRenamed("id", "transaction_id")
        .join(subs, "referenced_subscription_id")
        .join(payer, "user_id")
    )


def subscription_kpis(
    subscriptions: DataFrame,
    challenges: DataFrame,
    failed: DataFrame,
    as_of: Column,
    compat: bool = False,
) -> DataFrame:
    """Ten KPIs in one row from one pass over the subscriptions.

    `compat` returns the number of recent cancellations as churn_rate, not their share.
    """
    status, end = F.col("status"), F.col("end_date")
    cancelled = status == "cancelled"
    month = F.expr(MONTH)
    lasted = F.when(cancelled, interval_seconds(end - F.col("start_date")))
    base = subscriptions.agg(
        F.count(F.lit(1)).alias("__all"),
        count_where(status == "active", "total_active_subscriptions"),
        count_where(cancelled & (end >= as_of - month), "__churned"),
        F.coalesce(F.avg(F.col("price").cast("double")), F.lit(0.0)).alias("average_revenue_per_user"),
        F.coalesce(F.avg(lasted), F.lit(0.0)).alias("average_duration"),
        F.coalesce(F.sum("price"), F.lit(0)).alias("total_revenue"),
        count_where(status == "failed", "failed_status_count"),
        count_where(end.between(as_of, as_of + month), "near_expiry_count"),
    )
    share = lambda part: F.coalesce(
        F.try_divide(part.cast("double"), F.col("__all").cast("double")), F.lit(0.0)
    )
    challenged = one_row(challenges, F.count(F.lit(1)).alias("n"))["n"]
    churned = F.col("__churned")
    return base.select(
        "total_active_subscriptions",
        (churned.cast("double") if compat else share(churned)).alias("churn_rate"),
        "average_revenue_per_user",
        "average_duration",
        "total_revenue",
        F.coalesce(most_common(subscriptions, "payment_method"), F.lit("")).alias(
            "most_popular_payment_method"
        ),
        F.coalesce(most_common(subscriptions, "plan_id"), F.lit(0)).alias("most_subscribed_plan"),
        share(challenged).alias("challenged_rate"),
        "failed_status_count",
        one_row(failed, F.count(F.lit(1)).alias("n"))["n"].alias("failed_transactions_count"),
        "near_expiry_count",
    )


def revenue_by_plan(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Whole-unit revenue per plan name; summed per plan id before the join."""
    per_plan = subscriptions.groupBy("plan_id").agg(F.sum("price").alias("revenue"))
    return (
        per_plan.join(plans.select(F.col("id").alias("plan_id"), F.col("name").alias("plan_name")), "plan_id")
        .groupBy("plan_name")
        .agg(F.round(F.sum("revenue"), 0).cast("bigint").alias("total_revenue"))
    )


def challenge_outcomes(challenges: DataFrame) -> DataFrame:
    return challenges.groupBy("status").agg(F.count(F.lit(1)).alias("outcome_count"))


def revenue_by_payment_method(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.groupBy("payment_method").agg(
        F.coalesce(F.sum("price"), F.lit(0)).alias("revenue")
    )


def subscriptions_over_time(subscriptions: DataFrame, as_of: Column) -> DataFrame:
    """New subscriptions per day of the last 30 days; days without any are absent."""
    return (
        subscriptions.filter(F.col("start_date") >= as_of - F.expr(MONTH))
        .groupBy(F.to_date("start_date").alias("day"))
        .agg(F.count(F.lit(1)).alias("subscriptions_count"))
        .orderBy("day")
    )


def new_vs_cancelled(subscriptions: DataFrame, as_of: Column) -> DataFrame:
    since = as_of - F.expr(MONTH)
    return subscriptions.agg(
        count_where(F.col("start_date") >= since, "new_subscriptions"),
        count_where(
            (F.col("status") == "cancelled") & (F.col("end_date") >= since),
            "cancelled_subscriptions",
        ),
    )


def subscriptions_by_currency(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.groupBy("currency").agg(F.count(F.lit(1)).alias("currency_count"))


def subscription_report(
    subscriptions: DataFrame, plans: DataFrame, challenges: DataFrame, failed: DataFrame, as_of: Column
) -> dict[str, DataFrame]:
    """All report parts. Each part reads only its own columns, so nothing is cached."""
    return {
        "kpis": subscription_kpis(subscriptions, challenges, failed, as_of),
        "new_vs_cancelled": new_vs_cancelled(subscriptions, as_of),
        "revenue_by_plan": revenue_by_plan(subscriptions, plans),
        "challenge_outcomes": challenge_outcomes(challenges),
        "revenue_by_payment_method": revenue_by_payment_method(subscriptions),
        "subscriptions_over_time": subscriptions_over_time(subscriptions, as_of),
        "subscriptions_by_currency": subscriptions_by_currency(subscriptions),
    }


@dataclass(frozen=True)
class Renewals:
    challenged: DataFrame  # new challenge rows
    renewed: DataFrame  # new active subscriptions
    failed: DataFrame  # failed charges
    rejected: DataFrame  # replies for plans not on sale
    subscriptions: Change  # the table with renewed rows marked


def route_renewals(candidates: DataFrame, replies: DataFrame, plans: DataFrame, as_of: Column) -> DataFrame:
    """Due subscriptions with their charge reply and exactly one outcome.

    `replies` holds one parsed reply per `subscription_id`: paused, status,
    gateway_response, message, reference, transaction_id, authorization_url, channel and the
    card columns card_last4, card_exp_month, card_exp_year, card_type.
    A paused charge is challenged whatever its plan. Only plans on sale renew or fail; other
    replies are `rejected`.
    """
    on_sale = plans.filter("status = 'active'").select(
        F.col("id").alias("plan_id"), F.col("duration").alias("plan_duration"), F.lit(True).alias("__sold")
    )
    paid = (F.col("gateway_status") == "success") | (F.col("gateway_response") == "Approved")
    outcome = (
        F.when(F.coalesce("paused", F.lit(False)), "challenged")
        .when(~F.col("on_sale"), "rejected")
        .when(F.coalesce(paid, F.lit(False)), "renewed")
        .otherwise("failed")
    )
    return (
        candidates.join(replies, "subscription_id")
        .join(on_sale, "plan_id", "left")
        .withColumn("on_sale", F.coalesce("__sold", F.lit(False)))
        .drop("__sold")
        .withColumn("outcome", outcome)
        .withColumn("new_start", as_of)
        .withColumn("new_end", F.when(F.col("on_sale"), plan_end_date(F.col("plan_duration"), as_of)))
    )


def renewal_actions(
    candidates: DataFrame,
    replies: DataFrame,
    plans: DataFrame,
    subscriptions: DataFrame,
    as_of: Column,
) -> Renewals:
    """Rows to write for a batch of charge replies."""
    routed = route_renewals(candidates, replies, plans, as_of)
    challenged = routed.filter("outcome = 'challenged'").select(
        "user_id", F.col("subscription_id").alias("referenced_subscription_id"),
        "authorization_url", "reference", F.lit("pending").alias("status"),
        as_of.alias("created_at"),
    )
    paid = routed.filter("outcome = 'renewed'")
    renewed = paid.select(
        "user_id", "plan_id", F.col("new_start").alias("start_date"), F.col("new_end").alias("end_date"),
        "price", F.lit("active").alias("status"), "transaction_id",
        F.col("channel").alias("payment_method"), "authorization_code", "currency",
        "card_last4", "card_exp_month", "card_exp_year", "card_type",
    )
    failed = routed.filter("outcome = 'failed'").select(
        "user_id", "subscription_id", as_of.alias("attempt_date"), "authorization_code", "reference",
        F.col("price").alias("amount"), F.col("message").alias("failure_reason"),
        F.col("gateway_response").alias("error_code"),
    )
    marks = paid.select(F.col("subscription_id").alias("id"), F.lit("renewed").alias("status"))
    marked = keyed_update(subscriptions, marks, ["id"], ["status"], ["id"], {"updated_at": as_of})
    return Renewals(challenged, renewed, failed, routed.filter("outcome = 'rejected'"), marked)
