"""Row validation: rule sets that give the first message per field."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted formats.
EMAIL = (
    r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$"
)
UUID = r"^(?:urn:uuid:)?[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
PERMISSION = r"^[a-zA-Z]+:[a-zA-Z]+$"
NIL_UUID = "00000000-0000-0000-0000-000000000000"


@dataclass(frozen=True)
class Rule:
    field: str
    ok: Column
    message: str


def is_valid_url(url: Column) -> Column:
    """A URL with a scheme and a host."""
    has = lambda part: F.coalesce(F.try_parse_url(url, F.lit(part)), F.lit("")) != ""
    return has("PROTOCOL") & has("HOST")


def is_valid_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))


def provided(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def at_most_bytes(c: Column, n: int) -> Column:
    return F.octet_length(F.coalesce(c, F.lit(""))) <= n


def non_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)) != 0


def one_of(c: Column, *values: str) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def first_errors(rules: Sequence[Rule]) -> Column:
    """Map field -> first failing message, in rule order; empty map when all hold."""
    by_field: dict[str, Column] = {}
    for rule in reversed(rules):
        failing = F.when(~F.coalesce(rule.ok, F.lit(False)), F.lit(rule.message))
        later = by_field.get(rule.field)
        by_field[rule.field] = failing if later is None else F.coalesce(failing, later)
    ordered = list(dict.fromkeys(r.field for r in rules))
    entries = F.array(
        *[F.struct(F.lit(f).alias("field"), by_field[f].alias("message")) for f in ordered]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["message"].isNotNull()))


def validate_rows(df: DataFrame, rules: Sequence[Rule], errors: str = "errors") -> DataFrame:
    """Add the error map; a row is valid where it is empty."""
    return df.withColumn(errors, first_errors(rules))


def split_valid(df: DataFrame, rules: Sequence[Rule], errors: str = "errors"):
    """(valid rows without the map, rejected rows with it)."""
    checked = validate_rows(df, rules, errors)
    return checked.filter(F.size(errors) == 0).drop(errors), checked.filter(F.size(errors) > 0)


# Rule sets. Field names and messages are fixed values.


def feed_rules(name="name", url="url", image="img_url", kind="feed_type", about="feed_description"):
    c = F.col
    return [
        Rule("name", provided(c(name)), "must be provided"),
        Rule("name", at_most_bytes(c(name), 500), "must not be more than 500 bytes long"),
        Rule("url", provided(c(url)), "must be provided"),
        Rule("url", is_valid_url(c(url)), "must be a valid URL"),
        Rule("Image", provided(c(image)), "url must be provided"),
        Rule("Image", is_valid_url(c(image)), "must have a valid URL"),
        Rule("feed type", provided(c(kind)), "must be provided"),
        Rule("feed type", at_most_bytes(c(kind), 500), "must not be more than 500 bytes long"),
        Rule("feed description", provided(c(about)), "must be provided"),
        Rule(
            "feed description", at_most_bytes(c(about), 500), "must not be more than 500 bytes long"
        ),
    ]


def feed_follow_rules(feed_id="feed_id"):
    c = F.col(feed_id)
    return [
        Rule("feed id", provided(c) & (c.cast("string") != NIL_UUID), "must be provided"),
        Rule("feed id", is_valid_uuid(c.cast("string")), "must be a valid UUID"),
    ]


def favorite_rules(post_id="post_id", feed_id="feed_id"):
    return [
        Rule("feed id", is_valid_uuid(F.col(post_id).cast("string")), "must be a valid UUID"),
        Rule("feed id", is_valid_uuid(F.col(feed_id).cast("string")), "must be a valid UUID"),
    ]


def comment_rules(post_id="post_id", text="comment_text"):
    post, body = F.col(post_id).cast("string"), F.col(text)
    return [
        Rule("post_id", provided(post) & (post != NIL_UUID), "must be provided"),
        Rule("post id", is_valid_uuid(post), "must be a valid UUID"),
        Rule("comment_text", provided(body), "must be provided"),
        Rule("comment_text", at_most_bytes(body, 500), "must not be more than 500 bytes long"),
    ]


def comment_update_rules(comment_id="id", text="comment_text", version="version"):
    key, body = F.col(comment_id).cast("string"), F.col(text)
    return [
        Rule("comment_id", provided(key) & (key != NIL_UUID), "must be provided"),
        Rule("comment id", is_valid_uuid(key), "must be a valid UUID"),
        Rule("comment_text", provided(body), "must be provided"),
        Rule("comment_text", at_most_bytes(body, 500), "must not be more than 500 bytes long"),
        Rule("version", non_zero(F.col(version)), "must be valid and provided"),
    ]


def plan_rules():
    c = F.col
    return [
        Rule("name", provided(c("name")), "must be provided"),
        Rule("name", at_most_bytes(c("name"), 100), "must not be more than 100 characters"),
        Rule("description", provided(c("description")), "must be provided"),
        Rule(
            "description",
            at_most_bytes(c("description"), 500),
            "must not be more than 500 characters",
        ),
        Rule("duration", provided(c("duration")), "must be provided"),
        Rule("price", non_zero(c("price")), "must be provided"),
        Rule("features", F.coalesce(F.size("features"), F.lit(0)) > 0, "must be provided"),
        Rule("status", provided(c("status")), "must be provided"),
        Rule(
            "status",
            one_of(c("status"), "active", "inactive"),
            "must be either 'active' or 'inactive'",
        ),
    ]


def subscription_status_rules(key="id", status="status"):
    return [
        Rule("id", is_valid_uuid(F.col(key).cast("string")), "must be a valid UUID"),
        Rule("status", provided(F.col(status)), "must be provided"),
        Rule("status", one_of(F.col(status), "cancelled"), "must be a valid status"),
    ]


def challenge_rules(key="id", status="status"):
    return [
        Rule("ID", non_zero(F.col(key)), "must be valid or provided"),
        Rule("status", provided(F.col(status)), "must be provided"),
        Rule(
            "status",
            one_of(F.col(status), "pending", "failed", "successful"),
            "must be a valid status",
        ),
    ]


def charge_rules(amount="amount", plan="plan_id"):
    return [
        Rule("amount", non_zero(F.col(amount)), "must be varied"),
        Rule("plan_id", non_zero(F.col(plan)), "must be provided"),
    ]


def verification_rules(reference="reference", plan="plan_id"):
    return [
        Rule("reference", provided(F.col(reference)), "must be varied"),
        Rule("plan_id", non_zero(F.col(plan)), "must be provided"),
    ]


def announcement_rules():
    c = F.col
    return [
        Rule("title", provided(c("title")), "must be provided"),
        Rule("message", provided(c("message")), "must be provided"),
        Rule("created_by", non_zero(c("created_by")), "must be provided"),
        Rule("expires_at", c("expires_at").isNotNull(), "must be provided"),
        Rule("urgency", provided(c("urgency")), "must be provided"),
        Rule(
            "urgency",
            one_of(c("urgency"), "low", "medium", "high"),
            "must be one of 'low', 'medium', or 'high'",
        ),
    ]


def announcement_read_rules(key="announcement_id"):
    return [Rule("announcement_id", non_zero(F.col(key)), "must be provided")]


def user_rules(name="name", email="email", image="user_img"):
    return [
        Rule("email", provided(F.col(name)), "must be provided"),
        Rule("name", at_most_bytes(F.col(name), 500), "must not be more than 500 bytes long"),
        Rule("email", provided(F.col(email)), "must be provided"),
        Rule("email", F.col(email).rlike(EMAIL), "must be a valid email address"),
        Rule("image", provided(F.col(image)), "must be provided"),
    ]


def permission_rules(code="code"):
    return [
        Rule("codes", provided(F.col(code)), "must be provided"),
        Rule(
            "permissions", F.col(code).rlike(PERMISSION), "must be in the format 'permission:code'"
        ),
    ]


def grant_rules(codes="codes", user="user_id"):
    return [
        Rule("permissions", F.coalesce(F.size(codes), F.lit(0)) > 0, "must be provided"),
        Rule("user_id", non_zero(F.col(user)), "must be provided"),
    ]


def revoke_rules(code="code", user="user_id"):
    return [
        Rule("codes", provided(F.col(code)), "must be provided"),
        Rule("user_id", non_zero(F.col(user)), "must be provided"),
    ]


def feed_moderation_rules(approval="approval_status", priority="priority"):
    return [
        Rule("approval_status", provided(F.col(approval)), "must be provided"),
        Rule(
            "approval_status",
            one_of(F.col(approval), "approved", "pending", "rejected"),
            "must be either approved, pending or rejected",
        ),
        Rule("priority", provided(F.col(priority)), "must be provided"),
        Rule(
            "priority",
            one_of(F.col(priority), "high", "normal", "low"),
            "must be either high, normal or low",
        ),
    ]


def error_log_rules(notes="resolution_notes"):
    return [Rule("resolution_notes", provided(F.col(notes)), "must be provided")]


def paging_rules(page="page", size="page_size", sort="sort", sortable: Sequence[str] = ("id",)):
    page_no, per_page = F.col(page), F.col(size)
    return [
        Rule("page", page_no > 0, "must be greater than zero"),
        Rule("page", page_no <= 10_000_000, "must be a maximum of 10 million"),
        Rule("page_size", per_page > 0, "must be greater than zero"),
        Rule("page_size", per_page <= 100, "must be a maximum of 100"),
        Rule("sort", one_of(F.col(sort), *sortable), "invalid sort value"),
    ]
