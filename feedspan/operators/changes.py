"""Batches of changes applied to a table.

Every function is pure: frames in, frames out. The caller decides where the new
table is written. Changes are judged against the table as it was before the batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspan.operators.keys import highest, is_serial, numbered, serial_id
from feedspan.sources.storage import staged


@dataclass(frozen=True)
class Change:
    table: DataFrame  # the table after the batch
    changed: DataFrame  # rows written, updated or deleted
    rejected: DataFrame  # changes that did not apply
    # Every row of the table once, with `__state`: kept, changed, cleared or deleted; of an insert every
    # row of the batch, accepted or rejected. The frames above are filters on it, so a job that wants
    # more than one of them reads this one, or stages it.
    judged: DataFrame | None = None


def _judged(judged: DataFrame, columns: Sequence[str], rejected: DataFrame) -> Change:
    plain = [F.col(c) for c in columns]
    return Change(
        judged.filter("__state <> 'deleted'").select(*plain), judged.filter("__state <> 'kept'").select(*plain),
        rejected, judged.select(*plain, "__state"))


def _state(hit: Column, state: str) -> Column:
    return F.when(F.coalesce(hit, F.lit(False)), state).otherwise("kept").alias("__state")


def _normalised(df: DataFrame, keys: Sequence[str], ignore_case: bool, prefix: str) -> list[Column]:
    norm = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    return [norm(F.col(k)).alias(f"{prefix}{i}") for i, k in enumerate(keys)]


def _matches(left: Sequence[str], right: Sequence[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right, strict=True):
        cond = cond & (F.col(a) == F.col(b))
    return cond


def _with_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Union by name; columns the new rows lack become NULL, extra ones are left out."""
    shared = rows.select(*[c for c in table.columns if c in rows.columns])
    return table.unionByName(shared, allowMissingColumns=True)


def existing_keys(
    table: DataFrame, batch_keys: DataFrame, keys: Sequence[str], ignore_case: bool = False
) -> DataFrame:
    """Keys of the batch that the table already has, as columns `__e0..`.

    The table is the left side of a semi join, so a small batch is broadcast and the
    table is read once, keys only, without a shuffle.
    """
    held = table.select(*_normalised(table, keys, ignore_case, "__e"))
    names = [f"__e{i}" for i in range(len(keys))]
    asked = batch_keys.toDF(*[f"__k{i}" for i in range(len(keys))])
    return held.join(asked, _matches(names, asked.columns), "left_semi").distinct()


def flag_unique(
    table: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    ignore_case: bool = False,
    eligible: Column | None = None,
    first: int | None = None,
) -> DataFrame:
    """The batch with `__ok`, true where a row's key is new and the row is the first in `order`.

    Rows that aren't `eligible` take no part and are not ok. `order` must be unique in a key and never
    NULL, and unique in the batch if it numbers rows. Winners come from one map-side combined
    grouping and are matched back on (key, order), so a key repeated in a third of the batch is
    spread over all tasks. A NULL in a key never clashes. Where the table numbers its rows, an
    accepted row also gets its id: consecutive numbers after `first`, or the table's largest, in `order`.
    """
    names = [f"__b{i}" for i in range(len(keys))]
    asking = batch if eligible is None else batch.filter(eligible)
    keyed = asking.select(*order, *_normalised(batch, keys, ignore_case, "__b"))
    any_null = F.lit(False)
    for n in names:
        any_null = any_null | F.col(n).isNull()
    # A single order column aggregates in a hash map; a struct would need a sort.
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    winners = keyed.filter(~any_null).groupBy(*names).agg(F.min(rank).alias("__w"))
    won = [F.col(f"__w.{o}") for o in order] if len(order) > 1 else [F.col("__w")]
    held = existing_keys(table, winners.select(*names), keys, ignore_case)
    places, found = [f"__o{i}" for i in range(len(order))], [f"__f{i}" for i in range(len(keys))]
    fresh = winners.join(held, _matches(names, held.columns), "left_anti").select(
        *[F.col(n).alias(f) for n, f in zip(names, found, strict=True)], *[w.alias(o) for w, o in zip(won, places, strict=True)])
    may_be_null = any(f.nullable for f in keyed.schema if f.name in names)
    if may_be_null:
        fresh = fresh.unionAll(keyed.filter(any_null).select(*names, *order).toDF(*found, *places))
    same = _matches(order, places)
    for n, f in zip(names, found, strict=True):
        same = same & (F.col(n).eqNullSafe(F.col(f)) if may_be_null else F.col(n) == F.col(f))
    asked = batch.select("*", *_normalised(batch, keys, ignore_case, "__b"))
    if not is_serial(table, batch):
        flagged = asked.join(fresh.withColumn("__ok", F.lit(True)), same, "left")
        return flagged.select(*batch.columns, F.coalesce("__ok", F.lit(False)).alias("__ok"))
    flagged = asked.join(numbered(fresh, places), same, "left")
    number = serial_id(table, highest(table) if first is None else first, F.col("__n"))
    return flagged.select(*batch.columns, number, F.col("__n").isNotNull().alias("__ok"))


def insert_unique(
    table: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    ignore_case: bool = False,
    first: int | None = None,
) -> Change:
    """Insert rows whose key is new; the first row in `order` wins inside the batch (see `flag_unique`)."""
    flagged = flag_unique(table, batch, keys, order, ignore_case, first=first)
    accepted = flagged.filter("__ok").drop("__ok")
    rejected = flagged.filter(~F.col("__ok")).drop("__ok")
    state = F.when(F.col("__ok"), "accepted").otherwise("rejected").alias("__state")
    return Change(_with_rows(table, accepted), accepted, rejected, flagged.select("*", state).drop("__ok"))


def append_rows(table: DataFrame, batch: DataFrame, order: Sequence[str] = (), first: int | None = None) -> Change:
    """Append all rows; columns the batch lacks become NULL.

    Where the table numbers its rows, they get consecutive numbers in `order` after `first`, or
    after the table's largest.
    """
    if is_serial(table, batch):
        rows, start = numbered(batch, order), highest(table) if first is None else first
        batch = rows.select(*batch.columns, serial_id(table, start, F.col("__n")))
    return Change(_with_rows(table, batch), batch, batch.limit(0))


def _updated(table: DataFrame, set_columns: Sequence[str], hit: Column) -> list[Column]:
    """Table columns, replaced by the change's non-NULL values where `hit`."""
    return [
        F.when(hit, F.coalesce(F.col(f"__c_{c}"), F.col(c))).otherwise(F.col(c)).alias(c)
        if c in set_columns
        else F.col(c)
        for c in table.columns
    ]


def versioned_update(
    table: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    set_columns: Sequence[str],
    order: Sequence[str],
    version: str = "version",
    fixed: Mapping[str, Column] | None = None,
    stage: bool = False,
) -> Change:
    """Optimistic update: a change applies only where its version is the row's version.

    NULL in a change means "keep the old value". Of several changes with the right
    version, the first in `order` applies; the others, and changes with a stale
    version or unknown key, are rejected as edit conflicts. With `stage` the judged
    table is written once and all results read that.
    """
    match_on = [*keys, version]
    at = [f"__k{i}" for i in range(len(match_on))]
    places = [f"__o{i}" for i in range(len(order))]
    first = changes.groupBy(*match_on).agg(
        F.min_by(F.struct(*[F.col(c) for c in set_columns]), F.struct(*order)).alias("__set"),
        F.min(F.struct(*order)).alias("__first"),
    )
    picked = first.select(
        *[F.col(k).alias(a) for k, a in zip(match_on, at, strict=True)],
        *[F.col(f"__first.{o}").alias(p) for o, p in zip(order, places, strict=True)],
        F.lit(True).alias("__hit"),
        *[F.col(f"__set.{c}").alias(f"__c_{c}") for c in set_columns],
    )
    joined = table.join(picked, _matches(match_on, at), "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    result = joined.select(*_updated(table, set_columns, hit), _state(hit, "changed"), *at, *places)
    # Fixed values and the version step come after the change's own values.
    changed = F.col("__state") == "changed"
    judged = result.select(
        *[
            (F.when(changed, F.col(c) + 1).otherwise(F.col(c)).alias(c)
             if c == version
             else F.when(changed, fixed[c]).otherwise(F.col(c)).alias(c)
             if fixed and c in fixed
             else F.col(c))
            for c in table.columns
        ],
        "__state", *at, *places,
    )
    judged = staged(judged, "judged-rows") if stage else judged
    if stage:
        applied = judged.filter(changed).select(*at, *places)
    else:  # the keys of the table are cheaper to read again than to judge it twice
        held = existing_keys(table, first.select(*match_on), match_on)
        applied = picked.join(held, _matches(at, held.columns), "left_semi").select(*at, *places)
    rejected = changes.join(applied, _matches([*match_on, *order], applied.columns), "left_anti")
    return _judged(judged, table.columns, rejected)


def keyed_update(
    table: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    set_columns: Sequence[str],
    order: Sequence[str],
    fixed: Mapping[str, Column] | None = None,
    stage: bool = False,
) -> Change:
    """Unconditional update by key; the last change in `order` wins, NULLs are written."""
    last = changes.groupBy(*keys).agg(
        F.max_by(F.struct(*set_columns), F.struct(*order)).alias("__set")
    )
    at = [f"__k{i}" for i in range(len(keys))]
    picked = last.select(
        *[F.col(k).alias(a) for k, a in zip(keys, at, strict=True)],
        F.lit(True).alias("__hit"),
        *[F.col(f"__set.{c}").alias(f"__c_{c}") for c in set_columns],
    )
    joined = table.join(picked, _matches(keys, at), "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    fixed = dict(fixed or {})
    judged = joined.select(
        *[
            F.when(hit, F.col(f"__c_{c}")).otherwise(F.col(c)).alias(c)
            if c in set_columns
            else F.when(hit, fixed[c]).otherwise(F.col(c)).alias(c)
            if c in fixed
            else F.col(c)
            for c in table.columns
        ],
        _state(hit, "changed"), *at,
    )
    judged = staged(judged, "judged-rows") if stage else judged
    if stage:
        applied = judged.filter("__state = 'changed'").select(*at).distinct()
    else:
        applied = existing_keys(table, changes.select(*keys).distinct(), keys).toDF(*at)
    rejected = changes.join(applied, _matches(keys, at), "left_anti")
    return _judged(judged, table.columns, rejected)


def transition(
    table: DataFrame, when: Column, set_to: Mapping[str, Column]
) -> Change:
    """Bulk status change: rows that satisfy `when` get the new values. No shuffle."""
    due = F.coalesce(when, F.lit(False))
    marked = table.withColumn("__due", due)
    result = marked.select(
        *[
            F.when(F.col("__due"), set_to[c]).otherwise(F.col(c)).alias(c) if c in set_to else F.col(c)
            for c in table.columns
        ],
        "__due",
    )
    return Change(result.drop("__due"), result.filter("__due").drop("__due"), table.limit(0))


def expire_subscriptions(subscriptions: DataFrame, as_of: Column) -> Change:
    """Ended before today and still open -> expired."""
    ended = (F.col("end_date") < F.date_trunc("day", as_of).cast("timestamp_ntz")) & ~F.col(
        "status"
    ).isin("expired", "renewed", "cancelled")
    return transition(subscriptions, ended, {"status": F.lit("expired"), "updated_at": as_of})


def expire_challenges(challenges: DataFrame, as_of: Column) -> Change:
    """Pending for more than 24 hours -> failed."""
    stale = (F.col("status") == "pending") & (
        F.col("created_at") < as_of - F.expr("INTERVAL '24' HOUR")
    )
    return transition(challenges, stale, {"status": F.lit("failed"), "updated_at": as_of})


def delete_by_keys(table: DataFrame, doomed: DataFrame, keys: Sequence[str], stage: bool = False) -> Change:
    """Delete rows whose key occurs in `doomed`."""
    at = [f"__d{i}" for i in range(len(keys))]
    asked = doomed.select(*[F.col(k).alias(a) for k, a in zip(keys, at, strict=True)]).distinct()
    judged = table.join(asked, _matches(keys, at), "left").select(
        *[F.col(c) for c in table.columns], _state(F.col(at[0]).isNotNull(), "deleted"))
    judged = staged(judged, "judged-rows") if stage else judged
    gone = judged.filter("__state = 'deleted'").select(*[F.col(k).alias(a) for k, a in zip(keys, at, strict=True)]).distinct()
    return _judged(judged, table.columns, doomed.join(gone, _matches(keys, at), "left_anti"))


def purge_older_than(table: DataFrame, as_of: Column, minutes_kept: int) -> Change:
    """Retention: drop rows created at or before the cutoff; a filter, so old date folders are skipped."""
    cutoff = as_of - F.lit(minutes_kept).cast("bigint") * F.expr("INTERVAL '1' MINUTE")
    return Change(
        table.filter(F.col("created_at") > cutoff),
        table.filter(F.col("created_at") <= cutoff),
        table.limit(0),
    )


# parent table -> [(child table, child column, parent column)]: what goes when a row goes.
CASCADES: dict[str, list[tuple[str, str, str]]] = {
    "feeds": [
        ("feed_follows", "feed_id", "id"),
        ("posts", "feed_id", "id"),
        ("favorites", "feed_id", "id"),
        ("notifications", "feed_id", "id"),
        ("scraper_error_logs", "feed_id", "id"),
        ("feed_rejections", "feed_id", "id"),
    ],
    "posts": [
        ("favorites", "post_id", "id"),
        ("comments", "post_id", "id"),
        ("comment_notifications", "post_id", "id"),
    ],
    "comments": [("comment_notifications", "comment_id", "id")],
    "announcements": [("announcement_reads", "announcement_id", "id")],
    "permissions": [("users_permissions", "permission_id", "id")],
    "users": [
        ("feeds", "user_id", "id"),
        ("feed_follows", "user_id", "id"),
        ("favorites", "user_id", "id"),
        ("comments", "user_id", "id"),
        ("comment_notifications", "user_id", "id"),
        ("subscriptions", "user_id", "id"),
        ("challenged_transactions", "user_id", "id"),
        ("users_permissions", "user_id", "id"),
        ("announcement_reads", "user_id", "id"),
    ],
    "subscriptions": [("challenged_transactions", "referenced_subscription_id", "id")],
}


# parent table -> [(child table, child column, parent column)]: what loses its reference when a row goes.
SET_NULL: dict[str, list[tuple[str, str, str]]] = {
    "users": [("feed_rejections", "rejected_by", "id")],
    "payment_plans": [("subscriptions", "plan_id", "id")],
}


def _flag(table: DataFrame, keys: Mapping[str, DataFrame], flag: str) -> DataFrame:
    """The table with a flag for rows whose value of any column is among that column's keys.

    Keys are distinct and come straight from a written table, so a join shuffles plain scans and
    AQE can split a hot parent.
    """
    hit = F.lit(False)
    for i, (column, wanted) in enumerate(keys.items()):
        table = table.join(
            wanted.toDF(f"__d{i}").withColumn(f"__h{i}", F.lit(True)), F.col(column) == F.col(f"__d{i}"), "left")
        hit = hit | F.coalesce(F.col(f"__h{i}"), F.lit(False))
    spare = [f"__{x}{i}" for x in "dh" for i in range(len(keys))]
    return table.withColumn(flag, hit).drop(*spare)


def cascade_delete(
    tables: Mapping[str, DataFrame], root: str, doomed: DataFrame, key: str = "id"
) -> dict[str, Change]:
    """Delete root rows and everything that depends on them; references that may be NULL become so.

    Walks the fixed foreign-key graph parents first. A child row goes when any of its parents
    goes. The keys deleted at one level are written once and read by every child, and each table
    is flagged in one pass, so no deleted set is derived twice.
    """
    asked = staged(doomed.select(key).distinct(), "deleted-keys")
    lost: dict[str, dict[str, list[DataFrame]]] = {root: {key: [asked]}}
    cleared: dict[str, dict[str, list[DataFrame]]] = {}
    order, seen = [], set()

    def visit(name: str) -> None:
        if name in seen:
            return
        seen.add(name)
        for child, _, _ in [*CASCADES.get(name, []), *SET_NULL.get(name, [])]:
            if child in tables:
                visit(child)
        order.append(name)

    def merged(columns: Mapping[str, list[DataFrame]]) -> dict[str, DataFrame]:
        """One written list of distinct keys per column; several parents' lists become one."""
        return {
            c: frames[0] if len(frames) == 1 else staged(reduce(DataFrame.union, frames).distinct(), "deleted-keys")
            for c, frames in columns.items()
        }

    visit(root)
    results: dict[str, Change] = {}
    for name in reversed(order):
        table = tables[name]
        if name not in lost and name not in cleared:
            continue
        flagged = _flag(_flag(table, merged(lost.get(name, {})), "__gone"), merged(cleared.get(name, {})), "__cleared")
        columns = [
            F.when(F.col("__cleared"), None).otherwise(F.col(c)).alias(c) if c in cleared.get(name, {}) else F.col(c)
            for c in table.columns
        ]
        state = F.when(F.col("__gone"), "deleted").when(F.col("__cleared"), "cleared").otherwise("kept")
        # Deleted and cleared rows are told as they were, the table has them as they are now.
        results[name] = Change(
            flagged.filter(~F.col("__gone")).select(*columns),
            flagged.filter(F.col("__gone") | F.col("__cleared")).select(*table.columns), table.limit(0),
            flagged.select(*columns, state.alias("__state")))
        below = [
            (into, *edge) for edges, into in ((CASCADES, lost), (SET_NULL, cleared))
            for edge in edges.get(name, []) if edge[0] in tables
        ]
        deleted = {
            c: staged(flagged.filter("__gone").select(c).distinct(), "deleted-keys") for c in {edge[3] for edge in below}
        }
        for into, child, child_column, parent_column in below:
            into.setdefault(child, {}).setdefault(child_column, []).append(deleted[parent_column])
    return results
