import random

import pytest
from pyspark.sql import functions as F

from feedspan.functions.timestamps import as_ntz
from feedspan.operators import changes, paging
from feedspan.operators.summaries import latest_per_key, most_common, numbered_facet, one_row
from feedspan.operators.lookup import key_lookup
from feedspan.operators.paging import check_page, page_after, page_metadata, page_of, top_per_key
from feedspan.operators.search import search_all
from feedspan.operators.skew import hot_keys, join_sliced
from feedspan.plans import discovery, moderation, subscriptions

from conftest import rows


# Paging


def test_page_metadata(spark):
    got = page_metadata(spark.range(12), 2, 5).first().asDict()
    assert got == {"current_page": 2, "page_size": 5, "first_page": 1, "last_page": 3, "total_records": 12}
    assert set(page_metadata(spark.range(0), 1, 5).first()) == {None}


@pytest.mark.parametrize("page, size", [(0, 5), (-1, 5), (10_000_001, 5), (1, 0), (1, 101)])
def test_page_limits(page, size):
    with pytest.raises(ValueError):
        check_page(page, size)


def test_pages_cover_everything_once(spark):
    df = spark.range(23).withColumn("k", F.col("id") % 4)
    order = [F.desc("k"), F.asc("id")]
    got = [r["id"] for p in range(1, 6) for r in page_of(df, order, p, 5).collect()]
    assert got == [r["id"] for r in df.orderBy(*order).collect()]
    assert page_of(df, order, 99, 5).count() == 0
    walked, last = [], [10, -1]
    while True:
        page = page_after(df, [("k", True), ("id", False)], last, 5).collect()
        if not page:
            break
        walked += [r["id"] for r in page]
        last = [page[-1]["k"], page[-1]["id"]]
    assert walked == got


def test_top_per_key_with_hot_key(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
    top = top_per_key(df, ["k"], [F.desc("id")], 3, 2, "n")
    want = {}
    for r in sorted(df.collect(), key=lambda r: -r["id"]):
        want.setdefault(r["k"], []).append(r["id"])
    got = {}
    for r in top.orderBy("k", "n").collect():
        got.setdefault(r["k"], []).append(r["id"])
    assert got == {k: v[2:5] for k, v in want.items() if len(v) > 2}
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


# Aggregates


def test_most_common_tie_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,)], "v string")
    assert spark.range(1).select(most_common(df, "v").alias("m")).first()["m"] == "a"
    assert spark.range(1).select(most_common(df.limit(0), "v").alias("m")).first()["m"] is None


def test_numbered_facet(spark):
    words = ["red", "rex", "blue", "re", "b", "", "blur", "red"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert rows(numbered_facet(df, "w")) == sorted(
        (i + 1, w) for i, w in enumerate(sorted(set(words)))
    )


def test_latest_per_key_and_one_row(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (2, 1, "z")], "k int, t int, v string")
    assert rows(latest_per_key(df, "k", ["t"], ["v"])) == [(1, "y"), (2, "z")]
    assert spark.range(1).select(one_row(df, F.max("t").alias("m"))["m"].alias("m")).first()["m"] == 7


def test_join_sliced_splits_hot_keys_and_keeps_everything(spark):
    big = spark.range(3000).select(
        F.col("id").alias("who"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 100).alias("k")
    )
    per_key = big.select("k").distinct().withColumn("v", F.col("k") * 2)
    hot = {r["k"]: r["__slices"] for r in hot_keys(big, "k", min_rows=100).collect()}
    assert hot == {-1: 10}
    want = rows(big.join(per_key, "k").select("who", "k", "v"))
    for min_rows in (1, 10, 100_000):
        joined = join_sliced(big, per_key, "k", "who", min_rows=min_rows)
        assert rows(joined.select("who", "k", "v")) == want


# Lookup and search


def test_key_lookup(spark):
    table = spark.createDataFrame([("A@x", 1), ("b@x", 2), ("c@x", 3)], "email string, n int")
    keys = spark.createDataFrame([("a@X",), ("a@x",), ("C@x",)], "email string")
    assert rows(key_lookup(table, keys, ["email"], ignore_case=True)) == [("A@x", 1), ("c@x", 3)]
    assert rows(key_lookup(table, keys, ["email"], F.col("n") > 1, True)) == [("c@x", 3)]


def test_key_lookup_holds_a_repeated_key_once(spark):
    """Neither the broadcast side of the join nor a shuffle of it has one row per request."""
    table = spark.range(5)
    keys = spark.range(10_000).select((F.col("id") % 3).alias("id"))
    found = key_lookup(table, keys, ["id"])
    join = found._jdf.queryExecution().optimizedPlan()
    assert join.nodeName() == "Join" and join.right().nodeName() == "Aggregate"
    assert rows(found) == [(0,), (1,), (2,)]
    none = keys.select(F.lit(None).cast("bigint").alias("id"))
    assert rows(key_lookup(table, none, ["id"])) == []


@pytest.mark.parametrize("rows_per_slice", [1, 7, 1_000_000])
def test_search_all_equals_brute_force(spark, rows_per_slice):
    rng = random.Random(5)
    words = ["the"] * 5 + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))) for i in range(300)]
    asks = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for i in range(40)]
    asks += [(40, "?!"), (41, ""), (42, "nowhere the"), (43, "THE, w1 w1")]
    d = spark.createDataFrame(docs, "id int, text string")
    s = spark.createDataFrame(asks, "search_id int, search_text string")
    want = sorted(
        (i, k)
        for i, ask in asks
        for k, text in docs
        if (need := set(ask.lower().replace(",", " ").replace("?!", " ").split())) and need <= set(text.split())
    )
    got = sorted(tuple(r) for r in search_all(d, s, "id", "text", rows_per_slice=rows_per_slice).collect())
    assert got == want and want


# Change jobs


def test_insert_unique(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, url string")
    batch = spark.createDataFrame(
        [(10, "b"), (11, "c"), (12, "C"), (13, "c"), (14, None), (15, None), (9, "d"), (8, "d")],
        "id int, url string",
    )
    done = changes.insert_unique(table, batch, ["url"], ["id"])
    assert sorted(r["id"] for r in done.changed.collect()) == [8, 11, 12, 14, 15]
    assert sorted(r["id"] for r in done.rejected.collect()) == [9, 10, 13]
    assert done.table.count() == 7
    loose = changes.insert_unique(table, batch, ["url"], ["id"], ignore_case=True)
    assert sorted(r["id"] for r in loose.changed.collect()) == [8, 11, 14, 15]


def test_insert_unique_hot_key_is_whole(spark):
    batch = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("seq")
    )
    done = changes.insert_unique(batch.limit(0), batch, ["k"], ["seq"])
    assert done.changed.count() + done.rejected.count() == 3000
    assert done.rejected.count() == 999


def test_versioned_update(spark):
    table = spark.createDataFrame([(1, 1, "a", "x"), (2, 5, "b", "y"), (3, 1, "c", "z")],
                                  "id int, version int, name string, status string")
    edits = spark.createDataFrame(
        [(1, 1, 1, "A1"), (2, 1, 1, "A2"), (3, 2, 4, "stale"), (4, 9, 1, "unknown"), (5, 3, 1, None),
         (6, 1, 2, "next version")],
        "seq int, id int, version int, name string",
    )
    done = changes.versioned_update(table, edits, ["id"], ["name"], ["seq"],
                                    fixed={"status": F.lit("pending")})
    assert rows(done.table) == [(1, 2, "A1", "pending"), (2, 5, "b", "y"), (3, 2, "c", "pending")]
    assert rows(done.changed) == [(1, 2, "A1", "pending"), (3, 2, "c", "pending")]
    assert sorted(r["seq"] for r in done.rejected.collect()) == [2, 3, 4, 6]


def test_keyed_update_last_wins(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    edits = spark.createDataFrame([(1, 1, "x"), (2, 1, None), (3, 7, "q")], "seq int, id int, v string")
    done = changes.keyed_update(table, edits, ["id"], ["v"], ["seq"])
    assert rows(done.table) == [(1, None), (2, "b")]
    assert rows(done.rejected) == [(3, 7, "q")]


def test_delete_and_purge(spark):
    table = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id int, created_at string")
    table = table.withColumn("created_at", F.to_timestamp_ntz("created_at"))
    done = changes.delete_by_keys(table, spark.createDataFrame([(1,), (9,)], "id int"), ["id"])
    assert [r["id"] for r in done.table.collect()] == [2]
    assert [r["id"] for r in done.changed.collect()] == [1]
    assert [r["id"] for r in done.rejected.collect()] == [9]
    kept = changes.purge_older_than(table, as_ntz("2024-01-02 00:10:00"), 10)
    assert kept.table.count() == 0 and kept.changed.count() == 2


def test_cascade_delete_walks_the_graph(spark):
    make = spark.createDataFrame
    tables = {
        "feeds": make([(1,), (2,)], "id int"),
        "posts": make([(10, 1), (20, 2)], "id int, feed_id int"),
        "comments": make([(100, 10, None), (101, 20, 100)], "id int, post_id int, parent_comment_id int"),
        "comment_notifications": make([(1, 10, 100), (2, 20, 101), (3, 20, 100)],
                                      "id int, post_id int, comment_id int"),
        "favorites": make([(1, 10, 2), (2, 20, 1), (3, 20, 2)], "id int, post_id int, feed_id int"),
    }
    done = changes.cascade_delete(tables, "feeds", make([(1,), (7,)], "id int"))
    left = {name: sorted(r["id"] for r in c.table.collect()) for name, c in done.items()}
    gone = {name: sorted(r["id"] for r in c.changed.collect()) for name, c in done.items()}
    # A reply to a deleted comment stays; a row is deleted once although two parents go.
    assert left == {"feeds": [2], "posts": [20], "comments": [101],
                    "comment_notifications": [2], "favorites": [3]}
    assert gone == {"feeds": [1], "posts": [10], "comments": [100],
                    "comment_notifications": [1, 3], "favorites": [1, 2]}


def test_cascade_clears_references_that_may_be_null(spark):
    make = spark.createDataFrame
    tables = {
        "users": make([(1,), (2,)], "id int"),
        "feeds": make([(10, 1), (20, 2)], "id int, user_id int"),
        "feed_rejections": make([(10, 2), (20, 1), (20, 2)], "feed_id int, rejected_by int"),
    }
    done = changes.cascade_delete(tables, "users", make([(1,)], "id int"))
    assert rows(done["feed_rejections"].table) == [(20, 2), (20, None)]
    assert rows(done["feeds"].table) == [(20, 2)] and done["feed_rejections"].changed.count() == 2


# Plans: edge rows


def test_creator_edges(spark):
    make = spark.createDataFrame
    feeds = make([(1, 7, "2024-01-01", "pending"), (2, 8, "2024-01-01", "approved"),
                  (3, 8, "2024-01-11", "rejected"), (4, 8, "2024-01-05", "approved")],
                 "id int, user_id int, created_at string, approval_status string")
    feeds = feeds.withColumn("created_at", F.to_timestamp_ntz("created_at"))
    follows = make([("a", 1, 2), ("b", 2, 2), ("c", 3, 4)], "id string, user_id int, feed_id int")
    posts = make([(50, 2)], "id int, feed_id int")
    likes = make([(1, 50), (2, 50)], "id int, post_id int")
    comments = make([(1, 7)], "id int, user_id int")
    users = make([(7, "u7", "i"), (8, "u8", "i")], "id int, name string, user_img string")
    got = {r["user_id"]: r for r in discovery.top_feed_creators(
        feeds, follows, posts, likes, comments, users).collect()}
    assert (got[8]["total_follows"], got[8]["total_likes"], got[8]["total_created_feeds"]) == (3, 2, 2)
    assert got[8]["avg_time_between_feeds"] == 5.0
    # One feed has no gap; an owner without approved feeds counts none.
    assert (got[7]["avg_time_between_feeds"], got[7]["total_created_feeds"], got[7]["total_comments"]) == (0, 0, 1)


def test_timeline_equals_plain_join_under_skew(spark):
    """A third of all posts in one feed, followed by everybody."""
    posts = spark.range(900).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("feed_id"),
        F.concat(F.lit("title "), F.col("id")).alias("itemtitle"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("INTERVAL '1' MINUTE") * (F.col("id") % 97)).alias("created_at"),
    )
    follows = spark.range(600).select(
        (F.col("id") % 60).alias("user_id"),
        F.when(F.col("id") < 60, 0).otherwise((F.col("id") * 7) % 40).alias("feed_id"),
    ).distinct()
    likes = spark.range(200).select(F.lit(1).alias("id"), (F.col("id") % 60).alias("user_id"),
                                    (F.col("id") * 3).alias("post_id"))
    plain = follows.join(posts, "feed_id").join(
        likes.drop("id").withColumn("l", F.lit(True)),
        (F.col("id") == F.col("post_id")) & (follows["user_id"] == likes["user_id"]), "left",
    ).select(follows["user_id"], F.col("id"), "created_at", F.coalesce("l", F.lit(False)).alias("fav"))
    per_user = {}
    for r in plain.collect():
        per_user.setdefault(r["user_id"], []).append(r)
    for page, size, hot in [(1, 5, 1_000_000), (3, 4, 7)]:
        got = {}
        timeline = discovery.user_timeline(posts, follows, likes, page=page, page_size=size, hot_rows=hot)
        for r in timeline.collect():
            got.setdefault(r["user_id"], []).append((r["row_num"], r["post_id"], r["is_favorite"], r["total_records"]))
        for user, all_rows in per_user.items():
            ordered = sorted(all_rows, key=lambda r: (-r["created_at"].timestamp(), r["id"]))
            want = [(i + 1, r["id"], r["fav"], len(ordered)) for i, r in enumerate(ordered)]
            assert sorted(got[user]) == want[(page - 1) * size : page * size]


def test_catalog_with_follow_flag_mixes_own_hidden_feeds(spark):
    make = spark.createDataFrame
    feeds = make([(i, f"n{i}", i % 3, i % 4 == 0, "approved" if i % 5 else "pending", f"2024-01-{i + 1:02d}")
                  for i in range(25)],
                 "id int, name string, user_id int, is_hidden boolean, approval_status string, created_at string")
    feeds = feeds.withColumn("created_at", F.to_timestamp_ntz("created_at"))
    follows = make([("x", 1, 23), ("y", 2, 24)], "id string, user_id int, feed_id int")
    users = make([(0,), (1,), (2,), (3,)], "user_id int")
    got = discovery.feed_catalog_with_follow_flag(feeds, follows, users, page=2, page_size=4).collect()
    for user in range(4):
        seen = sorted((i for i in range(25) if i % 5 and (i % 4 or i % 3 == user)), reverse=True)
        mine = sorted((r["row_num"], r["feed_id"], r["total_records"]) for r in got if r["user_id"] == user)
        assert mine == [(n + 1, i, len(seen)) for n, i in enumerate(seen)][4:8]


def test_rejected_twice_shows_latest(spark, platform):
    feeds = platform.feeds.filter("id = 1")
    rejections = spark.createDataFrame(
        [(1, "2024-01-01", 3, "old"), (1, "2024-02-01", 4, "new")],
        "feed_id bigint, rejected_at string, rejected_by bigint, reason string")
    got = discovery.creator_feed_dashboard(feeds, platform.feed_follows, rejections, platform.users).collect()
    assert [(r["rejection_reason"], r["rejected_by"]) for r in got] == [("new", 4)]


def test_empty_subscriptions_are_guarded(spark, platform):
    none = platform.subscriptions.limit(0)
    r = subscriptions.subscription_kpis(
        none, platform.challenged_transactions.limit(0), platform.failed_transactions.limit(0),
        as_ntz("2001-08-01 00:00:00")).first()
    assert (r["churn_rate"], r["challenged_rate"], r["average_revenue_per_user"]) == (0.0, 0.0, 0.0)
    assert (r["most_popular_payment_method"], r["most_subscribed_plan"]) == ("", 0)
    stats = moderation.platform_statistics(platform.users, none, platform.comments, as_ntz("2024-01-30 00:00:00")).first()
    assert stats["most_used_payment_method"] == "N/A" and stats["total_revenue"] == 0


def test_renewals_have_one_outcome(spark, platform):
    make = spark.createDataFrame
    # Plan 3 is not on sale: its paused charge is still challenged, its other reply rejected.
    due = make([(i, "AUTH", 3 if i > 3 else 0, 10.0, "USD", 1) for i in range(6)],
               "subscription_id bigint, authorization_code string, plan_id bigint, price double, currency string, user_id bigint")
    card = ("4081", "12", "2030", "visa")
    replies = make(
        [(0, True, "success", "", "m", "r", 1, "u", "c", *card), (1, False, "success", "", "m", "r", 1, "u", "c", *card),
         (2, False, "x", "Approved", "m", "r", 1, "u", "c", *card), (3, None, None, None, "m", "r", 1, "u", "c", *card),
         (4, True, "success", "", "m", "r", 1, "u", "c", *card), (5, False, "success", "", "m", "r", 1, "u", "c", *card)],
        "subscription_id bigint, paused boolean, gateway_status string, gateway_response string, message string,"
        " reference string, transaction_id bigint, authorization_url string, channel string, card_last4 string,"
        " card_exp_month string, card_exp_year string, card_type string")
    subs = platform.subscriptions
    done = subscriptions.renewal_actions(due, replies, platform.payment_plans, subs, as_ntz("2001-08-01 00:00:00"))
    ids = lambda df, c: sorted(r[c] for r in df.collect())
    assert ids(done.challenged, "referenced_subscription_id") == [0, 4] and ids(done.failed, "subscription_id") == [3]
    assert ids(done.rejected, "subscription_id") == [5]
    assert [tuple(r[c] for c in ("card_last4", "card_exp_month", "card_exp_year", "card_type"))
            for r in done.renewed.collect()] == [card, card]
    assert sorted(r["id"] for r in done.subscriptions.changed.collect()) == [1, 2]
    assert done.subscriptions.table.count() == subs.count()


def test_inserted_rows_have_ids_and_defaults(spark, platform):
    from feedspan.operators.defaults import DEFAULTS, NATURAL_KEYS, complete

    now = as_ntz("2024-02-01 00:00:00")
    for name in DEFAULTS:
        table = getattr(platform, name)
        if "id" not in table.columns and name == "feed_rejections":
            table = table.withColumn("id", F.col("feed_id"))
        batch = table.limit(3).drop("id", *[c for c in DEFAULTS[name] if c not in NATURAL_KEYS.get(name, ())])
        done = changes.append_rows(table, complete(batch, table, name, now)).changed
        row = done.first()
        wanted = [c for c in ["id", *DEFAULTS[name]] if c in table.columns]
        assert all(row[c] is not None for c in wanted), name
        assert dict(done.dtypes)["id"] == dict(table.dtypes)["id"]
        assert done.select("id").distinct().count() == batch.count()


def test_numbers_are_consecutive_over_tasks(spark):
    from feedspan.operators.keys import numbered

    rows_in = spark.range(1000, numPartitions=13).selectExpr("(id * 7919) % 1000 AS x", "id AS y")
    got = numbered(rows_in, ["x"]).collect()
    assert sorted((r["__n"], r["x"]) for r in got) == [(i + 1, i) for i in range(1000)]
    assert sorted(r["__n"] for r in numbered(rows_in).collect()) == list(range(1, 1001))
    assert numbered(rows_in.limit(0), ["x"]).collect() == []
    # What was numbered once is read, not numbered anew.
    once = numbered(rows_in.repartition(5))
    assert sorted(once.collect()) == sorted(once.collect())


def test_null_and_repeated_keys_get_ids_of_their_own(spark):
    schema = "id bigint, transaction_id bigint, authorization_code string"
    table = spark.createDataFrame([(41, 1, "a"), (7, 2, None)], schema)
    batch = spark.createDataFrame(
        [(1, 1, "a"), (2, 3, None), (3, 3, None), (4, 2, None), (5, 4, "b"), (6, 4, "b")],
        "seq int, transaction_id bigint, authorization_code string")
    done = changes.insert_unique(table, batch, ["transaction_id", "authorization_code"], ["seq"])
    assert sorted((r["seq"], r["id"]) for r in done.changed.collect()) == [(2, 42), (3, 43), (4, 44), (5, 45)]
    assert sorted((r["seq"], r["id"]) for r in done.rejected.collect()) == [(1, None), (6, None)]
    assert done.table.select("id").distinct().count() == done.table.count() == 6
    same = spark.createDataFrame([(i, "ref") for i in range(5)], "seq int, reference string")
    numbered = changes.append_rows(table.selectExpr("id", "'ref' AS reference"), same, ["seq"])
    assert sorted(r["id"] for r in numbered.changed.collect()) == [42, 43, 44, 45, 46]
    empty = changes.append_rows(table.limit(0), batch, ["seq"]).changed
    assert sorted(r["id"] for r in empty.collect()) == [1, 2, 3, 4, 5, 6]


def test_text_ids_without_a_natural_key(spark):
    from feedspan.operators.defaults import complete

    table = spark.createDataFrame([], "id string, reference string, created_at timestamp_ntz")
    batch = spark.createDataFrame([(i, "ref") for i in range(6)], "seq int, reference string")
    make = lambda at: complete(batch, table, "challenged_transactions", as_ntz(at), ["seq"])
    once, again, later = ({(r["seq"], r["id"]) for r in make(at).collect()} for at in ("2024-01-01", "2024-01-01", "2024-01-02"))
    assert once == again and len({i for _, i in once | later}) == 12


def test_view_sizes_at_sf001(spark):
    from feedspan.sources.platform import Platform

    p = Platform(spark, "/root/testdata/sf0.01")
    sizes = {"users": 1500, "feeds": 2000, "feed_follows": 59391, "posts": 1000, "favorites": 1985,
             "comments": 512, "subscriptions": 15000, "challenged_transactions": 11058}
    assert {n: getattr(p, n).count() for n in sizes} == sizes
    assert p.feeds.filter("approval_status = 'approved'").count() == 1200
    assert p.feeds.filter("last_fetched_at IS NULL").count() == 182
    assert p.comments.filter("parent_comment_id IS NOT NULL").count() == 412


@pytest.mark.parametrize("descending", [True, False])
def test_pages_by_range_equal_offsets(spark, monkeypatch, descending):
    monkeypatch.setattr(paging, "SORTED", 5)
    monkeypatch.setattr(paging, "BINS", 4)
    df = spark.range(300).selectExpr(
        "id", "CASE WHEN id % 11 = 0 THEN NULL WHEN id < 40 THEN -7 ELSE (id * id) % 1009 - 500 END AS k")
    keys = [("k", descending), ("id", False)]
    order = [F.col("k").desc() if descending else F.col("k").asc(), F.col("id")]
    whole = [r["id"] for r in df.orderBy(*order).collect()]
    for page in (1, 2, 3, 9, 15, 24, 28, 30, 31, 40):
        got = paging.page_at(df, keys, page, 10)
        assert [r["id"] for r in got.collect()] == whole[10 * (page - 1) : 10 * page], page
        assert {r["total_records"] for r in got.collect()} <= {300}
    assert paging.page_at(df.limit(0), keys, 1, 10).collect() == []
    assert [r["id"] for r in paging.page_at(df.filter("k IS NULL"), keys, 2, 10).collect()] == list(range(110, 220, 11))


def test_a_deep_page_sorts_one_range(spark):
    """The first key of a page far down is filtered to a range of few rows before the sort."""
    df = spark.range(2_000_000).selectExpr("id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 3) AS at")
    page = paging.page_at(df, [("at", True), ("id", False)], 90_000, 20)
    assert [r["id"] for r in page.collect()] == list(range(2_000_000 - 1_799_980 - 1, 2_000_000 - 1_800_000 - 1, -1))
    below = page.queryExecution if hasattr(page, "queryExecution") else page._jdf.queryExecution()
    assert "Filter" in below.optimizedPlan().toString()


def test_timeline_cursors_walk_the_whole_timeline(spark):
    posts = spark.range(60).selectExpr(
        "id", "id % 3 AS feed_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 5 * (id DIV 4)) AS created_at", "'t' AS itemtitle")
    follows = spark.createDataFrame([(1, 0), (1, 2), (2, 1), (3, 9)], "user_id bigint, feed_id bigint")
    liked = spark.createDataFrame([(1, 3)], "user_id bigint, post_id bigint")
    cursor = spark.createDataFrame([(u, None, None) for u in (1, 2, 3)], "user_id bigint, created_at timestamp_ntz, post_id bigint")
    seen = {1: [], 2: [], 3: []}
    for _ in range(6):
        rows_ = discovery.user_timeline_after(posts, follows, liked, cursor, page_size=9).orderBy("user_id", "row_num").collect()
        for r in rows_:
            seen[r["user_id"]].append(r["post_id"])
            assert r["is_favorite"] == (r["user_id"] == 1 and r["post_id"] == 3)
        last = {r["user_id"]: (r["user_id"], r["created_at"], r["post_id"]) for r in rows_}
        cursor = spark.createDataFrame(list(last.values()), cursor.schema) if last else cursor.limit(0)
    order = sorted(range(60), key=lambda i: (-(i // 4), i))
    assert seen == {1: [i for i in order if i % 3 != 1], 2: [i for i in order if i % 3 == 1], 3: []}
