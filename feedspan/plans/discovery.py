"""Feeds, timelines, creators: what readers and feed owners see, for all users in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedspan.functions.scoring import creator_score, unit_hash
from feedspan.functions.text import token_match
from feedspan.functions.timestamps import interval_seconds
from feedspan.operators.paging import check_page, count_of, page_of, top_per_key
from feedspan.operators.skew import join_sliced
from feedspan.operators.summaries import count_where, latest_per_key
from feedspan.sources.storage import staged


def _newest(created: str = "created_at", key: str = "id") -> list[Column]:
    return [F.col(created).desc(), F.col(key).asc()]


def _only_users(df: DataFrame, users: DataFrame | None, column: str = "user_id") -> DataFrame:
    """Restrict a per-user job to the users in `users` (column `user_id`)."""
    if users is None:
        return df
    asked = users.select(F.col("user_id").alias("__u"))
    return df.join(asked, F.col(column) == F.col("__u"), "left_semi")


def feed_catalog(
    feeds: DataFrame,
    search: str = "",
    feed_type: str = "",
    page: int = 1,
    page_size: int = 20,
    compat: bool = False,
) -> DataFrame:
    """Public catalogue, newest first, with the total.

    `compat` keeps a known precedence slip: with a type, hidden and unapproved feeds
    are listed too; without one, the search text has no effect.
    """
    public = ~F.col("is_hidden") & (F.col("approval_status") == "approved")
    found = token_match(F.col("name"), search)
    if compat:
        keep = (found & (F.col("feed_type") == feed_type)) | (F.lit(feed_type == "") & public)
    else:
        keep = found & public
        if feed_type:
            keep = keep & (F.col("feed_type") == feed_type)
    return page_of(feeds.filter(keep), _newest(), page, page_size)


def feed_catalog_with_follow_flag(
    feeds: DataFrame,
    follows: DataFrame,
    users: DataFrame,
    search: str = "",
    feed_type: str = "",
    page: int = 1,
    page_size: int = 20,
) -> DataFrame:
    """The catalogue page of every user in `users` (column `user_id`), with a follow flag.

    All users share the public feeds and differ only in their own hidden ones, so the page of a
    user with h hidden feeds starts at most h public rows before the offset. Public rows from the
    largest such start to the page's end are taken once, whole, and each user gets those that the
    own page can hold; nothing is looked up by feed afterwards, where few feeds would be hot keys.
    """
    limit, offset = check_page(page, page_size)
    keep = (F.col("approval_status") == "approved") & token_match(F.col("name"), search)
    if feed_type:
        keep = keep & (F.col("feed_type") == feed_type)
    listed = feeds.filter(keep).withColumnRenamed("user_id", "owner_id")
    public, hidden = listed.filter(~F.col("is_hidden")), listed.filter("is_hidden")
    viewers = users.select("user_id").distinct()
    own = hidden.select(F.col("owner_id").alias("user_id"), F.struct(*listed.columns).alias("f"), "created_at", "id").join(
        viewers, "user_id", "left_semi")
    own_totals = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("__own"))
    # Shared rows start at `skip`: without an offset nobody needs earlier ones.
    skip = max(0, offset - (own_totals.agg(F.max("__own")).first()[0] or 0)) if offset else 0
    rows = public.orderBy(*_newest())
    rows = (rows.offset(skip) if skip else rows).limit(limit + offset - skip)
    # Sorted once, by the age of a feed and its id; a feed without a date is the oldest.
    age = F.coalesce(-F.unix_micros(F.col("created_at").cast("timestamp")), F.lit((1 << 63) - 1)).alias("age")
    sorted_ = F.sort_array(F.collect_list(F.struct(age, "id", F.struct(*listed.columns).alias("f"))))
    counted = viewers.join(own_totals, "user_id", "left").withColumns(
        {"__own": F.coalesce("__own", F.lit(0)), "__shared": rows.agg(sorted_.alias("a")).scalar()})
    # Public rows before `start` stand before every row of the user's page.
    start = F.greatest(F.lit(0), F.lit(offset - skip) - F.col("__own")).cast("int")
    reach = counted.select("user_id", "__own", start.alias("__start"), F.slice("__shared", start + 1, limit + offset).alias("__a"))
    for_all = reach.select("user_id", "__own", "__start", F.explode("__a.f").alias("f")).select(
        "user_id", "__own", "__start", "f", "f.created_at", "f.id")
    nearest = top_per_key(own, ["user_id"], _newest(), offset + limit).join(
        reach.select("user_id", "__own", "__start"), "user_id")
    both = for_all.unionByName(nearest)
    # A user's rows are numbered from the first one handed out.
    number = F.row_number().over(W.partitionBy("user_id").orderBy(*_newest())) + F.col("__start") + F.lit(skip)
    paged = both.withColumn("row_num", number).filter(F.col("row_num").between(offset + 1, offset + limit))
    flags = follows.select("user_id", F.col("feed_id").alias("__feed"), F.col("id").alias("follow_id"))
    return (
        paged.drop("created_at", "id").join(
            flags, (paged["user_id"] == flags["user_id"]) & (F.col("f.id") == F.col("__feed")), "left")
        .drop(flags["user_id"])
        .select("user_id", "row_num", "follow_id", "__own", "f.*").withColumnRenamed("id", "feed_id")
        .withColumn("is_followed", F.col("follow_id").isNotNull())
        .withColumn("total_records", count_of(public) + F.col("__own"))
        .drop("__own")
    )


def followed_feeds(
    feeds: DataFrame,
    follows: DataFrame,
    users: DataFrame | None = None,
    search: str = "",
    page: int = 1,
    page_size: int = 20,
    visible_only: bool = False,
) -> DataFrame:
    """Feeds each user follows, newest first, one page per user, with the user's total."""
    limit, offset = check_page(page, page_size)
    found = feeds.filter(token_match(F.col("name"), search))
    if visible_only:
        found = found.filter(~F.col("is_hidden") & (F.col("approval_status") == "approved"))
    mine = _only_users(follows, users).select("user_id", "feed_id")
    refs = mine.join(
        found.select(F.col("id").alias("feed_id"), "created_at"), "feed_id"
    )
    totals = refs.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_records"))
    rows = top_per_key(refs, ["user_id"], _newest(key="feed_id"), limit, offset, "row_num")
    detail = found.select(F.col("id").alias("feed_id"), "name", "url", "feed_type", "img_url")
    return rows.join(totals, "user_id").join(detail, "feed_id")


def user_timeline(
    posts: DataFrame,
    follows: DataFrame,
    favorites: DataFrame,
    users: DataFrame | None = None,
    search: str = "",
    feed_id: int | str | None = None,
    page: int = 1,
    page_size: int = 20,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Newest posts of the feeds each user follows: one page per user, with the user's total.

    A page can only hold the newest `page * page_size` posts of any one feed. So each
    feed is first cut to that many post keys, kept as one row per feed, and only those
    fan out to the followers; post text joins the finished pages. Followers of a feed with
    more than `hot_rows` of them are sliced over several tasks.
    """
    limit, offset = check_page(page, page_size)
    found = posts.filter(token_match(F.col("itemtitle"), search))
    mine = _only_users(follows, users).select("user_id", "feed_id")
    if feed_id is not None:
        found, mine = found.filter(F.col("feed_id") == feed_id), mine.filter(F.col("feed_id") == feed_id)
    newest = top_per_key(found, ["feed_id"], _newest(), limit + offset)
    recent = newest.groupBy("feed_id").agg(
        F.collect_list(F.struct("created_at", F.col("id").alias("post_id"))).alias("recent")
    )
    sizes = found.groupBy("feed_id").agg(F.count(F.lit(1)).alias("n"))
    reading = join_sliced(mine, recent.join(sizes, "feed_id"), "feed_id", "user_id", min_rows=hot_rows)
    totals = reading.groupBy("user_id").agg(F.sum("n").alias("total_records"))
    page_rows = top_per_key(
        reading.select("user_id", F.inline("recent")),
        ["user_id"], _newest(key="post_id"), limit, offset, "row_num",
    ).drop("created_at")
    liked = favorites.select("user_id", "post_id").distinct().withColumn("__liked", F.lit(True))
    return (
        page_rows.join(totals, "user_id")
        .join(liked, ["user_id", "post_id"], "left")
        .join(newest.withColumnRenamed("id", "post_id"), "post_id")
        .withColumn("is_favorite", F.coalesce("__liked", F.lit(False)))
        .drop("__liked")
    )


def _ranked(found: DataFrame, cursors: DataFrame) -> DataFrame:
    """Posts and cursors (feed_id, created_at, id) with `rank`: posts of the feed up to there, newest first.

    Ranks are counted within a day of a feed and days are added up, so no task sorts a whole feed.
    """
    key = ["feed_id", "created_at", "id"]
    both = found.select(*key, F.lit(1).alias("__post")).unionByName(cursors.select(*key, F.lit(0).alias("__post")))
    both = both.withColumn("__day", F.to_date("created_at"))
    in_day = W.partitionBy("feed_id", "__day").orderBy(
        F.desc("created_at"), "id", F.desc("__post")).rowsBetween(W.unboundedPreceding, W.currentRow)
    days = both.groupBy("feed_id", "__day").agg(F.sum("__post").alias("__n"))
    newer = F.sum("__n").over(W.partitionBy("feed_id").orderBy(F.desc("__day"))) - F.col("__n")
    days = days.select("feed_id", "__day", newer.alias("__newer"))
    return both.withColumn("rank", F.sum("__post").over(in_day)).join(days, ["feed_id", "__day"]).select(
        *key, "__post", (F.col("rank") + F.col("__newer")).alias("rank"))


def user_timeline_after(
    posts: DataFrame,
    follows: DataFrame,
    favorites: DataFrame,
    cursors: DataFrame,
    search: str = "",
    feed_id: int | str | None = None,
    page_size: int = 20,
) -> DataFrame:
    """The page of each user's timeline that follows the user's cursor, at any depth.

    `cursors`: user_id, created_at and post_id of the last row seen; a NULL time stands for the
    beginning. Every feed's posts are numbered once; a cursor is a place among them, and a user needs
    the next `page_size` numbers of each followed feed. So a deep page costs what the first one does.
    """
    limit, _ = check_page(1, page_size)
    found = posts.filter(token_match(F.col("itemtitle"), search))
    at = cursors.select(
        "user_id", F.coalesce("created_at", F.lit("9999-12-31").cast(posts.schema["created_at"].dataType)).alias("created_at"),
        F.coalesce("post_id", F.lit(-1)).cast(posts.schema["id"].dataType).alias("id"))
    mine = follows.select("user_id", "feed_id").join(at, "user_id")
    if feed_id is not None:
        found, mine = found.filter(F.col("feed_id") == feed_id), mine.filter(F.col("feed_id") == feed_id)
    ranked = staged(_ranked(found, mine.select("feed_id", "created_at", "id").distinct()), "ranked-posts")
    place = ranked.filter("__post = 0").select("feed_id", "created_at", "id", F.col("rank").alias("__seen"))
    wanted = mine.join(place, ["feed_id", "created_at", "id"]).select(
        "user_id", "feed_id", F.explode(F.sequence(F.col("__seen") + 1, F.col("__seen") + limit)).alias("rank"))
    numbers = ranked.filter("__post = 1").select("feed_id", "rank", F.col("id").alias("post_id"), "created_at")
    page = top_per_key(
        wanted.join(numbers, ["feed_id", "rank"]).drop("rank"), ["user_id"], _newest(key="post_id"), limit, rank="row_num")
    liked = favorites.select("user_id", "post_id").distinct().withColumn("__liked", F.lit(True))
    detail = found.drop("feed_id", "created_at").withColumnRenamed("id", "post_id")
    return (
        page.join(liked, ["user_id", "post_id"], "left")
        .join(detail, "post_id")
        .withColumn("is_favorite", F.coalesce("__liked", F.lit(False)))
        .drop("__liked")
    )


def favorite_timeline(
    posts: DataFrame,
    follows: DataFrame,
    favorites: DataFrame,
    users: DataFrame | None = None,
    search: str = "",
    feed_id: int | str | None = None,
    page: int = 1,
    page_size: int = 20,
) -> DataFrame:
    """Posts each user favourited, newest post first, with a followed-feed flag and the total."""
    limit, offset = check_page(page, page_size)
    found = posts.filter(token_match(F.col("itemtitle"), search))
    if feed_id is not None:
        found = found.filter(F.col("feed_id") == feed_id)
    mine = _only_users(favorites, users).select("user_id", "post_id")
    refs = mine.join(
        found.select(F.col("id").alias("post_id"), "feed_id", "created_at"), "post_id"
    )
    totals = refs.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_records"))
    rows = top_per_key(refs, ["user_id"], _newest(key="post_id"), limit, offset, "row_num")
    followed = follows.select("user_id", "feed_id").distinct().withColumn("__f", F.lit(True))
    detail = found.drop("feed_id", "created_at").withColumnRenamed("id", "post_id")
    return (
        rows.join(totals, "user_id")
        .join(followed, ["user_id", "feed_id"], "left")
        .join(detail, "post_id")
        .withColumn("is_favorite", F.lit(True))
        .withColumn("is_followed_feed", F.coalesce("__f", F.lit(False)))
        .drop("__f")
    )


def favorite_refs(favorites: DataFrame, users: DataFrame | None = None) -> DataFrame:
    return _only_users(favorites, users).select("id", "post_id", "feed_id", "user_id", "created_at")


def post_user_flags(
    posts: DataFrame, follows: DataFrame, favorites: DataFrame, requests: DataFrame
) -> DataFrame:
    """Post detail for each requested (user_id, post_id), with favourite and follow flags."""
    asked = requests.select("user_id", "post_id").distinct()
    liked = favorites.select("user_id", "post_id").distinct().withColumn("__l", F.lit(True))
    followed = follows.select("user_id", "feed_id").distinct().withColumn("__f", F.lit(True))
    return (
        asked.join(posts.withColumnRenamed("id", "post_id"), "post_id")
        .join(liked, ["user_id", "post_id"], "left")
        .join(followed, ["user_id", "feed_id"], "left")
        .withColumn("is_favorite", F.coalesce("__l", F.lit(False)))
        .withColumn("is_followed_feed", F.coalesce("__f", F.lit(False)))
        .drop("__l", "__f")
    )


def sample_posts_per_feed(posts: DataFrame, n: int, seed: str = "0", offset: int = 0) -> DataFrame:
    """n random posts of every feed. The order is a hash of seed and id, so a rerun agrees."""
    order = [F.md5(F.concat(F.lit(seed), F.col("id").cast("string"))), F.col("id")]
    return top_per_key(posts, ["feed_id"], order, n, offset, "row_num")


def creator_feed_dashboard(
    feeds: DataFrame,
    follows: DataFrame,
    rejections: DataFrame,
    users: DataFrame,
    owners: DataFrame | None = None,
    search: str = "",
    page: int = 1,
    page_size: int = 20,
) -> DataFrame:
    """Each owner's feeds, pending first then newest, with follows, counts and rejection detail."""
    limit, offset = check_page(page, page_size)
    mine = _only_users(feeds, owners)
    found = mine.filter(token_match(F.col("name"), search))
    pending_first = F.when(F.col("approval_status") == "pending", 1).otherwise(2)
    rows = top_per_key(found, ["user_id"], [pending_first, *_newest()], limit, offset, "row_num")
    counts = mine.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_feeds_count"),
        count_where(F.col("approval_status") == "approved", "approved_feeds_count"),
        count_where(F.col("approval_status") == "rejected", "rejected_feeds_count"),
    )
    matches = found.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_records"))
    followers = follows.groupBy(F.col("feed_id").alias("id")).agg(
        F.count(F.lit(1)).alias("follow_count")
    )
    last = latest_per_key(
        rejections, "feed_id", ["rejected_at", "rejected_by", "reason"],
        ["rejected_by", "reason", "rejected_at"],
    ).withColumnRenamed("reason", "rejection_reason")
    moderators = users.select(
        F.col("id").alias("rejected_by"), F.col("name").alias("rejected_by_username")
    )
    return (
        rows.join(counts, "user_id")
        .join(matches, "user_id")
        .join(followers, "id", "left")
        .join(
            last.withColumnRenamed("feed_id", "__feed"),
            (F.col("id") == F.col("__feed")) & (F.col("approval_status") == "rejected"),
            "left",
        )
        .drop("__feed")
        .join(moderators, "rejected_by", "left")
        .withColumn("follow_count", F.coalesce("follow_count", F.lit(0)))
    )


def _likes_per_feed(posts: DataFrame, favorites: DataFrame) -> DataFrame:
    """Favourites per feed, counted per post first so a hot post is one row in the join."""
    per_post = favorites.groupBy("post_id").agg(F.count("id").alias("n"))
    return (
        posts.select(F.col("id").alias("post_id"), "feed_id")
        .join(per_post, "post_id")
        .groupBy("feed_id")
        .agg(F.sum("n").alias("likes"))
    )


def feed_like_stats(
    feeds: DataFrame, users: DataFrame, posts: DataFrame, favorites: DataFrame
) -> DataFrame:
    """Owner and number of favourites of every feed."""
    owner = users.select(
        F.col("id").alias("user_id"), F.col("name").alias("user_name"), F.col("user_img").alias("user_img_url")
    )
    likes = _likes_per_feed(posts, favorites).withColumnRenamed("feed_id", "id")
    return (
        feeds.select("id", "user_id")
        .join(owner, "user_id")
        .join(likes, "id", "left")
        .select(
            F.col("id").alias("feed_id"), "user_name", "user_img_url",
            F.coalesce("likes", F.lit(0)).alias("liked_posts_count"),
        )
    )


def top_followed_feeds(
    feeds: DataFrame, follows: DataFrame, k: int, visible_only: bool = False
) -> DataFrame:
    """The k most followed feeds: counted and cut before the detail joins."""
    counts = follows.groupBy("feed_id").agg(F.count(F.lit(1)).alias("follow_count"))
    detail = feeds.withColumnRenamed("id", "feed_id")
    if visible_only:
        seen = detail.filter(~F.col("is_hidden") & (F.col("approval_status") == "approved"))
        counts = counts.join(seen.select("feed_id"), "feed_id", "left_semi")
    top = counts.orderBy(F.desc("follow_count"), F.asc("feed_id")).limit(k)
    return top.join(detail, "feed_id").orderBy(F.desc("follow_count"), F.asc("feed_id"))


def top_feed_creators(
    feeds: DataFrame,
    follows: DataFrame,
    posts: DataFrame,
    favorites: DataFrame,
    comments: DataFrame,
    users: DataFrame,
    page: int = 1,
    page_size: int = 5,
    jitter_seed: str | None = None,
    by_score: bool = False,
) -> DataFrame:
    """Creators with the most follows, one page, scored; `by_score` ranks all by score instead.

    Follows and likes shrink to one row per feed before they meet the feeds, so a hot
    feed is one row. The average gap between an owner's feeds telescopes to
    (newest - oldest) / (feeds - 1), which needs no ordered window per owner. Users are
    joined to the finished page only.
    """
    limit, offset = check_page(page, page_size)
    follows_per_feed = follows.groupBy(F.col("feed_id").alias("id")).agg(
        F.count("id").alias("follows")
    )
    likes_per_feed = _likes_per_feed(posts, favorites).withColumnRenamed("feed_id", "id")
    per_owner = (
        feeds.select("id", "user_id", "created_at", "approval_status")
        .join(follows_per_feed, "id", "left")
        .join(likes_per_feed, "id", "left")
        .groupBy("user_id")
        .agg(
            F.coalesce(F.sum("follows"), F.lit(0)).alias("total_follows"),
            F.coalesce(F.sum("likes"), F.lit(0)).alias("total_likes"),
            count_where(F.col("approval_status") == "approved", "total_created_feeds"),
            F.count("created_at").alias("__n"),
            (F.max("created_at") - F.min("created_at")).alias("__span"),
        )
    )
    commented = comments.groupBy("user_id").agg(F.count("id").alias("total_comments"))
    gap = F.when(
        F.col("__n") > 1, interval_seconds(F.col("__span")) / 86400.0 / (F.col("__n") - 1)
    ).otherwise(F.lit(0.0))
    order = [F.desc("score" if by_score else "total_follows"), F.asc("user_id")]

    def cut(df: DataFrame) -> DataFrame:
        df = df.orderBy(*order)
        return (df.offset(offset) if offset else df).limit(limit)

    jitter = unit_hash(F.col("user_id"), jitter_seed) if jitter_seed is not None else None
    score = creator_score(
        F.col("total_follows"), F.col("total_likes"), F.col("total_comments"),
        F.col("total_created_feeds"), F.col("avg_time_between_feeds"), jitter,
    )
    ranked = per_owner if by_score else cut(per_owner)
    scored = (
        ranked.join(commented, "user_id", "left")
        .withColumn("avg_time_between_feeds", gap)
        .withColumn("total_comments", F.coalesce("total_comments", F.lit(0)))
        .withColumn("score", score)
        .drop("__n", "__span")
    )
    names = users.select(F.col("id").alias("user_id"), "name", "user_img")
    page_rows = cut(scored) if by_score else scored
    return page_rows.join(names, "user_id", "left").orderBy(*order)


def comment_threads(comments: DataFrame, users: DataFrame, viewer: int | None = None) -> DataFrame:
    """Comments with the author's name; `parent_comment_id` links the thread."""
    author = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    mine = F.lit(False) if viewer is None else F.col("user_id") == viewer
    return comments.join(author, "user_id").withColumn("is_editable", mine)
