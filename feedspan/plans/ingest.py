"""From fetched feed bodies to post rows: parse, sanitise, date, insert-if-new; scrape errors."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspan.functions.checks import is_valid_url
from feedspan.functions.html import sanitize_fields
from feedspan.functions.timestamps import parse_any_timestamp
from feedspan.operators.changes import Change, flag_unique, keyed_update
from feedspan.operators.defaults import complete
from feedspan.sources.storage import staged

# Image of posts without one, error kinds with their messages, deadline status.
DEFAULT_IMAGE = (
    "https://images.unsplash.com/photo-1542396601-dca920ea2807?q=80&w=1351&auto=format&fit=crop"
    "&ixlib=rb-4.0.3&ixid=M3wxMjA3fDB8MHxwaG90by1wYWdlfHx8fGVufDB8fHx8fA%3D%3D"
)
DEADLINE_MESSAGE = "timeout exceeded while fetching feeds"
UNDETECTED_MESSAGE = "unable to detect the feed type in the url"
DEADLINE_TYPE = "FeedContextExceeded"
UNDETECTED_TYPE = "FeedType"
DEADLINE_STATUS = 504

LINKS = "array<struct<_href:string,_rel:string,_type:string>>"
RSS_ITEM = (
    "struct<title:string,link:string,description:string,`content:encoded`:string,pubDate:string,"
    "`dc:date`:string,image:struct<url:string>,`itunes:image`:struct<_href:string>,"
    "`media:thumbnail`:struct<_url:string>,enclosure:array<struct<_url:string,_type:string>>,"
    "`media:content`:array<struct<_url:string,_type:string,_medium:string>>>"
)
ATOM_ENTRY = (
    f"struct<title:string,link:{LINKS},summary:string,content:string,published:string,"
    "updated:string>"
)
# RSS 1.0 has its items beside the channel, RSS 2.0 inside it.
RSS = (
    "channel struct<title:string,link:string,description:string,language:string,`dc:language`:string,"
    f"item:array<{RSS_ITEM}>>, item array<{RSS_ITEM}>"
)
ATOM = f"title string, subtitle string, `_xml:lang` string, link {LINKS}, entry array<{ATOM_ENTRY}>"
JSON_FEED = (
    "version string, title string, home_page_url string, description string, language string, "
    "items array<struct<url:string,external_url:string,title:string,content_html:string,content_text:string,"
    "summary:string,image:string,banner_image:string,date_published:string,date_modified:string>>"
)
# The root element stands after declarations, comments and white space; its prefix is optional.
PROLOG = r"^\x{FEFF}?(?:\s+|<\?.*?\?>|<!--.*?-->)*+"
ROOT = rf"(?is){PROLOG}<(?:(\w+):)?(rss|rdf|feed)[\s>]"
# A document type, with its own declarations or without.
DOCTYPE = rf"(?is)({PROLOG})<!DOCTYPE(?:[^\[>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:\[(?:[^\]\"']++|\"[^\"]*+\"|'[^']*+')*+\]\s*+)?>"
# What XML itself reads after an ampersand; anything else would end the whole document.
REFERENCE = r"&(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);"
STRAY = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)"
XML_PARTS = r"(?s)<!\[CDATA\[.*?\]\]>|&(?:#?\w+;)?|[^&<]++|<"
ITEM_FIELDS = ["title", "link", "description", "content", "published", "image_url"]


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _first_url(array: Column, fit) -> Column:
    return F.get(F.filter(array, lambda x: F.coalesce(fit(x), F.lit(False))), 0)["_url"]


def _rss_item(item: Column) -> Column:
    picture = lambda x: x["_type"].startswith("image/")
    image = F.coalesce(
        item["image"]["url"], item["itunes:image"]["_href"], item["media:thumbnail"]["_url"],
        _first_url(item["media:content"], lambda x: (x["_medium"] == "image") | picture(x)),
        _first_url(item["enclosure"], picture),
    )
    return F.struct(
        _blank(item["title"]).alias("title"),
        _blank(item["link"]).alias("link"),
        _blank(item["description"]).alias("description"),
        _blank(item["content:encoded"]).alias("content"),
        _blank(F.coalesce(item["pubDate"], item["dc:date"])).alias("published"),
        F.coalesce(image, F.lit(DEFAULT_IMAGE)).alias("image_url"),
    )


def _page_link(links: Column) -> Column:
    """The link to the page itself: an alternate one or one without a relation, else the first."""
    own = F.filter(links, lambda x: F.coalesce(x["_rel"] == "alternate", F.lit(True)))
    return _blank(F.coalesce(F.get(own, 0)["_href"], F.get(links, 0)["_href"]))


def _atom_item(entry: Column) -> Column:
    images = F.filter(
        entry["link"],
        lambda link: F.coalesce(link["_rel"] == "enclosure", F.lit(False))
        | F.coalesce(link["_type"].isin("image/jpeg", "image/png"), F.lit(False)),
    )
    return F.struct(
        _blank(entry["title"]).alias("title"),
        _page_link(entry["link"]).alias("link"),
        _blank(entry["summary"]).alias("description"),
        _blank(entry["content"]).alias("content"),
        _blank(F.coalesce(entry["published"], entry["updated"])).alias("published"),
        F.coalesce(F.get(images, 0)["_href"], F.lit(DEFAULT_IMAGE)).alias("image_url"),
    )


def _json_item(item: Column) -> Column:
    text = lambda *cs: _blank(F.trim(F.coalesce(*cs)))
    return F.struct(
        text(item["title"]).alias("title"),
        text(item["url"], item["external_url"]).alias("link"),
        text(item["summary"]).alias("description"),
        text(item["content_html"], item["content_text"]).alias("content"),
        text(item["date_published"], item["date_modified"]).alias("published"),
        F.coalesce(item["image"], item["banner_image"], F.lit(DEFAULT_IMAGE)).alias("image_url"),
    )


def readable_xml(text: Column) -> Column:
    """XML without its document type, and with HTML's entities and stray ampersands as XML can read them.

    Feeds are read as leniently as people write them: `&nbsp;` becomes its number, an unknown name or
    a bare ampersand becomes text. CDATA sections stay as they are. Texts without such signs pass
    through after one search.
    """
    known = F.create_map(*[
        F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (f"&{name};", f"&#{code};")])
    bare = F.when(text.rlike(r"(?i)<!DOCTYPE"), F.regexp_replace(text, DOCTYPE, "$1")).otherwise(text)

    def part(p: Column) -> Column:
        other = F.coalesce(F.try_element_at(known, p), F.concat(F.lit("&amp;"), F.substring(p, 2, 1 << 30)))
        return F.when(~p.startswith("&") | p.rlike(REFERENCE), p).otherwise(other)

    mended = F.array_join(F.transform(F.regexp_extract_all(bare, F.lit(XML_PARTS), F.lit(0)), part), "")
    return F.when(bare.rlike(STRAY), mended).otherwise(bare)


def parse_channels(raw: DataFrame, body: str = "body") -> DataFrame:
    """Adds kind ('rss', 'atom', 'json', NULL when none), channel fields and the `items` array.

    RSS 0.9x, 1.0 (RDF) and 2.0, Atom with or without a prefix, and JSON Feed. Each shape is parsed
    with a schema of its own, picked by the root element.
    """
    is_json = F.coalesce(F.ltrim(F.col(body)).startswith("{"), F.lit(False))
    text = F.when(~is_json, readable_xml(F.col(body)))
    doc = raw.withColumn("__text", F.explode_outer(F.array(text)))
    text = F.col("__text")
    root = F.lower(F.regexp_extract(text, ROOT, 2))
    prefix = F.regexp_extract(text, ROOT, 1)
    plain = F.when(
        prefix != "", F.regexp_replace(text, F.concat(F.lit("(</?)"), prefix, F.lit(":")), F.lit("$1"))
    ).otherwise(text)
    lenient = {"mode": "PERMISSIVE"}
    doc = doc.withColumns({
        "__r": F.from_xml(F.when(root.isin("rss", "rdf"), text), RSS, lenient),
        "__a": F.from_xml(F.when(root == "feed", plain), ATOM, lenient),
        "__j": F.from_json(F.when(is_json, F.col(body)), JSON_FEED, lenient),
    })
    r, a, j = F.col("__r"), F.col("__a"), F.col("__j")
    is_rss = r["channel"].isNotNull()
    is_atom = a["title"].isNotNull() | a["entry"].isNotNull()
    is_feed = j["version"].contains("jsonfeed.org") & (j["title"].isNotNull() | j["items"].isNotNull())
    kind = F.when(is_rss, "rss").when(is_atom, "atom").when(is_feed, "json")
    pick = lambda rss, atom, json: _blank(
        F.when(is_rss, rss).when(is_atom, atom).when(is_feed, F.trim(json)))
    items = (
        F.when(is_rss, F.transform(F.coalesce(r["channel"]["item"], r["item"]), _rss_item))
        .when(is_atom, F.transform(a["entry"], _atom_item))
        .when(is_feed, F.transform(j["items"], _json_item))
    )
    language = F.coalesce(r["channel"]["language"], r["channel"]["dc:language"])
    return (
        doc.withColumn("kind", kind)
        .withColumn("channel_title", pick(r["channel"]["title"], a["title"], j["title"]))
        .withColumn("channel_link", pick(r["channel"]["link"], _page_link(a["link"]), j["home_page_url"]))
        .withColumn("channel_description", pick(r["channel"]["description"], a["subtitle"], j["description"]))
        .withColumn("channel_language", pick(language, a["_xml:lang"], j["language"]))
        .withColumn("items", items)
        .drop("__r", "__a", "__j", "__text", body)
    )


def parse_feed_documents(raw: DataFrame, body: str = "body", unread: bool = False) -> DataFrame:
    """One row per item of every RSS, Atom or JSON body; bodies that are none give no rows.

    With `unread` such a body gives one row, with a NULL kind and item. The outer explode matters: an
    inner one lets Catalyst infer a filter on the array, push it to the scan, and parse every body
    again for it.
    """
    parsed = parse_channels(raw, body)
    items = parsed.select(
        *[c for c in parsed.columns if c != "items"],
        F.posexplode_outer("items").alias("item_no", "__i"),
    )
    some = F.col("item_no").isNotNull()
    items = items.filter(some | F.col("kind").isNull() if unread else some)
    return items.select(
        *[c for c in items.columns if c != "__i"],
        *[F.col(f"__i.{f}").alias(f"item_{f}") for f in ITEM_FIELDS],
    )


POST_TEXT = [
    "channeltitle", "channeldescription", "channellanguage",
    "itemtitle", "itemdescription", "itemcontent",
]
SANITISED = [
    "channel_title", "channel_description", "channel_language",
    "item_title", "item_description", "item_content",
]


def sanitize_items(items: DataFrame, strict: bool = False) -> DataFrame:
    """Sanitise all text fields in one Python round trip. Links are validated, not rewritten."""
    clean = items.withColumn(
        "__s", sanitize_fields({c: F.col(c) for c in SANITISED}, strict)
    )
    return clean.withColumns({c: F.col(f"__s.{c}") for c in SANITISED}).drop("__s")


def judged_rows(items: DataFrame, fetched_at: Column, compat: bool = False) -> DataFrame:
    """Items as post rows with a `reason` why one can't be: unreadable feed, invalid link, unreadable date.

    `compat` keeps an empty item description when the channel has a description.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    description = (
        F.when(F.col("channel_description") != "", F.col("item_description"))
        if compat
        else some("item_description")
    )
    # The date passes through an explode, so filters on it stay above and it is parsed once.
    at = F.array(parse_any_timestamp(F.col("item_published")))
    dated = items.select("*", F.explode_outer(at).alias("__at"))
    unread = F.col("kind").isNull() if "kind" in items.columns else F.lit(False)
    reason = F.when(unread, "unreadable feed").when(~F.coalesce(is_valid_url(F.col("item_link")), F.lit(False)), "invalid link").when(
        F.col("__at").isNull(), "unreadable date")
    return dated.select(
        "feed_id", "document_id", "item_no",
        F.col("channel_title").alias("channeltitle"),
        some("channel_link").alias("channelurl"),
        some("channel_description").alias("channeldescription"),
        some("channel_language").alias("channellanguage"),
        F.col("item_title").alias("itemtitle"),
        description.alias("itemdescription"),
        some("item_content").alias("itemcontent"),
        F.col("__at").alias("itempublished_at"),
        F.col("item_link").alias("itemurl"),
        F.col("item_image_url").alias("img_url"),
        fetched_at.alias("created_at"),
        fetched_at.alias("updated_at"),
        reason.alias("reason"),
    )


def post_rows(items: DataFrame, fetched_at: Column, compat: bool = False) -> DataFrame:
    """Items as post rows; items without a readable date or a valid link are dropped."""
    return judged_rows(items, fetched_at, compat).filter("reason IS NULL").drop("reason")


def ingest_posts(
    raw: DataFrame, posts: DataFrame, fetched_at: Column, strict: bool = False
) -> Change:
    """Fetched bodies (feed_id, document_id, body) to new posts; known item URLs are skipped.

    Bodies are spread over the cluster by id before they are parsed, as files that hold few or large row
    groups would leave that to few tasks. Parsed items are staged, so bodies are parsed once and the search for duplicates reads keys only;
    its winners are staged with their numbers. Text is sanitised after the duplicates are gone, so
    Python sees new items only. `rejected` has every other item with a `reason`: duplicate, invalid
    link, unreadable date, or, for a body that is no feed, unreadable feed.
    """
    parsed = judged_rows(parse_feed_documents(raw.repartition("document_id"), unread=True), fetched_at)
    rows = staged(complete(parsed, posts, "posts", fetched_at), "parsed-items")
    flagged = flag_unique(posts, rows, ["itemurl"], ["document_id", "item_no"], eligible=F.col("reason").isNull())
    fresh = flagged.filter("__ok").drop("__ok", "reason")
    clean = fresh.withColumn("__s", sanitize_fields({c: F.col(c) for c in POST_TEXT}, strict))
    accepted = staged(clean.withColumns({c: F.col(f"__s.{c}") for c in POST_TEXT}).drop("__s"), "new-posts")
    rejected = flagged.filter(~F.col("__ok")).drop("__ok").withColumn("reason", F.coalesce("reason", F.lit("duplicate")))
    shared = [c for c in posts.columns if c in accepted.columns]
    return Change(posts.unionByName(accepted.select(*shared), allowMissingColumns=True), accepted, rejected)


def fetch_schedule(feeds: DataFrame, k: int) -> DataFrame:
    """The next k approved feeds: never fetched first, then longest ago."""
    return (
        feeds.filter("approval_status = 'approved'")
        .orderBy(F.asc_nulls_first("last_fetched_at"), F.asc("id"))
        .limit(k)
    )


def mark_fetched(feeds: DataFrame, fetched: DataFrame, as_of: Column) -> Change:
    """Stamp the fetched feeds (column `id`)."""
    stamps = fetched.select("id").withColumn("last_fetched_at", as_of)
    return keyed_update(feeds, stamps, ["id"], ["last_fetched_at"], ["last_fetched_at"])


def classify_scrape_errors(attempts: DataFrame) -> DataFrame:
    """Failed attempts that are logged, with error type and status; other failures are left out."""
    deadline = F.col("message").contains(DEADLINE_MESSAGE)
    undetected = F.col("message").contains(UNDETECTED_MESSAGE)
    known = F.when(F.coalesce("status_code", F.lit(0)) != 0, F.col("status_code"))
    return (
        attempts.withColumn(
            "error_type", F.when(deadline, DEADLINE_TYPE).when(undetected, UNDETECTED_TYPE)
        )
        .filter(F.col("error_type").isNotNull())
        .withColumn(
            "status_code",
            F.when(deadline, F.coalesce(known, F.lit(DEADLINE_STATUS))).otherwise(F.col("status_code")),
        )
    )


def error_counters(errors: DataFrame) -> DataFrame:
    """One row per (error_type, feed_id): how often, first and latest occurrence."""
    at = F.struct("ts", "id")
    return errors.groupBy("error_type", "feed_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("id").alias("first_id"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min_by("retry_attempts", at).alias("first_retries"),
        F.max_by("message", at).alias("message"),
        F.max_by("status_code", at).alias("status_code"),
    )


def scrape_error_upsert(logs: DataFrame, counters: DataFrame) -> DataFrame:
    """The error table after a batch of counters: counted up where known, added where new."""
    key = ["error_type", "feed_id"]
    new = counters.select(
        *key, *[F.col(c).alias(f"__{c}") for c in counters.columns if c not in key]
    )
    both = logs.join(new, key, "full_outer")
    added, touched = F.col("occurrence_count").isNull(), F.col("__n").isNotNull()
    n = F.coalesce("__n", F.lit(0))
    old = lambda c, fresh: F.when(added, fresh).otherwise(F.col(c)).alias(c)
    return both.select(
        old("id", F.col("__first_id")),
        *key,
        F.when(touched, F.col("__message")).otherwise(F.col("message")).alias("message"),
        F.when(touched, F.col("__status_code")).otherwise(F.col("status_code")).alias("status_code"),
        (F.when(added, F.col("__first_retries") - 1).otherwise(F.col("retry_attempts")) + n)
        .cast("int").alias("retry_attempts"),
        old("admin_notified", F.lit(False)),
        old("resolved", F.lit(False)),
        "resolution_notes",
        (F.coalesce("occurrence_count", F.lit(0)) + n).alias("occurrence_count"),
        old("occurred_at", F.col("__first_ts")),
        F.when(touched, F.greatest("last_occurrence", "__last_ts"))
        .otherwise(F.col("last_occurrence")).alias("last_occurrence"),
    )


def merge_partial_input(edits: DataFrame, feeds: DataFrame, admin: bool = False) -> DataFrame:
    """Edits completed with the feed's current values; owners' feed types become lower case."""
    fields = ["name", "url", "img_url", "feed_type", "feed_description", "is_hidden"]
    if admin:
        fields += ["approval_status", "priority"]
    current = feeds.select("id", *[F.col(c).alias(f"__{c}") for c in fields])
    given = edits
    for c in fields:
        if c not in given.columns:
            given = given.withColumn(c, F.lit(None).cast(feeds.schema[c].dataType))
    if not admin:
        given = given.withColumn("feed_type", F.lower("feed_type"))
    return (
        given.join(current, "id")
        .withColumns({c: F.coalesce(c, f"__{c}") for c in fields})
        .drop(*[f"__{c}" for c in fields])
    )
