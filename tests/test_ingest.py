import collections

from pyspark.sql import functions as F

from feedspan.functions.timestamps import as_ntz
from feedspan.plans import ingest, notifications
from feedspan.sources.documents import rendered_bodies

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:atom="http://www.w3.org/2005/Atom">
<channel><title>Ada's Notes</title><link>https://ada.example</link>
<atom:link href="https://ada.example/index.xml" rel="self"/><description>About</description><language>en</language>
<item><title>Salt &amp; Pepper</title><link>https://ada.example/1?a=1&amp;b=2</link>
<content:encoded><![CDATA[<p>Hi <b>all</b><script>x()</script></p>]]></content:encoded>
<pubDate>Tue, 03 Mar 2009 11:05:09 -0700</pubDate><image><url>https://i.example/1.png</url></image></item>
<item><title>No date</title><link>https://ada.example/2</link></item>
<item><title>Bad link</title><link>not a link</link><pubDate>2006-01-02</pubDate></item>
<item><title>Repeat</title><link>https://ada.example/1?a=1&amp;b=2</link><pubDate>2006-01-02</pubDate></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="en"><title>Example Atom Feed</title>
<subtitle>Sub</subtitle><link href="https://atom.example/"/>
<entry><title type="html">One</title><link href="https://atom.example/1" rel="alternate"/>
<link href="https://atom.example/1.png" rel="enclosure" type="image/png"/><summary>Some text.</summary>
<content type="html">&lt;p&gt;x&lt;/p&gt;</content><published>2003-12-13T18:30:02Z</published></entry>
<entry><title>No link</title><updated>2003-12-13T18:30:02Z</updated></entry></feed>"""
EMPTY = "<rss version='2.0'><channel></channel></rss>"
BROKEN = ["<rss><channel><title>x</ti", "plain text", "", None, "<html><body>feed </body></html>"]


def bodies(spark, *texts):
    return spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)],
                                 "document_id bigint, feed_id bigint, body string")


def test_parse(spark):
    channels = {r["document_id"]: r for r in
                ingest.parse_channels(bodies(spark, RSS, ATOM, EMPTY, *BROKEN)).collect()}
    assert channels[0]["kind"] == "rss" and channels[0]["channel_title"] == "Ada's Notes"
    assert channels[1]["kind"] == "atom" and channels[1]["channel_title"] == "Example Atom Feed"
    assert (channels[1]["channel_description"], channels[1]["channel_language"]) == ("Sub", "en")
    assert channels[2]["channel_title"] == ""
    assert all(channels[i]["kind"] is None for i in range(3, 8))
    items = {(r["document_id"], r["item_no"]): r for r in
             ingest.parse_feed_documents(bodies(spark, RSS, ATOM, EMPTY, *BROKEN)).collect()}
    assert set(items) == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)}
    assert items[0, 0]["item_link"] == "https://ada.example/1?a=1&b=2"
    assert items[0, 0]["item_image_url"] == "https://i.example/1.png"
    assert items[0, 1]["item_image_url"] == ingest.DEFAULT_IMAGE
    assert items[1, 0]["item_image_url"] == "https://atom.example/1.png"
    assert items[1, 0]["item_content"] == "<p>x</p>"
    assert (items[1, 1]["item_link"], items[1, 1]["item_published"]) == ("", "2003-12-13T18:30:02Z")


def test_sanitised_fields(spark):
    row = ingest.sanitize_items(ingest.parse_feed_documents(bodies(spark, RSS))).orderBy("item_no").first()
    assert row["channel_title"] == "Ada&#39;s Notes"
    assert row["item_title"] == "Salt &amp; Pepper"
    assert row["item_content"] == "<p>Hi <b>all</b></p>"
    assert row["item_link"] == "https://ada.example/1?a=1&b=2"


def test_ingest(spark):
    posts = spark.createDataFrame([(1, "https://atom.example/1")], "id bigint, itemurl string")
    done = ingest.ingest_posts(bodies(spark, RSS, ATOM, RSS, *BROKEN), posts, as_ntz("2024-01-01 00:00:00"))
    new = done.changed.collect()
    assert [(r["document_id"], r["item_no"], r["itemurl"]) for r in new] == [
        (0, 0, "https://ada.example/1?a=1&b=2")]
    assert new[0]["itemdescription"] is None and new[0]["channellanguage"] == "en"
    # The repeat in the body, both rows of the second copy, and the known Atom post.
    reasons = collections.Counter(r["reason"] for r in done.rejected.collect())
    assert reasons == {"duplicate": 4, "unreadable date": 2, "invalid link": 3, "unreadable feed": 5}
    assert sorted(r["id"] for r in done.table.collect()) == [1, 2]
    assert done.rejected.filter("id IS NOT NULL").count() == 0


def test_new_posts_are_counted_by_notifications(spark, platform):
    """What ingest inserts has ids, so later jobs see it."""
    posts = platform.posts.filter("id < 5")
    done = ingest.ingest_posts(bodies(spark, RSS), posts, as_ntz("2024-02-01 00:00:00"))
    feeds = spark.createDataFrame([(0, "zero")], "id bigint, name string")
    counts = notifications.new_post_notifications(done.table, feeds, as_ntz("2024-02-01 00:05:00"), 10)
    assert [(r["feed_id"], r["post_count"]) for r in counts.collect()] == [(0, 1)]


RDF = """<?xml version="1.0"?><!DOCTYPE x><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"
 xmlns:dc="http://purl.org/dc/elements/1.1/"><channel rdf:about="c"><title>Old</title><link>https://old.example</link></channel>
<item rdf:about="i"><title>First</title><link>https://old.example/1</link><dc:date>2005-10-07T10:00:00Z</dc:date></item></rdf:RDF>"""
PREFIXED = """<!-- see <rss version="2.0"> --><a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>P</a:title>
<a:entry><a:title>E</a:title><a:link rel="self" href="https://p.example/feed"/><a:link rel="alternate" href="https://p.example/e"/>
<a:updated>2003-12-13T18:30:02Z</a:updated></a:entry></a:feed>"""
JSON = """ {"version":"https://jsonfeed.org/version/1","title":"J","home_page_url":"https://j.example","items":[
{"id":"1","url":"https://j.example/1","title":"T","content_text":"c","image":"https://j.example/1.png","date_published":"2020-01-01T00:00:00Z"}]}"""
IMAGES = """<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>I</title>
<item><title>a</title><enclosure url="https://i.example/a.mp3" type="audio/mpeg"/><enclosure url="https://i.example/a.jpg" type="image/jpeg"/></item>
<item><title>b</title><media:content url="https://i.example/b.png" medium="image"/></item></channel></rss>"""


def test_other_shapes(spark):
    rows = ingest.parse_feed_documents(bodies(spark, RDF, PREFIXED, JSON, IMAGES, '{"version":"1"}')).collect()
    got = {(r["document_id"], r["item_no"]): r for r in rows}
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 0), (3, 1)}
    assert (got[0, 0]["kind"], got[0, 0]["item_link"], got[0, 0]["item_published"]) == (
        "rss", "https://old.example/1", "2005-10-07T10:00:00Z")
    assert (got[1, 0]["kind"], got[1, 0]["item_link"]) == ("atom", "https://p.example/e")
    assert (got[2, 0]["kind"], got[2, 0]["channel_link"], got[2, 0]["item_content"], got[2, 0]["item_image_url"]) == (
        "json", "https://j.example", "c", "https://j.example/1.png")
    assert [got[3, i]["item_image_url"] for i in (0, 1)] == ["https://i.example/a.jpg", "https://i.example/b.png"]


ITEM = "<item><title>{}</title><link>https://t.example/1</link><pubDate>2006-01-02</pubDate></item>"


def test_lenient_reading(spark):
    """Each body has one item; none may cost the whole feed."""
    rss = lambda title, before="": f'{before}<rss version="2.0"><channel><title>C</title>{ITEM.format(title)}</channel></rss>'
    cases = [
        (rss("T&nbsp;x"), "T\u00a0x"),
        (rss("caf&eacute; &amp; bar &#33; &#x21;"), "café & bar ! !"),
        (rss("R&D and &unknown; & more"), "R&D and &unknown; & more"),
        (rss("<![CDATA[a &nbsp; & <b>b</b>]]>") , "a &nbsp; & <b>b</b>"),
        (rss("T&nbsp;<![CDATA[&nbsp;]]>"), "T\u00a0&nbsp;"),
        (rss("x", '<?xml version="1.0"?>\n<!DOCTYPE rss [<!ENTITY x "y>]"> <!ELEMENT a (b)>]>\n'), "x"),
        (rss("x", '<!-- <!DOCTYPE a> -->\n<!DOCTYPE rss PUBLIC "-//N//DTD RSS 0.91//EN" "http://n.example/rss.dtd">'), "x"),
        (rss("&lt;!DOCTYPE a&gt;<![CDATA[<!DOCTYPE html>]]>"), "<!DOCTYPE a><!DOCTYPE html>"),
        (rss("x").replace("<rss", "<RSS").replace("</rss", "</RSS"), "x"),
        (rss("x", "\ufeff \n"), "x"),
        (ATOM.replace("One", "O&ouml;").replace("<entry><title>No link</title><updated>2003-12-13T18:30:02Z</updated></entry>", ""), "Oö"),
        (PREFIXED.replace(">E<", ">E&hellip;<"), "E…"),
        (RDF.replace("First", "F&copy; & Co"), "F© & Co"),
    ]
    rows = ingest.parse_feed_documents(bodies(spark, *[body for body, _ in cases])).collect()
    assert {r["document_id"]: r["item_title"] for r in rows} == {i: title for i, (_, title) in enumerate(cases)}


def test_bodies_that_are_no_feeds_are_told(spark):
    rows = ingest.parse_feed_documents(bodies(spark, RSS, EMPTY, *BROKEN), unread=True).filter("kind IS NULL").collect()
    assert [r["document_id"] for r in rows] == [2, 3, 4, 5, 6]


def test_description_compat(spark):
    items = ingest.parse_feed_documents(bodies(spark, RSS))
    now = as_ntz("2024-01-01 00:00:00")
    assert ingest.post_rows(items, now).first()["itemdescription"] is None
    assert ingest.post_rows(items, now, compat=True).first()["itemdescription"] == ""


def test_error_classes(spark):
    attempts = spark.createDataFrame(
        [("timeout exceeded while fetching feeds", 0), ("timeout exceeded while fetching feeds", 503),
         ("unable to detect the feed type in the url", 200), ("no route", 0), (None, 0)],
        "message string, status_code int")
    got = [(r["error_type"], r["status_code"]) for r in ingest.classify_scrape_errors(attempts).collect()]
    assert got == [("FeedContextExceeded", 504), ("FeedContextExceeded", 503), ("FeedType", 200)]


def test_schedule_puts_never_fetched_first(spark):
    feeds = spark.createDataFrame(
        [(1, "approved", "2024-01-02"), (2, "approved", None), (3, "pending", None), (4, "approved", "2024-01-01")],
        "id int, approval_status string, last_fetched_at string")
    feeds = feeds.withColumn("last_fetched_at", F.to_timestamp_ntz("last_fetched_at"))
    picked = ingest.fetch_schedule(feeds, 2)
    assert [r["id"] for r in picked.collect()] == [2, 4]
    done = ingest.mark_fetched(feeds, picked, as_ntz("2024-02-01 00:00:00"))
    assert [r["id"] for r in ingest.fetch_schedule(done.table, 1).collect()] == [1]


def test_partial_input(spark):
    feeds = spark.createDataFrame([(1, "n", "u", "i", "news", "d", False)],
                                  "id int, name string, url string, img_url string, feed_type string,"
                                  " feed_description string, is_hidden boolean")
    edits = spark.createDataFrame([(1, "NEW")], "id int, feed_type string")
    row = ingest.merge_partial_input(edits, feeds).first()
    assert (row["name"], row["feed_type"], row["is_hidden"]) == ("n", "new", False)


def test_bodies_of_one_file_are_spread_before_they_are_parsed(spark, platform, monkeypatch):
    """A file of one row group is one task, however many bodies it holds."""
    seen, parsed = [], ingest.parse_feed_documents

    def parse(raw, **options):
        seen.append(raw)
        return parsed(raw, **options)

    monkeypatch.setattr(ingest, "parse_feed_documents", parse)
    raw = spark.createDataFrame([(1, 1, RSS)], "feed_id bigint, document_id bigint, body string").coalesce(1)
    posts = spark.createDataFrame([], "itemurl string")
    assert ingest.ingest_posts(raw, posts, as_ntz("2024-01-01")).changed.count() == 1
    for spread, key in ((seen[0], "document_id"), (rendered_bodies(platform), "doc_id")):
        assert f"RepartitionByExpression [{key}" in spread._jdf.queryExecution().optimizedPlan().toString()
