"""Fetched feed bodies: readers for a folder, and bodies rendered from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedspan.sources.platform import Platform

# feed_id, url, status, body and fetch time of each fetched document.
BODY_SCHEMA = (
    "document_id bigint, feed_id bigint, url string, status int, body string, "
    "fetched_at timestamp"
)


def read_bodies(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(BODY_SCHEMA).format(fmt).load(path)


def stream_bodies(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(BODY_SCHEMA)
        .format(fmt)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def _xml(text: str) -> str:
    escaped = f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return escaped


def rendered_bodies(platform: Platform) -> DataFrame:
    """One feed body per document, in five shapes: every line is an item.

    German documents are Atom, those of odd ids with a prefix and behind a comment that names
    another root; of the others ids decide on RSS 2.0, RSS 1.0 or JSON Feed. The first line links to the document's known post URL,
    other lines to the hash of their text, so repeated lines collide. Every tenth item
    has no readable date. Documents are spread by id, so that a file of one row group isn't one task.
    """
    at = "TIMESTAMP_NTZ'2024-01-01 00:00:00' + INTERVAL '1' MINUTE * doc_id"
    link = (
        "CASE WHEN i = 0 THEN 'https://posts.example.com/' || doc_id"
        " ELSE 'https://posts.example.com/line/' || md5(line) END"
    )
    when = lambda good: f"CASE WHEN i % 10 = 9 THEN 'some day' ELSE {good} END"
    rss_item = (
        f"'<item><title>' || {_xml('line')} || '</title><link>' || {link} || '</link>'"
        f" || '<description>' || {_xml('line')} || '</description><pubDate>'"
        f" || {when('rfc')} || '</pubDate></item>'"
    )
    atom_item = (
        f"'<entry><title>' || {_xml('line')} || '</title><link href=\"' || {link} || '\"/>'"
        f" || '<summary>' || {_xml('line')} || '</summary><published>'"
        f" || {when('iso')} || '</published></entry>'"
    )
    lines = "split(text, '\\n')"
    rss = (
        "'<?xml version=\"1.0\"?><rss version=\"2.0\"><channel><title>' || source ||"
        " '</title><link>https://' || source || '.example.com</link><description>' || source ||"
        " ' channel</description><language>' || lang || '</language>' ||"
        f" array_join(transform({lines}, (line, i) -> {rss_item}), '') || '</channel></rss>'"
    )
    atom = (
        "'<feed xmlns=\"http://www.w3.org/2005/Atom\" xml:lang=\"' || lang || '\"><title>' ||"
        " source || '</title><subtitle>' || source || ' channel</subtitle>'"
        " || '<link href=\"https://' || source || '.example.com\"/>' ||"
        f" array_join(transform({lines}, (line, i) -> {atom_item}), '') || '</feed>'"
    )
    rdf_item = (
        f"'<item rdf:about=\"' || {link} || '\"><title>' || {_xml('line')} || '</title><link>' || {link} || '</link>'"
        f" || '<description>' || {_xml('line')} || '</description><dc:date>'"
        f" || {when('iso')} || '</dc:date></item>'"
    )
    rdf = (
        "'<rdf:RDF xmlns:rdf=\"http://www.w3.org/1999/02/22-rdf-syntax-ns#\" xmlns=\"http://purl.org/rss/1.0/\""
        " xmlns:dc=\"http://purl.org/dc/elements/1.1/\"><channel rdf:about=\"x\"><title>' || source ||"
        " '</title><link>https://' || source || '.example.com</link><description>' || source ||"
        " ' channel</description><dc:language>' || lang || '</dc:language></channel>' ||"
        f" array_join(transform({lines}, (line, i) -> {rdf_item}), '') || '</rdf:RDF>'"
    )
    prefixed = (
        "'<?xml version=\"1.0\"?><!-- not <rss version=\"2.0\"> -->' ||"
        f" regexp_replace(replace({atom}, ' xmlns=', ' xmlns:atom='), '(</?)(feed|title|subtitle|link|entry|summary|published)"
        "(?=[ />])', '$1atom:$2')"
    )
    json = (
        "to_json(named_struct('version', 'https://jsonfeed.org/version/1.1', 'title', source,"
        " 'home_page_url', 'https://' || source || '.example.com', 'description', source || ' channel', 'language', lang,"
        f" 'items', transform({lines}, (line, i) -> named_struct('title', line, 'url', {link}, 'summary', line,"
        f" 'date_published', {when('iso')}))))"
    )
    return (
        platform.raw("documents")
        .repartition("doc_id")
        .selectExpr(
            "*",
            f"date_format({at}, 'd MMM yyyy HH:mm:ss') || ' +0000' AS rfc",
            f"date_format({at}, \"yyyy-MM-dd'T'HH:mm:ss\") || 'Z' AS iso",
        )
        .selectExpr(
            "doc_id AS document_id",
            "doc_id % 200 AS feed_id",
            f"CASE WHEN lang = 'de' AND doc_id % 2 = 0 THEN {atom} WHEN lang = 'de' THEN {prefixed}"
            f" WHEN doc_id % 4 = 1 THEN {rdf} WHEN doc_id % 4 = 2 THEN {json} ELSE {rss} END AS body",
        )
    )


def page_bodies(platform: Platform) -> DataFrame:
    """One RSS body per web page, with the page's HTML as item content."""
    title = _xml("url")
    return platform.raw("pages").selectExpr(
        "page_id AS document_id",
        "page_id % 200 AS feed_id",
        "'<rss version=\"2.0\" xmlns:content=\"http://purl.org/rss/1.0/modules/content/\">"
        f"<channel><title>pages</title><item><title>' || {title} || '</title><link>' || {title} ||"
        f" '</link><content:encoded>' || {_xml('html')} ||"
        " '</content:encoded><pubDate>2024-01-01</pubDate></item></channel></rss>' AS body",
    )
