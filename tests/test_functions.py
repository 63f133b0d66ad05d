import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedspan.functions import checks, gateway
from feedspan.functions.ids import stable_uuid
from feedspan.functions.scoring import creator_score, unit_hash
from feedspan.functions.text import token_match, tokens
from feedspan.functions.timestamps import (
    format_timestamp,
    interval_seconds,
    parse_any_timestamp,
    plan_end_date,
    refine_interval,
)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def over(spark, values, build, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["r"] for r in df.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "text, query, expected",
    [
        ("Red Ring of Fire", "", True),
        ("Red Ring of Fire", "ring RED", True),
        ("Red Ring of Fire", "ring blue", False),
        ("Red Ring of Fire", "rin", False),
        ("Red Ring of Fire", "?!", False),
        ("Café-Noir", "café noir", True),
        (None, "ring", None),
    ],
)
def test_token_match(spark, text, query, expected):
    got = one(spark, token_match(F.lit(text).cast("string"), query))
    assert got in (False, None) if expected is None else got == expected


def test_tokens(spark):
    assert one(spark, tokens(F.lit(" A, b a, Ünï 42! "))) == ["a", "b", "ünï", "42"]


@pytest.mark.parametrize("text, want", [
    ("", ""), ("one", "one"), ("it's here", "it s here"), ("AT&T", "at t"), ("C++", "c"), ("#tag", "tag"),
    ("foo_bar", "foo bar"), ("5th of May", "5th of may"), ("naïve Straße", "naïve straße"), ("日本 語", "日本 語"),
    # Hyphenated words and their parts.
    ("foo-bar", "foo-bar foo bar"), ("state-of-the-art", "state-of-the-art state of the art"),
    ("foo-beta1", "foo-beta1 foo beta1"), ("Über-Maß", "über-maß über maß"), ("a - b", "a b"), ("trailing- word", "trailing word"),
    ("Foo-Foo", "foo-foo foo"),
    # Numbers.
    ("-12", "-12"), ("+5", "+5"), ("10-20", "10 -20"), ("2024-01-05", "2024 -01 -05"), ("3.14", "3.14"), ("-1.234", "-1.234"),
    ("-1.234e56", "-1.234e56"), ("1e5", "1e5"), ("8.3.0", "8.3.0"), ("1,000", "1 000"), ("$9.99", "9.99"), ("50%", "50"), ("12:30", "12 30"),
    # Addresses.
    ("foo@example.com", "foo@example.com"), ("Ada.Lovelace-2@mail.example.org!", "ada.lovelace-2@mail.example.org"), ("x@y", "x y"),
    ("www.example.com", "www.example.com"), ("node.js", "node.js"), ("example.com:8080", "example.com:8080"),
    ("http://example.com", "example.com"),
    ("https://Example.com/stuff/Index.html", "example.com/stuff/index.html example.com /stuff/index.html"),
    ("see example.com/a?b=c now", "see example.com/a?b=c example.com /a?b=c now"),
    ("example.com:80/", "example.com:80/ example.com:80 /"),
    ("/usr/local/foo.txt", "/usr/local/foo.txt"), ("path/file", "path/file"), ("and/or", "and/or"), ("01/02/2024", "01/02/2024"),
    # Markup.
    ('<a href="x.html">go</a>', "go"), ("fish &amp; chips &#33;", "fish chips"), ("<!-- no --> yes", "yes"), ("a < b", "a b"),
    ("End. Next", "end next"),
])
def test_compound_tokens(spark, text, want):
    assert one(spark, tokens(F.lit(text))) == want.split()


def test_compound_queries(spark):
    match = lambda text, query: one(spark, token_match(F.lit(text), query))
    assert match("a state-of-the-art thing", "state-of-the-art") and match("a state-of-the-art thing", "art")
    assert not match("state of the art", "state-of-the-art")
    assert match("mail foo@example.com", "foo@example.com") and not match("mail foo@example.com", "foo")
    assert match("at https://example.com/a/b", "example.com")


def test_creator_score(spark):
    args = [F.lit(x) for x in (100, 50, 20, 10)]
    assert round(one(spark, creator_score(*args, F.lit(30.0))), 6) == 55.266667
    assert round(one(spark, creator_score(*args, F.lit(0.0))), 6) == 55.4
    assert one(spark, creator_score(*args[:3], F.lit(10**6), F.lit(0.001))) == pytest.approx(
        0.8 * 69 + 0.2 * 100
    )
    assert one(spark, creator_score(*[F.lit(None).cast("int")] * 4, F.lit(None).cast("double"))) == 0.2


def test_unit_hash_is_stable_and_spread(spark):
    got = [r[0] for r in spark.range(1000).select(unit_hash(F.col("id"), "s")).collect()]
    assert got == [r[0] for r in spark.range(1000).select(unit_hash(F.col("id"), "s")).collect()]
    assert all(0 <= x < 1 for x in got) and 0.45 < sum(got) / 1000 < 0.55


def test_refine_interval(spark):
    asked = [10, 1, 100, -5, -1, 0, 234, None]
    assert over(spark, asked, lambda v: refine_interval(v, 10, 100), "int") == [
        10, 1, 100, 10, 10, 10, 10, 10]


def test_format_timestamp(spark):
    shown = ["2024-08-03T15:02:32.000Z", "2024-08-03", "invalid-date", "", None,
             "2024-02-30", "2024-08-03T15:02:32+05:00"]
    assert over(spark, shown, format_timestamp) == [
        "2024-08-03 15:02:32", "2024-08-03 00:00:00", "", "", "", "", "2024-08-03 15:02:32"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Mon, 02 Jan 2006 15:04:05 -0700", "2006-01-02 22:04:05"),
        ("Monday, 2 January 2006 15:04:05 +0000", "2006-01-02 15:04:05"),
        ("2 jan 2006 15:04 GMT", "2006-01-02 15:04:00"),
        ("02 Jan 2006 15:04:05 EST", "2006-01-02 20:04:05"),
        ("2 Sept 2006", "2006-09-02 00:00:00"),
        ("2006-01-02T15:04:05Z", "2006-01-02 15:04:05"),
        ("2006-01-02T15:04:05.123456+02:00", "2006-01-02 13:04:05"),
        ("2006-01-02T15:04:05.123-0700", "2006-01-02 22:04:05"),
        ("2006-01-02 15:04:05", "2006-01-02 15:04:05"),
        ("2006-01-02 15:04:05 +0100", "2006-01-02 14:04:05"),
        ("2006-01-02 15:04", "2006-01-02 15:04:00"),
        ("2006-01-02", "2006-01-02 00:00:00"),
        ("2006/01/02 15:04:05", "2006-01-02 15:04:05"),
        ("1/2/2006", "2006-01-02 00:00:00"),
        ("January 2, 2006", "2006-01-02 00:00:00"),
        ("Mon Jan 2 15:04:05 2006", "2006-01-02 15:04:05"),
        ("20060102", "2006-01-02 00:00:00"),
        ("1136214245", "2006-01-02 15:04:05"),
        ("1136214245000", "2006-01-02 15:04:05"),
        ("  2006-01-02  ", "2006-01-02 00:00:00"),
        ("some day", None),
        ("99 Jan 2006", None),
        ("", None),
        ("Fri Jul 03 2015 18:04:07 GMT+0100 (GMT Daylight Time)", "2015-07-03 17:04:07"),
        ("September 17, 2012 at 10:09am PST-08", "2012-09-17 18:09:00"),
        ("2013-04-01 22:43:22,213", "2013-04-01 22:43:22"),
        ("2014年04月08日", "2014-04-08 00:00:00"),
        ("2014年4月8日 19:17:22", "2014-04-08 19:17:22"),
        ("Thu Jul 09 2015 04:04:07 UTC-02:30", "2015-07-09 06:34:07"),
        (None, None),
    ],
)
def test_parse_any_timestamp(spark, text, expected):
    got = one(spark, F.date_format(parse_any_timestamp(F.lit(text).cast("string")), "yyyy-MM-dd HH:mm:ss"))
    assert got == expected


def test_plan_end_date(spark):
    start = F.to_timestamp_ntz(F.lit("2024-01-31 10:00:00"))
    ends = over(spark, ["day", "week", "month", "year", "once"], lambda v: plan_end_date(v, start))
    assert ends == [dt.datetime(2024, 2, 1, 10), dt.datetime(2024, 2, 7, 10),
                    dt.datetime(2024, 2, 29, 10), dt.datetime(2025, 1, 31, 10),
                    dt.datetime(2024, 1, 31, 10)]


def test_interval_seconds(spark):
    gap = F.expr("TIMESTAMP_NTZ'2024-01-03 01:02:03.5' - TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    assert one(spark, interval_seconds(gap)) == 2 * 86400 + 3723.5


def test_uuid_and_url(spark):
    uuids = ["7a467466-e92c-44ed-a206-3a460c867f3b", "c5f950a6-290d-4a38-a817-f49f2bb52b2f",
             "abcd123342123", "", None]
    assert over(spark, uuids, checks.is_valid_uuid) == [True, True, False, False, False]
    urls = ["https://a.example/x?y=1", "a.example/x", "/x", "", None, "http://"]
    assert over(spark, urls, checks.is_valid_url) == [True, False, False, False, False, False]


def test_stable_uuid(spark):
    keys = [("ab", "c"), ("a", "bc"), ("ab", "c"), ("abc", None), (None, "abc"), ("", "abc"), ("~", "abc")]
    ids = [one(spark, stable_uuid(*[F.lit(x).cast("string") for x in k])) for k in keys]
    assert len(set(ids)) == 6
    assert ids[0] == ids[2] != ids[1]
    assert one(spark, checks.is_valid_uuid(F.lit(ids[0])))


def test_first_message_per_field_wins(spark):
    df = spark.createDataFrame(
        [("", "x", "", "t", "d"), ("n", "https://a.b/", "https://a.b/i.png", "t" * 501, "é" * 250)],
        "name string, url string, img_url string, feed_type string, feed_description string",
    )
    got = [r["errors"] for r in checks.validate_rows(df, checks.feed_rules()).collect()]
    assert got[0] == {"name": "must be provided", "url": "must be a valid URL",
                      "Image": "url must be provided"}
    assert got[1] == {"feed type": "must not be more than 500 bytes long"}
    valid, rejected = checks.split_valid(df, checks.feed_rules())
    assert valid.count() == 0 and rejected.count() == 2


def test_other_rule_sets(spark):
    nil = checks.NIL_UUID
    good = "7a467466-e92c-44ed-a206-3a460c867f3b"

    def errors(rules, **values):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
        return checks.validate_rows(df, rules).first()["errors"]

    assert errors(checks.feed_follow_rules(), feed_id=nil) == {"feed id": "must be provided"}
    assert errors(checks.favorite_rules(), post_id=good, feed_id="x") == {"feed id": "must be a valid UUID"}
    assert errors(checks.comment_update_rules(), id=good, comment_text="x", version=0) == {
        "version": "must be valid and provided"}
    assert errors(checks.subscription_status_rules(), id=good, status="active") == {
        "status": "must be a valid status"}
    assert errors(checks.charge_rules(), amount=0, plan_id=1) == {"amount": "must be varied"}
    assert errors(checks.verification_rules(), reference="", plan_id=0) == {
        "reference": "must be varied", "plan_id": "must be provided"}
    assert errors(checks.announcement_read_rules(), announcement_id=0) == {
        "announcement_id": "must be provided"}
    assert errors(checks.grant_rules(), codes=[], user_id=1) == {"permissions": "must be provided"}
    assert errors(checks.revoke_rules(), code="", user_id=0) == {
        "codes": "must be provided", "user_id": "must be provided"}
    assert errors(checks.error_log_rules(), resolution_notes="") == {"resolution_notes": "must be provided"}


@pytest.mark.parametrize(
    "body, problem",
    [
        ('{"status":true,"data":{"id":1,"log":{"input":["a"],"history":[{"type":"x","time":1}]}}}', None),
        ('{"status":true,"extra":1}', "body contains unknown key extra"),
        ('{"status":true,"data":{"ids":1}}', "body contains unknown key ids"),
        ('{"status":', "body contains badly-formed JSON"),
        ("", "body must not be empty"),
        (None, "body must not be empty"),
        ('{"message":"' + "x" * 1_048_576 + '"}', "body must not be larger than 1048576 bytes"),
    ],
)
def test_gateway_payloads(spark, body, problem):
    df = spark.createDataFrame([(body,)], "body string")
    if problem and "larger" in problem:
        unlimited = gateway.parse_gateway_payloads(df).first()
        assert unlimited["problem"] is None and unlimited["body_bytes"] == len(body)
    row = gateway.parse_gateway_payloads(df, max_bytes=1_048_576).first()
    assert row["problem"] == problem
    assert (row["reply"] is None) == (problem is not None)
    if problem is None and "data" in body:
        assert row["reply"]["data"]["log"]["history"][0]["type"] == "x"
