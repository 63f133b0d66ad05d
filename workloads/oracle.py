"""Independent SQL for every job, run by DuckDB on the same parquet tables.

`VIEWS` restates the platform's tables; each check gets the views it names as CTEs.
"""

from __future__ import annotations

import re

from feedspan.functions.text import CLASSES, HOST, HYPHENATED

EVENTS = "TIMESTAMP '2024-01-30 12:00:00'"
ORDERS = "TIMESTAMP '2001-08-01 00:00:00'"

VIEWS = {
    "users": """
        SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.com' AS email,
               c_acctbal > 0 AS activated, 1 AS version,
               'https://img.example.com/u/' || c_custkey || '.png' AS user_img,
               coalesce((SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey),
                        TIMESTAMP '1995-01-01') AS created_at
        FROM customer""",
    "permissions": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, lower(n_name) || ':read' AS code FROM nation""",
    "users_permissions": """
        SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS permission_id
        FROM customer WHERE c_acctbal > 5000
        UNION ALL
        SELECT c_custkey, CAST((c_nationkey + 1) % 25 AS BIGINT) FROM customer WHERE c_acctbal > 5000""",
    "feeds": """
        SELECT p_partkey AS id, p_name AS name, 'https://feeds.example.com/' || p_partkey AS url,
               p_partkey % 97 AS user_id, 1 + p_partkey % 3 AS version,
               'https://img.example.com/f/' || p_partkey || '.png' AS img_url,
               lower(p_type) AS feed_type, p_brand || ' ' || p_name AS feed_description,
               p_partkey % 7 = 0 AS is_hidden,
               CASE p_partkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' ELSE 'approved' END
                 AS approval_status,
               CASE WHEN p_size <= 10 THEN 'high' WHEN p_size <= 35 THEN 'normal' ELSE 'low' END
                 AS priority,
               coalesce(s.a, TIMESTAMP '1995-01-01') AS created_at,
               CASE WHEN p_partkey % 11 <> 0 THEN s.b END AS last_fetched_at
        FROM part LEFT JOIN (SELECT l_partkey, min(l_shipdate) a, max(l_shipdate) b
                             FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey""",
    "feed_follows": """
        SELECT o_custkey || '-' || l_partkey AS id, o_custkey AS user_id, l_partkey AS feed_id,
               min(o_orderdate) AS created_at
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey""",
    "feed_rejections": """
        SELECT l_partkey AS feed_id, l_shipdate AS rejected_at, l_suppkey AS rejected_by,
               'returned by order ' || l_orderkey AS reason
        FROM lineitem WHERE l_returnflag = 'R'""",
    "posts": """
        SELECT doc_id AS id, doc_id % 200 AS feed_id, source AS channeltitle,
               'https://' || source || '.example.com' AS channelurl,
               source || ' channel' AS channeldescription, lang AS channellanguage,
               split_part(text, chr(10), 1) AS itemtitle, text AS itemcontent,
               'https://posts.example.com/' || doc_id AS itemurl,
               TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at
        FROM documents""",
    "post_arrivals": """
        SELECT event_id AS id, user_id AS feed_id, ts AS created_at
        FROM events WHERE event_type = 'view'""",
    "favorites": """
        SELECT min(event_id) AS id, post_id, post_id % 200 AS feed_id, user_id, min(ts) AS created_at
        FROM (SELECT event_id, ts, user_id,
                     (event_id * 7) % (SELECT count(*) FROM documents) AS post_id
              FROM events WHERE event_type = 'click')
        GROUP BY user_id, post_id""",
    "comments": """
        SELECT t.conv_id * 100 + t.turn AS id, t.conv_id % 200 AS post_id,
               (t.conv_id + t.turn) % 150 AS user_id,
               CASE WHEN b.conv_id IS NOT NULL THEN t.conv_id * 100 + t.turn - 1 END AS parent_comment_id,
               t.text AS comment_text, 1 AS version,
               TIMESTAMP '2024-01-21' + to_days(CAST(t.conv_id % 10 AS INTEGER))
                 + to_minutes(t.turn) AS created_at
        FROM conversations t LEFT JOIN conversations b
          ON b.conv_id = t.conv_id AND b.turn = t.turn - 1 AND b.role <> 'system'
        WHERE t.role <> 'system'""",
    "comment_notifications": """
        SELECT id, user_id, post_id, id AS comment_id, created_at FROM comments""",
    "notifications": """
        SELECT feed_id || '@' || strftime(slot, '%Y%m%d%H%M') AS id, feed_id, name AS feed_name,
               post_count, slot + INTERVAL 10 MINUTE AS created_at
        FROM (SELECT feed_id, time_bucket(INTERVAL 10 MINUTE, created_at) AS slot,
                     count(*) AS post_count FROM post_arrivals GROUP BY 1, 2)
        JOIN feeds ON feeds.id = feed_id""",
    "payment_plans": """
        SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name,
               'https://img.example.com/p/' || r_regionkey || '.png' AS image,
               'Plan ' || r_name AS description,
               CASE WHEN r_regionkey <= 2 THEN 'month' ELSE 'year' END AS duration,
               CAST(10 * (r_regionkey + 1) AS DOUBLE) AS price,
               'read,' || lower(r_name) AS features,
               CASE WHEN r_regionkey = 3 THEN 'inactive' ELSE 'active' END AS status, 1 AS version
        FROM region""",
    "subscriptions": """
        SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 5 AS plan_id,
               o_orderdate AS start_date,
               CASE WHEN o_orderkey % 5 <= 2 THEN o_orderdate + INTERVAL 30 DAY
                    ELSE o_orderdate + INTERVAL 365 DAY END AS end_date,
               CAST(o_totalprice AS DECIMAL(12,2)) AS price,
               CASE o_orderstatus WHEN 'F' THEN 'expired' WHEN 'O' THEN 'active'
                    ELSE 'cancelled' END AS status,
               o_orderkey AS transaction_id, o_orderpriority AS payment_method,
               'AUTH_' || o_orderkey AS authorization_code,
               right('0000' || o_orderkey, 4) AS card_last4,
               CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'KES' END AS currency,
               o_orderdate AS updated_at
        FROM orders""",
    "challenged_transactions": """
        SELECT l_orderkey AS id, o_custkey AS user_id, l_orderkey AS referenced_subscription_id,
               'https://pay.example.com/' || l_orderkey AS authorization_url,
               'ref-' || l_orderkey AS reference,
               CASE WHEN l_orderkey % 3 = 0 THEN 'pending' WHEN line = 'F' THEN 'successful'
                    ELSE 'failed' END AS status, at_ AS created_at, at_ AS updated_at
        FROM (SELECT l_orderkey, min(l_linestatus) line, max(l_shipdate) at_ FROM lineitem
              WHERE l_returnflag = 'R' GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey""",
    "failed_transactions": """
        SELECT id, user_id, referenced_subscription_id AS subscription_id, reference,
               'declined' AS failure_reason, created_at AS attempt_date
        FROM challenged_transactions WHERE status = 'failed'""",
    "scrape_attempts": """
        SELECT event_id AS id, user_id AS feed_id, ts,
               CASE WHEN value < 50 THEN 'unable to detect the feed type in the url'
                    WHEN value < 150 THEN 'timeout exceeded while fetching feeds'
                    ELSE 'connection refused' END AS message,
               CASE WHEN value < 50 THEN 200 WHEN value < 100 THEN 0 ELSE 408 END AS status_code,
               3 AS retry_attempts
        FROM events WHERE event_type = 'error'""",
    "scraper_error_logs": """
        SELECT min(event_id) AS id,
               CASE WHEN value < 50 THEN 'FeedType' ELSE 'FeedContextExceeded' END AS error_type,
               user_id AS feed_id, 'seen before' AS message, 504 AS status_code,
               3 AS retry_attempts, false AS admin_notified, false AS resolved,
               CAST(NULL AS VARCHAR) AS resolution_notes, count(*) AS occurrence_count,
               min(ts) AS occurred_at, max(ts) AS last_occurrence
        FROM events WHERE event_type = 'error' GROUP BY 2, 3""",
    "announcements": """
        SELECT CAST(r_regionkey AS BIGINT) AS id, 'News from ' || r_name AS title,
               'Service in ' || r_name AS message,
               TIMESTAMP '2024-01-01' + to_days(r_regionkey) AS created_at,
               TIMESTAMP '2024-01-15' + to_days(10 * r_regionkey) AS expires_at,
               CAST(r_regionkey AS BIGINT) AS created_by, r_regionkey <> 2 AS is_active,
               CASE r_regionkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS urgency
        FROM region""",
    "announcement_reads": """
        SELECT event_id AS id, user_id, event_id % 5 AS announcement_id, ts AS read_at
        FROM events WHERE event_type = 'signup'""",
    # Helpers of several checks
    "planned": """
        SELECT s.*, p.name AS plan_name, p.image AS plan_image, p.duration AS plan_duration
        FROM subscriptions s JOIN payment_plans p ON s.plan_id = p.id""",
    "planned_out": """
        SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM planned""",
    "due": """
        SELECT s.id AS subscription_id, authorization_code, plan_id, CAST(price AS DOUBLE) AS price,
               currency, user_id, end_date, email, name
        FROM subscriptions s JOIN users u ON s.user_id = u.id
        WHERE status = 'expired' AND end_date < TIMESTAMP '2001-08-01'
          AND NOT EXISTS (SELECT 1 FROM challenged_transactions c
                          WHERE c.referenced_subscription_id = s.id AND c.status = 'pending')""",
    "lines": """
        SELECT doc_id AS document_id, doc_id % 200 AS feed_id, source, lang, i - 1 AS item_no,
               trim(line) AS line, line AS raw_line,
               CASE WHEN i = 1 THEN 'https://posts.example.com/' || doc_id
                    ELSE 'https://posts.example.com/line/' || md5(line) END AS link,
               (i - 1) % 10 <> 9 AS dated,
               TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS at_
        FROM (SELECT *, unnest(string_split(text, chr(10))) AS line,
                     unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
              FROM documents)""",
    "replies": """
        SELECT o_orderkey AS subscription_id, o_orderkey % 7 = 0 AS paused, o_orderstatus = 'F' AS paid
        FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0""",
    "routes": """
        SELECT due.*, p.duration,
               CASE WHEN paused THEN 'challenged' WHEN p.id IS NULL THEN 'rejected' WHEN paid THEN 'renewed'
                    ELSE 'failed' END AS outcome
        FROM due JOIN replies USING (subscription_id)
        LEFT JOIN payment_plans p ON p.id = plan_id AND p.status = 'active'""",
    "feed_edits": """
        SELECT o_orderkey AS seq, o_orderkey // 4 AS id, (o_orderkey // 4) % 97 AS user_id,
               1 + o_orderkey % 3 AS version, 'name ' || o_orderkey AS name,
               CASE WHEN o_orderkey % 2 = 0 THEN 'promo' END AS new_type FROM orders""",
    "errors_after": """
        SELECT coalesce(l.id, n.first_id) AS id, coalesce(l.error_type, n.error_type) AS error_type,
               coalesce(l.feed_id, n.feed_id) AS feed_id,
               coalesce(n.message, l.message) AS message,
               CASE WHEN n.n IS NOT NULL THEN n.status_code ELSE l.status_code END AS status_code,
               CAST(CASE WHEN l.id IS NULL THEN 3 - 1 + n.n ELSE l.retry_attempts + coalesce(n.n, 0)
                    END AS INTEGER) AS retry_attempts,
               coalesce(l.admin_notified, false) AS admin_notified,
               coalesce(l.resolved, false) AS resolved,
               coalesce(l.occurrence_count, 0) + coalesce(n.n, 0) AS occurrence_count,
               coalesce(l.occurred_at, n.first_ts) AS occurred_at,
               greatest(l.last_occurrence, n.last_ts) AS last_occurrence
        FROM (SELECT * FROM scraper_error_logs WHERE occurred_at < TIMESTAMP '2024-01-05') l
        FULL JOIN (
          SELECT error_type, feed_id, count(*) AS n, min(id) AS first_id, min(ts) AS first_ts,
                 max(ts) AS last_ts, arg_max(message, id) AS message,
                 arg_max(status_code, id) AS status_code
          FROM classified GROUP BY 1, 2) n
        ON l.error_type = n.error_type AND l.feed_id = n.feed_id""",
    "classified": """
        SELECT * REPLACE (CASE WHEN message LIKE '%timeout%' AND status_code = 0 THEN 504
                          ELSE status_code END AS status_code),
               CASE WHEN message LIKE '%timeout%' THEN 'FeedContextExceeded' ELSE 'FeedType' END
                 AS error_type
        FROM scrape_attempts WHERE message NOT LIKE 'connection%'""",
}

SQL: dict[str, str] = {}

# Timelines and discovery

PUBLIC = "NOT is_hidden AND approval_status = 'approved'"


def _tokens(column: str) -> str:
    """The tokens of a text: the classes are tried in order at each place; addresses and hyphenated words add their parts."""
    host = HOST.replace("'", "''")
    pattern = "|".join(CLASSES.values()).replace("'", "''")
    return f"""list_distinct(flatten(list_transform(regexp_extract_all(lower({column}), '{pattern}'), lambda t:
        CASE WHEN regexp_matches(t, '^[<&]|://$') THEN CAST([] AS VARCHAR[])
             WHEN regexp_matches(t, '^{host}/') THEN [t, regexp_extract(t, '^{host}'), t[length(regexp_extract(t, '^{host}')) + 1:]]
             WHEN regexp_full_match(t, '{HYPHENATED}') THEN list_concat([t], string_split(t, '-')) ELSE [t] END)))"""


def _has(column: str, *words: str) -> str:
    wanted = ", ".join(f"'{w}'" for w in words)
    return f"list_has_all({_tokens(column)}, [{wanted}])"


SQL["feed_catalog"] = f"""
    SELECT *, (SELECT count(*) FROM feeds WHERE {PUBLIC}) AS total_records
    FROM feeds WHERE {PUBLIC} ORDER BY created_at DESC, id LIMIT 100"""
_F = f"{PUBLIC} AND feed_type = 'promo' AND {_has('name', 'plate')}"
SQL["feed_catalog_search"] = f"""
    SELECT *, (SELECT count(*) FROM feeds WHERE {_F}) AS total_records
    FROM feeds WHERE {_F} ORDER BY created_at DESC, id LIMIT 10"""
_F = f"feed_type = 'promo' AND {_has('name', 'plate')}"
SQL["feed_catalog_compat"] = f"""
    SELECT *, (SELECT count(*) FROM feeds WHERE {_F}) AS total_records
    FROM feeds WHERE {_F} ORDER BY created_at DESC, id LIMIT 100"""
SQL["feed_catalog_metadata"] = f"""
    SELECT 3 AS current_page, 7 AS page_size, 1 AS first_page,
           CAST(ceil(count(*) / 7.0) AS BIGINT) AS last_page, count(*) AS total_records
    FROM feeds WHERE {PUBLIC}"""
SQL["feed_catalog_page_after"] = f"""
    SELECT * FROM feeds WHERE {PUBLIC}
      AND (created_at < TIMESTAMP '1995-06-01' OR (created_at = TIMESTAMP '1995-06-01' AND id > 100))
    ORDER BY created_at DESC, id LIMIT 50"""
SQL["feed_catalog_with_follow_flag"] = """
    SELECT v.id AS user_id, f.id AS feed_id, f.name, f.is_hidden, ff.id IS NOT NULL AS is_followed,
           ff.id AS follow_id, count(*) OVER (PARTITION BY v.id) AS total_records,
           row_number() OVER (PARTITION BY v.id ORDER BY f.created_at DESC, f.id) AS row_num
    FROM users v JOIN feeds f ON approval_status = 'approved' AND (NOT is_hidden OR f.user_id = v.id)
    LEFT JOIN feed_follows ff ON ff.user_id = v.id AND ff.feed_id = f.id
    QUALIFY row_num <= 20"""
SQL["followed_feeds"] = """
    SELECT ff.user_id, f.id AS feed_id, f.created_at, f.name, f.url, f.feed_type, f.img_url,
           count(*) OVER (PARTITION BY ff.user_id) AS total_records,
           row_number() OVER (PARTITION BY ff.user_id ORDER BY f.created_at DESC, f.id) AS row_num
    FROM feed_follows ff JOIN feeds f ON ff.feed_id = f.id QUALIFY row_num <= 20"""
SQL["followed_feeds_search"] = f"""
    SELECT ff.user_id, f.id AS feed_id, f.created_at, f.name, f.url, f.feed_type, f.img_url,
           count(*) OVER (PARTITION BY ff.user_id) AS total_records,
           row_number() OVER (PARTITION BY ff.user_id ORDER BY f.created_at DESC, f.id) AS row_num
    FROM feed_follows ff JOIN feeds f ON ff.feed_id = f.id
    WHERE {_has('f.name', 'ring')} AND {PUBLIC}
    QUALIFY row_num BETWEEN 4 AND 6"""


def _timeline(where: str, rows: str) -> str:
    return f"""
    SELECT ff.user_id, p.id AS post_id, p.feed_id, p.channeltitle, md5(p.itemtitle) AS itemtitle,
           md5(p.itemcontent) AS itemcontent, p.itemurl, p.created_at, pf.id IS NOT NULL AS is_favorite,
           count(*) OVER (PARTITION BY ff.user_id) AS total_records,
           row_number() OVER (PARTITION BY ff.user_id ORDER BY p.created_at DESC, p.id) AS row_num
    FROM posts p JOIN feed_follows ff ON p.feed_id = ff.feed_id
    LEFT JOIN favorites pf ON pf.post_id = p.id AND pf.user_id = ff.user_id
    WHERE {where} QUALIFY {rows}"""


SQL["user_timeline"] = _timeline("true", "row_num <= 20")
SQL["user_timeline_after"] = f"""
    SELECT * EXCLUDE (total_records) REPLACE (row_num - 20 AS row_num) FROM ({_timeline("true", "row_num BETWEEN 21 AND 40")})"""
SQL["user_timeline_from_start"] = f"""SELECT * EXCLUDE (total_records) FROM ({_timeline(
    _has("p.itemtitle", "the") + " AND ff.user_id IN (SELECT user_id FROM favorites)", "row_num <= 7")})"""
SQL["posts_deep_page"] = """
    SELECT id, created_at, feed_id, (SELECT count(*) FROM posts) AS total_records FROM posts
    ORDER BY created_at DESC, id LIMIT 17 OFFSET 510"""
SQL["never_fetched_page"] = """
    SELECT id, last_fetched_at, (SELECT count(*) FROM feeds) AS total_records FROM feeds
    ORDER BY last_fetched_at DESC NULLS LAST, id DESC LIMIT 100 OFFSET 1800"""
SQL["user_timeline_search"] = _timeline(_has("p.itemtitle", "the", "of"), "row_num BETWEEN 4 AND 6")
SQL["user_timeline_one_feed"] = _timeline(
    "p.feed_id = 17 AND ff.user_id IN (SELECT user_id FROM favorites)", "row_num <= 20"
)
SQL["favorite_timeline"] = """
    SELECT pf.user_id, p.id AS post_id, p.feed_id, p.channeltitle, md5(p.itemtitle) AS itemtitle,
           md5(p.itemcontent) AS itemcontent, p.itemurl, p.created_at, true AS is_favorite,
           ff.id IS NOT NULL AS is_followed_feed,
           count(*) OVER (PARTITION BY pf.user_id) AS total_records,
           row_number() OVER (PARTITION BY pf.user_id ORDER BY p.created_at DESC, p.id) AS row_num
    FROM posts p JOIN favorites pf ON pf.post_id = p.id
    LEFT JOIN feed_follows ff ON ff.feed_id = p.feed_id AND ff.user_id = pf.user_id
    QUALIFY row_num <= 20"""
SQL["favorite_refs"] = """
    SELECT id, post_id, feed_id, user_id, created_at FROM favorites
    WHERE user_id IN (SELECT user_id FROM comments)"""
SQL["post_user_flags"] = """
    SELECT a.user_id, a.post_id, p.feed_id, p.itemurl, p.created_at, f.id IS NOT NULL AS is_favorite,
           ff.id IS NOT NULL AS is_followed_feed
    FROM (SELECT user_id, post_id FROM comments UNION SELECT user_id, post_id FROM favorites) a
    JOIN posts p ON p.id = a.post_id
    LEFT JOIN favorites f ON f.post_id = p.id AND f.user_id = a.user_id
    LEFT JOIN feed_follows ff ON ff.feed_id = p.feed_id AND ff.user_id = a.user_id"""
SQL["sample_posts_per_feed"] = """
    SELECT feed_id, id, row_number() OVER (PARTITION BY feed_id ORDER BY md5('s1' || id), id) AS row_num
    FROM posts QUALIFY row_num <= 3"""
SQL["creator_feed_dashboard"] = """
    SELECT f.id, f.name, f.url, f.user_id, f.feed_type, f.feed_description, f.is_hidden,
           f.approval_status, f.priority, f.created_at,
           coalesce((SELECT count(*) FROM feed_follows x WHERE x.feed_id = f.id), 0) AS follow_count,
           count(*) OVER (PARTITION BY f.user_id) AS total_records,
           count(*) OVER (PARTITION BY f.user_id) AS total_feeds_count,
           count(*) FILTER (f.approval_status = 'approved') OVER (PARTITION BY f.user_id)
             AS approved_feeds_count,
           count(*) FILTER (f.approval_status = 'rejected') OVER (PARTITION BY f.user_id)
             AS rejected_feeds_count,
           r.rejected_by, r.reason AS rejection_reason, r.rejected_at, u.name AS rejected_by_username,
           row_number() OVER (PARTITION BY f.user_id
             ORDER BY (f.approval_status = 'pending') DESC, f.created_at DESC, f.id) AS row_num
    FROM feeds f
    LEFT JOIN (SELECT * FROM feed_rejections QUALIFY row_number() OVER (PARTITION BY feed_id
                 ORDER BY rejected_at DESC, rejected_by DESC, reason DESC) = 1) r
      ON r.feed_id = f.id AND f.approval_status = 'rejected'
    LEFT JOIN users u ON u.id = r.rejected_by
    QUALIFY row_num <= 20"""
SQL["feed_like_stats"] = """
    SELECT f.id AS feed_id, u.name AS user_name, u.user_img AS user_img_url,
           count(pf.id) AS liked_posts_count
    FROM feeds f JOIN users u ON f.user_id = u.id LEFT JOIN posts rp ON rp.feed_id = f.id
    LEFT JOIN favorites pf ON pf.post_id = rp.id GROUP BY 1, 2, 3"""
SQL["top_followed_feeds"] = """
    SELECT c.feed_id, c.follow_count, f.* EXCLUDE (id)
    FROM (SELECT feed_id, count(*) AS follow_count FROM feed_follows GROUP BY 1
          ORDER BY 2 DESC, 1 LIMIT 20) c JOIN feeds f ON f.id = c.feed_id"""
SQL["top_followed_visible_feeds"] = f"""
    SELECT ff.feed_id, count(*) AS follow_count, any_value(f.name) AS name, any_value(f.url) AS url,
           any_value(f.user_id) AS user_id, any_value(f.version) AS version,
           any_value(f.img_url) AS img_url, any_value(f.feed_type) AS feed_type,
           any_value(f.feed_description) AS feed_description, any_value(f.is_hidden) AS is_hidden,
           any_value(f.approval_status) AS approval_status, any_value(f.priority) AS priority,
           any_value(f.created_at) AS created_at, any_value(f.last_fetched_at) AS last_fetched_at
    FROM feed_follows ff JOIN feeds f ON f.id = ff.feed_id WHERE {PUBLIC}
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
VIEWS["creators"] = """
    SELECT f.user_id, u.name, u.user_img, f.total_follows, l.total_likes,
           coalesce(a.n, 0) AS total_created_feeds, coalesce(g.gap, 0) AS avg_time_between_feeds,
           coalesce(c.n, 0) AS total_comments
    FROM (SELECT f.user_id, count(ff.id) AS total_follows
          FROM feeds f LEFT JOIN feed_follows ff ON f.id = ff.feed_id GROUP BY 1) f
    JOIN (SELECT f.user_id, count(pf.id) AS total_likes FROM feeds f
          LEFT JOIN posts rp ON f.id = rp.feed_id LEFT JOIN favorites pf ON rp.id = pf.post_id
          GROUP BY 1) l USING (user_id)
    LEFT JOIN (SELECT user_id, count(*) AS n FROM feeds WHERE approval_status = 'approved'
               GROUP BY 1) a USING (user_id)
    LEFT JOIN (SELECT user_id, avg(epoch_us(created_at) - epoch_us(prev)) / 86400000000.0 AS gap
               FROM (SELECT user_id, created_at,
                            lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) AS prev
                     FROM feeds) WHERE prev IS NOT NULL GROUP BY 1) g USING (user_id)
    LEFT JOIN (SELECT user_id, count(*) AS n FROM comments GROUP BY 1) c USING (user_id)
    LEFT JOIN users u ON u.id = f.user_id"""
_SCORE = """0.8 * (0.5 * total_follows + 0.3 * total_likes + 0.2 * total_comments) + 0.2 * CASE
    WHEN avg_time_between_feeds = 0 THEN 1.0
    ELSE greatest(0.0, least(100.0, total_created_feeds / avg_time_between_feeds)) END"""
SQL["top_feed_creators"] = f"""
    SELECT user_id, name, user_img, total_follows, total_likes, total_created_feeds,
           round(avg_time_between_feeds, 6) AS avg_time_between_feeds, total_comments,
           round({_SCORE}, 6) AS score
    FROM creators ORDER BY total_follows DESC, user_id LIMIT 20"""
SQL["top_feed_creators_jitter"] = f"""
    SELECT user_id, round({_SCORE}
        + 0.05 * CAST('0x' || substr(md5('j' || user_id), 1, 8) AS BIGINT) / 4294967296.0, 6) AS score
    FROM creators ORDER BY total_follows DESC, user_id LIMIT 10 OFFSET 10"""
SQL["top_feed_creators_by_score"] = f"""
    SELECT user_id, name, user_img, total_follows, total_likes, total_created_feeds,
           round(avg_time_between_feeds, 6) AS avg_time_between_feeds, total_comments,
           round({_SCORE}, 6) AS score
    FROM creators ORDER BY {_SCORE} DESC, user_id LIMIT 15 OFFSET 15"""
SQL["comment_threads"] = """
    SELECT c.id, c.post_id, c.user_id, c.parent_comment_id, md5(c.comment_text) AS comment_text,
           c.version, c.created_at, u.name AS user_name, c.user_id = 7 AS is_editable
    FROM comments c JOIN users u ON u.id = c.user_id"""
SQL["facet_feeds"] = "SELECT DISTINCT id, name FROM feeds"
for _name, _table, _column in [
    ("facet_feed_types", "feeds", "feed_type"), ("facet_feed_names", "feeds", "name"),
    ("facet_priorities", "feeds", "priority"),
    ("facet_error_types", "scraper_error_logs", "error_type"),
]:
    SQL[_name] = f"""
    SELECT row_number() OVER (ORDER BY {_column}) AS id, {_column}
    FROM (SELECT DISTINCT {_column} FROM {_table})"""
SQL["feed_by_id"] = "SELECT * FROM feeds WHERE id IN (SELECT feed_id FROM favorites)"
SQL["comment_by_id_and_owner"] = """
    SELECT * REPLACE (md5(comment_text) AS comment_text) FROM comments
    WHERE (id, user_id) IN (SELECT (conv_id * 100 + turn, (conv_id + 1) % 150) FROM conversations)"""
SQL["plan_by_id"] = """
    SELECT * FROM payment_plans WHERE status = 'active' AND id IN (SELECT plan_id FROM subscriptions)"""
SQL["admin_plan_by_id"] = """
    SELECT * FROM payment_plans WHERE id IN (SELECT plan_id FROM subscriptions)"""
SQL["error_log_by_id"] = """
    SELECT l.*, f.name AS feed_name, f.url AS feed_url, f.img_url AS feed_img_url
    FROM scraper_error_logs l JOIN feeds f ON f.id = l.feed_id
    WHERE l.id IN (SELECT id FROM scrape_attempts)"""
SQL["user_by_email"] = """
    SELECT * FROM users WHERE lower(email) IN (
      SELECT 'customer#' || lpad(CAST(s_suppkey * 7 AS VARCHAR), 9, '0') || '@example.com' FROM supplier)"""
SQL["search_feeds"] = f"""
    SELECT s.name AS search_id, f.id
    FROM (SELECT name, {_tokens("name")} AS t FROM (SELECT DISTINCT name FROM feeds)) s
    JOIN (SELECT id, {_tokens("name")} AS t FROM feeds) f ON list_has_all(f.t, s.t)"""
SQL["post_title_tokens"] = f"SELECT id, unnest({_tokens('itemtitle')}) AS token FROM posts"
SQL["page_tokens"] = f"SELECT page_id, unnest({_tokens('html')}) AS token FROM pages"

# Moderation and platform


def _board(compat: bool, where: str, page: str) -> str:
    oldest = "min(created_at)" if compat else "min(created_at) FILTER (approval_status = 'pending')"
    keep = f"approval_status = 'pending' AND {where} AND user_id IN (SELECT id FROM users)"
    return f"""
    SELECT f.id, f.name, f.url, f.user_id, f.feed_type, f.is_hidden, f.approval_status, f.priority,
           f.created_at, (SELECT count(*) FROM feeds WHERE {keep}) AS total_records,
           s.*, p.total_by_priority, o.pending_feeds_count, u.name AS user_name,
           u.email AS user_email, u.user_img
    FROM (SELECT * FROM feeds WHERE {keep} ORDER BY created_at, id {page}) f
    JOIN users u ON u.id = f.user_id
    CROSS JOIN (SELECT count(*) FILTER (approval_status = 'pending') AS total_pending_feeds,
                       count(*) FILTER (approval_status = 'approved') AS total_approved_feeds,
                       count(*) FILTER (approval_status = 'rejected') AS total_rejected_feeds,
                       CAST(floor(epoch({EVENTS} - {oldest}) / 86400) AS BIGINT) AS oldest_pending_days
                FROM feeds) s
    LEFT JOIN (SELECT priority, count(*) AS total_by_priority FROM feeds
               WHERE approval_status = 'pending' GROUP BY 1) p ON p.priority = f.priority
    LEFT JOIN (SELECT user_id, count(*) AS pending_feeds_count FROM feeds
               WHERE approval_status = 'pending' GROUP BY 1) o ON o.user_id = f.user_id"""


SQL["moderation_queue"] = _board(False, "true", "LIMIT 100")
SQL["moderation_queue_compat"] = _board(True, _has("name", "plate"), "LIMIT 5 OFFSET 5")


def _admin_board(where: str, rank: str, page: str) -> str:
    keep = f"{where} AND user_id IN (SELECT id FROM users)"
    return f"""
    SELECT f.id, f.name, f.url, f.user_id, f.feed_type, f.is_hidden, f.approval_status, f.priority,
           f.created_at, f.last_fetched_at, (SELECT count(*) FROM feeds WHERE {keep}) AS total_records,
           s.*, (SELECT feed_type FROM feeds GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
             AS most_common_feed_type,
           p.total_by_priority, coalesce(o.pending_feeds_count, 0) AS pending_feeds_count,
           u.name AS user_name, u.email AS user_email, u.user_img, coalesce(c.n, 0) AS follow_count
    FROM (SELECT * FROM feeds WHERE {keep} ORDER BY {rank}, created_at DESC, id {page}) f
    JOIN users u ON u.id = f.user_id
    CROSS JOIN (SELECT count(*) AS total_feeds,
                       count(*) FILTER (approval_status = 'pending') AS total_pending_feeds,
                       count(*) FILTER (approval_status = 'approved') AS total_approved_feeds,
                       count(*) FILTER (approval_status = 'rejected') AS total_rejected_feeds,
                       count(*) FILTER (priority = 'high') AS total_high_priority_feeds,
                       count(*) FILTER (is_hidden) AS total_hidden_feeds FROM feeds) s
    LEFT JOIN (SELECT priority, count(*) AS total_by_priority FROM feeds
               WHERE approval_status = 'pending' GROUP BY 1) p ON p.priority = f.priority
    LEFT JOIN (SELECT user_id, count(*) AS pending_feeds_count FROM feeds
               WHERE approval_status = 'pending' GROUP BY 1) o ON o.user_id = f.user_id
    LEFT JOIN (SELECT feed_id, count(*) AS n FROM feed_follows GROUP BY 1) c ON c.feed_id = f.id"""


SQL["feed_admin_board"] = _admin_board(
    "true", "CASE priority WHEN 'high' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END", "LIMIT 100"
)
SQL["feed_admin_board_filtered"] = _admin_board(
    f"{_has('name', 'ring')} AND feed_type = 'large' AND NOT is_hidden AND priority = 'normal'",
    "CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END", "LIMIT 100",
)
_DIRECTORY = """
    SELECT u.*, (SELECT count(*) FROM users) AS total_records,
           coalesce((SELECT string_agg(p.code, ',' ORDER BY p.id) FROM users_permissions up
                     JOIN permissions p ON p.id = up.permission_id WHERE up.user_id = u.id),
                    'normal user') AS permissions
    FROM users u"""
SQL["user_directory"] = _DIRECTORY
SQL["user_directory_page"] = _DIRECTORY + " ORDER BY u.created_at DESC, u.id LIMIT 15 OFFSET 30"
SQL["permission_grants"] = """
    SELECT u.id AS user_id, u.name, u.user_img, p.id AS permission_id, p.code AS permission_code
    FROM users u JOIN users_permissions up ON u.id = up.user_id
    JOIN permissions p ON p.id = up.permission_id"""
SQL["permission_codes"] = "SELECT id, code FROM permissions"
SQL["user_permission_codes"] = """
    SELECT up.user_id, string_agg(p.code, ',' ORDER BY p.id) AS permissions,
           bool_or(p.code = 'nation_3:read') AS is_admin
    FROM users_permissions up JOIN permissions p ON p.id = up.permission_id
    JOIN users u ON u.id = up.user_id GROUP BY 1"""
SQL["platform_statistics"] = f"""
    SELECT (SELECT count(*) FROM users) AS total_users,
           (SELECT count(*) FROM users WHERE activated) AS active_users,
           (SELECT count(*) FROM users WHERE created_at >= {EVENTS} - INTERVAL 7 DAY) AS new_signups,
           CAST(sum(price) AS DOUBLE) AS total_revenue,
           count(*) FILTER (status = 'active') AS active_subscriptions,
           count(*) FILTER (status = 'cancelled') AS cancelled_subscriptions,
           count(*) FILTER (status = 'expired') AS expired_subscriptions,
           (SELECT payment_method FROM subscriptions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
             AS most_used_payment_method,
           (SELECT count(*) FROM comments) AS total_comments,
           (SELECT count(*) FROM comments WHERE created_at >= {EVENTS} - INTERVAL 7 DAY)
             AS recent_comments
    FROM subscriptions"""
_ERRORS = """
    SELECT l.*, f.name AS feed_name, f.url AS feed_url, f.img_url AS feed_img_url,
           count(*) OVER () AS total_records
    FROM scraper_error_logs l JOIN feeds f ON f.id = l.feed_id"""
SQL["scraper_error_board"] = _ERRORS + " ORDER BY occurrence_count DESC, l.id LIMIT 100"
SQL["scraper_error_board_filtered"] = (
    _ERRORS + " WHERE error_type = 'FeedType' ORDER BY occurrence_count DESC, l.id LIMIT 20 OFFSET 20"
)
SQL["unread_announcements"] = """
    SELECT a.* FROM announcements a LEFT JOIN announcement_reads r
      ON a.id = r.announcement_id AND r.user_id = 15
    WHERE a.is_active AND r.id IS NULL"""
SQL["unread_unexpired_announcements"] = f"""
    SELECT a.* FROM announcements a LEFT JOIN announcement_reads r
      ON a.id = r.announcement_id AND r.user_id = 15
    WHERE a.is_active AND a.expires_at > {EVENTS} AND r.id IS NULL"""
SQL["unread_inbox"] = """
    SELECT user_id, announcement_id, row_num FROM (
      SELECT v.id AS user_id, a.id AS announcement_id, row_number() OVER (PARTITION BY v.id ORDER BY a.id) AS row_num
      FROM users v JOIN announcements a ON a.is_active
      WHERE NOT EXISTS (SELECT 1 FROM announcement_reads r WHERE r.announcement_id = a.id AND r.user_id = v.id))
    WHERE row_num <= 20"""
SQL["announcement_list"] = """
    SELECT *, count(*) OVER () AS total_records FROM announcements ORDER BY created_at DESC, id LIMIT 20"""
SQL["usage_quota"] = f"""
    SELECT *, created_feeds >= 5 OR followed_feeds >= 5 OR comments_today >= 10 AS over_limit
    FROM (SELECT u.id AS user_id, coalesce(a.n, 0) AS followed_feeds, coalesce(b.n, 0) AS created_feeds,
                 coalesce(c.n, 0) AS comments_today
          FROM users u
          LEFT JOIN (SELECT user_id, count(DISTINCT feed_id) n FROM feed_follows GROUP BY 1) a
            ON a.user_id = u.id
          LEFT JOIN (SELECT user_id, count(DISTINCT id) n FROM feeds GROUP BY 1) b ON b.user_id = u.id
          LEFT JOIN (SELECT user_id, count(DISTINCT id) n FROM comments
                     WHERE CAST(created_at AS DATE) = CAST({EVENTS} AS DATE) GROUP BY 1) c
            ON c.user_id = u.id)"""

# Subscriptions and revenue

SQL["plan_catalog"] = "SELECT * FROM payment_plans WHERE status = 'active'"
SQL["plan_catalog_all"] = "SELECT * FROM payment_plans"
SQL["running_subscriptions"] = f"""
    SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM subscriptions
    WHERE status = 'active' AND end_date > {ORDERS}
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start_date DESC, id) = 1"""
SQL["current_subscription"] = f"""
    SELECT * FROM planned_out
    WHERE status IN ('active', 'cancelled') AND (status <> 'cancelled' OR end_date > {ORDERS})
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start_date DESC, id) = 1"""
SQL["subscription_history"] = """
    SELECT *, count(*) OVER (PARTITION BY user_id) AS total_records,
           row_number() OVER (PARTITION BY user_id ORDER BY start_date DESC, id) AS row_num
    FROM planned_out QUALIFY row_num <= 5"""
_ALL = """
    SELECT p.*, EXISTS (SELECT 1 FROM challenged_transactions c
                        WHERE c.referenced_subscription_id = p.id) AS has_challenged_transactions"""
SQL["all_subscriptions"] = _ALL + " FROM planned_out p"
SQL["all_subscriptions_page"] = (
    _ALL + """, (SELECT count(*) FROM planned) AS total_records
    FROM (SELECT * FROM planned_out ORDER BY start_date DESC, id LIMIT 50 OFFSET 50) p"""
)
SQL["renewal_candidates"] = "SELECT * FROM due"
SQL["next_renewals"] = """
    SELECT *, (SELECT count(*) FROM due) AS total_records FROM due
    ORDER BY end_date, subscription_id"""
SQL["pending_challenges_by_user"] = """
    SELECT * FROM challenged_transactions
    WHERE status = 'pending' AND user_id IN (SELECT user_id FROM users_permissions)"""
SQL["pending_challenges_by_subscription"] = """
    SELECT * FROM challenged_transactions WHERE status = 'pending'
      AND referenced_subscription_id IN (SELECT id FROM subscriptions WHERE status = 'active')"""
SQL["pending_challenges_by_reference"] = """
    SELECT * FROM challenged_transactions
    WHERE status = 'pending' AND reference IN (SELECT 'ref-' || p_partkey * 6 FROM part)"""
SQL["challenge_detail"] = """
    SELECT ct.id AS transaction_id, ct.user_id, u.name AS user_name, u.email AS user_email, u.user_img,
           ct.referenced_subscription_id, ct.authorization_url, ct.reference, ct.created_at,
           ct.updated_at, ct.status, s.plan_id, CAST(s.price AS DOUBLE) AS price, s.start_date, s.end_date
    FROM challenged_transactions ct JOIN subscriptions s ON ct.referenced_subscription_id = s.id
    JOIN users u ON ct.user_id = u.id"""


def _kpis(churn: str) -> str:
    return f"""
    SELECT count(*) FILTER (status = 'active') AS total_active_subscriptions,
           round({churn}, 4) AS churn_rate,
           round(avg(CAST(price AS DOUBLE)), 4) AS average_revenue_per_user,
           round(avg(epoch(end_date - start_date)) FILTER (status = 'cancelled'), 4) AS average_duration,
           CAST(sum(price) AS DOUBLE) AS total_revenue,
           (SELECT payment_method FROM subscriptions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
             AS most_popular_payment_method,
           (SELECT plan_id FROM subscriptions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
             AS most_subscribed_plan,
           round((SELECT count(*) FROM challenged_transactions) / CAST(count(*) AS DOUBLE), 4)
             AS challenged_rate,
           count(*) FILTER (status = 'failed') AS failed_status_count,
           (SELECT count(*) FROM failed_transactions) AS failed_transactions_count,
           count(*) FILTER (end_date BETWEEN {ORDERS} AND {ORDERS} + INTERVAL 30 DAY)
             AS near_expiry_count
    FROM subscriptions"""


_CHURNED = f"count(*) FILTER (status = 'cancelled' AND end_date >= {ORDERS} - INTERVAL 30 DAY)"
SQL["subscription_kpis"] = _kpis(f"{_CHURNED} / CAST(count(*) AS DOUBLE)")
SQL["subscription_kpis_compat"] = _kpis(f"CAST({_CHURNED} AS DOUBLE)")
SQL["revenue_by_plan"] = """
    SELECT p.name AS plan_name, CAST(round(sum(s.price), 0) AS BIGINT) AS total_revenue
    FROM subscriptions s JOIN payment_plans p ON s.plan_id = p.id GROUP BY 1"""
SQL["challenge_outcomes"] = """
    SELECT status, count(*) AS outcome_count FROM challenged_transactions GROUP BY 1"""
SQL["revenue_by_payment_method"] = """
    SELECT payment_method, CAST(sum(price) AS DOUBLE) AS revenue FROM subscriptions GROUP BY 1"""
SQL["subscriptions_over_time"] = f"""
    SELECT CAST(CAST(start_date AS DATE) AS TIMESTAMP) AS day, count(*) AS subscriptions_count
    FROM subscriptions WHERE start_date >= {ORDERS} - INTERVAL 30 DAY GROUP BY 1"""
SQL["new_vs_cancelled"] = f"""
    SELECT count(*) FILTER (start_date >= {ORDERS} - INTERVAL 30 DAY) AS new_subscriptions,
           {_CHURNED} AS cancelled_subscriptions FROM subscriptions"""
SQL["subscriptions_by_currency"] = """
    SELECT currency, count(*) AS currency_count FROM subscriptions GROUP BY 1"""
VIEWS["kpis"] = SQL["subscription_kpis"]
VIEWS["new_vs_cancelled"] = SQL["new_vs_cancelled"]
_NUMBERS = [
    "total_active_subscriptions", "churn_rate", "average_revenue_per_user", "average_duration", "total_revenue",
    "most_subscribed_plan", "challenged_rate", "failed_status_count", "failed_transactions_count", "near_expiry_count",
]
_KPI_ROWS = " UNION ALL ".join(
    [f"SELECT 'kpis' AS part, '{c}' AS name, CAST({c} AS DOUBLE) AS value FROM kpis" for c in _NUMBERS]
    + ["SELECT 'kpis', 'most_popular_payment_method=' || most_popular_payment_method, 1.0 FROM kpis"]
    + [f"SELECT 'new_vs_cancelled', '{c}', CAST({c} AS DOUBLE) FROM new_vs_cancelled"
       for c in ("new_subscriptions", "cancelled_subscriptions")]
)
SQL["subscription_report"] = f"""
    {_KPI_ROWS} UNION ALL
    SELECT 'revenue_by_plan' AS part, p.name AS name,
           CAST(round(sum(s.price), 0) AS DOUBLE) AS value
    FROM subscriptions s JOIN payment_plans p ON s.plan_id = p.id GROUP BY 2
    UNION ALL SELECT 'challenge_outcomes', status, CAST(count(*) AS DOUBLE)
    FROM challenged_transactions GROUP BY 2
    UNION ALL SELECT 'revenue_by_payment_method', payment_method, CAST(sum(price) AS DOUBLE)
    FROM subscriptions GROUP BY 2
    UNION ALL SELECT 'subscriptions_over_time', CAST(CAST(start_date AS DATE) AS VARCHAR),
           CAST(count(*) AS DOUBLE)
    FROM subscriptions WHERE start_date >= {ORDERS} - INTERVAL 30 DAY GROUP BY 2
    UNION ALL SELECT 'subscriptions_by_currency', currency, CAST(count(*) AS DOUBLE)
    FROM subscriptions GROUP BY 2"""

# Notifications


def _key(name: str, *columns: str) -> str:
    parts = [f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')" for c in (f"'{name}'", *columns)]
    return "md5(" + " || ".join(parts) + ")"


def _serial(table: str, order: str) -> str:
    """The numbers after a table's largest id."""
    return f"(SELECT max(id) FROM {table}) + row_number() OVER (ORDER BY {order})"


def _uuid(name: str, *columns: str) -> str:
    shape = "'^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5'"
    return f"regexp_replace({_key(name, *columns)}, {shape})"


def _arrived(n: int) -> str:
    return f"""
    SELECT f.id AS feed_id, f.name AS feed_name, count(p.id) AS post_count
    FROM post_arrivals p JOIN feeds f ON p.feed_id = f.id
    WHERE p.created_at >= {EVENTS} - INTERVAL {n} MINUTE AND p.created_at <= {EVENTS} GROUP BY 1, 2"""


SQL["new_post_notifications"] = _arrived(1440)
SQL["notification_rows"] = f"""
    SELECT id, feed_id, feed_name, post_count, created_at FROM notifications
    UNION ALL SELECT {_uuid("notifications", "feed_id", f"CAST({EVENTS} AS VARCHAR)")}, feed_id, feed_name, post_count,
           {EVENTS} FROM ({_arrived(100)})"""
VIEWS["recent_notifications"] = f"""
    SELECT ff.user_id, n.id AS notification_id, n.feed_id, n.feed_name, n.post_count, n.created_at
    FROM notifications n JOIN feed_follows ff ON n.feed_id = ff.feed_id
    WHERE n.created_at >= {EVENTS} - INTERVAL 100 MINUTE"""
SQL["user_notifications"] = "SELECT * FROM recent_notifications"
VIEWS["comment_events"] = """
    SELECT v.viewer_id, cn.id AS notification_id, cn.post_id, v.kind AS notification_type,
           c.id AS comment_id, coalesce(c.parent_comment_id, -1) AS replied_comment_id,
           left(c.comment_text, 20) AS comment_snippet, md5(rp.itemtitle) AS post_title, cn.created_at
    FROM comment_notifications cn JOIN comments c ON cn.comment_id = c.id
    JOIN posts rp ON c.post_id = rp.id
    JOIN (SELECT c.id, f.user_id AS viewer_id, 'Comment on Favorited Post' AS kind
          FROM comments c JOIN favorites f ON f.post_id = c.post_id
          UNION ALL
          SELECT c.id, m.user_id, 'Reply to Your Comment'
          FROM comments c JOIN comments m ON m.id = c.parent_comment_id) v ON v.id = c.id"""
SQL["comment_notifications"] = "SELECT * FROM comment_events"
SQL["notifications_bundle"] = """
    SELECT user_id, 'post' AS kind, notification_id AS id, md5(feed_name) AS subject, created_at
    FROM recent_notifications
    UNION ALL
    SELECT viewer_id, notification_type, CAST(notification_id AS VARCHAR), post_title, created_at
    FROM comment_events"""
SQL["purge_notifications"] = f"""
    SELECT *, CASE WHEN created_at > {EVENTS} - INTERVAL 10000 MINUTE THEN 'kept' ELSE 'purged' END
      AS outcome FROM notifications"""
SQL["purge_notification_days"] = f"SELECT * FROM notifications WHERE created_at > {EVENTS} - INTERVAL 10000 MINUTE"
SQL["append_comment_notifications"] = f"""
    SELECT id, user_id, post_id, comment_id, created_at FROM comment_notifications
    UNION ALL SELECT {_serial("comment_notifications", "id")}, user_id, post_id, id, created_at
    FROM comments"""
SQL["delete_read_comment_notifications"] = """
    SELECT *, CASE WHEN post_id IN (SELECT post_id FROM favorites) THEN 'deleted' ELSE 'kept' END
      AS outcome FROM comment_notifications"""
SQL["delete_own_comment_notifications"] = """
    SELECT n.* FROM comment_notifications n LEFT JOIN favorites f
      ON f.post_id = n.post_id AND f.user_id = n.user_id WHERE f.id IS NULL"""

# Ingest

VIEWS["scheduled"] = """
    SELECT id, url, last_fetched_at FROM feeds WHERE approval_status = 'approved'
    ORDER BY last_fetched_at ASC NULLS FIRST, id LIMIT 50"""
SQL["fetch_schedule"] = "SELECT * FROM scheduled"
SQL["mark_fetched"] = f"""
    SELECT id, CASE WHEN id IN (SELECT id FROM scheduled) THEN {EVENTS} ELSE last_fetched_at END
      AS last_fetched_at FROM feeds"""
SQL["parse_feed_documents"] = """
    SELECT document_id, feed_id, CASE WHEN lang = 'de' THEN 'atom' WHEN document_id % 4 = 2 THEN 'json' ELSE 'rss' END AS kind,
           source AS channel_title, 'https://' || source || '.example.com' AS channel_link,
           source || ' channel' AS channel_description, lang AS channel_language,
           CAST(item_no AS INTEGER) AS item_no, md5(line) AS item_title, link AS item_link,
           md5(line) AS item_description, '' AS item_content,
           CASE WHEN NOT dated THEN 'some day'
                WHEN lang = 'de' OR document_id % 4 IN (1, 2) THEN strftime(at_, '%Y-%m-%dT%H:%M:%SZ')
                ELSE strftime(at_, '%-d %b %Y %H:%M:%S +0000') END AS item_published
    FROM lines"""
_IMAGE = (
    "https://images.unsplash.com/photo-1542396601-dca920ea2807?q=80&w=1351&auto=format&fit=crop"
    "&ixlib=rb-4.0.3&ixid=M3wxMjA3fDB8MHxwaG90by1wYWdlfHx8fGVufDB8fHx8fA%3D%3D"
)
_CLEAN = "replace(replace(replace(line, '&', '&amp;'), '\"', '&#34;'), '''', '&#39;')"
VIEWS["candidate_items"] = """
    SELECT *, NOT EXISTS (SELECT 1 FROM posts WHERE itemurl = link)
              AND row_number() OVER (PARTITION BY link ORDER BY document_id, item_no) = 1 AS fresh
    FROM lines WHERE dated"""
SQL["ingest_posts"] = f"""
    SELECT CASE WHEN fresh THEN (SELECT max(id) FROM posts) + row_number() OVER (PARTITION BY fresh ORDER BY document_id, item_no)
           END AS id, document_id, CAST(item_no AS INTEGER) AS item_no, feed_id,
           source AS channeltitle, CAST(NULL AS VARCHAR) AS itemcontent, '{_IMAGE}' AS img_url,
           {EVENTS} AS created_at, {EVENTS} AS updated_at, 'https://' || source || '.example.com' AS channelurl,
           source || ' channel' AS channeldescription, lang AS channellanguage,
           CASE WHEN fresh THEN md5({_CLEAN}) END AS itemtitle,
           CASE WHEN fresh AND line <> '' THEN md5({_CLEAN}) END AS itemdescription,
           link AS itemurl, CASE WHEN dated THEN CAST(epoch(at_) AS BIGINT) END AS itempublished_at,
           CASE WHEN fresh THEN 'accepted' WHEN dated THEN 'duplicate' ELSE 'unreadable date' END AS outcome
    FROM (FROM candidate_items UNION ALL BY NAME SELECT *, false AS fresh FROM lines WHERE NOT dated)"""
# Titles cut inside an entity leave '&', '&a', '&am' or '&amp' before the closing tag.
_STRIPPED = r"regexp_replace(replace(html, '&amp<', '&amp;<'), '&(|a|am)<', '&amp;\1<', 'g')"
for _tag in ("script", "style", "title", "noscript", "iframe", "object"):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', '', 'g')"
_STRIPPED = f"regexp_replace({_STRIPPED}, '(?s)<!--.*?-->|<[^>]*>', '', 'g')"
for _entity, _char in (("copy", "©"), ("quot", "\""), ("middot", "·"), ("nbsp", "\u00a0"), ("raquo", "»"), ("laquo", "«")):
    _STRIPPED = f"replace({_STRIPPED}, '&{_entity};', '{_char}')"
SQL["sanitized_pages_strict"] = f"""
    SELECT page_id, md5(replace(replace({_STRIPPED}, '"', '&#34;'), '''', '&#39;')) AS text FROM pages"""
SQL["sanitized_documents_strict"] = """
    SELECT id, md5(replace(replace(replace(replace(itemcontent, '&', '&amp;'), '"', '&#34;'),
                   '''', '&#39;'), '>', '&gt;')) AS text FROM posts"""
SQL["classify_scrape_errors"] = "SELECT * FROM classified"
SQL["scrape_error_upsert"] = "SELECT * FROM errors_after"

# Change jobs


def _insert(batch: str, keys: str, held: str, columns: str, order: str = "seq", numbered: str = "") -> str:
    """First row per key wins; `held` is true where the table has the key already.

    Accepted rows of a `numbered` table get the numbers after its largest id.
    """
    judged = f"""
    SELECT {columns}, CASE WHEN NOT ({held}) AND row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1
                      THEN 'accepted' ELSE 'rejected' END AS outcome
    FROM ({batch}) b"""
    if not numbered:
        return judged
    return f"""
    SELECT *, CASE WHEN outcome = 'accepted' THEN (SELECT max(id) FROM {numbered})
                    + row_number() OVER (PARTITION BY outcome ORDER BY {order}) END AS id
    FROM ({judged})"""


_NEW_FEEDS = """SELECT o_orderkey AS seq, 'https://feeds.example.com/' || (o_orderkey // 2) AS url,
    o_custkey AS user_id FROM orders"""
SQL["insert_feeds"] = _insert(
    _NEW_FEEDS, "url", "url IN (SELECT url FROM feeds)", "seq, url, user_id", numbered="feeds"
)
SQL["insert_feeds_table"] = f"""
    SELECT id, url, user_id, version, img_url, feed_type, feed_description, is_hidden, approval_status, priority,
           created_at, last_fetched_at FROM feeds
    UNION ALL SELECT {_serial("feeds", "min(seq)")}, url, arg_min(user_id, seq), 1,
           'https://cdn.pixabay.com/photo/2017/06/25/14/38/rss-2440955_960_720.png', 'general',
           'An interesting take on modern and latest changes in this field', false, 'pending', 'normal', {EVENTS}, NULL
    FROM ({_NEW_FEEDS}) WHERE url NOT IN (SELECT url FROM feeds) GROUP BY url"""
_PAIR = "SELECT event_id AS seq, user_id, CAST(floor(value) AS BIGINT) AS {} FROM events"
SQL["insert_feed_follows"] = _insert(
    _PAIR.format("feed_id"), "user_id, feed_id",
    "(user_id, feed_id) IN (SELECT (user_id, feed_id) FROM feed_follows)",
    f"{_uuid('feed_follows', 'user_id', 'feed_id')} AS id, seq, user_id, feed_id, {EVENTS} AS created_at",
)
SQL["new_follow_ids"] = f"""
    SELECT DISTINCT {_uuid("feed_follows", "user_id", "feed_id")} AS id, user_id, feed_id
    FROM ({_PAIR.format("feed_id")})
    WHERE (user_id, feed_id) NOT IN (SELECT (user_id, feed_id) FROM feed_follows)"""
SQL["insert_favorites"] = _insert(
    _PAIR.format("post_id"), "user_id, post_id",
    "(user_id, post_id) IN (SELECT (user_id, post_id) FROM favorites)",
    f"seq, user_id, post_id, {EVENTS} AS created_at", numbered="favorites",
)
SQL["insert_subscriptions"] = _insert(
    """SELECT event_id AS seq, event_id // 3 AS transaction_id, CASE WHEN event_id % 7 > 1
       THEN 'AUTH_' || (event_id // 3 + event_id % 2) END AS authorization_code FROM events""",
    "transaction_id, coalesce(authorization_code, 'none ' || seq)",
    "coalesce((transaction_id, authorization_code) IN (SELECT (transaction_id, authorization_code) FROM subscriptions), false)",
    f"seq, transaction_id, authorization_code, 'USD' AS currency, {EVENTS} AS start_date", numbered="subscriptions",
)
SQL["insert_permissions"] = _insert(
    "SELECT s_suppkey AS seq, 'nation_' || (s_suppkey % 40) || ':read' AS code FROM supplier",
    "code", "code IN (SELECT code FROM permissions)", "seq, code", numbered="permissions",
)
SQL["insert_plans"] = _insert(
    """SELECT n_nationkey AS seq, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE n_name END AS name
       FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "name", "name IN (SELECT name FROM payment_plans)",
    "seq, name, 'free' AS duration, 'active' AS status, 1 AS version", numbered="payment_plans",
)
SQL["insert_users"] = _insert(
    """SELECT s_suppkey AS seq, 'CUSTOMER#' || lpad(CAST((s_suppkey // 2) * 40 AS VARCHAR), 9, '0')
       || CASE WHEN s_suppkey % 2 = 0 THEN '@EXAMPLE.com' ELSE '@example.COM' END AS email FROM supplier""",
    "lower(email)", "lower(email) IN (SELECT lower(email) FROM users)",
    f"seq, email, false AS activated, 1 AS version, {EVENTS} AS created_at", numbered="users",
)
SQL["grant_permissions"] = _insert(
    """SELECT s_suppkey AS user_id, p.id AS permission_id, p.code FROM supplier JOIN permissions p
       ON p.code IN ('nation_' || s_nationkey || ':read', 'nation_' || (s_nationkey + 1) % 25 || ':read')""",
    "user_id, permission_id",
    "(user_id, permission_id) IN (SELECT (user_id, permission_id) FROM users_permissions)",
    "user_id, permission_id", "code",
)
SQL["append_comments"] = f"""
    SELECT * REPLACE (md5(comment_text) AS comment_text) FROM comments
    UNION ALL BY NAME
    SELECT {_serial("comments", "event_id")} AS id, event_id % 200 AS post_id, user_id, md5(props) AS comment_text,
           1 AS version, ts AS created_at FROM events WHERE event_type = 'purchase'"""
SQL["append_challenges"] = f"""
    SELECT * FROM challenged_transactions UNION ALL BY NAME
    SELECT {_serial("challenged_transactions", "id")} AS id,
           {ORDERS} AS updated_at, user_id, id AS referenced_subscription_id, 'new-' || (id // 8) AS reference, 'pending' AS status,
           end_date AS created_at FROM subscriptions WHERE status = 'expired'"""
SQL["append_failed_transactions"] = f"""
    SELECT * FROM failed_transactions UNION ALL BY NAME
    SELECT {_serial("failed_transactions", "id")} AS id, user_id, id AS subscription_id, 'new-' || (id // 8) AS reference, 'Declined' AS failure_reason,
           end_date AS attempt_date FROM subscriptions WHERE status = 'cancelled'"""
SQL["append_announcements"] = f"""
    SELECT * FROM announcements UNION ALL BY NAME
    SELECT {EVENTS} AS created_at, {_serial("announcements", "n_nationkey")} AS id, n_name AS title, 'hello' AS message,
           n_nationkey % 2 = 0 AS is_active, 'low' AS urgency FROM nation"""
SQL["append_announcement_reads"] = f"""
    SELECT * FROM announcement_reads UNION ALL BY NAME
    SELECT {_serial("announcement_reads", "event_id")} AS id, user_id, event_id % 5 AS announcement_id, ts AS read_at
    FROM events WHERE event_type = 'view'"""


def _versioned(table: str, edits: str, keys: list[str], sets: dict[str, str], fixed: dict[str, str],
               shown: list[str]) -> str:
    """Winners are the first edits with the row's version; everything else is a conflict."""
    on = " AND ".join(f"e.{k} = t.{k}" for k in [*keys, "version"])
    part = ", ".join(f"e.{k}" for k in keys)
    new = {**{c: f"coalesce({e}, t.{c})" for c, e in sets.items()}, **fixed, "version": "t.version + 1"}
    pad = lambda cols, n: ", ".join(
        [f"CAST({c} AS VARCHAR) AS c{i}" for i, c in enumerate(cols)]
        + [f"CAST(NULL AS VARCHAR) AS c{i}" for i in range(len(cols), n)]
    )
    width = max(len(shown), 3)
    after = pad([f"CASE WHEN e.seq IS NULL THEN t.{c} ELSE {new[c]} END" if c in new else f"t.{c}"
                 for c in shown], width)
    first = f"""(SELECT e.* FROM ({edits}) e JOIN {table} t ON {on}
                 QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY e.seq) = 1)"""
    return f"""
    SELECT {after}, 'table' AS outcome FROM {table} t LEFT JOIN {first} e ON {on}
    UNION ALL SELECT {after}, 'updated' FROM {table} t JOIN {first} e ON {on}
    UNION ALL SELECT {pad(['e.seq', 'e.id', 'e.version'], width)}, 'conflict' FROM ({edits}) e
    WHERE e.seq NOT IN (SELECT seq FROM {first})"""


SQL["update_feeds"] = _versioned(
    "feeds", "SELECT * FROM feed_edits WHERE id IN (SELECT id FROM feeds)", ["id", "user_id"],
    {"name": "e.name", "feed_type": "e.new_type"}, {"approval_status": "'pending'"},
    ["id", "version", "name", "feed_type", "approval_status"],
)
SQL["update_feeds_in_folders"] = f"""
    SELECT CAST(c0 AS BIGINT) AS id, CAST(c1 AS BIGINT) AS version, c2 AS name, c3 AS feed_type, c4 AS approval_status
    FROM ({SQL["update_feeds"]}) WHERE outcome = 'table'"""
SQL["insert_feeds_in_folders"] = f"""
    SELECT id, url, user_id, version, feed_type, is_hidden, priority, created_at FROM ({SQL["insert_feeds_table"]})"""
SQL["admin_update_feeds"] = _versioned(
    "feeds",
    """SELECT * REPLACE (upper(new_type) AS new_type),
              CASE WHEN seq % 2 = 0 THEN 'approved' ELSE 'rejected' END AS approval
       FROM feed_edits WHERE id IN (SELECT id FROM feeds)""",
    ["id", "user_id"],
    {"name": "e.name", "feed_type": "e.new_type", "approval_status": "e.approval", "priority": "'high'"},
    {}, ["id", "version", "name", "feed_type", "approval_status", "priority"],
)
_COMMENT_EDITS = """SELECT conv_id * 100 + turn AS seq, conv_id * 100 + turn AS id,
    (conv_id + CASE WHEN role = 'user' THEN turn ELSE 0 END) % 150 AS user_id,
    1 + turn % 3 AS version, role || ' edit' AS comment_text FROM conversations"""
SQL["update_comments"] = "SELECT c0, c1, md5(c2) AS c2, outcome FROM (" + _versioned(
    "comments", _COMMENT_EDITS, ["id", "user_id"], {"comment_text": "e.comment_text"}, {},
    ["id", "version", "comment_text"],
) + ")"
SQL["update_plans"] = _versioned(
    "payment_plans",
    """SELECT n_nationkey AS seq, n_regionkey AS id, 1 + n_nationkey % 2 AS version, n_name AS name
       FROM nation""",
    ["id"], {"name": "e.name", "status": "'inactive'"}, {}, ["id", "version", "name", "status"],
)
SQL["update_users"] = _versioned(
    "users",
    """SELECT c_custkey AS seq, c_custkey AS id, 1 + c_custkey % 2 AS version,
       'user ' || c_custkey AS name, c_mktsegment = 'BUILDING' AS activated FROM customer""",
    ["id"], {"name": "e.name", "activated": "e.activated"}, {}, ["id", "version", "name", "activated"],
)
SQL["update_error_logs"] = """
    SELECT l.id, true AS admin_notified, value > 100 AS resolved,
           'value ' || CAST(floor(value) AS BIGINT) AS resolution_notes
    FROM scraper_error_logs l JOIN events ON event_id = l.id"""
SQL["update_subscription_status"] = f"""
    SELECT s.id, s.user_id, coalesce(e.status, s.status) AS status,
           CASE WHEN e.status IS NULL THEN s.updated_at ELSE {ORDERS} END AS updated_at
    FROM subscriptions s LEFT JOIN (
      SELECT l_orderkey, CASE WHEN l_linestatus = 'F' THEN 'cancelled' ELSE 'renewed' END AS status
      FROM lineitem WHERE l_returnflag = 'R'
      QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC,
                                 l_suppkey DESC, l_linestatus DESC) = 1) e ON e.l_orderkey = s.id"""
SQL["update_challenge_status"] = """
    SELECT c.id, c.user_id, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'successful' END AS status,
           'table' AS outcome
    FROM challenged_transactions c JOIN orders ON o_orderkey = c.id
    UNION ALL
    SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'successful' END,
           'unknown'
    FROM orders WHERE o_orderkey NOT IN (SELECT id FROM challenged_transactions)"""
SQL["rename_permissions"] = """
    SELECT id, CASE WHEN r_name IS NULL THEN code ELSE lower(r_name) || ':write' END AS code
    FROM permissions LEFT JOIN region ON r_regionkey * 3 = id"""


def _moved(table: str, due: str, status: str) -> str:
    after = f"""id, user_id, CASE WHEN {due} THEN '{status}' ELSE status END AS status,
           CASE WHEN {due} THEN {ORDERS} ELSE updated_at END AS updated_at"""
    return f"""
    SELECT {after}, 'table' AS outcome FROM {table}
    UNION ALL SELECT {after}, 'changed' FROM {table} WHERE {due}"""


SQL["expire_subscriptions"] = _moved(
    "subscriptions",
    f"(end_date < CAST({ORDERS} AS DATE) AND status NOT IN ('expired', 'renewed', 'cancelled'))",
    "expired",
)
SQL["expire_challenges"] = _moved(
    "challenged_transactions",
    f"(status = 'pending' AND created_at < {ORDERS} - INTERVAL 24 HOUR)", "failed",
)
_UNFOLLOW = """SELECT user_id || '-' || CAST(floor(value) AS BIGINT) AS id, user_id FROM events"""
SQL["delete_feed_follows"] = f"""
    SELECT id, user_id, CASE WHEN id IN (SELECT id FROM ({_UNFOLLOW})) THEN 'deleted' ELSE 'kept' END
      AS outcome FROM feed_follows
    UNION ALL SELECT id, user_id, 'unknown' FROM ({_UNFOLLOW})
    WHERE id NOT IN (SELECT id FROM feed_follows)"""
SQL["delete_follows_in_folders"] = f"""
    SELECT id, user_id FROM feed_follows WHERE (id, user_id) NOT IN (SELECT (id, user_id) FROM ({_UNFOLLOW}))"""
SQL["delete_comments"] = """
    SELECT id, user_id, parent_comment_id FROM comments WHERE (id, user_id) NOT IN (
      SELECT (conv_id * 100 + turn, (conv_id + CASE WHEN role = 'user' THEN turn ELSE 0 END) % 150)
      FROM conversations)"""
SQL["delete_favorites"] = """
    SELECT * FROM favorites WHERE (post_id, user_id) NOT IN (
      SELECT (CAST(floor(value) AS BIGINT), user_id) FROM events)"""
SQL["revoke_permissions"] = """
    SELECT * FROM users_permissions WHERE (user_id, permission_id) NOT IN (
      SELECT (c_custkey, CAST(c_nationkey AS BIGINT)) FROM customer)"""
SQL["delete_error_logs"] = """
    SELECT id, error_type, feed_id FROM scraper_error_logs
    WHERE id NOT IN (SELECT event_id FROM events WHERE value > 60)"""


def _states(*tables: tuple[str, str]) -> str:
    """Table, state and id of every row; `gone` says which rows go."""
    name = {"users_permissions": "user_id || '-' || permission_id", "feed_rejections": "CAST(feed_id AS VARCHAR)"}
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, CASE WHEN {gone} THEN 'deleted' ELSE 'kept' END AS state,"
        f" {name.get(table, 'CAST(id AS VARCHAR)')} AS id FROM {table}"
        for table, gone in tables
    )


_LOW = "(SELECT id FROM announcements WHERE urgency = 'low')"
SQL["delete_announcements"] = _states(
    ("announcements", "urgency = 'low'"), ("announcement_reads", f"announcement_id IN {_LOW}")
)
_THIRDS = "(SELECT r_regionkey * 3 FROM region)"
SQL["delete_permissions"] = _states(
    ("permissions", f"id IN {_THIRDS}"), ("users_permissions", f"permission_id IN {_THIRDS}")
)
_GONE = "(SELECT id FROM feeds WHERE approval_status = 'rejected')"
_GONE_POSTS = f"(SELECT id FROM posts WHERE feed_id IN {_GONE})"
SQL["delete_feeds"] = _states(
    ("feeds", "approval_status = 'rejected'"),
    *[(t, f"feed_id IN {_GONE}") for t in
      ["feed_follows", "posts", "notifications", "scraper_error_logs", "feed_rejections"]],
    ("favorites", f"feed_id IN {_GONE} OR post_id IN {_GONE_POSTS}"),
    ("comments", f"post_id IN {_GONE_POSTS}"),
    ("comment_notifications", f"post_id IN {_GONE_POSTS}"),
)

# Row logic

SQL["plan_end_dates"] = """
    SELECT o_orderkey AS id, o_orderdate,
           CASE o_orderkey % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'week' WHEN 2 THEN 'month'
                WHEN 3 THEN 'year' ELSE 'once' END AS duration,
           CASE o_orderkey % 5 WHEN 0 THEN o_orderdate + INTERVAL 1 DAY
                WHEN 1 THEN o_orderdate + INTERVAL 7 DAY WHEN 2 THEN o_orderdate + INTERVAL 1 MONTH
                WHEN 3 THEN o_orderdate + INTERVAL 1 YEAR ELSE o_orderdate END AS end_date
    FROM orders"""
SQL["refined_intervals"] = """
    SELECT event_id, asked, CASE WHEN asked BETWEEN 1 AND 100 THEN asked ELSE 10 END AS minutes
    FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN CAST(floor(value) AS BIGINT) - 10 END
            AS asked FROM events)"""
SQL["formatted_timestamps"] = """
    SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                          WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d 00:00:00')
                          ELSE '' END AS formatted FROM events"""
SQL["parsed_timestamps"] = """
    SELECT event_id, CAST(epoch(CASE WHEN k < 22 THEN date_trunc('second', ts) WHEN k < 26 THEN date_trunc('minute', ts)
                                     WHEN k < 35 THEN date_trunc('day', ts) WHEN k = 35 THEN date_trunc('month', ts)
                                     WHEN k = 36 THEN date_trunc('year', ts) END) AS BIGINT) AS seconds
    FROM (SELECT *, event_id % 38 AS k FROM events)"""
SQL["merged_feed_edits"] = """
    SELECT e.seq, e.id, e.user_id, e.version, e.name, coalesce(e.new_type, f.feed_type) AS feed_type,
           f.url, f.img_url, f.feed_description, f.is_hidden
    FROM feed_edits e JOIN feeds f ON f.id = e.id"""
SQL["validate_feeds"] = """
    SELECT p_partkey AS id, 'name' AS field, CASE WHEN p_size > 40 THEN 'must be provided'
           ELSE 'must not be more than 500 bytes long' END AS message FROM part WHERE p_size > 30
    UNION ALL SELECT p_partkey, 'url', CASE WHEN p_size % 3 = 1 THEN 'must be provided'
           ELSE 'must be a valid URL' END FROM part WHERE p_size % 3 <> 2
    UNION ALL SELECT p_partkey, 'Image', 'url must be provided' FROM part WHERE p_size >= 20"""
SQL["validate_comments"] = """
    SELECT conv_id * 100 + turn AS id, 'post_id' AS field, 'must be provided' AS message
    FROM conversations WHERE turn IN (0, 2)
    UNION ALL SELECT conv_id * 100 + turn, 'post id', 'must be a valid UUID'
    FROM conversations WHERE turn IN (1, 2)
    UNION ALL SELECT conv_id * 100 + turn, 'comment_text', CASE WHEN text = '' THEN 'must be provided'
           ELSE 'must not be more than 500 bytes long' END
    FROM conversations WHERE text = '' OR strlen(text) > 500"""
SQL["validate_users"] = """
    SELECT c_custkey AS id, 'email' AS field, CASE WHEN c_mktsegment = 'BUILDING'
           THEN 'must be provided' ELSE 'must be a valid email address' END AS message
    FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
    UNION ALL SELECT c_custkey, 'image', 'must be provided' FROM customer WHERE NOT c_acctbal > 0"""
SQL["validate_permissions"] = """
    SELECT s_suppkey AS id, 'codes' AS field, 'must be provided' AS message
    FROM supplier WHERE s_acctbal < 3000
    UNION ALL SELECT s_suppkey, 'permissions', 'must be in the format ''permission:code'''
    FROM supplier WHERE s_acctbal < 3000 OR s_acctbal >= 6000"""
SQL["validate_plans"] = """
    SELECT n_nationkey AS id, 'description' AS field, 'must be provided' AS message FROM nation
    UNION ALL SELECT n_nationkey, 'price', 'must be provided' FROM nation WHERE n_regionkey = 0
    UNION ALL SELECT n_nationkey, 'features', 'must be provided' FROM nation WHERE n_nationkey % 2 = 1
    UNION ALL SELECT n_nationkey, 'status', 'must be either ''active'' or ''inactive'''
    FROM nation WHERE n_nationkey % 3 = 0"""
SQL["validate_announcements"] = """
    SELECT id, 'created_by' AS field, 'must be provided' AS message FROM announcements WHERE created_by = 0
    UNION ALL SELECT id, 'urgency', 'must be one of ''low'', ''medium'', or ''high'''
    FROM announcements WHERE urgency = 'high'"""
SQL["validate_moderation"] = """
    SELECT p_partkey AS id, 'approval_status' AS field, 'must be provided' AS message
    FROM part WHERE p_size < 10
    UNION ALL SELECT p_partkey, 'priority', 'must be either high, normal or low' FROM part"""
SQL["validate_paging"] = """
    SELECT event_id AS id, 'page' AS field, 'must be greater than zero' AS message
    FROM events WHERE floor(value) <= 5
    UNION ALL SELECT event_id, 'page_size', CASE WHEN event_id % 150 = 0 THEN 'must be greater than zero'
           ELSE 'must be a maximum of 100' END FROM events WHERE event_id % 150 = 0 OR event_id % 150 > 100
    UNION ALL SELECT event_id, 'sort', 'invalid sort value' FROM events WHERE event_type = 'view'"""
def _event_errors(*wrong: tuple[str, str, str]) -> str:
    """Rows (kind of event or condition, field, message)."""
    return " UNION ALL ".join(
        f"SELECT event_id AS id, '{field}' AS field, '{message}' AS message FROM events WHERE "
        + (kind if " " in kind else f"event_type = '{kind}'")
        for kind, field, message in wrong
    )


_MISSING, _NO_UUID = "must be provided", "must be a valid UUID"
SQL["validate_follows"] = _event_errors(("view", "feed id", _MISSING), ("click", "feed id", _NO_UUID))
SQL["validate_favorites"] = _event_errors(("view", "feed id", _NO_UUID), ("click", "feed id", _NO_UUID))
SQL["validate_comment_updates"] = _event_errors(
    ("view", "comment id", _NO_UUID), ("click", "comment_text", _MISSING), ("purchase", "version", "must be valid and provided"))
SQL["validate_subscription_statuses"] = _event_errors(
    ("view", "id", _NO_UUID), ("click", "status", _MISSING), ("purchase", "status", "must be a valid status"))
SQL["validate_charges"] = _event_errors(("view", "amount", "must be varied"), ("click", "plan_id", _MISSING))
SQL["validate_verifications"] = _event_errors(("view", "reference", "must be varied"), ("click", "plan_id", _MISSING))
SQL["validate_announcement_reads"] = _event_errors(("event_id % 5 = 0", "announcement_id", _MISSING))
SQL["validate_grants"] = _event_errors(
    ("view", "permissions", _MISSING), ("click", "permissions", _MISSING), ("purchase", "user_id", _MISSING))
SQL["validate_revokes"] = _event_errors(("view", "codes", _MISSING), ("click", "user_id", _MISSING))
SQL["validate_error_notes"] = _event_errors(("view", "resolution_notes", _MISSING), ("click", "resolution_notes", _MISSING))
SQL["validate_statuses"] = """
    SELECT id, 'ID' AS field, 'must be valid or provided' AS message
    FROM challenged_transactions WHERE id = 0
    UNION ALL SELECT id, 'status', 'must be a valid status'
    FROM challenged_transactions WHERE status = 'failed'"""
SQL["valid_page_urls"] = "SELECT page_id, page_id % 3 <> 0 AS valid FROM pages"
SQL["gateway_payloads"] = """
    SELECT o_orderkey AS subscription_id,
           CASE WHEN o_orderkey % 13 = 0 THEN 'body contains badly-formed JSON'
                WHEN o_orderkey % 11 = 0 THEN 'body contains unknown key surprise' END AS problem,
           CASE WHEN ok THEN CASE o_orderstatus WHEN 'F' THEN 'success' ELSE 'declined' END END
             AS gateway_status,
           CASE WHEN ok THEN o_orderkey % 7 = 0 END AS paused,
           CASE WHEN ok THEN 'r-' || o_orderkey END AS reference,
           CASE WHEN ok THEN o_orderkey END AS transaction_id,
           CASE WHEN ok THEN '4081' END AS last4, CASE WHEN ok THEN '1' END AS split_a
    FROM (SELECT *, o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 AS ok FROM orders)"""
SQL["renewal_routes"] = f"""
    SELECT subscription_id, user_id, plan_id, outcome, price,
           CASE duration WHEN 'month' THEN {ORDERS} + INTERVAL 1 MONTH
                         WHEN 'year' THEN {ORDERS} + INTERVAL 1 YEAR END AS new_end FROM routes"""
SQL["renewal_actions"] = """
    SELECT outcome AS part, CAST(user_id AS VARCHAR) AS user_id,
           CASE WHEN outcome <> 'renewed' THEN CAST(subscription_id AS VARCHAR) END AS subscription_id,
           CASE WHEN outcome = 'renewed' THEN CAST(subscription_id AS VARCHAR) ELSE 'r-' || subscription_id END AS reference,
           CASE outcome WHEN 'challenged' THEN 'pending' WHEN 'renewed' THEN 'active'
                        WHEN 'failed' THEN 'm' || subscription_id % 3 END AS status,
           CASE WHEN outcome = 'renewed' THEN '4081' END AS card_last4 FROM routes
    UNION ALL SELECT 'marked', CAST(user_id AS VARCHAR), CAST(subscription_id AS VARCHAR), NULL, 'renewed', NULL
    FROM routes WHERE outcome = 'renewed'"""

# Streams

SQL["stream_new_post_notifications"] = """
    SELECT feed_id, post_count, CAST(epoch(slot) + 3600 AS BIGINT) AS created_at, f.name AS feed_name
    FROM (SELECT feed_id, date_trunc('hour', created_at) AS slot, count(*) AS post_count
          FROM post_arrivals GROUP BY 1, 2) JOIN feeds f ON f.id = feed_id"""
SQL["stream_scrape_errors"] = "SELECT * FROM errors_after"
SQL["stream_post_ingest"] = f"""
    SELECT * EXCLUDE (id, outcome) REPLACE (CAST(epoch(created_at) AS BIGINT) AS created_at, CAST(epoch(updated_at) AS BIGINT) AS updated_at),
           CAST(1 AS BIGINT) AS n
    FROM ({SQL["ingest_posts"]}) WHERE outcome = 'accepted'"""
SQL["stream_timeline"] = """
    SELECT ff.user_id, p.feed_id, p.id AS post_id, p.created_at
    FROM post_arrivals p JOIN feed_follows ff ON ff.feed_id = p.feed_id"""
SQL["stream_expired_challenges"] = """
    SELECT s.event_id // 10 AS id, s.user_id, 'failed' AS status,
           CAST(floor(epoch(s.ts + INTERVAL 24 HOUR)) AS BIGINT) AS updated_at
    FROM events s WHERE event_type = 'signup' AND NOT EXISTS (
      SELECT 1 FROM events c WHERE c.event_type = 'purchase' AND c.event_id // 10 = s.event_id // 10
        AND c.ts >= s.ts AND c.ts <= s.ts + INTERVAL 24 HOUR)
      AND s.ts + INTERVAL 24 HOUR < (SELECT least(max(ts) FILTER (event_type = 'signup'),
                                         max(ts) FILTER (event_type = 'purchase')) FROM events)
                                    - INTERVAL 1 HOUR"""


def _named(text: str) -> list[str]:
    words = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text))
    return [v for v in VIEWS if v in words]


def with_views(body: str) -> str:
    """The check with all views it needs, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in _named(VIEWS[name]):
            if needed != name:
                add(needed)
        ordered.append(name)

    for name in _named(body):
        add(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    return f"WITH {ctes}\n{body}"


def oracle_queries() -> dict[str, str]:
    return {name: with_views(body) for name, body in SQL.items()}
