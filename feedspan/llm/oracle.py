"""SQL for the operators that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from feedspan.llm.quality_rules import ERRORS, FIRST, GROWTH, SIGNALS

SQL: dict[str, str] = {}

#: Least id reachable over the links of a table (a, b), both directions given.
_CLASSES = """
    reach(id, least) AS (
        SELECT id, id FROM nodes
        UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.id WHERE r.least < l.b
    ),
    classes AS (SELECT id, min(least) AS component_id FROM reach GROUP BY id)"""

SQL["op3_minhash_near_dedup"] = f"""
    WITH RECURSIVE
    plain AS (
        SELECT doc_id AS id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g')) AS words
        FROM documents
    ),
    listed AS (SELECT id, string_split(words, ' ') AS w FROM plain WHERE words <> ''),
    runs AS (
        SELECT id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
        FROM listed
    ),
    bags AS (SELECT id, s, count(*) AS n FROM runs GROUP BY id, s),
    sizes AS (SELECT id, sum(n) AS n FROM bags GROUP BY id),
    shared AS (
        SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS n FROM bags x JOIN bags y ON x.s = y.s AND x.id <> y.id
        GROUP BY x.id, y.id
    ),
    links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b
        WHERE shared.n >= 0.8 * (x.n + y.n - shared.n)
    ),
    nodes AS (SELECT id FROM plain),
    {_CLASSES}
    SELECT id AS doc_id, component_id, id = component_id AS kept FROM classes"""

SQL["op4_embedding_near_dedup"] = f"""
    WITH RECURSIVE
    usable AS (
        SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    normed AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM usable),
    links AS (
        SELECT x.id AS a, y.id AS b FROM normed x JOIN normed y ON x.label = y.label AND x.id <> y.id AND len(x.v) = len(y.v)
        WHERE list_dot_product(x.v, y.v) / (x.size * y.size) >= 0.98
    ),
    nodes AS (SELECT vec_id AS id FROM embeddings),
    {_CLASSES}
    SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = c.id) AS n_links, component_id, id = component_id AS kept
    FROM classes c"""


def _quality_rules(min_rows: int = 100) -> str:
    ratio = lambda top, below: f"{top} / CAST(greatest({below}, 1) AS DOUBLE)"
    cells = " UNION ALL ".join(
        f"SELECT lang, source, '{k}' AS signal, {ratio(top, below)} AS x FROM counts WHERE NOT base_failed"
        for k, (top, below, *_) in SIGNALS.items()
    )
    rule = "CASE WHEN base_failed THEN 'base'"
    for k, (top, below, _, _, width, both) in SIGNALS.items():
        x, spread = ratio(top, below), f"(f_{k}.upper_q - f_{k}.lower_q)"
        error = f"{ERRORS} * sqrt(CAST({top} AS DOUBLE)) / CAST(greatest({below}, 1) AS DOUBLE)"
        rule += f" WHEN {x} > f_{k}.upper_q + {width} * {spread} + {error} THEN '{k}_high'"
        if both:
            rule += f" WHEN {x} < f_{k}.lower_q - {width} * {spread} - {error} THEN '{k}_low'"
    percent = lambda i: "CASE signal " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in SIGNALS.items()) + " END"
    joins = " ".join(
        f"LEFT JOIN fences f_{k} ON f_{k}.signal = '{k}' AND f_{k}.lang IS NOT DISTINCT FROM c.lang"
        f" AND f_{k}.source IS NOT DISTINCT FROM c.source"
        for k in SIGNALS
    )
    value = lambda b: f"CASE WHEN {b} > 0 THEN {FIRST} * pow({GROWTH}, {b}) ELSE 0 END"
    return f"""
    WITH listed AS (
        SELECT doc_id, lang, source, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ),
    windows AS (
        SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g
        FROM listed WHERE len(w) > 2
    ),
    again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
    covered AS (
        SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
    ),
    split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM listed),
    lined AS (
        SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM split
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
    ),
    counts AS (
        SELECT doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
               length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(l.n, 0) AS n_lines,
               coalesce(l.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
               len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
        FROM listed LEFT JOIN covered r USING (doc_id) LEFT JOIN lined l USING (doc_id)
    ),
    bins AS (
        SELECT lang, source, signal, CASE WHEN x > {FIRST} THEN CAST(ceil(ln(x / {FIRST}) / ln({GROWTH})) AS INT) ELSE 0 END AS b
        FROM ({cells})
    ),
    sketches AS (
        SELECT 0 AS level, lang, source, signal, b, count(*) AS n FROM bins GROUP BY ALL
        UNION ALL SELECT 1, lang, NULL, signal, b, count(*) FROM bins GROUP BY ALL
        UNION ALL SELECT 2, NULL, NULL, signal, b, count(*) FROM bins GROUP BY ALL
    ),
    ranked AS (
        SELECT *, sum(n) OVER (PARTITION BY level, lang, source, signal ORDER BY b) AS upto,
               sum(n) OVER (PARTITION BY level, lang, source, signal) AS total FROM sketches
    ),
    quartiles AS (
        SELECT level, lang, source, signal, max(total) AS total,
               min(b) FILTER (upto * 100 >= total * {percent(2)}) AS b1, min(b) FILTER (upto * 100 >= total * {percent(3)}) AS b3
        FROM ranked GROUP BY ALL
    ),
    fences AS (
        SELECT g.lang, g.source, q2.signal, {value("coalesce(q0.b1, q1.b1, q2.b1)")} AS lower_q, {value("coalesce(q0.b3, q1.b3, q2.b3)")} AS upper_q
        FROM (SELECT DISTINCT lang, source FROM counts) g
        JOIN quartiles q2 ON q2.level = 2
        LEFT JOIN quartiles q1 ON q1.level = 1 AND q1.lang IS NOT DISTINCT FROM g.lang AND q1.signal = q2.signal AND q1.total >= {min_rows}
        LEFT JOIN quartiles q0 ON q0.level = 0 AND q0.lang IS NOT DISTINCT FROM g.lang AND q0.source IS NOT DISTINCT FROM g.source
             AND q0.signal = q2.signal AND q0.total >= {min_rows}
    )
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
           CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
           CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, {rule} END IS NULL AS kept, {rule} END AS rule
    FROM counts c {joins}"""


SQL["op10_quality_rules"] = _quality_rules()

SQL["op11_fill_in_middle"] = """
    WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
    drawn AS (
        SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
               CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM hashed
    ),
    cuts AS (
        SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
               CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM drawn
    ),
    parts AS (SELECT *, t[1:lo] AS pre, substr(t, lo + 1, hi - lo) AS mid, substr(t, hi + 1) AS suf FROM cuts)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM parts"""
