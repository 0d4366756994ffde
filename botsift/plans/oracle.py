"""DuckDB SQL twins of the registered queries.

Each string runs on DuckDB with the test tables registered as views.  The
adapter of ``botsift.sources.fixtures`` is restated here as CTEs, written
independently in SQL, so every Spark query is checked against a separate
formulation of the same definition.

Dialect notes: epoch milliseconds are ``epoch_us(ts) // 1000`` (DuckDB's
``epoch_ms`` rounds, Spark truncates); every ratio is computed in DOUBLE from
integer sums; decimal literals are cast to DOUBLE.
"""

from __future__ import annotations

import math

USERS = """
users AS (
  SELECT c.c_custkey AS user_id,
         c.c_name AS screen_name,
         coalesce(f.n, 0) AS followers_count,
         CAST(c.c_nationkey AS BIGINT) AS friends_count,
         (c.c_mktsegment = 'BUILDING' AND c.c_custkey % 5 = 0) AS is_protected,
         (c.c_acctbal > 9000) AS is_verified,
         CASE WHEN CAST(c.c_nationkey AS BIGINT) > coalesce(f.n, 0) THEN 'bot' ELSE 'human' END AS label
  FROM customer c
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) f
         ON f.o_custkey = c.c_custkey
)"""

STATUSES = """
statuses AS (
  SELECT event_id AS status_id,
         user_id,
         epoch_us(ts) // 1000 AS created_ms,
         event_type AS source,
         CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS n_urls,
         greatest(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 3, 0), 0) AS n_hashtags,
         greatest(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 2, 0), 0) AS n_mentions
  FROM events
)"""

OPEN_TIMELINE = """
open_posts AS (
  SELECT s.* FROM statuses s
  WHERE s.user_id NOT IN (SELECT user_id FROM users WHERE is_protected)
),
tl AS (
  SELECT *, row_number() OVER (PARTITION BY user_id
                               ORDER BY created_ms DESC NULLS LAST, status_id DESC) AS rk
  FROM open_posts
)"""


def _features_sql(source: str, bucket_expr: str) -> str:
    """Feature rows for every user from the posts in CTE ``source``."""
    return f"""
summ AS (
  SELECT user_id, count(*) AS n_statuses,
         CAST(sum(CASE WHEN n_urls > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS urlRatio,
         CAST(sum(n_hashtags) AS DOUBLE) / count(*) AS hashtagRatio,
         CAST(sum(n_mentions) AS DOUBLE) / count(*) AS mentionRatio,
         count(created_ms) AS n_ms, min(created_ms) AS lo, max(created_ms) AS hi
  FROM {source} GROUP BY user_id
),
bk AS (
  SELECT user_id, {bucket_expr} AS bucket, count(*) AS n
  FROM {source} WHERE created_ms IS NOT NULL GROUP BY ALL
),
rates AS (
  SELECT user_id, CAST(sum(n) AS DOUBLE) / count(*) AS tweetRate, max(n) AS maxTweetRate
  FROM bk GROUP BY user_id
),
dc AS (
  SELECT user_id, source, count(*) AS n FROM {source}
  WHERE source IS NOT NULL AND source <> '' GROUP BY user_id, source
),
md AS (
  SELECT user_id, count(*) AS uniqueDevices, max(n) AS mainDeviceCount,
         max(CASE WHEN rn = 1 THEN source END) AS mainDevice
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, source ASC) AS rn FROM dc) x
  GROUP BY user_id
),
feat AS (
  SELECT u.user_id AS id, u.label,
         CASE WHEN u.is_protected THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS isProtected,
         CASE WHEN u.is_verified THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS isVerified,
         CASE WHEN s.n_ms >= 2 THEN CAST(s.hi - s.lo AS DOUBLE) / (s.n_ms - 1) ELSE CAST(-1 AS DOUBLE) END AS meanIA,
         coalesce(r.tweetRate, CAST(-1 AS DOUBLE)) AS tweetRate,
         CAST(coalesce(r.maxTweetRate, 0) AS BIGINT) AS maxTweetRate,
         CAST(length(u.screen_name) AS BIGINT) AS screenNameLength,
         (CAST(u.followers_count AS DOUBLE) + 1) / ((CAST(u.followers_count AS DOUBLE) + 1) + CAST(u.friends_count AS DOUBLE)) AS followerRatio,
         coalesce(s.urlRatio, CAST(-1 AS DOUBLE)) AS urlRatio,
         coalesce(s.hashtagRatio, CAST(-1 AS DOUBLE)) AS hashtagRatio,
         coalesce(s.mentionRatio, CAST(-1 AS DOUBLE)) AS mentionRatio,
         CAST(coalesce(m.uniqueDevices, 0) AS BIGINT) AS uniqueDevices,
         CAST(CASE WHEN s.n_statuses IS NULL THEN 0
                   WHEN m.mainDeviceCount IS NULL THEN -1
                   ELSE m.mainDeviceCount END AS BIGINT) AS mainDeviceCount,
         coalesce(m.mainDevice, 'NA') AS mainDevice
  FROM users u
  LEFT JOIN summ s ON s.user_id = u.user_id
  LEFT JOIN rates r ON r.user_id = u.user_id
  LEFT JOIN md m ON m.user_id = u.user_id
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


USER_FEATURES = with_(USERS, STATUSES, OPEN_TIMELINE, _features_sql("tl", "created_ms")) + "SELECT * FROM feat"

SQL: dict[str, str] = {
    "user_features": USER_FEATURES,
}

DAY = "floor(created_ms / 86400000)"
_US = with_(USERS, STATUSES)

SQL.update({
    "user_features_daily": with_(USERS, STATUSES, OPEN_TIMELINE, _features_sql("tl", DAY)) + "SELECT * FROM feat",
    "profile_features": _US + """
SELECT user_id AS id, label,
       CASE WHEN is_protected THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS isProtected,
       CASE WHEN is_verified THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS isVerified,
       CAST(length(screen_name) AS BIGINT) AS screenNameLength,
       (CAST(followers_count AS DOUBLE) + 1) / ((CAST(followers_count AS DOUBLE) + 1) + CAST(friends_count AS DOUBLE)) AS followerRatio
FROM users""",
    "status_entity_counts": _US + """
SELECT status_id, user_id, CAST(n_urls AS BIGINT) AS n_urls, CAST(n_hashtags AS BIGINT) AS n_hashtags,
       CAST(n_mentions AS BIGINT) AS n_mentions, n_urls > 0 AS has_url
FROM statuses""",
    "status_ratios": _US + """
SELECT user_id, count(*) AS n_statuses,
       CAST(sum(CASE WHEN n_urls > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS urlRatio,
       CAST(sum(n_hashtags) AS DOUBLE) / count(*) AS hashtagRatio,
       CAST(sum(n_mentions) AS DOUBLE) / count(*) AS mentionRatio
FROM statuses GROUP BY user_id""",
    "device_counts": _US + """
SELECT user_id, source, count(*) AS n FROM statuses
WHERE source IS NOT NULL AND source <> '' GROUP BY user_id, source""",
    "main_device": _US + """,
dc AS (SELECT user_id, source, count(*) AS n FROM statuses
       WHERE source IS NOT NULL AND source <> '' GROUP BY user_id, source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, source) AS rn FROM dc),
md AS (SELECT user_id, count(*) AS uniqueDevices, max(n) AS mainDeviceCount,
              max(CASE WHEN rn = 1 THEN source END) AS mainDevice FROM ranked GROUP BY user_id),
cnt AS (SELECT user_id, count(*) AS n FROM statuses GROUP BY user_id)
SELECT u.user_id AS id,
       CAST(coalesce(md.uniqueDevices, 0) AS BIGINT) AS uniqueDevices,
       coalesce(md.mainDevice, 'NA') AS mainDevice,
       CAST(CASE WHEN cnt.n IS NULL THEN 0 WHEN md.mainDeviceCount IS NULL THEN -1
                 ELSE md.mainDeviceCount END AS BIGINT) AS mainDeviceCount
FROM users u LEFT JOIN cnt ON cnt.user_id = u.user_id LEFT JOIN md ON md.user_id = u.user_id""",
    "tweet_buckets": _US + """
SELECT user_id, created_ms AS bucket, count(*) AS n FROM statuses
WHERE created_ms IS NOT NULL GROUP BY user_id, created_ms""",
    "tweet_rate_exact": _US + """,
bk AS (SELECT user_id, created_ms AS bucket, count(*) AS n FROM statuses
       WHERE created_ms IS NOT NULL GROUP BY user_id, created_ms)
SELECT user_id, CAST(sum(n) AS DOUBLE) / count(*) AS tweetRate, max(n) AS maxTweetRate
FROM bk GROUP BY user_id""",
    "tweet_rate_daily": _US + f""",
bk AS (SELECT user_id, {DAY} AS bucket, count(*) AS n FROM statuses
       WHERE created_ms IS NOT NULL GROUP BY ALL)
SELECT user_id, CAST(sum(n) AS DOUBLE) / count(*) AS tweetRate, max(n) AS maxTweetRate
FROM bk GROUP BY user_id""",
    "mean_interarrival": _US + """
SELECT user_id,
       CASE WHEN count(created_ms) >= 2
            THEN CAST(max(created_ms) - min(created_ms) AS DOUBLE) / (count(created_ms) - 1)
            ELSE CAST(-1 AS DOUBLE) END AS meanIA
FROM statuses GROUP BY user_id""",
    "timeline_gate": _US + """
SELECT status_id, user_id FROM statuses
WHERE user_id NOT IN (SELECT user_id FROM users WHERE is_protected)""",
    "timeline_topk": with_(USERS, STATUSES, OPEN_TIMELINE) + """
SELECT user_id, status_id, CAST(rk AS INTEGER) AS rank FROM tl WHERE rk <= 50""",
    "timeline_latest_5000": with_(USERS, STATUSES) + """
SELECT user_id, status_id, CAST(rk AS INTEGER) AS rank FROM (
  SELECT user_id, status_id, row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC NULLS LAST, status_id DESC) AS rk
  FROM (SELECT CASE WHEN status_id % 3 = 0 THEN 1 ELSE user_id END AS user_id, status_id,
               CASE WHEN status_id % 11 <> 0 THEN created_ms END AS created_ms FROM statuses) s
  WHERE user_id NOT IN (SELECT user_id FROM users WHERE is_protected)) x
WHERE rk <= 5000""",
    "interarrivals": with_(USERS, STATUSES, OPEN_TIMELINE) + """
SELECT * FROM (
  SELECT user_id, status_id, created_ms,
         created_ms - lead(created_ms) OVER (PARTITION BY user_id ORDER BY created_ms DESC, status_id DESC) AS gap_ms
  FROM tl WHERE created_ms IS NOT NULL) g
WHERE gap_ms IS NOT NULL""",
    "statuses_by_user": with_(USERS, STATUSES) + """
SELECT user_id, CAST(floor(created_ms / 86400000) AS BIGINT) AS chunk, count(*) AS n_posts,
       string_agg(CAST(status_id AS VARCHAR), ' ' ORDER BY created_ms DESC NULLS LAST, status_id DESC) AS status_ids,
       max(created_ms) AS newest_ms
FROM statuses GROUP BY ALL""",
    "feature_preview": USER_FEATURES + " ORDER BY id LIMIT 20",
})

# ------------------------------------------------------------ sources (A)
LINES = """
entries AS (  -- the listed posts; accounts of class 2 list post 0 before their own
  SELECT user_id, event_id FROM events
  UNION SELECT DISTINCT user_id, 0 FROM events WHERE user_id % 10 = 2),
listed AS (
  SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS ids, count(*) AS n
  FROM entries GROUP BY user_id
),
final_lines AS (
  SELECT l.user_id, u.label, l.ids, l.n, l.user_id % 10 AS m
  FROM listed l JOIN users u ON u.user_id = l.user_id
),
lines AS (  -- accounts of class 1 have an earlier line with the other label
  SELECT * FROM final_lines
  UNION ALL SELECT user_id, CASE label WHEN 'bot' THEN 'human' ELSE 'bot' END, ids, n, m FROM final_lines WHERE m = 1
)"""

# The first ten listed posts of an account's last line; a post belongs to the last account that lists it.
TRAINING = """
used AS (
  SELECT l.user_id, l.label, e.event_id AS status_id,
         row_number() OVER (PARTITION BY l.user_id ORDER BY e.event_id) - 1 AS position
  FROM final_lines l JOIN entries e ON e.user_id = l.user_id WHERE l.m NOT IN (3, 7, 9)),
training AS (
  SELECT status_id, user_id, label, CAST(position AS INTEGER) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY status_id ORDER BY user_id DESC) AS rn FROM used WHERE position < 10) x
  WHERE rn = 1)"""

REQ = """
req AS (SELECT p_partkey AS user_id, p_size < 20 AS first_pass FROM part),
reqa AS (SELECT r.user_id, r.first_pass, u.user_id IS NOT NULL AS acct, u.label
         FROM req r LEFT JOIN users u ON u.user_id = r.user_id)"""

EVENTS = """
ev AS (SELECT o_orderkey AS seq, o_custkey AS user_id,
              CASE WHEN o_orderkey % 2 = 0 THEN 'human' ELSE 'bot' END AS label FROM orders),
cur AS (SELECT user_id, label, seq FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM ev) x
        WHERE rn = 1)"""

DEV_INDEX = """
dev AS (SELECT mainDevice,
               CAST(row_number() OVER (ORDER BY count(*) DESC, mainDevice) - 1 AS DOUBLE) AS indexedMainDevice
        FROM feat GROUP BY mainDevice)"""

_FEAT = [USERS, STATUSES, OPEN_TIMELINE, _features_sql("tl", "created_ms")]

SQL.update({
    "read_labelled": with_(USERS, LINES) + """
SELECT label, user_id, n AS n_status_ids, ids AS status_ids FROM lines WHERE m NOT IN (3, 7, 9)""",
    "labelled_quarantine": with_(USERS, LINES) + """
SELECT CASE m WHEN 3 THEN 'non_numeric' WHEN 7 THEN 'blank' ELSE 'empty_token' END AS reason,
       CASE m WHEN 3 THEN label || ' u' || CAST(user_id AS VARCHAR) || ' ' || ids
              WHEN 7 THEN ''
              ELSE label || '  ' || CAST(user_id AS VARCHAR) || ' ' || ids END AS line
FROM lines WHERE m IN (3, 7, 9)""",
    "training_statuses": with_(USERS, STATUSES, LINES, TRAINING) + """
SELECT t.status_id, t.user_id, t.label, t.position, s.user_id AS author_id, s.created_ms, s.source
FROM training t JOIN statuses s ON s.status_id = t.status_id""",
    "resolve_users": with_(USERS, LINES) + """
SELECT l.user_id, l.label, u.screen_name, u.followers_count, u.friends_count
FROM final_lines l JOIN users u ON u.user_id = l.user_id WHERE l.m NOT IN (3, 7, 9)""",
    "read_status_json": with_(USERS, STATUSES) + """
SELECT s.status_id, s.user_id, u.screen_name,
       CASE WHEN s.status_id % 19 <> 0 THEN (epoch_us(e.ts) // 1000000) * 1000 END AS created_ms, s.source,
       CAST(s.n_urls AS BIGINT) AS n_urls, CAST(s.n_hashtags AS BIGINT) AS n_hashtags,
       CAST(s.n_mentions AS BIGINT) AS n_mentions
FROM statuses s JOIN events e ON e.event_id = s.status_id JOIN users u ON u.user_id = s.user_id
WHERE s.status_id % 13 <> 0 AND s.status_id % 17 <> 0""",
    "profile_store_lookup": with_(USERS, REQ) + """
SELECT user_id, CASE WHEN NOT first_pass THEN 'unseen' WHEN acct THEN 'found' ELSE 'missing' END AS state
FROM reqa""",
    "missing_users": with_(USERS, REQ) + """
SELECT DISTINCT user_id, 'missing' AS state FROM reqa WHERE NOT acct""",
    "known_users": with_(USERS, REQ) + """
SELECT user_id FROM reqa WHERE first_pass AND acct""",
    "profile_store_upsert": with_(USERS, REQ) + """
SELECT user_id, CASE WHEN acct THEN 'found' ELSE 'missing' END AS state, label,
       CAST(CASE WHEN NOT first_pass THEN 2
                 WHEN acct AND user_id IN (SELECT user_id FROM events) THEN 2
                 ELSE 1 END AS BIGINT) AS version
FROM reqa""",
    "ingest_coverage": with_(USERS, REQ, LINES) + """,
lk AS (
  SELECT count(*) AS requested,
         count(*) FILTER (WHERE first_pass AND acct) AS cached,
         count(*) FILTER (WHERE first_pass AND NOT acct) AS tombstoned,
         count(*) FILTER (WHERE NOT first_pass) AS unseen,
         count(*) FILTER (WHERE NOT first_pass AND acct) AS retrieved,
         count(*) FILTER (WHERE NOT first_pass AND NOT acct) AS not_found
  FROM reqa),
fl AS (
  SELECT count(*) AS lines,
         count(*) FILTER (WHERE m NOT IN (3, 7, 9)) AS accounts,
         count(*) FILTER (WHERE m IN (3, 7, 9)) AS quarantined
  FROM lines),
named AS (
  SELECT l.user_id, e.event_id, row_number() OVER (PARTITION BY l.user_id, l.label ORDER BY e.event_id) AS rn
  FROM lines l JOIN entries e ON e.user_id = l.user_id WHERE l.m NOT IN (3, 7, 9)),
st AS (
  SELECT count(*) AS listed, count(*) FILTER (WHERE rn <= 10) AS used,
         count(*) FILTER (WHERE rn <= 10 AND u.user_id IS NOT NULL) AS resolved,
         count(*) FILTER (WHERE rn <= 10 AND p.event_id IS NULL) AS no_post,
         count(*) FILTER (WHERE rn <= 10 AND p.event_id IS NOT NULL AND u.user_id IS NULL) AS no_owner
  FROM named n LEFT JOIN events p ON p.event_id = n.event_id LEFT JOIN users u ON u.user_id = p.user_id)
SELECT 'lookup' AS stage, metric, n FROM (UNPIVOT lk ON COLUMNS(*) INTO NAME metric VALUE n)
UNION ALL
SELECT 'labelled_file', metric, n FROM (UNPIVOT fl ON COLUMNS(*) INTO NAME metric VALUE n)
UNION ALL
SELECT 'statuses', metric, n FROM (UNPIVOT st ON COLUMNS(*) INTO NAME metric VALUE n)""",
    "profile_json_roundtrip": with_(*_FEAT, LINES, TRAINING) + """,
tr AS (SELECT t.user_id, string_agg(CAST(t.status_id AS VARCHAR), ' ' ORDER BY s.created_ms, s.status_id) AS ids
       FROM training t JOIN statuses s ON s.status_id = t.status_id GROUP BY t.user_id)
SELECT u.user_id, CAST(NULL AS BIGINT) AS chunk, u.label, u.screen_name, u.followers_count, f.meanIA, f.mainDevice,
       coalesce(tr.ids, '') AS training_ids, '' AS timeline_ids, true AS raw_same
FROM users u LEFT JOIN feat f ON f.id = u.user_id LEFT JOIN tr ON tr.user_id = u.user_id
UNION ALL
SELECT user_id, CAST(coalesce(floor(created_ms / 86400000), -1) AS BIGINT), NULL, NULL, NULL, NULL, NULL, '',
       string_agg(CAST(status_id AS VARCHAR), ' ' ORDER BY created_ms DESC NULLS LAST, status_id DESC), true
FROM tl GROUP BY 1, 2""",
    "feature_table": with_(*_FEAT, DEV_INDEX) + """
SELECT f.*, d.indexedMainDevice FROM feat f JOIN dev d ON d.mainDevice = f.mainDevice""",
    "index_device": with_(*_FEAT, DEV_INDEX) + "SELECT mainDevice, indexedMainDevice FROM dev",
    "index_label": with_(USERS) + """
SELECT label, CAST(row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS DOUBLE) AS indexedLabel
FROM users GROUP BY label""",
    "train_test_split": with_(USERS) + """
SELECT user_id AS id,
       CASE WHEN CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 1000000 < 600000
            THEN 'train' ELSE 'test' END AS split
FROM users""",
    "confusion_matrix": with_(*_FEAT) + """
SELECT label, CASE WHEN followerRatio < 0.5 THEN 'bot' ELSE 'human' END AS prediction, count(*) AS n
FROM feat GROUP BY ALL""",
    "attach_label": with_(USERS, EVENTS) + """
SELECT u.user_id, u.screen_name, c.label FROM users u JOIN cur c ON c.user_id = u.user_id""",
    "dedupe_last_wins": with_(EVENTS) + "SELECT user_id, seq, label FROM cur",
    "effective_labels": with_(USERS, EVENTS) + """
SELECT u.user_id, coalesce(c.label, u.label) AS label,
       CASE WHEN c.label IS NOT NULL THEN 'override' ELSE 'file' END AS label_source
FROM users u LEFT JOIN cur c ON c.user_id = u.user_id""",
    "label_upsert": with_(USERS, REQ, EVENTS) + """,
st AS (SELECT user_id, label FROM reqa WHERE first_pass AND acct)
SELECT coalesce(st.user_id, cur.user_id) AS user_id, coalesce(cur.label, st.label) AS label,
       CASE WHEN st.user_id IS NULL THEN 'created' WHEN cur.label IS NOT NULL THEN 'updated'
            ELSE 'unchanged' END AS origin
FROM st FULL OUTER JOIN cur ON cur.user_id = st.user_id""",
    "feature_reuse": with_(*_FEAT) + """
SELECT *, CASE WHEN id IN (SELECT p_partkey FROM part WHERE p_size < 20)
               THEN 'stored' ELSE 'computed' END AS origin
FROM feat""",
})

# ------------------------------------------------------------ spam and text
TEXT = """
ts AS (
  SELECT d.doc_id AS status_id, CASE WHEN l.toxic = 1 THEN 'bot' ELSE 'human' END AS label,
         d.text, p.url
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
),
th AS (
  SELECT url,
         CASE WHEN page_id % 7 = 3 THEN 'UNWANTED_SOFTWARE'
              WHEN page_id % 2 = 0 THEN 'MALWARE' ELSE 'SOCIAL_ENGINEERING' END AS threat_type,
         CASE WHEN page_id % 7 = 5 THEN 'LINUX' ELSE 'WINDOWS' END AS platform_type,
         'URL' AS threat_entry_type
  FROM pages WHERE page_id % 7 IN (0, 3, 5)
),
flag AS (
  SELECT DISTINCT url, threat_type FROM th
  WHERE threat_type IN ('MALWARE', 'SOCIAL_ENGINEERING') AND platform_type = 'WINDOWS'
    AND threat_entry_type = 'URL'
)"""

WS = "[ \\t\\n\\x0B\\f\\r]"


def _tokens(text: str) -> str:
    """Spark ML Tokenizer in SQL: lower-case, split on single whitespace
    characters, trailing empty tokens dropped (Java split semantics)."""
    return f"unnest(string_split_regex(regexp_replace(lower({text}), '{WS}+$', ''), '{WS}'))"


SQL.update({
    "status_urls": with_(TEXT) + "SELECT DISTINCT label, url FROM ts WHERE url IS NOT NULL",
    "spam_urls": with_(TEXT) + """
SELECT u.url, f.threat_type FROM (SELECT DISTINCT url FROM ts WHERE url IS NOT NULL) u
JOIN flag f ON f.url = u.url""",
    "labelled_statuses": with_(TEXT) + """,
last AS (SELECT label, url, status_id, text FROM (
           SELECT *, row_number() OVER (PARTITION BY label, url ORDER BY status_id DESC) AS rn
           FROM ts WHERE url IS NOT NULL) x WHERE rn = 1)
SELECT CASE WHEN label = 'human' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS label,
       url, status_id, text AS statusText
FROM last WHERE url IN (SELECT url FROM flag)""",
    "spam_counts": with_(TEXT) + """
SELECT label, count(DISTINCT status_id) AS n_statuses, count(DISTINCT url) AS n_urls,
       count(DISTINCT CASE WHEN url IN (SELECT url FROM flag) THEN url END) AS n_spam_urls
FROM ts WHERE url IS NOT NULL GROUP BY label""",
    "tokenize": f"""
SELECT doc_id, token, count(*) AS n
FROM (SELECT doc_id, {_tokens('text')} AS token FROM documents) x
GROUP BY doc_id, token""",
    "idf_tokens": with_(TEXT) + f""",
tok AS (SELECT DISTINCT status_id, token FROM (SELECT status_id, {_tokens('text')} AS token FROM ts) x)
SELECT token, count(*) AS df,
       round(ln((CAST((SELECT count(*) FROM ts) AS DOUBLE) + 1) / (CAST(count(*) AS DOUBLE) + 1)), 9) AS idf
FROM tok GROUP BY token""",
})

SQL["stream_label_upsert"] = SQL["dedupe_last_wins"]
SQL["stream_label_state"] = SQL["dedupe_last_wins"]
SQL["bucketed_lookup"] = with_(USERS, REQ) + """
SELECT r.user_id, CASE WHEN NOT r.first_pass THEN 'unseen' WHEN r.acct THEN 'found' ELSE 'missing' END AS state,
       r.acct AS is_account, r.acct AND NOT r.first_pass AS to_fetch, coalesce(n, 0) AS n_posts
FROM reqa r LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e ON e.user_id = r.user_id"""

# ------------------------------------------------------------ model inputs
# The model inputs in vector order.
MODEL_SLOTS = [
    "isProtected", "isVerified", "meanIA", "tweetRate", "maxTweetRate",
    "screenNameLength", "followerRatio", "urlRatio", "hashtagRatio",
    "mentionRatio", "uniqueDevices", "mainDeviceCount", "indexedMainDevice",
]

SLOTS = "slots AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT f.id, CAST({i} AS INTEGER) AS slot, '{name}' AS feature, CAST(f.{name} AS DOUBLE) AS value "
    f"FROM fi f"
    for i, name in enumerate(MODEL_SLOTS)
) + "\n)"

FI = """
fi AS (SELECT f.*, d.indexedMainDevice FROM feat f JOIN dev d ON d.mainDevice = f.mainDevice)"""

# Vector indexer: a slot with at most 4 distinct values becomes categorical;
# 0.0 keeps code 0 and the other values take codes in ascending order.
VECTOR_INDEX = """
dist AS (SELECT slot, value FROM slots GROUP BY slot, value),
k AS (SELECT slot, count(*) AS k, bool_or(value = 0) AS has_zero FROM dist GROUP BY slot),
codes AS (
  SELECT d.slot, d.value,
         CASE WHEN d.value = 0 THEN 0
              ELSE (row_number() OVER (PARTITION BY d.slot, d.value = 0 ORDER BY d.value) - 1)
                   + CASE WHEN k.has_zero THEN 1 ELSE 0 END END AS code
  FROM dist d JOIN k ON k.slot = d.slot WHERE k.k <= 4
)"""

SQL.update({
    "assemble_features": with_(*_FEAT, DEV_INDEX, FI, SLOTS) + "SELECT id, slot, feature, value FROM slots",
    "vector_index": with_(*_FEAT, DEV_INDEX, FI, SLOTS, VECTOR_INDEX) + """
SELECT s.id, s.slot, s.feature, coalesce(CAST(c.code AS DOUBLE), s.value) AS value
FROM slots s LEFT JOIN codes c ON c.slot = s.slot AND c.value = s.value""",
    "model_roundtrip": with_(USERS) + "SELECT user_id AS id, true AS same FROM users",
})

SQL["features_from_batches"] = USER_FEATURES
SQL["incremental_refresh"] = with_(*_FEAT) + """
SELECT *, CASE WHEN id IN (SELECT user_id FROM statuses
                           WHERE created_ms >= (SELECT max(created_ms) FROM statuses) - 86400000)
               THEN 'refreshed' ELSE 'stored' END AS origin
FROM feat"""

# ------------------------------------------------------------ models
SPLIT = """
split AS (
  SELECT user_id AS id, label,
         CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 1000000 >= 600000 AS test
  FROM users)"""


def forest_sql(trees: int, depth: int, bins: int = 32, per_node: int = 4, seed: int = 207325481) -> list[str]:
    """CTEs that train a forest on the training split, level by level, and
    score every account with it: ``nodes``, ``leaf`` (account, tree, votes)
    and ``pred`` (id, label, test, predictedLabel, probability)."""
    poisson = [math.floor(2**52 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
    draw = f"CAST('0x' || substr(md5('{seed}|' || t || '|' || id), 1, 13) AS BIGINT)"
    weight = " + ".join(f"CASE WHEN u >= {k} THEN 1 ELSE 0 END" for k in poisson)
    unpivot = "\n  UNION ALL\n".join(
        f"  SELECT id, label, test, {i} AS slot, '{n}' AS feature, CAST({n} AS DOUBLE) AS value FROM fv"
        for i, n in enumerate(MODEL_SLOTS))
    out = [f"""
fs AS MATERIALIZED (SELECT f.*, s.test FROM feat f JOIN split s ON s.id = f.id)""", """
dv AS (SELECT mainDevice, CAST(row_number() OVER (ORDER BY count(*) DESC, mainDevice) - 1 AS DOUBLE) AS code
       FROM fs WHERE NOT test GROUP BY mainDevice)""", """
fv AS (SELECT fs.*, coalesce(dv.code, (SELECT CAST(count(*) AS DOUBLE) FROM dv)) AS indexedMainDevice
       FROM fs LEFT JOIN dv ON dv.mainDevice = fs.mainDevice)""", f"""
sl AS MATERIALIZED (
{unpivot})""", f"""
bn AS MATERIALIZED (
  SELECT slot, value, dense_rank() OVER (PARTITION BY slot ORDER BY part) - 1 AS bin, max(value) OVER (PARTITION BY slot, part) AS edge
  FROM (SELECT slot, value, CAST(before * {bins} // (SELECT count(*) FROM fs WHERE NOT test) AS BIGINT) AS part
        FROM (SELECT slot, value, sum(count(*)) OVER (PARTITION BY slot ORDER BY value) - count(*) AS before
              FROM sl WHERE NOT test GROUP BY slot, value) c) p)""", """
tb AS MATERIALIZED (SELECT sl.id, sl.slot, bn.bin FROM sl JOIN bn ON bn.slot = sl.slot AND bn.value = sl.value WHERE NOT test)""", f"""
r0 AS MATERIALIZED (
  SELECT id, label = 'bot' AS y, t AS tree, CAST(1 AS BIGINT) AS node, {weight} AS w
  FROM (SELECT id, label, t, {draw} AS u FROM fs, (SELECT unnest(range({trees})) AS t) x WHERE NOT test) d
  WHERE {weight} > 0)"""]
    gini = "(1.0::DOUBLE - ({0} * {0} + {1} * {1}) / ({2} * {2}))".format
    for d in range(depth + 1):
        out.append(f"""
l{d} AS MATERIALIZED (SELECT tree, node, CAST(sum(CASE WHEN y THEN 0 ELSE w END) AS DOUBLE) AS h,
              CAST(sum(CASE WHEN y THEN w ELSE 0 END) AS DOUBLE) AS b FROM r{d} GROUP BY tree, node)""")
        if d == depth:
            break
        out.append(f"""
m{d} AS (SELECT tree, node, slot FROM (
           SELECT tree, node, slot, row_number() OVER (
             PARTITION BY tree, node ORDER BY md5('{seed}|' || tree || '|' || node || '|' || slot)) AS k
           FROM l{d}, (SELECT unnest(range({len(MODEL_SLOTS)})) AS slot) s WHERE h > 0 AND b > 0) x WHERE k <= {per_node})""")
        out.append(f"""
c{d} AS MATERIALIZED (
  SELECT tree, node, slot, bin, h, b, CAST(sum(bh) OVER o AS DOUBLE) AS lh, CAST(sum(bb) OVER o AS DOUBLE) AS lb
  FROM (SELECT r.tree, r.node, tb.slot, tb.bin, sum(CASE WHEN y THEN 0 ELSE w END) AS bh, sum(CASE WHEN y THEN w ELSE 0 END) AS bb
        FROM r{d} r JOIN m{d} m ON m.tree = r.tree AND m.node = r.node JOIN tb ON tb.id = r.id AND tb.slot = m.slot
        GROUP BY r.tree, r.node, tb.slot, tb.bin) g JOIN l{d} l USING (tree, node)
  WINDOW o AS (PARTITION BY tree, node, slot ORDER BY bin))""")
        out.append(f"""
s{d} AS MATERIALIZED (
  SELECT * FROM (SELECT tree, node, slot, bin, {gini('h', 'b', '(h + b)')} - ((lh + lb) * {gini('lh', 'lb', '(lh + lb)')}
                        + (h - lh + (b - lb)) * {gini('(h - lh)', '(b - lb)', '(h - lh + (b - lb))')}) / (h + b) AS gain
                 FROM c{d} WHERE h - lh + (b - lb) > 0) x
  WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, slot, bin) = 1)""")
        out.append(f"""
r{d + 1} AS MATERIALIZED (
  SELECT r.id, r.y, r.tree, 2 * r.node + CASE WHEN tb.bin > s.bin THEN 1 ELSE 0 END AS node, r.w
  FROM r{d} r JOIN s{d} s ON s.tree = r.tree AND s.node = r.node JOIN tb ON tb.id = r.id AND tb.slot = s.slot)""")
    out.append("\nnodes AS MATERIALIZED (\n" + "\n  UNION ALL\n".join(
        f"  SELECT l.tree, l.node, {d} AS depth, l.h, l.b, " + (
            f"s.slot, e.edge, s.gain FROM l{d} l LEFT JOIN s{d} s ON s.tree = l.tree AND s.node = l.node "
            f"LEFT JOIN (SELECT DISTINCT slot, bin, edge FROM bn) e ON e.slot = s.slot AND e.bin = s.bin" if d < depth
            else f"NULL AS slot, NULL AS edge, NULL AS gain FROM l{d} l") for d in range(depth + 1)) + ")")
    step, last = "SELECT id, tree, CAST(1 AS BIGINT) AS node FROM fs, (SELECT DISTINCT tree FROM nodes) t", "at0"
    out.append(f"\nat0 AS MATERIALIZED ({step})")
    for d in range(depth):
        last = f"at{d + 1}"
        out.append(f"""
{last} AS MATERIALIZED (
  SELECT a.id, a.tree, CASE WHEN n.slot IS NULL THEN a.node WHEN sl.value <= n.edge THEN 2 * a.node ELSE 2 * a.node + 1 END AS node
  FROM at{d} a JOIN nodes n ON n.tree = a.tree AND n.node = a.node LEFT JOIN sl ON sl.id = a.id AND sl.slot = n.slot)""")
    out.append(f"""
votes AS (
  SELECT a.id, sum(CAST(floor(h / (h + b) * 1000000000000) AS BIGINT)) AS vh, sum(CAST(floor(b / (h + b) * 1000000000000) AS BIGINT)) AS vb
  FROM {last} a JOIN nodes n ON n.tree = a.tree AND n.node = a.node GROUP BY a.id)""")
    out.append("""
pred AS (
  SELECT fs.id, fs.label, fs.test, CASE WHEN vb > vh THEN 'bot' ELSE 'human' END AS predictedLabel,
         round(CAST(greatest(vh, vb) AS DOUBLE) / CAST(vh + vb AS DOUBLE), 9) AS probability
  FROM fs JOIN votes ON votes.id = fs.id)""")
    return out


FOREST = with_(*_FEAT, SPLIT, *forest_sql(8, 4))
_SCORED = FOREST + "SELECT id, predictedLabel, probability FROM pred"

SQL.update({
    "train_forest": "SELECT CAST(unnest(range(20)) AS INTEGER) AS tree, CAST(1 AS DOUBLE) AS weight, true AS sound",
    "grow_forest": FOREST + """
SELECT CAST(tree AS INTEGER) AS tree, node, CAST(depth AS INTEGER) AS depth, f.feature, edge AS threshold,
       CAST(h AS BIGINT) AS n_human, CAST(b AS BIGINT) AS n_bot, round(gain, 9) AS gain
FROM nodes LEFT JOIN (SELECT DISTINCT slot, feature FROM sl) f ON f.slot = nodes.slot""",
    "ml_forest_walk": with_(USERS) + "SELECT user_id AS id, true AS same FROM users",
    "cv_folds": with_(USERS, SPLIT) + """
SELECT id, CAST(CAST('0x' || substr(md5('fold|' || id), 1, 8) AS BIGINT) % 4 AS INTEGER) AS fold FROM split WHERE NOT test""",
    "score_users": _SCORED,
    "stream_score": _SCORED,
    "evaluate_forest": FOREST + """
SELECT round(avg(CASE WHEN label = predictedLabel THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy,
       round(1 - avg(CASE WHEN label = predictedLabel THEN 1.0::DOUBLE ELSE 0 END), 9) AS test_error, count(*) AS n_test
FROM pred WHERE test""",
    "forest_confusion": FOREST + """
SELECT label, predictedLabel AS prediction, count(*) AS n FROM pred WHERE test GROUP BY label, predictedLabel""",
    "cross_validate": """
SELECT t AS "numTrees", d AS "maxDepth", true AS is_share, CAST(1 AS BIGINT) AS n_best, true AS best_is_top
FROM (SELECT unnest([10, 100, 1]) AS t) CROSS JOIN (SELECT unnest([5, 10, 1]) AS d)""",
    "best_model": with_(USERS) + "SELECT true AS is_best_row, count(*) AS n_scored FROM users",
    "feature_importance": FOREST + """,
g AS (SELECT tree, slot, sum(gain * (h + b)) AS g FROM nodes WHERE slot IS NOT NULL GROUP BY tree, slot),
sh AS (SELECT slot, sum(g / a) AS share FROM (SELECT *, sum(g) OVER (PARTITION BY tree) AS a FROM g) x GROUP BY slot)
SELECT f.feature, round(coalesce(share / (SELECT sum(share) FROM sh), 0), 9) AS importance
FROM (SELECT DISTINCT slot, feature FROM sl) f LEFT JOIN sh ON sh.slot = f.slot""",
    "prediction_table": FOREST + "SELECT id, predictedLabel, label FROM pred WHERE test",
    "misclassified": FOREST + "SELECT id, label, predictedLabel, probability FROM pred WHERE test AND label <> predictedLabel",
    "corrected_misclassified": with_(*_FEAT, SPLIT, *forest_sql(8, 4), EVENTS) + """
SELECT p.id, coalesce(c.label, p.label) AS label, CASE WHEN c.label IS NOT NULL THEN 'override' ELSE 'file' END AS label_source,
       predictedLabel, probability
FROM pred p LEFT JOIN cur c ON c.user_id = p.id WHERE test AND coalesce(c.label, p.label) <> predictedLabel""",
    "classify_users": with_(*_FEAT, SPLIT, *forest_sql(8, 4), REQ) + """
SELECT r.user_id AS id, CASE WHEN NOT acct THEN 'missing' WHEN first_pass THEN 'stored' ELSE 'computed' END AS state,
       p.predictedLabel, p.probability, f.meanIA, f.tweetRate, f.maxTweetRate, f.followerRatio, f.urlRatio,
       f.mainDevice, f.mainDeviceCount
FROM reqa r LEFT JOIN feat f ON f.id = r.user_id LEFT JOIN pred p ON p.id = r.user_id""",
    "correct_profiles": with_(USERS, REQ, EVENTS) + """,
v2 AS (SELECT c.user_id, CASE WHEN u.user_id IS NOT NULL THEN 'found' ELSE 'missing' END AS state,
              CASE WHEN u.user_id IS NOT NULL THEN c.label END AS label, CAST(2 AS BIGINT) AS version
       FROM cur c LEFT JOIN users u ON u.user_id = c.user_id)
SELECT * FROM v2
UNION ALL
SELECT user_id, CASE WHEN acct THEN 'found' ELSE 'missing' END, label, CAST(1 AS BIGINT)
FROM reqa WHERE first_pass AND user_id NOT IN (SELECT user_id FROM v2)""",
    "hashing_tf": with_(TEXT) + f""",
w AS (SELECT status_id, label, len(string_split_regex(regexp_replace(lower(text), '{WS}+$', ''), '{WS}')) AS n FROM ts)
SELECT status_id, label, CAST(n AS BIGINT) AS n_terms, CAST(20 AS INTEGER) AS n_buckets, CAST(n AS DOUBLE) AS tf_total
FROM w""",
    "train_text_model": "SELECT label, count(*) AS n, true AS sound FROM (" + SQL["labelled_statuses"] + ") x GROUP BY label",
    "retrain_with_corrections": with_(USERS, LINES, EVENTS) + """
SELECT l.user_id AS id, coalesce(c.label, l.label) AS label,
       CASE WHEN c.label IS NOT NULL THEN 'override' ELSE 'file' END AS label_source, true AS labelled
FROM final_lines l JOIN users u ON u.user_id = l.user_id LEFT JOIN cur c ON c.user_id = l.user_id
WHERE l.m NOT IN (3, 7, 9)""",
})

# The copy-on-write store: the rows that each of its four commits writes.
COMMITS = with_(USERS, REQ) + """,
ev AS (SELECT o_orderkey AS seq, o_custkey AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'human' ELSE 'bot' END AS label,
              CASE WHEN o_orderdate < (SELECT max(o_orderdate) FROM orders) THEN 3 ELSE 4 END AS version FROM orders),
cur AS (SELECT version, user_id, arg_max(label, seq) AS label FROM ev GROUP BY version, user_id),
w AS (
  SELECT user_id, CASE WHEN acct THEN 'found' ELSE 'missing' END AS state, label, CAST(1 AS BIGINT) AS version FROM reqa WHERE first_pass
  UNION ALL
  SELECT user_id, CASE WHEN acct THEN 'found' ELSE 'missing' END, label, CAST(2 AS BIGINT) FROM reqa
  WHERE NOT first_pass OR (acct AND user_id IN (SELECT user_id FROM events))
  UNION ALL
  SELECT c.user_id, CASE WHEN u.user_id IS NOT NULL THEN 'found' ELSE 'missing' END,
         CASE WHEN u.user_id IS NOT NULL THEN c.label END, CAST(c.version AS BIGINT)
  FROM cur c LEFT JOIN users u ON u.user_id = c.user_id)"""
SQL["store_copy_on_write"] = COMMITS + """
SELECT user_id, state, label, version FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY version DESC) = 1"""
SQL["store_manifests"] = COMMITS + """,
b AS (SELECT user_id, version, CAST(CAST('0x' || substr(md5('bucket|' || user_id), 1, 8) AS BIGINT) % 16 AS INTEGER) AS bucket FROM w)
SELECT CAST(v.version AS BIGINT) AS version, b.bucket, max(b.version) AS written, count(DISTINCT b.user_id) AS n_rows
FROM (VALUES (1), (2), (3), (4)) v(version) JOIN b ON b.version <= v.version GROUP BY v.version, b.bucket"""

# Naive Bayes: terms, parameters and predictions from the same split, in one chain of aggregates.
BAYES = ("WITH lab AS MATERIALIZED (" + SQL["labelled_statuses"] + "),\n" + f"""
tr AS (SELECT *, CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % 1000000 < 600000 AS train FROM lab),
tok AS (SELECT url, label, train, {_tokens('statusText')} AS token FROM tr),
tb AS MATERIALIZED (SELECT url, label, train, CAST(CAST('0x' || substr(md5(token), 1, 13) AS BIGINT) % 20 AS INTEGER) AS bucket, count(*) AS n
       FROM tok GROUP BY ALL),
pri AS (SELECT label, ln(CAST(count(*) AS DOUBLE) + 1)
               - ln(CAST((SELECT count(*) FROM tr WHERE train) AS DOUBLE) + (SELECT count(DISTINCT label) FROM tr WHERE train)) AS log_prior
        FROM tr WHERE train GROUP BY label),
bk AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS bucket),
idf AS (SELECT bk.bucket, ln((CAST((SELECT count(*) FROM tr WHERE train) AS DOUBLE) + 1) / (CAST(count(tb.url) AS DOUBLE) + 1)) AS idf
        FROM bk LEFT JOIN tb ON tb.bucket = bk.bucket AND tb.train GROUP BY bk.bucket),
w AS (SELECT p.label, i.bucket, i.idf, CAST(coalesce(s.tf, 0) AS DOUBLE) * i.idf AS w
      FROM pri p CROSS JOIN idf i LEFT JOIN (SELECT label, bucket, sum(n) AS tf FROM tb WHERE train GROUP BY ALL) s
      ON s.label = p.label AND s.bucket = i.bucket),
par AS MATERIALIZED (
  SELECT w.label, bucket, idf, log_prior, ln(w + 1) - ln(sum(w) OVER (PARTITION BY w.label) + 20) AS log_likelihood
  FROM w JOIN pri ON pri.label = w.label),
sc AS (SELECT t.url, t.label, p.label AS class, p.log_prior + coalesce(x.s, 0) AS score
       FROM tr t CROSS JOIN pri p
       LEFT JOIN (SELECT tb.url, tb.label, par.label AS class, sum(n * idf * log_likelihood) AS s
                  FROM tb JOIN par ON par.bucket = tb.bucket GROUP BY ALL) x
       ON x.url = t.url AND x.label = t.label AND x.class = p.label WHERE NOT t.train),
pr AS (SELECT url, label, class AS prediction, 1 / sum(exp(score - top)) OVER (PARTITION BY url, label) AS probability, score, top
       FROM (SELECT *, max(score) OVER (PARTITION BY url, label) AS top FROM sc) x
       QUALIFY row_number() OVER (PARTITION BY url, label ORDER BY score DESC, class) = 1)
""")

SQL.update({
    "hashed_terms": with_(TEXT) + f"""
SELECT status_id, label, CAST(CAST('0x' || substr(md5(token), 1, 13) AS BIGINT) % 20 AS INTEGER) AS bucket, count(*) AS n
FROM (SELECT status_id, label, {_tokens('text')} AS token FROM ts) x GROUP BY ALL""",
    "text_model_parameters": BAYES + """
SELECT label, bucket, round(idf, 9) AS idf, round(log_prior, 9) AS log_prior, round(log_likelihood, 9) AS log_likelihood FROM par""",
    "text_predictions": BAYES + "SELECT url, label, prediction, round(probability, 9) AS probability FROM pr",
    "evaluate_text_model": BAYES + """
SELECT label, prediction, count(*) AS n,
       (SELECT round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 9) FROM pr) AS accuracy
FROM pr GROUP BY label, prediction""",
})
