"""What the queries have to give, as SQL for another engine."""

from __future__ import annotations

from ..fixed_values import FILENAME_WORDS, HARMLESS_PHRASES, LINK_BLACKLIST, NON_ROUTABLE, WHITELIST

_TLDS = ("com", "org", "net", "io", "de", "fr", "es")
_SPACE = r"[\t\n\x0b\f\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_SHAPES = {
    "url": r"(?i)\b(?:hxxps?|https?|ftps?)://[^\s/$.?#].\S*\b",
    "email": r"(?i)\b[a-zA-Z0-9._%+-]+(?:@|\[@])[a-zA-Z0-9.-]+(?:\[\.]|\.)[a-zA-Z]{2,24}\b",
    "cve": r"(?i)\bCVE-(?:1999|2\d{3})-(?:0\d{2}[1-9]|[1-9]\d{3,})\b",
    "ipv4": rf"\b(?:{_OCTET}(?:\[\.\]|\.|\s)){{3}}{_OCTET}\b",
    "hash": r"\b(?:[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b",
    # The character before a domain is part of the match and cut off again.
    "domain": r"(?:^|[^@\p{L}\p{N}_])(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\[\.]|\(\.\)|\.))+[a-zA-Z]{2,24}\b",
}
_ORDER = ["url", "email", "file", "domain", "cve", "ipv4", "md5", "sha1", "sha256", "apt_group_mention", "country_mention"]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


_NORM = f"""norm AS (
  SELECT doc_id, 'https://' || source || '.example.com/post/' || doc_id AS url, text,
         trim(regexp_replace(translate(text, '“”‘’', {_q(chr(34) * 2 + chr(39) * 2)}), {_q(_SPACE)}, ' ', 'g')) AS t
  FROM documents)"""


def _spans(kind: str, pattern: str) -> str:
    """Matches with their positions, from the lengths of gaps and matches."""
    lead = kind == "domain"
    raw = "regexp_replace(m, '^[^a-zA-Z0-9]', '')" if lead else "m"
    return f"""
  SELECT doc_id, t, {_q(kind)} AS kind, gap + length(m) - length({raw}) AS s, gap + length(m) AS e, {raw} AS raw
  FROM (SELECT doc_id, t, unnest(ms) AS m, unnest(starts) AS gap FROM (
    SELECT doc_id, t, ms, list_transform(range(1, len(ms) + 1), lambda i:
      list_sum(list_transform(gs[1:i], lambda g: length(g)))
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)) AS starts
    FROM (SELECT doc_id, t, regexp_extract_all(t, {_q(pattern)}) AS ms, string_split_regex(t, {_q(pattern)}) AS gs
          FROM norm WHERE regexp_matches(t, {_q(pattern)}))))"""


_SNIPPET = "substring(t, CAST(greatest(s - 50, 0) + 1 AS BIGINT), CAST(least(e + 50, length(t)) - greatest(s - 50, 0) AS BIGINT))"


def _ip(text: str) -> int:
    a, b, c, d = map(int, text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def _routable(value: str) -> str:
    number = "(" + " + ".join(
        f"CAST(split_part({value}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)
    ) + ")"
    ranges = " OR ".join(
        f"{number} BETWEEN {_ip(c.split('/')[0])} AND {_ip(c.split('/')[0]) + 2 ** (32 - int(c.split('/')[1])) - 1}"
        for c in NON_ROUTABLE
    )
    return f"(NOT ({ranges}) OR {number} IN ({_ip('192.0.0.9')}, {_ip('192.0.0.10')}))"


_IP_VALUE = "replace(replace(raw, '[.]', '.'), ' ', '.')"
_PLAIN = "replace(replace(replace(raw, '[.]', '.'), '(.)', '.'), '[:]', ':')"
_TYPE = "CASE WHEN kind <> 'hash' THEN kind WHEN length(raw) = 32 THEN 'md5' WHEN length(raw) = 40 THEN 'sha1' ELSE 'sha256' END"
_HARMLESS = r"(?i)\b(?:" + "|".join(p.replace(".", r"\.") for p in HARMLESS_PHRASES) + r")\b"


def _resolved(extra: dict | None = None) -> str:
    """CTEs that end in ``hits``: validated candidates without overlaps."""
    shapes = {**_SHAPES, **(extra or {})}
    union = " UNION ALL ".join(_spans(k, p) for k, p in shapes.items())
    prio = "CASE type " + " ".join(f"WHEN {_q(t)} THEN {i}" for i, t in enumerate(_ORDER)) + " END"
    return f"""WITH RECURSIVE {_NORM},
cand AS MATERIALIZED ({union}),
typed AS (SELECT doc_id, s, e, {_TYPE} AS type, {_SNIPPET} AS snippet,
  CASE WHEN kind = 'ipv4' THEN {_IP_VALUE} WHEN kind = 'email' THEN replace({_PLAIN}, '[@]', '@') ELSE {_PLAIN} END AS value
  FROM cand),
valid AS (SELECT *, {prio} AS prio FROM typed WHERE
  (type NOT IN ('url', 'email', 'domain', 'ipv4') OR NOT regexp_matches(snippet, {_q(_HARMLESS)}))
  AND (type <> 'ipv4' OR (value NOT IN {_list(WHITELIST["ips"])} AND {_routable("value")}))
  AND (type <> 'domain' OR (lower(split_part(value, '.', -1)) IN {_list(_TLDS)} AND lower(value) NOT IN {_list(WHITELIST["domains"])}))),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, prio) AS rn FROM valid),
walk AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS last_end, false AS kept FROM ordered
  UNION ALL
  SELECT o.doc_id, o.rn, CASE WHEN o.s >= w.last_end THEN CAST(o.e AS BIGINT) ELSE w.last_end END, o.s >= w.last_end
  FROM walk w JOIN ordered o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1),
hits AS (SELECT o.doc_id, o.s, o.e, o.value, o.type, '...' || o.snippet || '...' AS snippet
  FROM ordered o JOIN walk w ON o.doc_id = w.doc_id AND o.rn = w.rn WHERE w.kept)"""


_NORM_VALUE = "CASE WHEN type IN ('domain', 'email') THEN lower(value) ELSE value END"


def _single(kind: str, value: str, type_: str, more: str = "") -> str:
    return f"""WITH {_NORM}, cand AS ({_spans(kind, _SHAPES[kind])})
SELECT doc_id AS article_idx, CAST(s AS INTEGER) AS pos, {value} AS ioc_value, {type_} AS ioc_type, {_SNIPPET} AS snippet{more} FROM cand"""


_HISTORY = """history AS (SELECT url, max(ts) AS last_scanned FROM pages LEFT JOIN events ON event_id = page_id GROUP BY url)"""
_TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_HOST = "regexp_extract({}, '^[a-zA-Z]+://([^/?#]*)', 1)"


def _file_name(value: str, size: int) -> str:
    for word, name in FILENAME_WORDS.items():
        value = f"replace({value}, {_q(word)}, {_q(name)})"
    safe = f"trim(regexp_replace(regexp_replace({value}, '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g'), '_+', '_', 'g'), '._')"
    return f"CASE WHEN {safe} = '' THEN 'default_ioc_name' ELSE trim(left({safe}, {size}), '._') END"


_ANCHORS = f"""anchors AS (
  SELECT page_id, url AS source_url, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(a, '>([^<]*)<', 1)) AS link_text
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a FROM pages)),
links AS (
  SELECT page_id, source_url, regexp_extract(source_url, '^([a-z]+://[^/?#]*)', 1) || href AS url, link_text, href AS path
  FROM anchors WHERE href NOT IN ('', '/', '#') AND link_text <> '' AND NOT regexp_matches(href, {_q("(?i)" + "|".join(LINK_BLACKLIST))})),
scored AS (
  SELECT *, CASE WHEN len(string_split_regex(link_text, '\\s+')) >= 4 THEN 2 WHEN len(string_split_regex(link_text, '\\s+')) >= 3 THEN 1 ELSE 0 END
    + CASE WHEN length(path) - length(replace(path, '/', '')) >= 3 THEN 1 ELSE 0 END
    + CASE WHEN regexp_matches(path, '/\\d{{4}}/\\d{{2}}/') OR path LIKE '%.html' OR path LIKE '%.htm' THEN 1 ELSE 0 END
    + CASE WHEN path LIKE '%/' THEN 0 ELSE 1 END AS score FROM links)"""

_KINDS = "['ipv4', 'domain', 'md5', 'sha256', 'file', 'email']"
_BATCH = f"""named AS (SELECT p_partkey, p_name || '-' || p_partkey AS ioc_value, ({_KINDS})[(length(p_type) + p_size) % 6 + 1] AS ioc_type FROM part),
item_of AS (SELECT * FROM named JOIN lineitem ON l_partkey = p_partkey),
iocs AS (SELECT ioc_value, ioc_type, count(*) AS occurrence_count, 'first order ' || min(l_orderkey) AS snippet FROM item_of GROUP BY ALL),
sources AS (SELECT DISTINCT ioc_value, ioc_type, 'https://s' || l_suppkey || '.example.com/feed' AS url FROM item_of),
sold AS (SELECT * FROM item_of JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
mentions AS (
  SELECT ioc_value, ioc_type, 'apt_group_mention' AS mention_type, s_name AS value, min(l_orderkey) AS seen FROM sold GROUP BY ALL
  UNION ALL SELECT ioc_value, ioc_type, 'country_mention', n_name, min(l_orderkey) FROM sold GROUP BY ALL
  UNION ALL SELECT ioc_value, ioc_type, 'cve', 'cve-2024-000' || l_linenumber, min(l_orderkey) FROM sold GROUP BY ALL),
observables AS (SELECT ioc_value, ioc_type,
  CASE ioc_type WHEN 'ipv4' THEN 'ipv4-addr' WHEN 'domain' THEN 'domain-name' WHEN 'email' THEN 'email-addr' ELSE 'file' END AS type,
  CASE ioc_type WHEN 'file' THEN '{{"name":"' || ioc_value || '"}}' WHEN 'md5' THEN '{{"hashes":{{"MD5":"' || ioc_value || '"}}}}'
    WHEN 'sha256' THEN '{{"hashes":{{"SHA-256":"' || ioc_value || '"}}}}' ELSE '{{"value":"' || ioc_value || '"}}' END AS label FROM iocs),
edges AS (
  SELECT 'uses' AS relationship_type, ioc_type, ioc_value, a.value AS source, ioc_value AS target FROM mentions a WHERE mention_type = 'apt_group_mention'
  UNION ALL SELECT CASE b.mention_type WHEN 'cve' THEN 'targets' ELSE 'originates-from' END, a.ioc_type, a.ioc_value, a.value, b.value
  FROM mentions a JOIN mentions b USING (ioc_value, ioc_type) WHERE a.mention_type = 'apt_group_mention' AND b.mention_type <> 'apt_group_mention'),
old AS (SELECT ioc_value, ioc_type FROM iocs WHERE occurrence_count < 30),
fresh AS (SELECT * FROM sources s WHERE NOT (s.url < 'https://s5' AND EXISTS (SELECT 1 FROM old o WHERE o.ioc_value = s.ioc_value AND o.ioc_type = s.ioc_type)))"""


def _joined(kind: str, value: str = "value") -> str:
    return f"""coalesce((SELECT string_agg({value}, ';' ORDER BY seen, value) FROM mentions m
      WHERE m.ioc_value = i.ioc_value AND m.ioc_type = i.ioc_type AND mention_type = {_q(kind)}), '')"""


def _of_ioc(kind: str) -> str:
    return f"(SELECT count(*) FROM mentions m WHERE m.ioc_value = i.ioc_value AND m.ioc_type = i.ioc_type AND mention_type = {_q(kind)})"


_WORDS = {"country_mention": r"(?i)\b(?:that|from|with)\b", "apt_group_mention": r"(?i)\b(?:the|for)\b"}

ORACLE = {
    "extract_ipv4": _single("ipv4", _IP_VALUE, "'ipv4'", f", {_routable(_IP_VALUE)} AS routable"),
    "extract_email": _single("email", f"replace({_PLAIN}, '[@]', '@')", "'email'"),
    "extract_hash": _single("hash", "raw", _TYPE),
    "extract_resolved": _resolved() + """
SELECT doc_id AS article_idx, CAST(s AS INTEGER) AS pos, CAST(e AS INTEGER) AS end_pos, value AS ioc_value, type AS ioc_type, snippet AS context_snippet FROM hits""",
    "ioc_dedup": _resolved() + f""", ranked AS (SELECT {_NORM_VALUE} AS ioc_value, type, snippet,
  row_number() OVER (PARTITION BY {_NORM_VALUE}, type ORDER BY doc_id, s) AS k, count(*) OVER (PARTITION BY {_NORM_VALUE}, type) AS n
  FROM hits WHERE type <> 'cve')
SELECT ioc_value, type AS ioc_type, n AS occurrence_count, snippet AS first_seen_context_snippet FROM ranked WHERE k = 1""",
    "ioc_sources": _resolved() + f"""
SELECT DISTINCT {_NORM_VALUE} AS ioc_value, type AS ioc_type, url FROM hits JOIN norm USING (doc_id) WHERE type <> 'cve'""",
    "ioc_types_in_text": _resolved() + """
SELECT type, count(*) AS ioc_count FROM hits GROUP BY type ORDER BY ioc_count DESC, type LIMIT 7""",
    "mention_proximity": _resolved(_WORDS) + f""",
prim AS (SELECT DISTINCT doc_id, value, type FROM hits WHERE type NOT IN ('country_mention', 'apt_group_mention', 'cve')),
ment AS (SELECT DISTINCT doc_id, value, type FROM hits WHERE type IN ('country_mention', 'apt_group_mention', 'cve')),
cut AS (SELECT doc_id, value, type, text, p, regexp_extract_all(text, p) AS ms, string_split_regex(text, p) AS gs FROM (
  SELECT DISTINCT doc_id, prim.value, prim.type, text, '(?i)\\b' || regexp_escape(prim.value) || '\\b' AS p FROM prim JOIN norm USING (doc_id))),
place AS (SELECT doc_id, value, type, text, unnest(list_transform(range(1, len(ms) + 1), lambda i:
    list_sum(list_transform(gs[1:i], lambda g: length(g))) + (i - 1) * length(value))) AS s FROM cut),
area AS (SELECT doc_id, value, type, substring(text, CAST(greatest(s - 250, 0) + 1 AS BIGINT),
    CAST(least(s + length(value) + 250, length(text)) - greatest(s - 250, 0) AS BIGINT)) AS near FROM place)
SELECT DISTINCT CASE WHEN area.type IN ('domain', 'email') THEN lower(area.value) ELSE area.value END AS ioc_value, area.type AS ioc_type,
  ment.type AS mention_type, ment.value AS value, CASE WHEN ment.type = 'apt_group_mention' THEN upper(ment.value) END AS normalized_value
FROM area JOIN ment USING (doc_id) WHERE regexp_matches(near, '(?i)\\b' || regexp_escape(ment.value) || '\\b')""",
    "mentions_of_large_lexicon": f"""WITH {_NORM},
lexicon AS (SELECT DISTINCT lower(regexp_extract(t, '^([A-Za-z]{{4,}})', 1)) AS name FROM norm),
tokens AS (SELECT doc_id, lower(unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+'))) AS name FROM norm)
SELECT name, count(*) AS mentions, count(DISTINCT doc_id) AS articles FROM tokens JOIN lexicon USING (name) WHERE name <> '' GROUP BY name""",
    "indicator_mix": """WITH c AS (SELECT c_custkey AS k, lower(replace(c_name, '#', '-')) AS n, (c_custkey % 256) || '.' || ((c_custkey // 256) % 256) || '.7' AS o FROM customer),
v AS (SELECT k, unnest([
  {'t': 'domain', 'v': 'host.' || n || '.com'}, {'t': 'domain', 'v': 'cdn.' || n || '.org'}, {'t': 'url', 'v': 'https://' || n || '.net/a/' || k},
  {'t': 'url', 'v': 'http://' || n || '.net/b'}, {'t': 'file', 'v': n || '.exe'}, {'t': 'email', 'v': n || '@mail.example.org'}, {'t': 'cve', 'v': 'CVE-2021-' || (10000 + k)},
  {'t': 'md5', 'v': md5(n)}, {'t': 'sha1', 'v': sha1(n)}, {'t': 'sha256', 'v': upper(sha256(n))}, {'t': 'ipv4', 'v': '11.' || o}]) AS x FROM c)
SELECT k AS article_idx, x.t AS ioc_type, x.v AS ioc_value FROM v""",
    "refang_cases": f"""WITH m AS (SELECT page_id, (['url', 'domain', 'email', 'ipv4', 'file'])[page_id % 5 + 1] AS kind,
  replace(replace(replace(url, '.', '[.]'), 'http', 'hxxp'), '://', '[:]//') || '[@]x y.' AS raw FROM pages),
p AS (SELECT page_id, kind, {_PLAIN} AS v FROM m)
SELECT page_id, kind, CASE WHEN kind = 'ipv4' THEN replace(v, ' ', '.')
  WHEN kind = 'email' THEN regexp_replace(rtrim(replace(v, '[@]', '@'), '.'), '^hxxp', 'http')
  WHEN kind IN ('url', 'domain') THEN regexp_replace(rtrim(v, '.'), '^hxxp', 'http') ELSE v END AS refanged FROM p""",
    "name_normalize": """WITH n AS (SELECT c_custkey, c_name || '- ' || c_mktsegment AS name, c_name, c_mktsegment FROM customer)
SELECT c_custkey, replace(replace(lower(name), '-', ''), ' ', '') AS name_key,
  regexp_replace(replace(c_name, '#', ''), '^([a-zA-Z]+)(\\d+)$', '\\1 \\2') AS variation,
  c_name || '- ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS title FROM n""",
    "filename_sanitize": f"SELECT page_id, {_file_name('url', 40)} AS file_name FROM pages",
    "url_host": f"""WITH u AS (SELECT page_id, url, {_HOST.format('url')} AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, regexp_extract(url, '#(.*)$', 1) AS fragment, regexp_extract(url, '^([a-z]+)://', 1) || '://' || host ||
  CASE WHEN path LIKE '%/' THEN regexp_replace(path, '[^/]+/$', '') ELSE regexp_replace(path, '[^/]+/[^/]*$', '') END || 'a/b.html?q=1' AS resolved FROM u""",
    "country_name_cases": """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'DR Congo' WHEN 1 THEN 'Republic of the Congo' WHEN 2 THEN 'South Korea'
  WHEN 3 THEN 'North Korea' WHEN 4 THEN 'British Virgin Islands' WHEN 5 THEN 'U.S. Virgin Islands' ELSE c_name END AS country_name FROM customer""",
    "actor_alias_match": """WITH made AS (SELECT DISTINCT 'New-Group ' || l_returnflag || l_linenumber AS v FROM lineitem)
SELECT DISTINCT 'resolved' AS outcome, 'sup ' || l_suppkey AS value, s_name AS actor_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
UNION ALL SELECT 'resolved', 'any-supplier', arg_min(s_name, s_suppkey) FROM supplier
UNION ALL SELECT 'resolved', v, v FROM made UNION ALL SELECT 'added', v, v FROM made""",
    "actor_lexicon_keys": """SELECT lower(s_name) AS name, s_name AS canonical FROM supplier
UNION ALL SELECT 'sup-' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'any supplier', arg_max(s_name, s_suppkey) FROM supplier""",
    "country_match": """WITH m AS (SELECT c_name, 'nation_' || (c_nationkey + length(c_mktsegment) - 8) AS v FROM customer)
SELECT c_name AS ioc_value, v AS value, CAST(n_nationkey AS VARCHAR) AS iso2_code FROM m LEFT JOIN nation ON lower(n_name) = v""",
    "rescan_filter": f"""WITH {_HISTORY} SELECT url FROM history WHERE last_scanned < TIMESTAMP '2024-01-01 09:00:00'""",
    "scan_history_upsert": f"""WITH {_HISTORY}, scanned AS (SELECT DISTINCT 'https://' || source || '.example.com/' || lang AS url FROM documents)
SELECT url, {_TEXT.format('last_scanned')} AS last_scanned FROM history WHERE url NOT IN (SELECT url FROM scanned)
UNION ALL SELECT url, '2024-01-31 00:00:00' FROM scanned""",
    "scan_history_search": f"""WITH {_HISTORY} SELECT url, {_TEXT.format('last_scanned')} AS last_scanned FROM history
WHERE url ILIKE '%EXAMPLE.com%' AND url ILIKE '%/en/%'""",
    "scan_history_sorted": f"WITH {_HISTORY} SELECT url, {_TEXT.format('last_scanned')} AS last_scanned FROM history ORDER BY lower(url), url",
    "scan_history_prefix": f"""WITH {_HISTORY} SELECT url, {_TEXT.format('last_scanned')} AS last_scanned FROM history WHERE url ILIKE 'https://blog.%'""",
    "scanned_domains": f"SELECT 'Alle' AS domain UNION ALL SELECT DISTINCT {_HOST.format('url')} FROM pages",
    "known_and_new_urls": f"""WITH {_HISTORY} SELECT url, CASE WHEN last_scanned < TIMESTAMP '2024-01-01 09:00:00' THEN 'known' ELSE 'new' END AS state FROM history""",
    "link_filter": f"WITH {_ANCHORS} SELECT page_id, url, link_text, score FROM scored",
    "link_score": f"WITH {_ANCHORS} SELECT DISTINCT source_url, url FROM scored WHERE score >= 1",
    "link_areas": """SELECT page_id, source_url, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS link_text FROM (
  SELECT page_id, url AS source_url, unnest(regexp_extract_all(CASE WHEN html LIKE '%<nav>%' THEN regexp_extract(html, '(?s)<nav>(.*)</nav>', 1) ELSE html END,
    '<a href="[^"]*">[^<]*</a>')) AS a FROM pages)""",
    "feed_or_page_links": f"""WITH {_ANCHORS}, f AS (SELECT DISTINCT url FROM pages WHERE url LIKE 'https:%')
SELECT url FROM f UNION SELECT url || '/2' FROM f UNION SELECT url FROM scored WHERE score >= 1 AND source_url NOT LIKE 'https:%'""",
    "monthly_iocs": "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(DISTINCT l_partkey) AS ioc_count FROM lineitem GROUP BY month",
    "monthly_sightings": "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS sighting_count FROM lineitem GROUP BY month",
    "monthly_series": """WITH c AS (SELECT CAST(unnest(generate_series(DATE '1999-12-01', DATE '2001-11-01', INTERVAL 1 MONTH)) AS DATE) AS d),
n AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(DISTINCT l_partkey) AS i, count(*) AS s FROM lineitem GROUP BY month)
SELECT strftime(d, '%Y-%m') AS month, strftime(d, '%b %y') AS label, coalesce(i, 0) AS ioc_count, coalesce(s, 0) AS sighting_count
FROM c LEFT JOIN n ON n.month = strftime(d, '%Y-%m') ORDER BY month""",
    "ioc_top_types": "SELECT lower(p_type) AS type, count(*) AS ioc_count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7",
    "top_actors": """SELECT s_name, count(*) AS sighting_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name ORDER BY 2 DESC, 1 LIMIT 5""",
    "top_countries": """SELECT n_name, count(*) AS sighting_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY n_name ORDER BY 2 DESC, 1 LIMIT 5""",
    "top_sources": """SELECT 's' || l_suppkey || '.example.com' AS domain, count(*) AS sighting_count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "last_sighting_by_url": f"""SELECT 'https://s' || l_suppkey || '.example.com/feed' AS source_article_url, {_TEXT.format('max(l_shipdate)')} AS last_sighting
FROM lineitem WHERE CAST(l_suppkey AS VARCHAR) LIKE '1%' GROUP BY l_suppkey""",
    "ioc_search": """SELECT p_name || '-' || p_partkey AS value, lower(p_type) AS type, count(l_partkey) AS sources, coalesce(strftime(max(l_shipdate), '%Y-%m-%d'), 'N/A') AS last_sighting
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_type = 'ECONOMY' AND p_name || '-' || p_partkey ILIKE '%ring%' GROUP BY p_partkey, p_name, p_type""",
    "ioc_search_sorted": """SELECT p_name || '-' || p_partkey AS value, lower(p_type) AS type, count(l_partkey) AS sources, coalesce(strftime(max(l_shipdate), '%Y-%m-%d'), 'N/A') AS last_sighting
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_name, p_type""",
    "ioc_detail": f"""SELECT p_name || '-' || p_partkey AS value, lower(p_type) AS type, 'https://s' || l_suppkey || '.example.com/feed' AS source_article_url,
  {_TEXT.format('l_shipdate')} AS seen, s_name AS actors, n_name AS countries
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey WHERE p_partkey = 7""",
    "insert_if_absent": """SELECT n_nationkey AS iso2_code, n_name AS name FROM nation WHERE n_regionkey < 2
UNION ALL SELECT c_nationkey, min(c_name) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) GROUP BY c_nationkey""",
    "dim_upsert": """SELECT coalesce(c_custkey + 50, s_suppkey) AS mitre_id, coalesce(c_name, s_name) AS name, s_acctbal
FROM supplier FULL JOIN customer ON s_suppkey = c_custkey + 50""",
    "ioc_load": f"""WITH {_BATCH} SELECT 'ioc' AS kind, ioc_value AS item, CAST(1 AS INTEGER) AS n FROM iocs WHERE occurrence_count >= 30
UNION ALL SELECT 'sighting', url, CAST(count(*) AS INTEGER) FROM fresh GROUP BY url""",
    "sighting_bridge": f"""WITH {_BATCH}
SELECT CASE mention_type WHEN 'cve' THEN 'cve' WHEN 'country_mention' THEN 'country' ELSE 'actor' END AS kind,
  CASE WHEN mention_type = 'country_mention' THEN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_name = value) ELSE value END AS item, count(*) AS n
FROM fresh JOIN mentions USING (ioc_value, ioc_type) GROUP BY mention_type, value""",
    "false_positive_removal": """WITH kept AS (SELECT p_partkey FROM part WHERE p_size > 10), items AS (SELECT * FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM kept))
SELECT 'iocs' AS table_name, count(*) AS n FROM kept UNION ALL SELECT 'sightings', count(*) FROM items
UNION ALL SELECT 'sighting_actors', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM items)""",
    "whitelist_feedback": f"""WITH known AS (SELECT DISTINCT upper({_HOST.format('url')}) AS v FROM pages WHERE url LIKE 'https://www.%')
SELECT 'domains' AS kind, v AS value FROM known UNION ALL SELECT 'files', c_name FROM (SELECT DISTINCT c_name FROM customer)
UNION ALL SELECT 'domains', min({_HOST.format('url')}) FROM pages WHERE lower({_HOST.format('url')}) NOT IN (SELECT lower(v) FROM known) GROUP BY lower({_HOST.format('url')})""",
    "actor_table_page": "SELECT 'G' || s_suppkey AS mitre_id, s_name AS name, 'x' || s_suppkey || '|y & z' AS aliases, 'about' AS description FROM supplier",
    "country_table_page": "SELECT c_name AS name, 'EU' AS continent_code, CAST(c_custkey AS VARCHAR) AS iso2_code, 'I' || c_custkey AS iso3_code, '.tld' AS tld FROM customer",
    "tld_table_page": "SELECT DISTINCT lower(c_mktsegment) AS tld FROM customer",
    "csv_flat": f"""WITH {_BATCH} SELECT ioc_value, ioc_type, occurrence_count,
  (SELECT string_agg(url, '|' ORDER BY url) FROM sources s WHERE s.ioc_value = i.ioc_value AND s.ioc_type = i.ioc_type) AS source_article_urls,
  snippet AS first_seen_context_snippet, {_joined('cve')} AS associated_cves, {_joined('country_mention')} AS associated_countries,
  {_joined('apt_group_mention')} AS associated_apts, {_joined('apt_group_mention', 'upper(value)')} AS normalized_apts, CAST(0 AS INTEGER) AS part FROM iocs i""",
    "json_flat": f"""WITH {_BATCH} SELECT ioc_type || '_' || replace(ioc_value, ' ', '_') || '.json' AS file_key, occurrence_count,
  CAST((SELECT count(*) FROM sources s WHERE s.ioc_value = i.ioc_value AND s.ioc_type = i.ioc_type) AS INTEGER) AS urls,
  CAST({_of_ioc('apt_group_mention')} AS INTEGER) AS apts, CAST({_of_ioc('cve')} AS INTEGER) AS cves FROM iocs i""",
    "stix_objects": f"""WITH {_BATCH} SELECT type, label FROM observables
UNION ALL SELECT DISTINCT 'intrusion-set', upper(value) || '/' || value FROM mentions WHERE mention_type = 'apt_group_mention'
UNION ALL SELECT DISTINCT 'vulnerability', upper(value) FROM mentions WHERE mention_type = 'cve'
UNION ALL SELECT DISTINCT 'location', n_nationkey || '/' || upper(left(value, 1)) || lower(substr(value, 2)) FROM mentions JOIN nation ON n_name = value
  WHERE mention_type = 'country_mention'""",
    "stix_edges": f"""WITH {_BATCH} SELECT relationship_type, ioc_type, count(*) AS edges, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets
FROM edges GROUP BY relationship_type, ioc_type""",
    "stix_reports": f"""WITH {_BATCH} SELECT url, 'Report from ' || {_HOST.format('url')} AS name,
  'Threat intelligence report sourced from the article at ' || url || '.' AS description, '2024-01-31 00:00:00' AS published, CAST(count(*) AS INTEGER) AS refs
FROM sources GROUP BY url""",
    "stix_bundle_lines": f"""WITH {_BATCH}, o AS (SELECT type FROM observables
  UNION ALL SELECT 'intrusion-set' FROM (SELECT DISTINCT value FROM mentions WHERE mention_type = 'apt_group_mention')
  UNION ALL SELECT 'vulnerability' FROM (SELECT DISTINCT value FROM mentions WHERE mention_type = 'cve')
  UNION ALL SELECT 'location' FROM (SELECT DISTINCT value FROM mentions WHERE mention_type = 'country_mention')
  UNION ALL SELECT 'relationship' FROM edges UNION ALL SELECT 'report' FROM (SELECT DISTINCT url FROM sources))
SELECT type, count(*) AS objects, count(*) AS ids FROM o GROUP BY type""",
}
