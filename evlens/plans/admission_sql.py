"""DuckDB oracle text for the admission pipeline over the ``raw_requests`` fixture view.

Written independently of the Spark plan: the counters are replayed row by row
with recursive CTEs, the rules are spelled out as CASE expressions (generated
from the same fixed rule tables). Nested-metadata screening is applied to the
metadata text; the fixture's metadata holds no string values, so this equals
the value walk on these rows.
"""

from __future__ import annotations

from ..functions import text as X
from ..functions import useragent as UA
from ..sources.fixtures import oracle_with


def _re2(pattern: str) -> str:
    """Java regex text -> RE2 text for the few constructs that differ, as a SQL literal."""
    p = pattern.replace("\\z", "$")
    for code in ("00a0", "1680", "2000", "200a", "2028", "2029", "202f", "205f", "3000", "feff"):
        p = p.replace(f"\\u{code}", f"\\x{{{code}}}")
    return "'" + p.replace("'", "''") + "'"


def _sanitize(col: str) -> str:
    out = col
    for pattern, repl in X.SANITIZE_STEPS:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        out = f"regexp_replace({out}, {_re2(pattern.replace('(?i)', ''))}, '{repl}', '{flags}')"
    return out


def _inj(col: str) -> str:
    pats = "|".join(X.INJECTION_PATTERNS)
    return f"coalesce(regexp_matches({col}, {_re2(pats)}, 'i'), false)"


def _first_rule(rules, ua: str, value_of) -> str:
    whens = []
    for rule in rules:
        pattern = _re2(rule[0].replace("(?i)", ""))
        flags = ", 'i'" if rule[0].startswith("(?i)") else ""
        whens.append(f"WHEN regexp_matches({ua}, {pattern}{flags}) THEN {value_of(rule)}")
    return f"CASE {' '.join(whens)} ELSE 'Other' END"


def _browser_value(rule, ua: str) -> str:
    if rule[2] is None:
        return f"'{rule[1]}'"
    g1 = f"nullif(regexp_extract({ua}, {_re2(rule[2])}, 1), '')"
    g2 = f"nullif(regexp_extract({ua}, {_re2(rule[2])}, 2), '')" if rule[2].count("(") > 1 else "NULL"
    v = f"coalesce({g1}, {g2})"
    return f"CASE WHEN {v} IS NULL THEN '{rule[1]}' ELSE '{rule[1]} ' || {v} END"


def _js_or(*cols: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cols) + ")"


def _replay(name: str, src: str, key: str, ttl: int, limit_col: str) -> str:
    return f"""{name}_o AS (
  SELECT {key} AS k, received_at, {limit_col} AS lim,
         row_number() OVER (PARTITION BY {key} ORDER BY received_at) AS rn FROM {src}),
{name}_w AS (
  SELECT k, rn, received_at, lim, received_at AS s, CAST(1 AS BIGINT) AS c FROM {name}_o WHERE rn = 1
  UNION ALL
  SELECT o.k, o.rn, o.received_at, o.lim,
         CASE WHEN o.received_at > w.s + INTERVAL {ttl} SECOND THEN o.received_at ELSE w.s END,
         CASE WHEN o.received_at > w.s + INTERVAL {ttl} SECOND THEN 1 ELSE w.c + 1 END
  FROM {name}_w w JOIN {name}_o o ON o.k = w.k AND o.rn = w.rn + 1)"""


# Fixed values, written out so that a wrong constant in the operator shows: storage limits, the
# months provisioned as of 2024-01-31, and the collect limit that the fixture is scaled to.
VARCHAR_LIMITS = (("event_name", 255), ("device", 50), ("ip_address", 45), ("user_id", 255), ("session_id", 255),
                  ("browser", 100), ("os", 100), ("screen_size", 50), ("country", 2), ("city", 100))
MONTHS = ("2024-01", "2024-02", "2024-03", "2024-04", "2024-05", "2024-06", "2024-07", "2024-08", "2024-09", "2024-10",
          "2024-11", "2024-12", "2025-01", "2025-02")
COLLECT_LIMIT, COLLECT_TTL = 2, 86400


def admission_ctes(as_of: str, key_hour_ttl: int) -> str:
    months = ", ".join(f"'{m}'" for m in MONTHS)
    uaq = "nullif(q.user_agent, '')"
    body_scalar = ["event", "url", "referrer", "device", "ipAddress", "userId", "sessionId", "timestamp_text"]
    san = ",\n         ".join(f"{_sanitize('r.' + c)} AS {c}" for c in body_scalar)
    size = ("strlen(CAST(to_json({" + ", ".join(f"'{c}': r.{c}" for c in body_scalar) + "}) AS VARCHAR))"
            " + coalesce(strlen(r.metadata), 0) + coalesce(strlen(r.extra), 0)")
    inj = " OR ".join(_inj(f"q.{c}") for c in body_scalar + ["metadata"]) + " OR q.extra_hit"
    # Every string value of the further fields, at any depth, sanitised and screened by itself.
    extra_hit = (f"coalesce((SELECT bool_or({_inj(_sanitize('t.s'))}) FROM (SELECT json_extract_string(j.value, '$') AS s, j.type AS kind"
                 " FROM json_tree(r.extra) j) t WHERE t.kind = 'VARCHAR'), false)")
    agent_browser = _first_rule(UA.BROWSER_RULES, uaq, lambda r: _browser_value(r, uaq))
    agent_os = _first_rule(UA.OS_RULES, uaq, lambda r: f"'{r[1]}'")
    handheld = f"regexp_matches({uaq}, {_re2(UA.HANDHELD_PATTERN)})"
    mobile_or_desktop = f"CASE WHEN {handheld} THEN 'mobile' ELSE 'desktop' END"
    device_type = f"CASE WHEN {uaq} IS NOT NULL THEN {_js_or('q.device', mobile_or_desktop)} END"
    device_out = _js_or(device_type, "q.device")
    browser_out = _js_or(f"CASE WHEN {uaq} IS NOT NULL THEN {_js_or('q.mb', agent_browser)} END", "q.mb")
    os_out = _js_or(f"CASE WHEN {uaq} IS NOT NULL THEN {_js_or('q.mo', agent_os)} END", "q.mo")
    iso = _re2(X.ISO8601_PATTERN)
    name_ok = _re2(X.EVENT_NAME_PATTERN)
    return f"""
req AS (
  SELECT r.received_at, r.api_key, r.client_ip, r.user_agent, r.metadata,
         CASE WHEN json_valid(r.metadata) THEN r.metadata END AS meta,
         {size} AS body_bytes, {extra_hit} AS extra_hit,
         {san}
  FROM (SELECT *, CAST(NULL AS VARCHAR) AS referrer, CAST(NULL AS VARCHAR) AS device,
               CAST(NULL AS VARCHAR) AS ipAddress, CAST(NULL AS VARCHAR) AS sessionId FROM raw_requests) r),
keyed AS (
  SELECT q.*, k.id AS key_id, k.app_id AS key_app, k.is_active AS key_active, k.expires_at AS key_expires,
         k.allowed_ip AS key_ip, k.can_write AS key_write, k.rate_limit_per_hour AS key_limit,
         CASE WHEN q.body_bytes > 1048576 THEN 'too_large'
              WHEN q.metadata IS NOT NULL AND NOT json_valid(q.metadata) THEN 'malformed_body'
              WHEN {inj} THEN 'sql_pattern'
              WHEN q.api_key IS NULL OR q.api_key = '' THEN 'api_key_missing'
              WHEN k.id IS NULL OR NOT coalesce(k.is_active, false)
                   OR (k.expires_at IS NOT NULL AND k.expires_at < q.received_at) THEN 'api_key_invalid'
              WHEN k.allowed_ip IS NOT NULL AND k.allowed_ip <> q.client_ip AND k.allowed_ip <> '*'
                   THEN 'api_key_ip_blocked' END AS reason6
  FROM req q
  LEFT JOIN (SELECT ak.* FROM api_keys ak JOIN apps a ON ak.app_id = a.id) k
    ON q.api_key IS NOT NULL AND q.api_key <> '' AND k.key_hash = sha256(q.api_key)),
{_replay("c1", "(SELECT * FROM keyed WHERE reason6 IS NULL) x", "key_id", key_hour_ttl,
         f"coalesce(nullif(key_limit, 0), 10000)")},
step8 AS (
  SELECT q.*, coalesce(q.reason6,
           CASE WHEN w.c > w.lim THEN 'api_key_rate_limit' END,
           CASE WHEN NOT q.key_write THEN 'no_permission' END) AS reason8
  FROM keyed q LEFT JOIN c1_w w ON w.k = q.key_id AND w.received_at = q.received_at),
{_replay("c2", "(SELECT * FROM step8 WHERE reason8 IS NULL) x", "coalesce(nullif(api_key, ''), client_ip)", COLLECT_TTL,
         str(COLLECT_LIMIT))},
enriched AS (
  SELECT q.*, coalesce(q.reason8, CASE WHEN w.c > w.lim THEN 'collect_rate_limit' END) AS reason9,
         concat_ws(',',
           CASE WHEN q.event IS NULL OR q.event = '' THEN 'event_required' END,
           CASE WHEN length(q.event) > 255 THEN 'event_too_long' END,
           CASE WHEN NOT coalesce(regexp_matches(q.event, {name_ok}), false) THEN 'event_invalid_chars' END,
           CASE WHEN q.url IS NOT NULL AND length(q.url) > 2048 THEN 'url_too_long' END,
           CASE WHEN q.timestamp_text IS NOT NULL AND NOT coalesce(regexp_matches(q.timestamp_text, {iso}), false)
                THEN 'timestamp_invalid' END,
           CASE WHEN q.metadata IS NOT NULL AND coalesce(json_type(q.meta), '') <> 'OBJECT'
                THEN 'metadata_not_object' END) AS validation_errors,
         q.key_app AS app_id, q.event AS event_name,
         {device_out} AS device_out,
         {_js_or('q.ipAddress', 'q.client_ip')} AS ip_address,
         q.userId AS user_id, q.sessionId AS session_id,
         CASE WHEN nullif(q.timestamp_text, '') IS NULL THEN q.received_at
              ELSE TRY_CAST(q.timestamp_text AS TIMESTAMP) END AS ts,
         {browser_out} AS browser,
         {os_out} AS os,
         json_extract_string(q.meta, '$.screenSize') AS screen_size,
         json_extract_string(q.meta, '$.country') AS country,
         json_extract_string(q.meta, '$.city') AS city
  FROM (SELECT *, json_extract_string(meta, '$.browser') AS mb, json_extract_string(meta, '$.os') AS mo
        FROM step8) q
  LEFT JOIN c2_w w ON w.k = coalesce(nullif(q.api_key, ''), q.client_ip) AND w.received_at = q.received_at),
outcome AS (
  SELECT e.*, CASE WHEN e.reason9 IS NOT NULL THEN e.reason9
      WHEN e.validation_errors <> '' THEN 'validation'
      WHEN nullif(e.timestamp_text, '') IS NOT NULL AND e.ts IS NULL THEN 'constraint:timestamp'
      {" ".join(f"WHEN length({'e.device_out' if c == 'device' else 'e.ts' if c == 'timestamp' else 'e.' + c}) > {n} THEN 'constraint:{c}'" for c, n in VARCHAR_LIMITS)}
      WHEN strftime(e.ts, '%Y-%m') NOT IN ({months}) THEN 'no_partition' END AS reject_reason
  FROM enriched e)"""


def admission_oracle(select: str, as_of: str, key_hour_ttl: int) -> str:
    return oracle_with(select, "raw_requests", "api_keys", "apps", recursive=True,
                       more=admission_ctes(as_of, key_hour_ttl))
