"""The named queries again, as SQL for an independent engine.

Written against the raw benchmark tables only; nothing here is generated from
the Spark plans. Double literals carry an exponent, because a bare 0.1 is a
decimal.
"""

from __future__ import annotations


def uuid_of(text: str) -> str:
    m = f"md5({text})"
    return (
        f"substr({m},1,8)||'-'||substr({m},9,4)||'-'||substr({m},13,4)||'-'||substr({m},17,4)||'-'||substr({m},21,12)"
    )


def items(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


DEPTS = items(["finance", "hr", "legal", "engineering", "sales", "security"])
CLASSES = items(["PII", "financial", "policy", "internal", "public"])
RISKY = items(["bulk_download", "delete", "privilege_change"])
NORMAL = items(["read", "search", "download", "update"])
T0 = "2024-01-31T00:00:00.000000+00:00"

# --- building blocks (each a list of CTEs) ---------------------------------------------------

ACCESS = f"""
ev AS (
  SELECT event_id AS seq, ts, user_id AS u, event_type AS kind,
         CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k
  FROM events),
acc AS (
  SELECT seq, k, {uuid_of('CAST(seq AS VARCHAR)')} AS event_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS occurred_at,
    CAST(u AS VARCHAR) AS user_id,
    CASE WHEN u % 4 = 0 THEN 'manager' ELSE 'analyst' END AS role,
    {DEPTS}[u % 6 + 1] AS department,
    {DEPTS}[(u + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END) % 6 + 1] || '-' || lower({CLASSES}[k % 5 + 1]) || '-'
      || lpad(CAST(k % 5 + 1 AS VARCHAR), 3, '0') AS resource_id,
    {CLASSES}[k % 5 + 1] AS resource_class,
    CASE kind WHEN 'view' THEN 'read' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'download'
              WHEN 'signup' THEN 'update' ELSE {RISKY}[k % 3 + 1] END AS action,
    CASE WHEN k % 7 = 0 THEN '198.51.100.' || k ELSE '10.' || (u % 12 + 1) || '.0.' || k END AS source_ip,
    CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN 'unmanaged-' || k ELSE 'managed-' || u END AS device_id,
    CAST(NULL AS VARCHAR) AS session_id,
    kind = 'error' AS is_anomaly
  FROM ev)"""

DIRTY = f"""
dirty AS (
  SELECT * REPLACE (
    CASE WHEN k = 11 THEN '' WHEN k = 12 THEN 'not-a-uuid' ELSE event_id END AS event_id,
    CASE WHEN k = 21 THEN NULL WHEN k = 22 THEN 'format_disk' ELSE action END AS action,
    CASE WHEN k = 31 THEN 'secret' ELSE resource_class END AS resource_class,
    CASE WHEN k = 41 THEN '' ELSE user_id END AS user_id,
    CASE WHEN k = 51 THEN 'not-a-date' WHEN k = 52 THEN NULL ELSE occurred_at END AS occurred_at)
  FROM acc),
normal AS (
  SELECT * REPLACE (
    CASE WHEN coalesce(event_id, '') <> '' THEN event_id ELSE
      {uuid_of("concat_ws('|', 'event', 'events.parquet', 'access', coalesce(occurred_at, ''), coalesce(user_id, ''), coalesce(role, ''), coalesce(department, ''), coalesce(resource_id, ''), coalesce(resource_class, ''), coalesce(action, ''), coalesce(source_ip, ''), coalesce(device_id, ''), coalesce(session_id, ''), '', '')")}
      END AS event_id,
    CASE WHEN coalesce(occurred_at, '') <> '' THEN occurred_at ELSE '{T0}' END AS occurred_at)
  FROM dirty),
checked AS (
  SELECT *, concat_ws(',',
    CASE WHEN NOT regexp_full_match(event_id, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') THEN 'event_id' END,
    CASE WHEN coalesce(user_id, '') = '' THEN 'access.user_id' END,
    CASE WHEN coalesce(resource_class NOT IN ('PII','financial','policy','internal','public'), true) THEN 'access.resource_class' END,
    CASE WHEN coalesce(action NOT IN ('read','search','download','update','bulk_download','delete','privilege_change'), true) THEN 'access.action' END
  ) AS errors FROM normal)"""

RISK = """
risk AS (
  SELECT *, greatest(0e0, least(1e0,
      1e-1 + CASE WHEN action IN ('bulk_download','delete','privilege_change') THEN 6e-1 ELSE 0e0 END
      + CASE WHEN device_id IS NULL OR device_id LIKE 'unmanaged%' OR device_id = '' THEN 2e-1 ELSE 0e0 END
      + CASE WHEN CAST(substr(occurred_at, 12, 2) AS INT) < 6 OR CAST(substr(occurred_at, 12, 2) AS INT) >= 22
             THEN 2e-1 ELSE 0e0 END)) AS r
  FROM acc),
scored AS (
  SELECT *, round(least(1e0, r + 5e-2), 4) AS iso, round(greatest(0e0, r - 5e-2), 4) AS lstm, round(r, 4) AS fused
  FROM risk)"""

CONTENT = f"""
doc AS (
  SELECT {uuid_of("concat_ws('|', 'doc', CAST(doc_id AS VARCHAR))")} AS event_id,
    'doc-' || doc_id AS document_id, text, md5(text) AS text_md5, doc_id AS seq,
    CASE WHEN contains(lower(text), '@') OR contains(lower(text), '+1 (') THEN 'PII'
         WHEN contains(lower(text), '|') THEN 'financial'
         WHEN contains(lower(text), 'license') THEN 'policy' ELSE 'internal' END AS cls
  FROM documents WHERE text <> '')"""

BLOCK = "action = 'bulk_download' AND resource_class IN ('PII','financial')"
PRIV = "action = 'privilege_change'"
DEL = "action = 'delete' AND resource_class IN ('PII','financial','policy')"
X_BLOCK = "Bulk export of sensitive data blocked (GDPR Art.32; ISO 27001 A.8)."
X_PRIV = "Privilege change is a sensitive access-control event (ISO 27001 A.9)."
X_DEL = "Deletion of sensitive/governed data (ISO 27001 A.8; GDPR Art.5)."
X_HIGH = "Fused anomaly score >= 0.8 indicates high-risk access (ISO 27001 A.12)."
X_MED = "Fused anomaly score >= 0.5 warrants review (ISO 27001 A.12)."
X_PII = "PII detected in content; review required (GDPR Art.5/32)."
X_FIN = "Financial content flagged for handling controls (ISO 27001 A.8)."
X_NONE = "No governance rule triggered."

DECISIONS = f"""
acc_rules AS (
  SELECT *, concat_ws(',',
      CASE WHEN {BLOCK} THEN 'ACC-BULK-SENSITIVE' END, CASE WHEN {PRIV} THEN 'ACC-PRIV-CHANGE' END,
      CASE WHEN {DEL} THEN 'ACC-DELETE-SENSITIVE' END, CASE WHEN fused >= 8e-1 THEN 'ACC-HIGH-ANOMALY' END,
      CASE WHEN fused >= 5e-1 THEN 'ACC-MED-ANOMALY' END) AS fired,
    concat_ws(' ', CASE WHEN {BLOCK} THEN '{X_BLOCK}' END, CASE WHEN {PRIV} THEN '{X_PRIV}' END,
      CASE WHEN {DEL} THEN '{X_DEL}' END, CASE WHEN fused >= 8e-1 THEN '{X_HIGH}' END,
      CASE WHEN fused >= 5e-1 THEN '{X_MED}' END) AS said,
    CASE WHEN {BLOCK} THEN 'block' WHEN {PRIV} OR ({DEL}) OR fused >= 8e-1 THEN 'alert'
         WHEN fused >= 5e-1 THEN 'flag' ELSE 'allow' END AS verdict
  FROM scored),
made AS (
  SELECT 'access' AS plane, event_id, occurred_at AS decided_at, verdict AS action,
    CASE WHEN fired = '' THEN ['default-allow'] ELSE string_split(fired, ',') END AS rule_ids,
    CASE WHEN fired = '' THEN '{X_NONE}' ELSE said END AS explanation,
    CAST(NULL AS VARCHAR) AS content_class, CAST(NULL AS DOUBLE) AS content_confidence,
    iso AS isolation_forest_score, lstm AS lstm_score, fused AS fused_anomaly_score,
    {uuid_of("concat_ws('|', 'decision', event_id, 'events.parquet', occurred_at, user_id, role, department, resource_id, resource_class, action, source_ip, coalesce(device_id, ''), '', '', '', '')")} AS decision_id
  FROM acc_rules
  UNION ALL
  SELECT 'content', event_id, '{T0}',
    CASE WHEN cls IN ('PII', 'financial') THEN 'flag' ELSE 'allow' END,
    [CASE cls WHEN 'PII' THEN 'CONT-PII' WHEN 'financial' THEN 'CONT-FINANCIAL' ELSE 'default-allow' END],
    CASE cls WHEN 'PII' THEN '{X_PII}' WHEN 'financial' THEN '{X_FIN}' ELSE '{X_NONE}' END,
    cls, CASE WHEN cls = 'internal' THEN 5e-1 ELSE 6e-1 END, NULL, NULL, NULL,
    {uuid_of(f"concat_ws('|', 'decision', event_id, 'documents.parquet', '{T0}', '', '', '', '', '', '', '', '', '', document_id, text_md5, '')")}
  FROM doc),
dec AS (
  SELECT *, sha256(concat_ws('|', decision_id, event_id, decided_at, action, array_to_string(rule_ids, ','))) AS tx,
    substr(decision_id, 36, 1) < '8' AS recorded
  FROM made)"""

ALL = f"{ACCESS}, {RISK}, {CONTENT}, {DECISIONS}"
REFS = """
refs(rule_id, reference) AS (VALUES
  ('CONT-PII','GDPR-Art-5'), ('CONT-PII','GDPR-Art-32'), ('CONT-PII','ISO-27001-A.8'),
  ('CONT-FINANCIAL','ISO-27001-A.8'), ('ACC-PRIV-CHANGE','ISO-27001-A.9'),
  ('ACC-BULK-SENSITIVE','GDPR-Art-32'), ('ACC-BULK-SENSITIVE','ISO-27001-A.8'),
  ('ACC-DELETE-SENSITIVE','ISO-27001-A.8'), ('ACC-DELETE-SENSITIVE','GDPR-Art-5'),
  ('ACC-HIGH-ANOMALY','ISO-27001-A.12'), ('ACC-MED-ANOMALY','ISO-27001-A.12'))"""
FREQ = "freq AS (SELECT r AS rule_id, count(*) AS n FROM (SELECT unnest(rule_ids) AS r FROM dec) GROUP BY r)"
BATCH = """
batch AS (
  SELECT * REPLACE (CASE WHEN substr(decision_id, 1, 2) = '00' THEN NULL ELSE decision_id END AS decision_id),
    unnest(CASE WHEN substr(decision_id, 1, 1) = '3' THEN [0, 1] ELSE [0] END) AS copy
  FROM dec)"""

ACTIONS = "(VALUES ('allow'), ('flag'), ('alert'), ('block')) AS a(action)"
SHOWN_CASE = "substr(replace(decided_at, 'T', ' '), 1, 19)"


def ratio(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) = 0 THEN 0e0 ELSE round(CAST({n} AS DOUBLE) / ({d}), 4) END"


def rates() -> str:
    return (
        f"{ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall_detection_rate, "
        f"{ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {ratio('fp', 'fp + tn')} AS false_positive_rate"
    )


LEDGER_TEXT = """'"ledger":{"chaincode":"governance","channel":"governance","transaction_id":"'
      || CASE WHEN recorded THEN tx ELSE '' END || '"},'"""


def decision_text(ledger: str, d: str = "") -> str:
    """A decision as compact JSON with sorted keys; absent members are left out."""

    def member(name: str) -> str:
        return f"coalesce('\"{name}\":' || CAST({d}{name} AS VARCHAR), NULL)"

    signals = (
        f"concat_ws(',', '\"content_class\":\"' || {d}content_class || '\"', {member('content_confidence')}, "
        f"{member('fused_anomaly_score')}, {member('isolation_forest_score')}, {member('lstm_score')})"
    )
    return (
        f"""'{{"action":"' || {d}action || '","decided_at":"' || {d}decided_at || '","decision_id":"' || {d}decision_id
      || '","event_id":"' || {d}event_id || '","explanation":"' || {d}explanation || '",' || {ledger}
      || '"rule_ids":["' || array_to_string({d}rule_ids, '","') || '"],"signals":{{' || {signals} || '}}}}'"""
    )


RULE_OUT = "event_id, action, array_to_string(rule_ids, ',') AS rule_ids, explanation"
TOTALS = """
tot AS (
  SELECT count(*) AS n, count(*) FILTER (action IN ('flag','alert','block')) AS enf,
    count(*) FILTER (recorded) AS rec, count(*) FILTER (action = 'allow') AS alw,
    count(*) FILTER (action IN ('alert','block')) AS open FROM dec)"""

# --- feature code, windows -------------------------------------------------------------------------

CODED = f"""
coded AS (
  SELECT *, CAST(substr(occurred_at, 12, 2) AS INT) AS hour,
    CASE WHEN device_id IS NULL OR device_id LIKE 'unmanaged%' THEN 1 ELSE 0 END AS unmanaged,
    CASE WHEN source_ip LIKE '10.%' THEN 0 ELSE 1 END AS external,
    CASE WHEN split_part(resource_id, '-', 1) <> department THEN 1 ELSE 0 END AS crossing,
    coalesce(list_position(['read','search','download','update','bulk_download','delete','privilege_change'], action), 0) AS ia,
    coalesce(list_position(['manager','analyst'], role), 0) AS ir,
    coalesce(list_position({DEPTS}, department), 0) AS id,
    coalesce(list_position({CLASSES}, resource_class), 0) AS ic
  FROM acc),
code AS (
  SELECT *, CAST(((((((ia * 3 + ir) * 7 + id) * 6 + ic) * 24 + hour) * 2 + unmanaged) * 2 + external) * 2 + crossing AS BIGINT) AS code
  FROM coded)"""
FRAME = "ORDER BY occurred_at, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW"

TRUTH = """
truth AS (
  SELECT event_id, iso AS isolation_forest_score, lstm AS lstm_score, fused AS fused_anomaly_score,
    (is_anomaly OR k % 9 = 4) AND k % 13 <> 5 AS truth
  FROM scored)"""


def auc(score: str, source: str, by: str = "") -> str:
    """Rank-sum area with average ranks for ties."""
    part = f"PARTITION BY {by} " if by else ""
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
  SELECT {cols}(sum(CASE WHEN truth THEN rk END) - count(*) FILTER (truth) * (count(*) FILTER (truth) + 1) / 2e0)
      / (CAST(count(*) FILTER (truth) AS DOUBLE) * count(*) FILTER (NOT truth)) AS roc_auc
  FROM (SELECT *, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {cols}{score}) - 1) / 2e0 AS rk FROM {source})
  {group}"""


SWEEP = f"""
grid AS (
  SELECT w / 10e0 AS weight, t / 100e0 AS threshold
  FROM range(0, 11) a(w), range(5, 96) b(t)),
cells AS (
  SELECT weight, threshold,
    count(*) FILTER (hit AND truth) AS tp, count(*) FILTER (hit AND NOT truth) AS fp,
    count(*) FILTER (NOT hit AND NOT truth) AS tn, count(*) FILTER (NOT hit AND truth) AS fn
  FROM (SELECT weight, threshold, truth,
          greatest(0e0, least(1e0, weight * lstm_score + (1e0 - weight) * isolation_forest_score)) >= threshold AS hit
        FROM truth, grid)
  GROUP BY weight, threshold)"""

# --- documents ----------------------------------------------------------------------------------------

WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def norm(t: str) -> str:
    return f"regexp_replace(lower({strip(t)}), '{WS}+', ' ', 'g')"


def signature(t: str) -> str:
    spaced = f"regexp_replace({norm(t)}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')"
    return f"sha1(array_to_string(string_split(trim({spaced}), ' ')[1:10], ' '))"


SIGNED = f"""
signed AS (
  SELECT doc_id, lang, text, {signature('text')} AS signature FROM documents WHERE {strip('text')} <> '')"""

CANDIDATES = """
cand AS (
  SELECT model, truth, predicted FROM (
    SELECT CAST(quality AS VARCHAR) AS truth, CASE WHEN n_chars >= 400 THEN '1' ELSE '0' END AS a,
           CASE WHEN lang = 'en' THEN '1' ELSE '0' END AS b
    FROM documents JOIN labels USING (doc_id)) x,
  LATERAL (VALUES ('by_length', a), ('by_language', b)) v(model, predicted)),
labs AS (SELECT DISTINCT model, l FROM (SELECT model, truth AS l FROM cand UNION SELECT model, predicted FROM cand)),
per AS (
  SELECT labs.model, l, count(*) FILTER (truth = l AND predicted = l) AS tp,
    count(*) FILTER (truth = l) AS actual, count(*) FILTER (predicted = l) AS called
  FROM labs JOIN cand ON labs.model = cand.model GROUP BY labs.model, l),
prf AS (
  SELECT *, CASE WHEN called > 0 THEN tp / CAST(called AS DOUBLE) ELSE 0e0 END AS p,
    CASE WHEN actual > 0 THEN tp / CAST(actual AS DOUBLE) ELSE 0e0 END AS r,
    CASE WHEN actual + called > 0 THEN 2e0 * tp / (actual + called) ELSE 0e0 END AS f FROM per),
rep AS (
  SELECT model, CAST(sum(actual) AS BIGINT) AS eval_count, round(sum(tp) / CAST(sum(actual) AS DOUBLE), 4) AS accuracy,
    round(avg(p), 4) AS macro_precision, round(avg(r), 4) AS macro_recall, round(avg(f), 4) AS macro_f1
  FROM prf GROUP BY model)"""


# --- isolation forest ---------------------------------------------------------------------------------

TREES, SAMPLE, SEED, DEPTH = 200, 256, 740, 8
WANTED = 333  # rows offered to a tree


def drawn(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT)"


def digit(below: int, radix: int) -> str:
    return f"(code // {below}) % {radix}"


# a code's digits, as positions in vocabularies (0: not in it), the hour and three flags
A, R, D, C, H = digit(24192, 8), digit(8064, 3), digit(1152, 7), digit(192, 6), digit(8, 24)
FEATURES = ", ".join(
    [f"CASE WHEN {p} = {i} THEN 1 ELSE 0 END" for p, n in ((A, 7), (R, 2), (D, 6), (C, 5)) for i in range(1, n + 1)]
    + [f"{H} / 23e0", f"CASE WHEN {H} < 6 OR {H} >= 22 THEN 1 ELSE 0 END", digit(4, 2), digit(2, 2), digit(1, 2)]
)


def average(n: str) -> str:
    """Mean path length of an unsuccessful search among ``n`` points."""
    harmonic = f"2e0 * (ln({n} - 1e0) + 0.5772156649015329e0)"
    return f"CASE WHEN {n} <= 1 THEN 0e0 WHEN {n} = 2 THEN 1e0 ELSE {harmonic} - 2e0 * ({n} - 1e0) / {n} END"


def grown() -> str:
    """Trees level by level: every node's range of values, its drawn feature and cut."""
    levels = []
    for depth in range(DEPTH + 1):
        levels.append(f"""
range{depth} AS (
  SELECT tree, node, i, min(x) AS low, max(x) AS high, count(*) AS n FROM at{depth} JOIN vec USING (code) GROUP BY ALL),
cut{depth} AS MATERIALIZED (
  SELECT *, CASE WHEN feature >= 0 THEN lows[feature + 1] + (highs[feature + 1] - lows[feature + 1])
      * ({drawn(str(SEED), 'tree', 'node', "'cut'")} / 4294967296e0) ELSE 0e0 END AS cut
  FROM (SELECT tree, node, n, lows, highs, CASE WHEN {depth} >= most OR n <= 1 OR coalesce(len(varied), 0) = 0 THEN -1
      ELSE varied[{drawn(str(SEED), 'tree', 'node', "'feature'")} % len(varied) + 1] END AS feature
    FROM (SELECT tree, node, max(n) AS n, list(low ORDER BY i) AS lows, list(high ORDER BY i) AS highs,
        list(i ORDER BY i) FILTER (high > low) AS varied FROM range{depth} GROUP BY ALL) JOIN sizes USING (tree))),
at{depth + 1} AS MATERIALIZED (
  SELECT tree, code, 2 * node + CASE WHEN x <= cut THEN 1 ELSE 2 END AS node
  FROM at{depth} JOIN cut{depth} USING (tree, node) JOIN vec USING (code) WHERE i = feature)""")
    all_nodes = " UNION ALL ".join(f"SELECT {d} AS depth, * FROM cut{d}" for d in range(DEPTH + 1))
    return ",".join(levels) + f""",
nodes AS MATERIALIZED (
  SELECT tree, node, feature, cut, CASE WHEN feature < 0 THEN -1 ELSE 2 * node + 1 END AS "left",
    CASE WHEN feature < 0 THEN -1 ELSE 2 * node + 2 END AS "right",
    CASE WHEN feature < 0 THEN depth + ({average('n')}) ELSE 0e0 END AS length, sample
  FROM ({all_nodes}) JOIN sizes USING (tree))"""


def walks() -> str:
    steps = ["""
walk0 AS (SELECT code, tree, 0 AS node FROM (SELECT DISTINCT code FROM parts), (SELECT DISTINCT tree FROM sizes))"""]
    for depth in range(DEPTH):
        steps.append(f"""
walk{depth + 1} AS (
  SELECT code, tree, CASE WHEN feature < 0 THEN node WHEN x <= cut THEN "left" ELSE "right" END AS node
  FROM walk{depth} JOIN nodes USING (tree, node) LEFT JOIN vec ON vec.code = walk{depth}.code AND vec.i = feature)""".replace(
            "SELECT code, tree,", f"SELECT walk{depth}.code, tree,"
        ))
    return ",".join(steps)


FOREST = f"""
parts AS MATERIALIZED (
  SELECT event_id, code, CASE WHEN rn > n - CAST(floor(n * 2e-1) AS BIGINT) THEN 'validation' ELSE 'fit' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY seq) AS rn, count(*) OVER () AS n FROM code)),
vec AS MATERIALIZED (
  SELECT code, unnest(range(0, 25)) AS i, CAST(CAST(unnest([{FEATURES}]) AS FLOAT) AS DOUBLE) AS x FROM (SELECT DISTINCT code FROM parts)),
fit AS (SELECT event_id AS rid, code, count(*) OVER () AS n FROM parts WHERE split = 'fit'),
offered AS (
  SELECT rid, code, ({drawn(str(SEED + 1), 'rid')} % {TREES} + copy
      * list_filter(range(1, {TREES + 1}), lambda s: gcd(s, {TREES}) = 1)[{drawn(str(SEED + 2), 'rid')} % len(
        list_filter(range(1, {TREES + 1}), lambda s: gcd(s, {TREES}) = 1)) + 1]) % {TREES} AS tree
  FROM (SELECT *, unnest(range(0, least({TREES}, greatest(1, CAST(ceil({TREES * WANTED}e0 / n) AS BIGINT))))) AS copy FROM fit
    WHERE n <= {TREES * WANTED} OR {drawn(str(SEED), 'rid')} % 1000000 < ceil({TREES * WANTED}e0 / n * 1000000))),
at0 AS MATERIALIZED (
  SELECT tree, code, 0 AS node FROM offered
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY {drawn(str(SEED + 3), 'tree', 'rid')}, rid) <= {SAMPLE}),
sizes AS MATERIALIZED (
  SELECT tree, count(*) AS sample, length(bin(greatest(count(*), 2) - 1)) AS most FROM at0 GROUP BY tree),{grown()}"""


def oracle() -> dict[str, str]:
    access_cols = "event_id, user_id, role, department, resource_id, resource_class, action, source_ip, device_id, session_id"
    return {
        "governed_actions": f"""WITH {ALL} SELECT a.action, count(dec.action) AS n FROM {ACTIONS}
            LEFT JOIN dec ON dec.action = a.action GROUP BY a.action""",
        "normalized_access": f"""WITH {ACCESS}, {DIRTY} SELECT {access_cols}, 'access' AS event_type, 'access' AS data_plane,
            occurred_at, 'events.parquet' AS source FROM normal""",
        "normalized_content": f"""WITH {CONTENT} SELECT
            {uuid_of("concat_ws('|', 'event', 'documents.parquet', 'content', '', '', '', '', '', '', '', '', '', '', document_id, replace(replace(text, '\\', '\\\\'), '|', '\\|'))")} AS event_id,
            'content' AS event_type, 'content' AS data_plane, '{T0}' AS occurred_at, 'documents.parquet' AS source,
            document_id, text_md5 FROM doc""",
        "inferred_planes": f"""WITH {ACCESS}, {CONTENT} SELECT event_id AS id,
              k % 17 <> 0 AND k % 19 <> 0 AND k % 23 = 0 AS malformed,
              CASE WHEN k % 17 = 0 THEN 'content' WHEN k % 19 = 0 THEN 'content' WHEN k % 23 = 0 THEN NULL ELSE 'access' END AS plane
            FROM acc UNION ALL SELECT event_id, false, 'content' FROM doc""",
        "key_planes": """WITH raw AS (
              SELECT page_id, ['raw/access/','raw/content/','content/','RAW/ACCESS/','raw/','raw/access/content/'][page_id % 6 + 1]
                || replace(regexp_replace(url, '^https?://[^/]*/', ''), '=', '%3D+') AS enc FROM pages),
            keys AS (SELECT page_id, url_decode(replace(enc, '+', ' ')) AS key FROM raw),
            flags AS (SELECT page_id, key,
                contains(lower(key), '/access/') OR starts_with(lower(key), 'access/') AS a,
                contains(lower(key), '/content/') OR starts_with(lower(key), 'content/') AS c FROM keys)
            SELECT page_id, CASE WHEN a AND NOT c THEN 'access' WHEN c AND NOT a THEN 'content' END AS plane,
              regexp_replace(key, '^[^/]*/', '') AS output_key FROM flags""",
        "routed_planes": f"""WITH {ALL} SELECT plane AS data_plane, plane AS event_type, count(*) AS n,
            count(content_class) AS classified, count(fused_anomaly_score) AS scored FROM dec GROUP BY plane""",
        "event_contract": f"WITH {ACCESS}, {DIRTY} SELECT seq, errors FROM checked",
        "dead_letters": f"""WITH {ACCESS}, {DIRTY} SELECT reason, count(*) AS n FROM (
              SELECT unnest(string_split(errors, ',')) AS reason FROM checked WHERE errors <> ''
              UNION ALL SELECT 'empty text' FROM documents WHERE doc_id % 50 = 7 OR {strip('text')} = '') GROUP BY reason""",
        "decision_contract": f"""WITH {ALL} SELECT decision_id, concat_ws(',',
              CASE WHEN d = '5' THEN 'event_id' END, CASE WHEN d = '0' THEN 'action' END,
              CASE WHEN d = '2' THEN 'rule_ids.empty' END, CASE WHEN d = '3' THEN 'rule_ids.blank' END,
              CASE WHEN d = '1' THEN 'rule_ids.repeated' END,
              CASE WHEN d = '4' AND fused_anomaly_score + 1e0 > 1e0 THEN 'signals.fused_anomaly_score' END) AS errors
            FROM (SELECT *, substr(decision_id, 36, 1) AS d FROM dec)""",
        "decision_table": f"""WITH {ALL} SELECT decision_id, decided_at, {RULE_OUT}, content_class, content_confidence,
            isolation_forest_score, lstm_score, fused_anomaly_score, plane, recorded,
            CASE WHEN recorded THEN tx ELSE '' END AS transaction_id FROM dec""",
        "decision_display": f"""WITH {ALL} SELECT decision_id, {SHOWN_CASE} AS shown_at, action,
            array_to_string(rule_ids, ', ') AS rules,
            CASE WHEN content_class IS NOT NULL THEN content_class || ' (' || content_confidence || ')'
                 ELSE 'anomaly ' || regexp_replace(CAST(fused_anomaly_score AS VARCHAR), '\\.0$', '') END AS signal,
            CASE WHEN recorded THEN substr(tx, 1, 12) || '…' ELSE '—' END AS tx FROM dec""",
        "decision_json": f"WITH {ALL} SELECT decision_id, {decision_text(LEDGER_TEXT)} AS json FROM dec",
        "access_heuristic": f"""WITH {ACCESS}, {RISK} SELECT event_id, iso AS isolation_forest_score,
            lstm AS lstm_score, fused AS fused_anomaly_score FROM scored""",
        "keyword_classes": f"""WITH {CONTENT} SELECT document_id, cls AS content_class,
            CASE WHEN cls = 'internal' THEN 5e-1 ELSE 6e-1 END AS content_confidence FROM doc""",
        "rule_decisions": f"WITH {ALL} SELECT {RULE_OUT} FROM dec",
        "rule_rows_decisions": f"WITH {ALL} SELECT {RULE_OUT} FROM dec",
        "fallback_decisions": f"""WITH {ALL} SELECT event_id,
              CASE WHEN {PRIV} OR fused >= 8e-1 THEN 'alert' WHEN fused >= 5e-1 THEN 'flag' ELSE 'allow' END AS action,
              CASE WHEN {PRIV} THEN 'ACC-PRIV-CHANGE' WHEN fused >= 8e-1 THEN 'ACC-HIGH-ANOMALY'
                   WHEN fused >= 5e-1 THEN 'ACC-MED-ANOMALY' ELSE 'default-allow' END AS rule_ids,
              CASE WHEN {PRIV} THEN 'Privilege change is always alerted.' WHEN fused >= 8e-1 THEN 'Fused anomaly score >= 0.8.'
                   WHEN fused >= 5e-1 THEN 'Fused anomaly score >= 0.5.' ELSE 'No access rule triggered.' END AS explanation
            FROM scored
            UNION ALL SELECT event_id, CASE WHEN cls IN ('PII','financial') THEN 'flag' ELSE 'allow' END,
              CASE cls WHEN 'PII' THEN 'CONT-PII' WHEN 'financial' THEN 'CONT-FIN' ELSE 'default-allow' END,
              CASE cls WHEN 'PII' THEN 'PII content flagged for review.' WHEN 'financial' THEN 'Financial content flagged.'
                ELSE 'No content rule triggered.' END FROM doc""",
        "rule_references": f"WITH {ALL}, {REFS}, {FREQ} SELECT rule_id, reference FROM freq JOIN refs USING (rule_id)",
        "event_decision_pairs": f"""WITH {ALL}, whole AS (
              SELECT event_id, 'access' AS event_type, 'access' AS data_plane, occurred_at, 'events.parquet' AS source,
                user_id, role, department, resource_id, resource_class, action, source_ip, device_id, session_id,
                CAST(NULL AS VARCHAR) AS document_id, CAST(NULL AS VARCHAR) AS text_md5, CAST(NULL AS VARCHAR) AS label FROM acc
              UNION ALL SELECT event_id, 'content', 'content', '{T0}', 'documents.parquet',
                NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, document_id, text_md5, NULL FROM doc)
            SELECT whole.*, {decision_text(LEDGER_TEXT, 'dec.')} AS decision
            FROM whole JOIN dec ON dec.event_id = whole.event_id AND dec.plane = whole.data_plane""",
        "ledger_append": f"""WITH {ALL}, {BATCH} SELECT event_id, decision_id,
              CASE WHEN decision_id IS NULL THEN 'decision is missing decision_id'
                   WHEN recorded OR copy > 0 THEN 'decision already exists' ELSE 'accepted' END AS outcome,
              CASE WHEN decision_id IS NOT NULL AND NOT recorded AND copy = 0 THEN tx END AS tx_id FROM batch""",
        "ledger_scan": f"""WITH {ALL} SELECT decision_id, action, decided_at, tx AS transaction_id,
            'governance' AS channel FROM dec WHERE recorded ORDER BY decision_id""",
        "ledger_lookup": f"""WITH {ALL} SELECT decision_id, CASE WHEN recorded THEN action END AS action,
            CASE WHEN recorded THEN tx END AS ledger_tx_id, recorded AS found FROM dec""",
        "ledger_exists": f"WITH {ALL} SELECT decision_id FROM dec WHERE recorded",
        "ledger_history": f"""WITH {ALL} SELECT decision_id, tx AS tx_id, decided_at AS timestamp, false AS is_delete,
            {decision_text("'\"ledger_tx_id\":\"' || tx || '\",'")} AS value FROM dec WHERE recorded""",
        "metric_totals": f"""WITH {ALL}, {TOTALS} SELECT n AS decisions, enf AS enforced, rec AS ledger_recorded, open AS open_alerts,
            {ratio('enf', 'n')} AS enforcement_rate, {ratio('rec', 'n')} AS ledger_coverage, {ratio('alw', 'n')} AS allow_rate FROM tot""",
        "metric_actions": f"""WITH {ALL} SELECT a.action, count(dec.action) AS n FROM {ACTIONS}
            LEFT JOIN dec ON dec.action = a.action GROUP BY a.action""",
        "metric_planes": f"WITH {ALL} SELECT plane, count(*) AS n FROM dec GROUP BY plane",
        "metric_breakdown": f"""WITH {ALL} SELECT 'total' AS panel, 'all' AS name, count(*) AS n FROM dec
            UNION ALL SELECT 'action', action, count(*) FROM dec GROUP BY action
            UNION ALL SELECT 'plane', plane, count(*) FROM dec GROUP BY plane""",
        "metric_grouping_sets": f"""WITH {ALL} SELECT action, plane, count(*) AS n, CAST(grouping(action, plane) AS BIGINT) AS level
            FROM dec GROUP BY GROUPING SETS ((action), (plane), ())""",
        "metric_indicators": f"""WITH {ALL}, {TOTALS} SELECT 'SDG9_infrastructure' AS indicator, CASE WHEN n > 0 THEN 1e0 ELSE 0e0 END AS score,
              'Automated digital infrastructure' AS label FROM tot
            UNION ALL SELECT 'SDG13_digital_sustainability', {ratio('enf', 'n')}, 'Digital sustainability (self-enforcement)' FROM tot
            UNION ALL SELECT 'SDG16_accountability', {ratio('(rec + enf)', '2 * n')}, 'Institutional accountability' FROM tot
            UNION ALL SELECT 'SDG17_verifiable_sharing', {ratio('rec', 'n')}, 'Verifiable cross-org data governance' FROM tot""",
        "rule_frequency": f"WITH {ALL}, {FREQ} SELECT * FROM freq",
        "top_rules": f"WITH {ALL}, {FREQ} SELECT * FROM freq ORDER BY n DESC, rule_id LIMIT 10",
        "compliance_hits": f"""WITH {ALL}, {REFS}, {FREQ} SELECT split_part(reference, '-', 1) AS framework,
            CAST(sum(n) AS BIGINT) AS n FROM freq JOIN refs USING (rule_id) GROUP BY 1""",
        "recent_decisions": f"""WITH {ALL} SELECT decision_id, decided_at, action FROM dec
            ORDER BY decided_at DESC, decision_id LIMIT 50""",
        "latest_alerts": f"""WITH {ALL} SELECT decision_id, action, array_to_string(rule_ids, ',') AS rule_ids, decided_at,
            explanation, recorded FROM dec WHERE action IN ('alert','block') ORDER BY decided_at DESC, decision_id LIMIT 20""",
        "alert_view": f"""WITH {ALL} SELECT decision_id, action, array_to_string(rule_ids, ', ') AS rules, explanation,
            {SHOWN_CASE} AS shown_at, CASE WHEN recorded THEN '✓ recorded on ledger' ELSE 'not recorded' END AS audit
            FROM (SELECT * FROM dec WHERE action IN ('alert','block') ORDER BY decided_at DESC, decision_id LIMIT 20)""",
        "run_summary": f"""WITH {ACCESS}, {DIRTY} SELECT substr(occurred_at, 1, 10) AS run_id, count(*) FILTER (errors = '') AS processed,
            count(*) FILTER (errors <> '') AS errors FROM checked GROUP BY 1""",
        "batch_summary": f"""WITH {ALL} SELECT CASE plane WHEN 'access' THEN 'events.parquet' ELSE 'documents.parquet' END AS key,
            plane, count(*) AS records FROM dec GROUP BY plane""",
        "anomaly_counts": f"WITH {ACCESS} SELECT is_anomaly, count(*) AS n FROM acc GROUP BY 1",
        "access_features": f"""WITH {ACCESS}, {CODED} SELECT event_id, CAST(is_anomaly AS INT) AS y, split_part(resource_id, '-', 1) AS resource_department, code,
              rpad(repeat('0', ia - 1) || '1', 7, '0') || rpad(repeat('0', ir - 1) || '1', 2, '0')
              || rpad(repeat('0', id - 1) || '1', 6, '0') || rpad(repeat('0', ic - 1) || '1', 5, '0') AS one_hots,
              round(hour / 23e0, 4) AS hour_norm, CASE WHEN hour < 6 OR hour >= 22 THEN 1 ELSE 0 END AS off_hours,
              unmanaged AS unmanaged_device, external AS external_ip, crossing AS cross_department FROM code""",
        "score_fusion": f"""WITH {ACCESS}, {RISK} SELECT event_id,
              round(greatest(0e0, least(1e0, 8e-1 * lstm + (1e0 - 8e-1) * iso)), 4) AS fused,
              round(greatest(0e0, least(1e0, (iso - 2e-1) / (9e-1 - 2e-1))), 4) AS scaled,
              round(greatest(0e0, least(1e0, (iso - 5e-1) / 1e0)), 4) AS flat,
              greatest(0e0, least(1e0, iso * 2 - 5e-1)) AS clipped FROM scored""",
        "user_sequences": f"""WITH {ACCESS}, {CODED} SELECT event_id, count(*) OVER w AS size, first_value(code) OVER w AS oldest, code AS newest,
              CAST(sum(code) OVER w AS BIGINT) AS total, array_to_string(list(code) OVER w, ',') AS codes
            FROM code WINDOW w AS (PARTITION BY user_id {FRAME})""",
        "positional_split": f"""WITH {ACCESS} SELECT seq, is_anomaly,
              CASE WHEN rn > n - CAST(floor(n * 2e-1) AS BIGINT) THEN 'validation' ELSE 'fit' END AS split
            FROM (SELECT *, row_number() OVER (ORDER BY seq) AS rn, count(*) OVER () AS n FROM acc)""",
        "split_sequences": f"""WITH {ACCESS}, {CODED}, parts AS (
              SELECT *, CASE WHEN rn > n - CAST(floor(n * 2e-1) AS BIGINT) THEN 'validation' ELSE 'fit' END AS split
              FROM (SELECT *, row_number() OVER (ORDER BY seq) AS rn, count(*) OVER () AS n FROM code))
            SELECT event_id, split, array_to_string(list(code) OVER (PARTITION BY user_id, split {FRAME}), ',') AS codes FROM parts""",
        "confusion_rates": f"""WITH {ACCESS}, {RISK}, {TRUTH}, c AS (
              SELECT count(*) FILTER (h AND truth) AS tp, count(*) FILTER (h AND NOT truth) AS fp,
                count(*) FILTER (NOT h AND NOT truth) AS tn, count(*) FILTER (NOT h AND truth) AS fn
              FROM (SELECT truth, fused_anomaly_score >= 5e-1 AS h FROM truth))
            SELECT *, {rates()} FROM c""",
        "roc_area": f"""WITH {ACCESS}, {RISK}, {TRUTH}, a AS ({auc('isolation_forest_score', 'truth')})
            SELECT round(roc_auc, 9) AS roc_auc FROM a""",
        "class_weights": f"""WITH {ACCESS} SELECT count(*) FILTER (NOT is_anomaly) AS n_neg, count(*) FILTER (is_anomaly) AS n_pos,
            count(*) FILTER (NOT is_anomaly) / CAST(greatest(count(*) FILTER (is_anomaly), 1) AS DOUBLE) AS positive_weight FROM acc""",
        "fusion_sweep": f"WITH {ACCESS}, {RISK}, {TRUTH}, {SWEEP} SELECT *, {rates()} FROM cells",
        "fusion_choice": f"""WITH {ACCESS}, {RISK}, {TRUTH}, {SWEEP} SELECT *, {rates()} FROM cells
            ORDER BY CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2e0 * tp / (2 * tp + fp + fn) END DESC, weight, threshold LIMIT 1""",
        "scorer_report": f"""WITH {ACCESS}, {RISK}, {TRUTH}, long AS (
              SELECT truth, scorer, score, score >= thr AS h FROM truth, LATERAL (VALUES
                ('isolation_forest', isolation_forest_score, 39e-2), ('lstm', lstm_score, 6e-1),
                ('fused', fused_anomaly_score, 5e-1)) v(scorer, score, thr)),
            c AS (SELECT scorer, count(*) FILTER (h AND truth) AS tp, count(*) FILTER (h AND NOT truth) AS fp,
                count(*) FILTER (NOT h AND NOT truth) AS tn, count(*) FILTER (NOT h AND truth) AS fn FROM long GROUP BY scorer),
            a AS ({auc('score', 'long', 'scorer')})
            SELECT c.*, {rates()}, round(roc_auc, 4) AS roc_auc FROM c JOIN a USING (scorer)""",
        "multiclass_report": f"WITH {CANDIDATES} SELECT * FROM rep",
        "class_f1": f"""WITH {CANDIDATES} SELECT model, coalesce(max(round(f, 4)) FILTER (l = '0'), 0e0) AS "0",
            coalesce(max(round(f, 4)) FILTER (l = '1'), 0e0) AS "1", coalesce(max(round(f, 4)) FILTER (l = '2'), 0e0) AS "2"
            FROM prf GROUP BY model""",
        "model_comparison": f"WITH {CANDIDATES} SELECT model, macro_f1 FROM rep ORDER BY macro_f1 DESC, model LIMIT 1",
        "text_signatures": f"""SELECT doc_id, md5({norm('text')}) AS norm_md5, {signature('text')} AS signature
            FROM documents WHERE {strip('text')} <> ''""",
        "deduped_documents": f"""WITH {SIGNED} SELECT doc_id, md5({strip('text')}) AS text_md5 FROM (
            SELECT *, row_number() OVER (PARTITION BY signature ORDER BY doc_id) AS rn FROM signed) WHERE rn = 1""",
        "leakage_removed": f"""WITH {SIGNED}, seen AS (
              SELECT signature FROM signed WHERE doc_id IN (SELECT doc_id FROM labels)
              UNION SELECT {signature('text')} FROM benchmark WHERE {strip('text')} <> '')
            SELECT doc_id FROM signed WHERE signature NOT IN (SELECT signature FROM seen)""",
        "balanced_classes": """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
            SELECT doc_id, lang FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))""",
        "forest_nodes": f"""WITH {ACCESS}, {CODED}, {FOREST} SELECT CAST(tree AS INT) AS tree, CAST(node AS INT) AS node,
              CAST(feature AS INT) AS feature, round(cut, 9) AS cut, CAST("left" AS INT) AS "left",
              CAST("right" AS INT) AS "right", round(length, 9) AS length, CAST(sample AS INT) AS sample FROM nodes""",
        "forest_scores": f"""WITH {ACCESS}, {CODED}, {FOREST}, {walks()},
            raw AS (
              SELECT code, pow(2e0, -avg(length) / (SELECT {average('max(sample)')} FROM sizes)) AS raw
              FROM walk{DEPTH} JOIN nodes USING (tree, node) GROUP BY code),
            ends AS (SELECT min(raw) AS low, max(raw) AS high FROM raw WHERE code IN (SELECT code FROM fit))
            SELECT event_id, split, round(greatest(0e0, least(1e0, (raw - low) / (high - low))), 4) AS isolation_forest_score
            FROM parts JOIN raw USING (code), ends""",
        "record_ids": """SELECT doc_id, 'llm-740-' || lpad(CAST(row_number() OVER (ORDER BY lang, doc_id) - 1 AS VARCHAR), 6, '0') AS document_id
            FROM documents""",
    }
