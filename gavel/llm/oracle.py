"""DuckDB SQL for the operators' queries, where SQL can express them.

Written from the definitions of the results alone; the rules' cutoffs are parameters.
"""

from __future__ import annotations

from gavel.llm.quality_rules import ERROR, FALSE_REJECTION, RULES

SPACED = r"'[^\x20\x09-\x0D]+'"
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tests() -> str:
    return ", ".join(
        f"('{rule}', {step}, {cutoff})" for rule, (_, _, cutoffs) in RULES.items() for step, cutoff in enumerate(cutoffs)
    )


def _value(rule: str) -> str:
    part, whole, _ = RULES[rule]
    return f"coalesce((1000 * {part}) // nullif({whole}, 0), 0)"


VALUE = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {_value(rule)}" for rule in RULES) + " END"
LIMIT = FALSE_REJECTION / len(RULES)

QUALITY = f"""
WITH d AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {SPACED})) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS n FROM (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS v
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN repeated USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
tests(rule, step, cutoff) AS (VALUES {_tests()}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
counts AS (
  SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER (WHERE {VALUE} > cutoff) AS k
  FROM (SELECT * FROM b WHERE NOT base_failed) b JOIN good USING (doc_id), tests GROUP BY ALL),
tried AS (
  SELECT *, k < n * {LIMIT} AND list_sum(list_transform(range(0, k + 1), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({LIMIT}) + (n - i) * ln(1 - {LIMIT}))))
    <= {ERROR} / {len(RULES)} / (SELECT count(DISTINCT coalesce(stratum, '?')) FROM counts) AS passed
  FROM counts),
stops AS (SELECT stratum, rule, min(step) FILTER (WHERE NOT passed) AS stop FROM tried GROUP BY ALL),
cuts AS (
  SELECT t.stratum, t.rule, min(t.cutoff) AS cutoff FROM tried t JOIN stops s
    ON t.stratum IS NOT DISTINCT FROM s.stratum AND t.rule = s.rule WHERE s.stop IS NULL OR t.step < s.stop GROUP BY ALL),
broken AS (
  SELECT DISTINCT doc_id FROM b JOIN cuts ON b.stratum IS NOT DISTINCT FROM cuts.stratum WHERE {VALUE} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept, n_lines, stratum
FROM b"""

DECONTAMINATION = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p:p + 9], ' ') AS v
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM patterns),
found AS (
  SELECT doc_id, p, s.size, item_id FROM (
    SELECT doc_id, s.size, p, array_to_string(w[p:p + s.size - 1], ' ') AS v
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM w, sizes WHERE len(w) >= size) s) s
  JOIN patterns ON patterns.size = s.size AND patterns.v = s.v),
hits AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLDED}, {SPACED}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS v
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.v = y.v AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, links.b FROM reach r JOIN links ON links.a = r.b),
least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)"""

EXACT_COPIES = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)"""


def _floor_mean(total: str, n: str) -> str:
    return f"CAST(({total} - (({total} % {n}) + {n}) % {n}) // {n} AS BIGINT)"


def _lloyd(rounds: int, by: str) -> str:
    """Assignments ``a0, a1, ...`` of the points ``v`` (rid, {by}i, x) to the centres ``c0``
    ({by}k, i, x), and the centres moved in between."""
    using = f"USING ({by}i)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (SELECT rid, {by}k, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{r} c {using} GROUP BY ALL),
a{r} AS MATERIALIZED (
  SELECT rid, {by}k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid{', part' if by else ''} ORDER BY d, k) = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT {by}k, i, {_floor_mean('sum(x)', 'count(*)')} AS x FROM a{r} JOIN v USING (rid{', part' if by else ''}) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT {by}k, i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING ({by}k, i))""")
    return ",".join(steps)


SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

CLUSTERS = f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND {SOUND}),
v AS MATERIALIZED (
  SELECT rid, unnest(range(1, 65)) AS i, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM e),
s AS (
  SELECT rid, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS k FROM e QUALIFY k < 40),
c0 AS MATERIALIZED (SELECT k, i, x FROM s JOIN v USING (rid)),{_lloyd(5, '')},
sums AS (SELECT k, sum(d) AS s FROM a5 GROUP BY k),
marks AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS mark FROM c5 GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sums.s AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(d) FROM a5) AS BIGINT) AS inertia, mark AS centroid_sha256
FROM a5 JOIN e USING (rid) JOIN sums USING (k) JOIN marks USING (k)"""

CODES = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings WHERE {SOUND}),
size AS (SELECT len(embedding) // 8 AS w FROM e ORDER BY vec_id LIMIT 1),
v AS MATERIALIZED (
  SELECT rid, (p - 1) // w AS part, (p - 1) % w AS i, x FROM (
    SELECT rid, unnest(range(1, len(embedding) + 1)) AS p,
      CAST(floor(4096 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM e), size),
s AS (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM e QUALIFY k < 16),
c0 AS MATERIALIZED (SELECT part, k, i, x FROM s JOIN v USING (rid)),{_lloyd(6, 'part, ')},
named AS (
  SELECT rid, string_agg(printf('%02x', k), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, k, i)) FROM c6) AS codebooks_sha256
FROM named JOIN e USING (rid)"""

ORACLE: dict[str, str] = {
    "op4_quality_rules": QUALITY,
    "op7_decontamination": DECONTAMINATION,
    "op9_ngram_jaccard": JACCARD,
    "op11_exact_dedup": EXACT_COPIES,
    "op12_centroid_clustering": CLUSTERS,
    "op13_vector_codes": CODES,
}
