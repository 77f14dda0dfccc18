"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from . import license_scan, quality_rules, secret_scan


def _sql(text: str) -> str:
    return text.replace("'", "''")


def quality_rules_sql() -> str:
    gap = r"[\x20\x09-\x0D]+"
    bits = " | ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality_rules.RULES)
    w = quality_rules.WINDOW
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{gap}'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{gap}', '', 'g') <> '') AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i + {w - 1}], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - {w - 2})) AS i FROM w WHERE len(words) >= {w})),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {w})) AS p FROM c WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '{gap}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
  length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_capitals, length(t) - length(replace(t, '!!', '!')) AS n_shouts
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
SELECT *, (fail_bits & {quality_rules.BASE.mask}) <> 0 AS base_failed, (fail_bits & {quality_rules.DEFAULT.mask}) = 0 AS kept, {quality_rules.DEFAULT.version} AS policy_version FROM b"""


def secret_scan_sql() -> str:
    """Matches in turn, by what is left of the text after each."""
    rules = secret_scan.RULES
    parts = []
    for k, r in enumerate(rules):
        p = _sql(r.pattern)
        parts.append(f"SELECT doc_id, {k} AS k, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS found, regexp_extract_all(t, '{p}', {r.group}) AS keys FROM d WHERE regexp_matches(t, '{p}')")
    least = "CASE k " + " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(rules)) + " END"
    kind = "CASE k " + " ".join(f"WHEN {k} THEN '{r.kind}'" for k, r in enumerate(rules)) + " END"
    base = ", ".join(f"count(*) FILTER (k = {k}) AS n_{name}" for k, name in enumerate(secret_scan.BASE))
    total = ", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in secret_scan.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
x AS (SELECT doc_id, k, unnest(range(1, len(found) + 1)) AS i, gaps, found, keys FROM m),
y AS (SELECT doc_id, k, i, length(gaps[i]) + length(found[i]) AS n, length(found[i]) AS len, length(keys[i]) AS key FROM x),
s AS (SELECT doc_id, k, key, len, (sum(n) OVER (PARTITION BY doc_id, k ORDER BY i))::BIGINT AS stop FROM y),
z AS (SELECT doc_id, k, stop - len AS start, {kind} || ':' || (stop - len) || ':' || stop AS shown FROM s WHERE key >= {least}),
a AS (SELECT doc_id, {base}, string_agg(shown, ',' ORDER BY start, k) AS spans, string_agg(shown, ',' ORDER BY start, k) FILTER (k < {len(secret_scan.BASE)}) AS base FROM z GROUP BY doc_id)
SELECT d.doc_id, {total}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob_sha256 FROM d LEFT JOIN a USING (doc_id)"""


def license_scan_sql() -> str:
    low = f"translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}')"
    cut = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = []
    for phrase, label in license_scan.PHRASES.items():
        ws = phrase.split()
        test = " AND ".join(f"words[i + {k}] = '{x}'" for k, x in enumerate(ws))
        places.append(f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w) WHERE {test}")
    quoted = lambda ws: "[" + ", ".join(f"'{x}'" for x in ws) + "]::VARCHAR[]"
    fixed = ", ".join(f"({k}, '{t.label}', {quoted(t.words)}, {quoted(t.must)}, {quoted(t.never)}, {license_scan.needed(len(t.words), license_scan.THRESHOLD)}, {t.reach})" for k, t in enumerate(license_scan.TEMPLATES))
    return f"""WITH d AS (SELECT doc_id, {low} AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '{cut}'), lambda x: x <> '') AS words FROM d),
p AS ({" UNION ALL ".join(places)}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
f(k, label, ws, must, never, least, reach) AS (VALUES {fixed}),
x AS (SELECT doc_id, k, label, ws, must, never, least, reach, words FROM w JOIN f ON len(list_intersect(words, ws)) >= least),
s AS (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM x),
g AS (SELECT doc_id, label, ws, must, never, least, words[i:i + reach - 1] AS block FROM s WHERE list_contains(ws, words[i])),
h AS (SELECT doc_id, label, len(list_intersect(block, ws)) / len(ws) AS c FROM g WHERE len(list_intersect(block, ws)) >= least AND len(list_intersect(block, must)) = len(must) AND NOT list_has_any(block, never)),
q AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION ALL SELECT doc_id, label FROM h) GROUP BY doc_id),
e AS (SELECT doc_id, max(c) AS best FROM h GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN e USING (doc_id)"""


def vector_dedup_sql() -> str:
    return """WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
n AS (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS size FROM e WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0 AND list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.98),
r AS (SELECT vec_id, vec_id AS component_id FROM e UNION SELECT l.b, r.component_id FROM r JOIN l ON l.a = r.vec_id WHERE r.component_id < l.b),
c AS (SELECT vec_id, min(component_id) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c"""


def near_dedup_sql(size: int = 4) -> str:
    """Pairs that share a shingle, on the whole sets; the components by the least id that reaches each."""
    low = f"translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}')"
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({low}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + {size - 1}], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {size - 2}, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS component_id FROM w UNION SELECT l.b, r.component_id FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(component_id) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""


def suffix_dedup_sql(length: int = 50) -> str:
    """Every window of a text's bytes in hex; those that start in a smaller document too, joined into runs, and what lies between."""
    n = length
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * n}) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {n - 1})) AS i FROM d WHERE len(h) >= {2 * n})),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {n} THEN 0 ELSE 1 END AS new FROM m),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + {n} AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
k AS (SELECT doc_id, b AS since, lead(a) OVER (PARTITION BY doc_id ORDER BY a, b) AS upto FROM (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, 0, 0 FROM d)),
x AS (SELECT d.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (coalesce(upto, len(h) // 2) - since)), '' ORDER BY since) AS kept FROM k JOIN d USING (doc_id) GROUP BY d.doc_id),
c AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM r GROUP BY doc_id)
SELECT d.doc_id, strlen(t) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(x.kept)) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": suffix_dedup_sql(),
        "op2_near_dedup": near_dedup_sql(),
        "op5_license_scan": license_scan_sql(),
        "op6_quality_rules": quality_rules_sql(),
        "op8_vector_dedup": vector_dedup_sql(),
        "op10_secret_scan": secret_scan_sql(),
    }
