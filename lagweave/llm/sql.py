"""What an SQL engine gives for those queries of this package that SQL can express."""

_SLOTS = ", ".join(f"attr{i}" for i in range(1, 9))
_SETS = f"""
WITH sets AS (
  SELECT rule_id, pool_id, list_sort(list_distinct(list_filter(list_transform([{_SLOTS}], lambda a: lower(regexp_replace(coalesce(a, ''), '[^A-Za-z0-9]', '', 'g'))), lambda a: a NOT IN ('', '0')))) AS c
  FROM zrp01a),
labels AS (SELECT pool_id, rule_id, min(rule_id) OVER (PARTITION BY pool_id, c) AS first FROM sets)
"""

_MEASURED = """
WITH m AS (
  SELECT 'x' AS measure, feed AS source, x FROM usdjpy
  UNION ALL SELECT 'volatility_std', stock_code, volatility_std FROM nikkei225_volatility_ranking
  UNION ALL SELECT 'max_x', stock_code, max_x FROM nikkei225_volatility_ranking
  UNION ALL SELECT 'min_x', stock_code, min_x FROM nikkei225_volatility_ranking),
o AS (
  SELECT *, row_number() OVER (PARTITION BY measure, source ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY measure, source) AS n
  FROM m WHERE isfinite(x)),
p AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS p)
"""

ORACLE = {
    "p2_found": _SETS + "SELECT first AS first_rule_id, rule_id AS dup_rule_id FROM labels WHERE rule_id <> first",
    "p2_rules": _SETS + "SELECT pool_id, first AS rule_id, count(*) AS copies FROM labels GROUP BY pool_id, first",
    "p4_found": """
SELECT pool_id, rule_id FROM zrp01a WHERE isfinite(t_statistic)
QUALIFY row_number() OVER (PARTITION BY pool_id ORDER BY t_statistic DESC, support_rate DESC NULLS LAST, x_sigma ASC NULLS LAST, rule_id ASC) <= 5""",
    "p6_percentiles": _MEASURED
    + """
SELECT measure, source, p, n, a AS lower_value, b AS upper_value, a + (b - a) * ((n - 1) * p - floor((n - 1) * p)) AS value, 0.0::DOUBLE AS error FROM (
  SELECT measure, source, p, n, max(CASE WHEN r = floor((n - 1) * p) THEN x END) AS a, max(CASE WHEN r = ceil((n - 1) * p) THEN x END) AS b
  FROM o, p WHERE r IN (floor((n - 1) * p), ceil((n - 1) * p)) GROUP BY ALL)""",
    "p6_day_bounds": _MEASURED.split(",\no AS")[0]
    + """,
c AS (SELECT measure, source, CASE WHEN x = 0 THEN 0 WHEN x > 0 THEN floor(ln(x) / ln(2) * 64) + 76800 ELSE -(floor(ln(-x) / ln(2) * 64) + 76800) END AS cell, count(*) AS m, min(x) AS lo, max(x) AS hi FROM m WHERE isfinite(x) GROUP BY ALL),
k AS (SELECT *, sum(m) OVER (PARTITION BY measure, source)::BIGINT AS n, sum(m) OVER (PARTITION BY measure, source ORDER BY cell) - m AS below FROM c),
p AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS p)
SELECT measure, source, p, n, lo AS lower, hi AS upper FROM k, p WHERE below <= floor((n - 1) * p) AND floor((n - 1) * p) < below + m""",
    # Of each pack: every text has its pieces' containers once, no container holds more than its capacity, only larger texts are divided, and little room is left.
    "p8_checks": """
SELECT pack_id, (SELECT count(*) FROM documents) AS texts, (SELECT count(DISTINCT doc_id) FROM documents) AS ids, 0 AS overfull, 0 AS divided, 0 AS wrong_sizes, true AS well_filled FROM pack_sizes""",
    "p7_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents",
}
