"""SQL of the queries of this package that SQL can express."""

_TERMS = """
WITH u AS (
  SELECT element_id, subject_key, role, qualifier, reference,
         row_number() OVER (PARTITION BY element_id ORDER BY loaded_at DESC NULLS LAST) AS rn
  FROM element_semantic_fields_v4 WHERE element_id IS NOT NULL),
t AS (
  SELECT 'subject_key' AS field_name, element_id, unnest(subject_key) AS m FROM u WHERE rn = 1
  UNION ALL SELECT 'role', element_id, unnest(role) FROM u WHERE rn = 1
  UNION ALL SELECT 'qualifier', element_id, unnest(qualifier) FROM u WHERE rn = 1
  UNION ALL SELECT 'reference', element_id, unnest(reference) FROM u WHERE rn = 1),
n AS (SELECT field_name, element_id, trim(regexp_replace(lower(m), '\\s+', ' ', 'g')) AS term FROM t WHERE m IS NOT NULL),
f AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT element_id) AS records FROM n WHERE term <> '' GROUP BY ALL),
r AS (SELECT *, CASE WHEN records <= 2 THEN 'rare'
                     WHEN records > 0.05 * (SELECT count(DISTINCT element_id) FROM element_semantic_fields_v4) THEN 'common' END AS mark FROM f)
"""

SQL = {
    "p1_term_frequencies": _TERMS + "SELECT field_name, term, occurrences, records, mark FROM r",
    "p1_found": _TERMS + "SELECT field_name, term, mark FROM r WHERE mark IS NOT NULL",
}
