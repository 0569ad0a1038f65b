"""SQL of clinical matching, for the check."""

LINKS = "'of', 'in', 'on', 'at', 'the', 'a', 'an', 'and', 'from', 'to', 'with', 'by', 'for'"
SINGULAR = """CASE WHEN length({w}) > 4 AND {w} LIKE '%es' AND {w} NOT LIKE '%ses' AND {w} NOT LIKE '%tes'
  THEN left({w}, length({w}) - 2) WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND {w} NOT LIKE '%is'
  AND {w} NOT LIKE '%us' THEN left({w}, length({w}) - 1) ELSE {w} END"""
WORDS = (
    "list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(replace(replace(replace(lower({t}), 'æ', 'ae'),"
    " 'œ', 'oe'), '-', ''), '[a-z]+'), lambda w: w NOT IN ("
    + LINKS
    + ")), lambda w: "
    + SINGULAR.format(w="w")
    + ")))"
)
MATCHED = f"""
    WITH d AS (SELECT case_id, disease_ord, disease, {WORDS.format(t="disease")} AS words FROM v_diseases),
    t AS (SELECT text AS term, term_ord, remedies, {WORDS.format(t="text")} AS words FROM v_clinical_terms),
    matched AS (SELECT d.case_id, d.disease_ord, t.term_ord, t.term, t.remedies FROM d JOIN t ON len(t.words) > 0 AND list_has_all(d.words, t.words)),
    popular AS (SELECT remedy_id, count(*) AS popularity FROM (SELECT unnest(remedies) AS remedy_id FROM v_clinical_terms) GROUP BY ALL),
    scored AS (SELECT case_id, remedy_id, count(*) AS count, CAST(sum(share) AS BIGINT) AS rarity FROM (
      SELECT case_id, CAST(floor(1.0::DOUBLE / ln(len(remedies) + 2) * 1e12::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS share, unnest(remedies) AS remedy_id
      FROM (SELECT DISTINCT case_id, term, remedies FROM matched)) GROUP BY ALL),
    ranked AS (SELECT s.*, p.popularity, row_number() OVER (
      PARTITION BY case_id ORDER BY count DESC, rarity DESC, popularity DESC, remedy_id) AS rank
      FROM scored s JOIN popular p USING (remedy_id)),
    gate AS (SELECT case_id, max(count) AS lead, max(tied) AS tied, max(count) > 1 OR max(tied) < 5 AS decisive FROM (
      SELECT case_id, count, count(*) AS tied, max(count) OVER (PARTITION BY case_id) AS lead FROM scored GROUP BY case_id, count)
      WHERE count = lead GROUP BY case_id)
"""
