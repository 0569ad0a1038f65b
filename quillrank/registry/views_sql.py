"""The views of ``quillrank.sources`` as SQL for the check."""

import re

from quillrank.registry.clinical_sql import MATCHED

VIEWS = {
    "v_passages": """
        SELECT d.doc_id % 7 AS book_ord, 'book' || (d.doc_id % 7) AS book_id, d.doc_id AS id,
               'chunk-' || d.doc_id AS chunk_id, 'Book ' || (d.doc_id % 7) AS source_title,
               CASE WHEN (d.doc_id % 7) % 2 = 0 THEN 'Author ' || (d.doc_id % 7) END AS author,
               CASE WHEN d.doc_id % 7 <> 5 THEN 'remedy-' || (d.doc_id % 41) END AS remedy_id,
               CASE WHEN d.doc_id % 7 <> 5 THEN 'Remedy ' || (d.doc_id % 41) END AS remedy,
               CASE WHEN d.doc_id % 4 <> 0 THEN d.lang END AS section_group,
               [d.source, d.lang] AS sections,
               CASE WHEN d.doc_id % 7 = 5 THEN
                 CASE d.doc_id % 3 WHEN 0 THEN [d.doc_id] WHEN 1 THEN [d.doc_id, d.doc_id + 1]
                 ELSE [d.doc_id, d.doc_id + 4] END END AS aphorisms,
               d.doc_id % 10 AS chunk_index, d.text AS content,
               CASE WHEN d.doc_id % 7 <> 5 THEN 'remedy:remedy-' || (d.doc_id % 41)
                    ELSE 'book:book' || (d.doc_id % 7) END AS subject,
               e.embedding
        FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)""",
    "v_queries": """
        SELECT b.item_id AS query_id, b.text, e.embedding
        FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id""",
    "v_case_symptoms": """
        SELECT query_id // 5 AS case_id, query_id % 5 AS symptom_ord, text AS symptom, embedding FROM v_queries""",
    "v_rubrics": """
        SELECT vec_id % 2 AS repertory_ord, 'repertory' || (vec_id % 2) AS book_id, vec_id AS id,
               'Chapter ' || label AS chapter, 'Chapter ' || label || ': rubric ' || vec_id AS text,
               list_transform([0, 1, 2, 3, 4], lambda j: {
                 'remedy_id': 'remedy-' || ((vec_id * (j + 3) + j * 7) % 41), 'grade': (vec_id + j) % 3 + 1}) AS remedies,
               embedding
        FROM embeddings""",
    "v_rubric_hits": """
        SELECT o.o_custkey AS case_id, CAST(substr(o.o_orderpriority, 1, 1) AS BIGINT) AS symptom_ord,
               o.o_orderkey AS rubric_id, 'remedy-' || l.l_suppkey AS remedy_id,
               max(CAST(floor(l.l_quantity) AS BIGINT) % 3 + 1) AS grade
        FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY ALL""",
    "v_rubric_matches": """
        SELECT o_custkey AS case_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS symptom_ord,
               o_orderkey AS rubric_id FROM orders""",
    "v_clinical_terms": """
        SELECT text, list_sort(list(DISTINCT brand)) AS remedies, min(o) AS term_ord FROM (
          SELECT split_part(p_name, ' ', 2) AS text, lower(p_brand) AS brand, p_partkey * 2 AS o FROM part
          UNION ALL
          SELECT split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1), lower(p_brand), p_partkey * 2 + 1 FROM part)
        GROUP BY text""",
    "v_diseases": """
        SELECT c.c_custkey AS case_id, 0 AS disease_ord,
               CASE WHEN c.c_custkey % 3 = 0
                    THEN 'unnamed ' || substr(split_part(a.p_name, ' ', 2), 1, 2) || '-' || substr(split_part(a.p_name, ' ', 2), 3)
                    ELSE split_part(b.p_name, ' ', 1) || ' ' || split_part(a.p_name, ' ', 2) || 's of the '
                         || split_part(a.p_name, ' ', 1) || ' ' || split_part(b.p_name, ' ', 2) END AS disease
        FROM customer c
        JOIN part a ON a.p_partkey = (c.c_custkey * 7) % (SELECT count(*) FROM part)
        JOIN part b ON b.p_partkey = (c.c_custkey * 13 + 5) % (SELECT count(*) FROM part)""",
    "v_turns": "SELECT conv_id, turn, role, text FROM conversations",
    "v_events": "SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS now_ms FROM events",
    # Rankings of the hybrid search with limit 5: 40 candidates each.
    "v_dense": """
        SELECT * FROM (
          SELECT query_id, book_id, book_ord, id, subject, score,
                 row_number() OVER (PARTITION BY query_id ORDER BY score DESC, book_ord, id) AS pos
          FROM (SELECT q.query_id, p.book_id, p.book_ord, p.id, p.subject,
                       round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 9) AS score
                FROM v_queries q CROSS JOIN v_passages p)) WHERE pos <= 40""",
    "v_postings": """
        SELECT book_id, book_ord, id, subject, len, term, count(*) AS tf
        FROM (SELECT book_id, book_ord, id, subject, len(w) AS len, unnest(w) AS term
              FROM (SELECT *, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM v_passages))
        GROUP BY ALL""",
    "v_book_stats": """
        SELECT book_id, count(*) AS n, avg(len(regexp_extract_all(lower(content), '[a-z0-9]+'))) AS mean_len
        FROM v_passages GROUP BY book_id""",
    "v_term_stats": """
        SELECT p.book_id, p.term, count(*) AS df,
               ln(1 + (any_value(s.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
        FROM v_postings p JOIN v_book_stats s USING (book_id) GROUP BY ALL""",
    "v_query_terms": """
        SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM v_queries""",
    "v_sparse": """
        SELECT * FROM (
          SELECT query_id, book_id, book_ord, id, subject, score,
                 row_number() OVER (PARTITION BY query_id, book_id ORDER BY score DESC, id) AS pos
          FROM (SELECT q.query_id, p.book_id, p.book_ord, p.id, p.subject,
                       CAST(sum(CAST(floor((p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.len / s.mean_len))) * t.idf * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) / 1e9::DOUBLE AS score
                FROM v_query_terms q JOIN v_postings p USING (term)
                JOIN v_term_stats t ON t.book_id = p.book_id AND t.term = p.term
                JOIN v_book_stats s ON s.book_id = p.book_id
                GROUP BY ALL)) WHERE pos <= 40""",
    "v_rankings": """
        SELECT query_id, CAST(0 AS BIGINT) AS ranking_ord, pos, book_id, book_ord, id, subject, score FROM v_dense
        UNION ALL
        SELECT query_id, book_ord + 1, pos, book_id, book_ord, id, subject, score FROM v_sparse""",
    "v_fused": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_ranking, first_pos) AS fused_rank
        FROM (SELECT query_id, book_id, id, subject, sum(1.0::DOUBLE / (60 + pos)) AS score,
                     min(ranking_ord) AS first_ranking, arg_min(pos, ranking_ord) AS first_pos
              FROM v_rankings GROUP BY ALL)""",
    "v_dominated": """
        SELECT query_id, max(held) AS most_held, max(held) >= 2.5 AS dominated
        FROM (SELECT query_id, subject, count(*) AS held FROM v_fused WHERE fused_rank <= 5 GROUP BY ALL) GROUP BY query_id""",
    "v_support": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, first_rank) AS support_rank
        FROM (SELECT query_id, subject, CAST(sum(CAST(floor(best * 1e12::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) AS support, min(first_rank) AS first_rank
              FROM (SELECT query_id, subject, book_id, max(score) AS best, min(fused_rank) AS first_rank
                    FROM v_fused GROUP BY ALL) GROUP BY ALL)""",
    # Two prior rankings of remedies for each query, by a rule.
    "v_priors": """
        SELECT query_id, CAST(o AS BIGINT) AS prior_ord, 'remedy:remedy-' || ((query_id * (3 + o) + p * 5) % 41) AS subject,
               CAST(p AS BIGINT) AS place
        FROM v_queries, unnest([0, 1]) AS a(o), unnest(range(1, 9)) AS b(p)""",
    "v_places": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prior_score DESC, support_rank) AS place
        FROM (SELECT s.query_id, s.subject, s.support_rank, s.first_rank,
                     CAST(floor(1.0::DOUBLE / (10 + s.support_rank) * 1e12::DOUBLE + 0.5::DOUBLE) AS BIGINT) + coalesce(p.lift, 0) AS prior_score
              FROM v_support s LEFT JOIN (SELECT query_id, subject, CAST(sum(CAST(floor(1.0::DOUBLE / (10 + place) * 1e12::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) AS lift
                                          FROM v_priors GROUP BY ALL) p
              ON p.query_id = s.query_id AND p.subject = s.subject)""",
    "v_best": """
        SELECT * FROM (
          SELECT query_id, book_id, id, subject, score, fused_rank, dominated, row_number() OVER (
                   PARTITION BY query_id ORDER BY
                     CASE WHEN dominated OR fused_rank <> first_rank THEN 1 ELSE 0 END,
                     CASE WHEN dominated OR fused_rank <> first_rank THEN fused_rank ELSE support_rank END) AS rank
          FROM v_fused f JOIN v_dominated d USING (query_id) JOIN v_support s USING (query_id, subject)
          WHERE dominated OR support_rank <= 5) WHERE rank <= 5""",
    # Repertorisation of ``rubric_hits``.
    "v_coverage": """
        SELECT case_id, remedy_id, count(*) AS symptoms, CAST(sum(grade) AS BIGINT) AS grades FROM (
          SELECT case_id, symptom_ord, remedy_id, max(grade) AS grade FROM v_rubric_hits GROUP BY ALL) GROUP BY ALL""",
    "v_ranked_remedies": """
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY symptoms DESC, grades DESC, remedy_id) AS rank
        FROM v_coverage""",
    "v_decisive": """
        SELECT case_id, case_symptoms, lead, tied, lead > 0 AND ((lead > 1 AND lead * 2 >= case_symptoms) OR tied < 5) AS decisive
        FROM (SELECT s.case_id, s.case_symptoms, coalesce(l.lead, 0) AS lead,
                     (SELECT count(*) FROM v_coverage c WHERE c.case_id = s.case_id AND c.symptoms = l.lead) AS tied
              FROM (SELECT case_id, count(DISTINCT symptom_ord) AS case_symptoms FROM v_rubric_matches GROUP BY ALL) s
              LEFT JOIN (SELECT case_id, max(symptoms) AS lead FROM v_coverage GROUP BY ALL) l USING (case_id))""",
    "v_leaders": """
        SELECT r.case_id, r.remedy_id, r.symptoms, r.grades, r.rank AS leader_ord
        FROM v_ranked_remedies r LEFT JOIN v_ranked_remedies n ON n.case_id = r.case_id AND n.rank = 4
        WHERE r.rank <= 3 AND (n.rank IS NULL OR n.symptoms <> r.symptoms OR n.grades <> r.grades)""",
    "v_best_rubrics": """
        SELECT case_id, symptom_ord, leader_ord, remedy_id, grade, rubric_id FROM (
          SELECT h.*, l.leader_ord, row_number() OVER (
                   PARTITION BY h.case_id, h.symptom_ord, l.leader_ord ORDER BY h.grade DESC, h.rubric_id) AS n
          FROM v_rubric_hits h JOIN v_leaders l ON l.case_id = h.case_id AND l.remedy_id = h.remedy_id) WHERE n = 1""",
    "v_cited": """
        SELECT case_id, rubric_id, n + 5 AS number FROM (
          SELECT case_id, rubric_id, row_number() OVER (PARTITION BY case_id ORDER BY seen) AS n FROM (
            SELECT case_id, rubric_id, min(symptom_ord * 10 + leader_ord) AS seen FROM v_best_rubrics GROUP BY ALL)) WHERE n <= 15""",
    # Repertorisation of ``case_symptoms`` by nearest rubrics.
    "v_symptom_rubrics": """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY case_id, symptom_ord, book_id ORDER BY score DESC, rubric_id) AS pos
          FROM (SELECT s.case_id, s.symptom_ord, r.repertory_ord, r.book_id, r.id AS rubric_id,
                       round(list_cosine_similarity(CAST(s.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 9) AS score
                FROM v_case_symptoms s CROSS JOIN v_rubrics r)) WHERE pos <= 3""",
    "v_combined": """
        SELECT case_id, symptom_ord, book_id, rubric_id,
               row_number() OVER (PARTITION BY case_id, symptom_ord ORDER BY repertory_ord, pos) AS rubric_ord
        FROM v_symptom_rubrics""",
    "v_matches": """
        SELECT * EXCLUDE (n) FROM (
          SELECT *, row_number() OVER (PARTITION BY case_id, book_id, rubric_id ORDER BY symptom_ord, rubric_ord) AS n
          FROM v_combined) WHERE n = 1""",
    "v_listed": """
        SELECT book_id, id AS rubric_id, listed_ord, remedies[listed_ord].remedy_id AS remedy_id, remedies[listed_ord].grade AS grade
        FROM v_rubrics, unnest([1, 2, 3, 4, 5]) AS u(listed_ord)""",
    "v_case_hits": """
        SELECT m.*, l.listed_ord, l.remedy_id, l.grade FROM v_matches m
        JOIN v_listed l ON l.book_id = m.book_id AND l.rubric_id = m.rubric_id""",
    "v_case_coverage": """
        SELECT case_id, remedy_id, count(*) AS symptoms, CAST(sum(grade) AS BIGINT) AS grades FROM (
          SELECT case_id, symptom_ord, remedy_id, max(grade) AS grade FROM v_case_hits GROUP BY ALL) GROUP BY ALL""",
    "v_case_decisive": """
        SELECT m.case_id, (max(lead) > 1 AND max(lead) * 2 >= max(n)) OR
               count(*) FILTER (WHERE symptoms = lead) < 5 AS decisive
        FROM (SELECT *, max(symptoms) OVER (PARTITION BY case_id) AS lead FROM v_case_coverage) m
        JOIN (SELECT case_id, count(DISTINCT symptom_ord) AS n FROM v_matches GROUP BY ALL) s USING (case_id) GROUP BY m.case_id""",
    "v_case_leaders": """
        SELECT r.case_id, r.remedy_id, r.rank AS leader_ord FROM v_case_ranked r
        LEFT JOIN v_case_ranked n ON n.case_id = r.case_id AND n.rank = 4
        WHERE r.rank <= 3 AND (n.rank IS NULL OR n.symptoms <> r.symptoms OR n.grades <> r.grades)""",
    "v_case_ranked": """
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY symptoms DESC, grades DESC, remedy_id) AS rank
        FROM v_case_coverage""",
    "v_case_best": """
        SELECT * EXCLUDE (n) FROM (
          SELECT h.case_id, h.symptom_ord, h.book_id, h.rubric_id, h.remedy_id, l.leader_ord,
                 row_number() OVER (PARTITION BY h.case_id, h.symptom_ord, l.leader_ord ORDER BY h.grade DESC, h.rubric_ord) AS n
          FROM (SELECT case_id, symptom_ord, rubric_ord, book_id, rubric_id, remedy_id, arg_min(grade, listed_ord) AS grade
                FROM v_case_hits GROUP BY ALL) h
          JOIN v_case_leaders l ON l.case_id = h.case_id AND l.remedy_id = h.remedy_id) WHERE n = 1""",
    "v_case_cited": """
        SELECT case_id, book_id, rubric_id, n, n + 5 AS number FROM (
          SELECT case_id, book_id, rubric_id, row_number() OVER (PARTITION BY case_id ORDER BY seen) AS n FROM (
            SELECT case_id, book_id, rubric_id, min(symptom_ord * 10 + leader_ord) AS seen FROM v_case_best GROUP BY ALL))
        WHERE n <= 15""",
    "v_case_sources": """
        SELECT c.case_id, c.book_id, c.rubric_id, any_value(c.n) AS n, any_value(c.number) AS number, 'Remedies and their grades: ' || string_agg(
                 upper(l.remedy_id[1]) || replace(substr(l.remedy_id, 2), '-', ' ') || ' (' || l.grade || ')', ', '
                 ORDER BY coalesce(x.leader_ord, 99), l.grade DESC, l.listed_ord) AS text
        FROM v_case_cited c JOIN v_listed l ON l.book_id = c.book_id AND l.rubric_id = c.rubric_id
        LEFT JOIN v_case_leaders x ON x.case_id = c.case_id AND x.remedy_id = l.remedy_id
        GROUP BY c.case_id, c.book_id, c.rubric_id""",
    # Requests, replies and answers.
    "v_replies": """
        SELECT conv_id * 1000 + turn AS reply_id, conv_id, turn,
               CASE turn % 4 WHEN 0 THEN 'Here they are:' || chr(10) || '1. ' WHEN 1 THEN '* Disease: ' WHEN 2 THEN 'None.' || chr(10)
                 ELSE 'No diseases are named.' || chr(10) || '2) ' END
               || replace(text, chr(10), chr(10) || '- **') || chr(10) || '• ' || lower(text) AS reply FROM conversations""",
    "v_kind_replies": """
        SELECT conv_id * 1000 + turn AS reply_id,
               CASE turn % 3 WHEN 0 THEN ' Question.' || chr(10) WHEN 1 THEN 'CASE ' ELSE 'questions ' END || text AS reply
        FROM conversations""",
    "v_answers": """
        SELECT conv_id * 1000 + turn AS answer_id, conv_id % 9 AS sources,
               CASE WHEN (conv_id + turn) % 4 = 0 THEN text ELSE text || ' See [' || turn || '], [2-' || (turn + 3) || '], [1, '
                 || (conv_id % 7) || '] and [9](x); [5–40] [7-3] [2, 4-5] [3]' END AS answer
        FROM conversations WHERE role = 'assistant'""",
    "v_requests": """
        SELECT q.conv_id, q.message, CASE WHEN q.conv_id % 3 = 0 THEN 'Earlier, ' || left(q.message, 40) END AS summary,
               CASE q.conv_id % 3 WHEN 1 THEN CAST([] AS VARCHAR[])
                 WHEN 2 THEN ['symptom a of ' || q.conv_id, 'symptom b of ' || q.conv_id] END AS symptoms,
               CASE WHEN q.conv_id % 4 = 1 THEN CAST([] AS VARCHAR[])
                 WHEN q.conv_id % 4 >= 2 AND d.disease IS NOT NULL THEN [d.disease] END AS diseases
        FROM (SELECT conv_id, arg_max(text, turn) AS message FROM conversations WHERE role = 'user' GROUP BY ALL) q
        LEFT JOIN v_diseases d ON d.case_id = q.conv_id""",
    "v_history": """
        SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c
        JOIN (SELECT conv_id, max(turn) AS asked_at FROM conversations WHERE role = 'user' GROUP BY ALL) q USING (conv_id)
        WHERE c.role IN ('user', 'assistant') AND c.turn < q.asked_at""",
    # Chats and feedback.
    "v_chats": """
        SELECT user_id, event_id AS chat_id, upper(event_type[1]) || event_type[2:] || ' chat ' || event_id AS title,
               now_ms AS updated_at, CAST(floor(value) AS BIGINT) * 10 + 5 AS bytes FROM v_events""",
    "v_messages": """
        SELECT conv_id AS chat_id, turn, role, text, CASE WHEN (conv_id * 7 + turn) % 11 = 0 THEN 'error' END AS status FROM conversations""",
    "v_archives": """
        SELECT event_id, CASE WHEN event_id % 10 = 7 THEN '{nope' WHEN event_id % 10 = 8 THEN head
                 ELSE '[' || older || ',' || broken || ',' || head || ']' END AS archive
        FROM (SELECT event_id,
                '{"id":"c' || event_id || '","title":"' || event_type || '","updatedAt":' || now_ms || ',"messages":[],"history":[]}' AS head,
                '{"id":"d' || event_id || '","title":"older","updatedAt":' || (now_ms - 1000) || ',"messages":[1],"history":[]}' AS older,
                CASE event_id % 3 WHEN 0 THEN '{"id": 1}' WHEN 1 THEN '{"id":"x","title":"x","updatedAt":"1","messages":[],"history":[]}'
                  ELSE '{"id":"x","title":"x","updatedAt":1,"messages":{},"history":[]}' END AS broken FROM v_events)""",
    "v_feedback": """
        SELECT user_id, event_id, event_id % 20 AS answer_id,
               'c' || (user_id % 5) || CASE WHEN event_id % 3 = 0 THEN '-x' ELSE '' END || '-' || (event_id % 20)
                 || CASE WHEN event_id % 7 = 0 THEN 'a' ELSE '' END AS feedback_id,
               CASE event_type WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' END AS rating,
               CASE WHEN event_type = 'error' THEN ['unclear'] END AS reasons,
               CASE WHEN event_type = 'view' THEN event_type END AS comment FROM events""",
    "v_rating_events": """
        SELECT user_id, event_id % 20 AS answer_id, event_id AS seq,
               CASE WHEN event_type IN ('purchase', 'error', 'signup') THEN CASE WHEN event_id % 3 = 0 THEN 'source' ELSE 'answer' END
                 WHEN event_type = 'view' THEN 'reasons' ELSE 'comment' END AS kind,
               CASE event_type WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' END AS rating,
               event_id % 4 AS number, 'unclear,' || event_id AS reasons, 'comment ' || event_id AS comment FROM events""",
    "v_pieces": """
        SELECT doc_id AS answer_id, seq, substr(text, seq * 50 + 1, 50) AS text
        FROM (SELECT doc_id, text, unnest(range(0, greatest((length(text) - 1) // 50, 0) + 1)) AS seq FROM documents)""",
    # Lists read from replies.
    "v_lines": r"""
        WITH raw AS (SELECT reply_id, generate_subscripts(string_split(reply, chr(10)), 1) - 1 AS line_no, unnest(string_split(reply, chr(10))) AS line FROM v_replies),
        cleaned AS (SELECT reply_id, line_no, trim(regexp_replace(regexp_replace(line, '^[\s*\-•#]*(\d+[.)])?\s*', ''), '\*\*|__', '', 'g')) AS line FROM raw)
        SELECT reply_id, line_no, line FROM cleaned
        WHERE line <> '' AND line NOT LIKE '%:' AND NOT regexp_matches(line, '(?i)^none\W*$')""",
    "v_symptom_items": "SELECT reply_id, line_no, rtrim(left(line, 200)) AS item FROM v_lines",
    "v_disease_items": r"""
        SELECT * FROM (SELECT reply_id, line_no, rtrim(left(regexp_replace(line, '(?i)^(disease|diagnosis)\s*:\s*', ''), 200)) AS item FROM v_lines)
        WHERE item <> '' AND NOT regexp_matches(item, '(?i)^no\b')""",
    "v_parsed_symptoms": """
        SELECT reply_id, item, row_number() OVER (PARTITION BY reply_id ORDER BY line_no) AS ord FROM (
          SELECT reply_id, lower(item) AS l, min(line_no) AS line_no, arg_min(item, line_no) AS item FROM v_symptom_items GROUP BY reply_id, lower(item))
        QUALIFY ord <= 15""",
    "v_parsed_diseases": """
        SELECT reply_id, item, row_number() OVER (PARTITION BY reply_id ORDER BY line_no) AS ord FROM (
          SELECT reply_id, lower(item) AS l, min(line_no) AS line_no, arg_min(item, line_no) AS item FROM v_disease_items GROUP BY reply_id, lower(item))
        QUALIFY ord <= 15""",
    # Retrieval for requests.
    "v_searched": """
        WITH asked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n
                                      FROM v_history WHERE role = 'user') WHERE n <= 2),
        texts AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS texts FROM asked GROUP BY ALL)
        SELECT q.conv_id, right(concat_ws(chr(10), t.texts, q.message), 8000) AS query, q.symptoms, q.diseases
        FROM v_requests q LEFT JOIN texts t USING (conv_id)""",
    "v_question_replies": """
        SELECT r.conv_id, r.reply_id, CASE WHEN r.conv_id % 10 = 9 THEN 'timeout' END AS error FROM v_replies r
        JOIN (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY ALL) q
        ON q.conv_id = r.conv_id AND q.turn = r.turn""",
    "v_r_queries": """
        SELECT s.conv_id AS query_id, e.embedding,
               CASE WHEN coalesce(len(symptoms), 0) + coalesce(len(diseases), 0) > 0
                 THEN left(array_to_string(list_concat(coalesce(symptoms, []), coalesce(diseases, [])), chr(10)), 8000) ELSE query END AS text
        FROM v_searched s JOIN embeddings e ON e.vec_id = s.conv_id""",
    "v_r_case_symptoms": """
        SELECT i.conv_id AS case_id, i.ord AS symptom_ord, i.item AS symptom, e.embedding
        FROM (SELECT conv_id, generate_subscripts(symptoms, 1) - 1 AS ord, unnest(symptoms) AS item FROM v_requests
              UNION ALL SELECT q.conv_id, p.ord - 1, p.item FROM v_parsed_symptoms p JOIN v_question_replies q USING (reply_id)
              JOIN v_requests r ON r.conv_id = q.conv_id WHERE q.error IS NULL AND r.symptoms IS NULL) i
        JOIN embeddings e ON e.vec_id = (i.conv_id * 7 + i.ord * 3) % (SELECT count(*) FROM embeddings)""",
    "v_r_diseases": """
        SELECT conv_id AS case_id, generate_subscripts(diseases, 1) AS disease_ord, unnest(diseases) AS disease FROM v_requests
        UNION ALL SELECT q.conv_id, p.ord, p.item FROM v_parsed_diseases p JOIN v_question_replies q USING (reply_id)
        JOIN v_requests r ON r.conv_id = q.conv_id WHERE q.error IS NULL AND r.diseases IS NULL""",
    "v_r_clinical": MATCHED.replace("v_diseases", "v_r_diseases")
    + "SELECT r.case_id, r.remedy_id, r.rank FROM ranked r JOIN gate g USING (case_id) WHERE g.decisive",
    "v_r_clinical_terms": MATCHED.replace("v_diseases", "v_r_diseases")
    + """SELECT r.case_id, r.remedy_id, r.rank, m.term, min(m.disease_ord * 1000000000 + m.term_ord) AS place
         FROM ranked r JOIN gate g USING (case_id) JOIN matched m
         ON m.case_id = r.case_id AND list_contains(m.remedies, r.remedy_id) WHERE g.decisive AND r.rank <= 3 GROUP BY ALL""",
    "v_r_priors": """
        SELECT case_id AS query_id, 0 AS prior_ord, 'remedy:' || remedy_id AS subject, rank AS place
        FROM v_r_case_ranked JOIN v_r_case_decisive USING (case_id) WHERE decisive
        UNION ALL SELECT case_id, 1, 'remedy:' || remedy_id, rank FROM v_r_clinical""",
    "v_r_best": """
        SELECT * FROM (
          SELECT query_id, book_id, id, subject, score, row_number() OVER (
                   PARTITION BY query_id ORDER BY
                     CASE WHEN dominated OR fused_rank <> first_rank THEN 1 ELSE 0 END,
                     CASE WHEN dominated OR fused_rank <> first_rank THEN fused_rank ELSE place END) AS rank
          FROM v_r_fused f JOIN v_r_dominated d USING (query_id) JOIN v_r_places s USING (query_id, subject)
          WHERE dominated OR place <= 5) WHERE rank <= 5""",
    "v_r_sources": """
        WITH labelled AS (SELECT *, CASE WHEN len(aphorisms) = 1 THEN '§ ' || aphorisms[1]
              WHEN len(aphorisms) > 1 AND aphorisms[2] = aphorisms[1] + 1 THEN '§§ ' || aphorisms[1] || '–' || aphorisms[-1]
              WHEN len(aphorisms) > 1 THEN '§§ ' || array_to_string(aphorisms, ', ') END AS label FROM v_passages),
        titled AS (SELECT *, array_to_string(list_concat(list_filter(sections, lambda s: s <> coalesce(section_group, '')),
            CASE WHEN label IS NULL THEN CAST([] AS VARCHAR[]) ELSE [label] END), '; ') AS joined FROM labelled)
        SELECT b.query_id, b.rank AS number, t.chunk_id, t.book_id, t.source_title AS book_title, t.author, t.remedy AS remedy_name,
               CASE WHEN coalesce(section_group, '') <> '' AND joined <> '' THEN section_group || ': ' || joined
                    WHEN coalesce(section_group, '') <> '' THEN section_group ELSE joined END AS section_title,
               t.content AS text, b.score
        FROM v_r_best b JOIN titled t ON t.id = b.id
        UNION ALL
        SELECT c.case_id, c.n + (SELECT count(*) FROM v_r_best x WHERE x.query_id = c.case_id), CAST(c.rubric_id AS VARCHAR), c.book_id,
               coalesce(k.book_title, c.book_id), k.author, NULL, left(r.text, 500), c.text, 0
        FROM v_r_case_sources c JOIN v_rubrics r ON r.id = c.rubric_id
        LEFT JOIN (SELECT 'repertory0' AS book_id, 'Repertory of ' || r_name AS book_title, r_name AS author FROM region WHERE r_regionkey = 0) k
          ON k.book_id = c.book_id""",
}

_SEARCH = ["v_dense", "v_query_terms", "v_sparse", "v_rankings", "v_fused", "v_dominated", "v_support", "v_places"]
_CASES = [
    "v_symptom_rubrics", "v_combined", "v_matches", "v_case_hits", "v_case_coverage", "v_case_decisive", "v_case_ranked",
    "v_case_leaders", "v_case_best", "v_case_cited", "v_case_sources",
]
_RENAMED = [*_SEARCH, *_CASES, "v_queries", "v_priors", "v_case_symptoms"]


def _for_requests(text: str) -> str:
    """A view's text over the requests' queries and cases instead of the benchmark's."""
    return re.sub(r"\bv_(\w+)\b", lambda m: f"v_r_{m[1]}" if m[0] in _RENAMED else m[0], text)


for _name in [*_SEARCH, *_CASES]:
    VIEWS[_for_requests(_name)] = _for_requests(VIEWS[_name])
# Only decisive cases have leaders.
VIEWS["v_r_case_leaders"] += " AND r.case_id IN (SELECT case_id FROM v_r_case_decisive WHERE decisive)"
