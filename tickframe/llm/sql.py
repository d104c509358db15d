"""The queries that SQL can express, for another engine to check."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {}

SQL["op9_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS norm FROM documents),
     g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

SQL["op4_line_dedup"] = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(c.last_doc <> k.doc_id, false) AS dropped
      FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

SQL["op8_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_az(coalesce(text, '')), 'WORD') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(lower_az(coalesce(text, '')), 'WORD') AS w FROM benchmark),
     i AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
     v AS (SELECT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS win
           FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM i)),
     sizes AS (SELECT DISTINCT size FROM v),
     p AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size),
     h AS (SELECT p.doc_id, p.s, p.size, v.item_id FROM p JOIN v
           ON v.size = p.size AND v.win = array_to_string(p.w[p.s:p.s + p.size - 1], ' ')),
     hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (
               SELECT doc_id, unnest(range(s, s + size)) AS pos FROM h) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (
                 SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.listed, '')) AS items_sha256, hit.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
""".replace("lower_az(coalesce(text, ''))", _LOWER.format("coalesce(text, '')")).replace(
    "WORD", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Conversations: the damage, the faults, then the cheapest edits by dynamic programming over the rows, in a recursion.
# States: 0 nothing yet, s after a system row, u after a user row, t after an assistant row.
SQL["op12_conversations"] = r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))) AS crc FROM conversations),
fate AS (SELECT *, xor(crc, 4294967295) % 20 AS f FROM src),
hurt AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
                CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM fate WHERE f <> 0),
r AS (SELECT conv_id, turn, role, text, coalesce(CAST(conv_id AS VARCHAR), 'null') AS talk, role[1] AS tok,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen FROM hurt),
w AS (SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             lag(tok) OVER (PARTITION BY conv_id ORDER BY i) || tok AS pair FROM r),
ins(f, t, more, letters, said) AS (VALUES ('0', '0', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('t', 't', 0, '', ''),
    ('0', 'u', 5, 'I', 'user:' || chr(10)), ('s', 'u', 5, 'I', 'user:' || chr(10)), ('t', 'u', 5, 'I', 'user:' || chr(10)),
    ('u', 't', 5, 'I', 'assistant:' || chr(10)), ('0', 't', 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
    ('s', 't', 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), ('t', 't', 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
    ('u', 'u', 10, 'II', 'assistant:' || chr(10) || 'user:' || chr(10))),
mv(f, tok, t, whose) AS (VALUES ('0', 's', 's', ''), ('0', 'u', 'u', 'user'), ('s', 'u', 'u', 'user'), ('t', 'u', 'u', 'user'), ('u', 'a', 't', 'assistant')),
act AS (SELECT DISTINCT t AS f, t, 'D' AS letter, '' AS tok, 2 AS more, '' AS whose FROM ins UNION ALL
        SELECT f, t, 'K', tok, 0, '' FROM mv UNION ALL SELECT f, t, 'R', tok, 1, whose FROM mv WHERE whose <> ''),
n AS (SELECT talk, any_value(conv_id) AS conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
             count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM w GROUP BY talk),
dp AS (
  SELECT talk, 0::BIGINT AS i, '0' AS st, 0 AS cost, '' AS audit, '' AS rep FROM n
  UNION ALL
  SELECT talk, i, st, cost, audit, rep FROM (
    SELECT d.talk, w.i, act.t AS st, d.cost + ins.more + act.more + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost,
           d.audit || ins.letters || letter AS audit,
           d.rep || ins.said || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN w.role || ':' || w.text || chr(10) ELSE whose || ':' || w.text || chr(10) END AS rep,
           row_number() OVER (PARTITION BY d.talk, act.t ORDER BY d.cost + ins.more + act.more
             + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END, d.audit || ins.letters || letter) AS place
    FROM dp d JOIN w ON w.talk = d.talk AND w.i = d.i + 1 JOIN ins ON ins.f = d.st
    JOIN act ON act.f = ins.t AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR act.tok = w.tok))
  ) WHERE place = 1),
done AS (SELECT dp.talk, dp.cost + more AS cost, audit || letters AS audit, rep || said AS rep,
                row_number() OVER (PARTITION BY dp.talk ORDER BY dp.cost + more, audit || letters) AS place
         FROM dp JOIN n ON n.talk = dp.talk AND n.n = dp.i JOIN ins ON ins.f = dp.st AND ins.t IN ('0', 't'))
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(rep[1:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'null') AS talk FROM conversations) c
LEFT JOIN n ON n.talk = c.talk LEFT JOIN done ON done.talk = c.talk AND done.place = 1
"""
