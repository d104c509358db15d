"""Keyword rules, priority audit, TF-IDF and similarity in SQL."""

from tickframe.operators.audit import DEFINITIONS, prompt_parts

from . import keywords as R
from .base import inc, pct0
from .keywords import REASONS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def score(words, text="t"):
    return "(" + " + ".join(f"CAST(contains({text}, {q(w)}) AS INTEGER)" for w in words) + ")"


def any_of(words, text="t"):
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


PHRASES = [
    "login with badge and permission", "permission denied for this role", "certif renewal needs access", "account lock after login",
    "badge and role access", "error, it went wrong and is not working", "crash, very slow, cannot go on", "crash and unable to start",
    "report with data fetch to export", "upload of a document", "validation of the export, rejected", "new user onboard, profile for a joiner",
    "vpn, wifi and dns", "laptop, printer and monitor", "install software and a patch", "update to this software version",
    "license for the software patch", "server, storage and backup of the database", "enhancement in the product backlog, a feature request",
    "provision of materials management", "complete failure and total outage", "significant delay", "significant for multiple users",
    "how to, an inquiry and a question", "nothing of note"]
PHRASED = "phrased AS (SELECT * REPLACE (text || ' ' || ([" + ", ".join(q(p) for p in PHRASES) + f"])[1 + (doc_id // 2) % {len(PHRASES)}] AS text) FROM documents)"


def category(rules, source="phrased"):
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(rules))) + ")"
    whens = " ".join(f"WHEN s{i} = {best} THEN {q(n)}" for i, n in enumerate(rules))
    scores = ", ".join(f"{score(w)} AS s{i}" for i, w in enumerate(rules.values()))
    return f"""SELECT doc_id, t, CASE WHEN {best} = 0 THEN 'General' {whens} END AS category
        FROM (SELECT doc_id, t, {scores} FROM (SELECT doc_id, lower(text) AS t FROM {source}))"""


SUB = "CASE " + " ".join(f"WHEN category = {q(c)} AND {any_of(words)} THEN {q(label)}"
                         for c, labelled in R.SUBCATEGORY_KEYWORDS.items() for label, words in labelled) + " ELSE 'General' END"

AUD = f"""sc AS (SELECT number, short_description, service_offering, priority, seq,
    {score(R.AUDIT_P1_KEYWORDS)} AS a1, {score(R.AUDIT_P2_KEYWORDS)} AS a2, {score(R.AUDIT_P4_KEYWORDS)} AS a4
  FROM (SELECT *, lower(short_description || ' ' || service_offering) AS t FROM src)),
rs AS (SELECT *, CASE WHEN priority = 1 THEN CASE WHEN a1 >= 2 THEN 'p1_ok' WHEN a2 >= 1 AND a1 = 0 THEN 'p1_to_2' ELSE 'p1_to_3' END
    ELSE CASE WHEN a2 >= 2 OR a1 >= 2 THEN 'p2_ok' WHEN a4 >= 2 THEN 'p2_to_4' ELSE 'p2_to_3' END END AS rk FROM sc),
aud AS (SELECT number, short_description, service_offering, priority AS current_priority,
    CASE WHEN rk IN ('p1_ok', 'p2_ok') THEN 'CORRECT' ELSE 'RECLASSIFY' END AS verdict,
    CASE rk WHEN 'p1_ok' THEN 1 WHEN 'p1_to_2' THEN 2 WHEN 'p2_ok' THEN 2 WHEN 'p2_to_4' THEN 4 ELSE 3 END AS suggested_priority,
    CAST(CASE WHEN rk IN ('p1_ok', 'p2_ok') THEN 0.65 WHEN rk IN ('p1_to_2', 'p2_to_4') THEN 0.60 ELSE 0.55 END AS DOUBLE) AS confidence,
    CASE rk {' '.join(f"WHEN '{k}' THEN {q(v)}" for k, v in REASONS.items())} END AS reasoning,
    CASE rk WHEN 'p1_ok' THEN 1 WHEN 'p1_to_2' THEN 2 WHEN 'p2_ok' THEN 2 WHEN 'p2_to_4' THEN 4 ELSE 3 END - priority AS delta FROM rs)"""

SPOKEN = "said AS (SELECT * REPLACE (short_description || ' ' || ([" + ", ".join(q(p) for p in PHRASES) + f"])[1 + (seq // 2) % {len(PHRASES)}] AS short_description) FROM inc)"
P12 = f"{SPOKEN}, src AS (SELECT * FROM said WHERE priority IN (1, 2))"
SMP = SPOKEN + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY seq) AS rn FROM said WHERE priority IN (1, 2)),
src AS (SELECT * FROM ranked WHERE (priority = 1 AND rn <= 5) OR (priority = 2 AND rn <= 20 - (SELECT least(5, count(*)) FROM inc WHERE priority = 1)))"""
DOCS = """src AS (SELECT doc_id AS seq, 'DOC' || doc_id AS number, text AS short_description, source AS service_offering,
  CAST(doc_id % 2 + 1 AS INTEGER) AS priority FROM phrased)"""
COUNTS = f"""SELECT count(*) AS total_audited, count(*) FILTER (WHERE current_priority = 1) AS p1_count, count(*) FILTER (WHERE current_priority = 2) AS p2_count,
  count(*) FILTER (WHERE verdict = 'CORRECT') AS correctly_classified, {pct0("count(*) FILTER (WHERE verdict = 'CORRECT')", 'count(*)')} AS correctly_classified_pct,
  count(*) FILTER (WHERE delta < 0) AS should_escalate, count(*) FILTER (WHERE delta > 0) AS should_downgrade FROM aud"""

CRITERIA, CLOSING = prompt_parts()
PROMPT = f"""SELECT number, priority, 'Evaluate this incident''s priority classification:' || chr(10) || chr(10) || 'INCIDENT:' || chr(10) || '  Number: ' || number
  || chr(10) || '  Short Description: ' || short_description || chr(10) || '  Service/Application: '
  || CASE WHEN service_offering = '' THEN 'Not specified' ELSE service_offering END || chr(10) || '  Current Priority: P' || priority || ' ('
  || CASE priority WHEN 1 THEN {q(DEFINITIONS[1]['label'])} ELSE {q(DEFINITIONS[2]['label'])} END || ')' || {q(CRITERIA)}
  || chr(10) || chr(10) || 'Is P' || priority || {q(CLOSING)} AS prompt FROM inc WHERE priority IN (1, 2)"""


def tfidf(source: str, key: str, prefix: str, min_df: int, strip: bool) -> str:
    """CTEs: tokens, unigrams and bigrams, vocabulary, L2-normalised weights."""
    text = "strip_accents(lower(text))" if strip else "lower(text)"
    p = prefix
    return f"""
{p}tok AS (SELECT {key} AS id, regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {source}),
{p}term AS (SELECT id, unnest(w) AS term FROM {p}tok UNION ALL
           SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM {p}tok),
{p}tf AS (SELECT id, term, count(*) AS tf FROM {p}term GROUP BY 1, 2),
{p}voc AS (SELECT term, sum(tf) AS total, count(*) AS df FROM {p}tf GROUP BY 1 HAVING count(*) >= {min_df}),
{p}idf AS (SELECT term, ln((1 + (SELECT count(*) FROM {p}tok)) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM {p}voc),
{p}raw AS (SELECT id, term, (1 + ln(tf)) * idf AS v FROM {p}tf JOIN {p}idf USING (term)),
{p}wt AS (SELECT id, term, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS weight FROM {p}raw)"""


def similar(queries: str, qkey: str, corpus: str, ckey: str, k: int) -> str:
    """Top-k cosine per query, scores below 0.05 left out; ranks on 9 decimals."""
    return f"""{tfidf(corpus, ckey, 'd', 1, False)},
qtok AS (SELECT {qkey} AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {queries}),
qterm AS (SELECT id, unnest(w) AS term FROM qtok UNION ALL
          SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM qtok),
qtf AS (SELECT id, term, count(*) AS tf FROM qterm GROUP BY 1, 2),
qraw AS (SELECT id, term, (1 + ln(tf)) * idf AS v FROM qtf JOIN didf USING (term)),
qwt AS (SELECT id, term, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS weight FROM qraw),
sims AS (SELECT q.id AS qid, d.id AS did, round(sum(q.weight * d.weight), 9) AS s FROM qwt q JOIN dwt d USING (term) GROUP BY 1, 2),
best AS (SELECT qid, did, s, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, did) AS INTEGER) AS rank FROM sims WHERE s >= 0.05
         QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, did) <= {k})"""


INC_TEXT = """txt AS (SELECT number AS id, trim(concat_ws(' ', nullif(short_description, ''), nullif(service_offering, ''), nullif(category, ''))) AS text FROM inc)"""

SQL = {
    "classify_category": f"WITH {PHRASED} SELECT doc_id, category FROM ({category(R.CATEGORY_KEYWORDS)})",
    "classify_category_import": f"WITH {PHRASED} SELECT doc_id, category FROM ({category(R.CATEGORY_KEYWORDS_IMPORT)})",
    "classify_category_table": f"SELECT doc_id, category FROM ({category(R.CATEGORY_KEYWORDS | {'Parts': ['ring', 'bolt'], 'Network': [*R.CATEGORY_KEYWORDS['Network'], 'the that']}, 'documents')})",
    "classify_subcategory": f"WITH {PHRASED} SELECT doc_id, category, {SUB} AS subcategory FROM ({category(R.CATEGORY_KEYWORDS)})",
    "audit_priority_rules": inc("SELECT * FROM aud", f"{P12},{AUD}"),
    "audit_document_rules": f"WITH {PHRASED},{DOCS},{AUD} SELECT number, current_priority, verdict, suggested_priority, confidence, reasoning, delta FROM aud",
    "audit_sample": inc("SELECT * FROM aud", f"{SMP},{AUD}"),
    "union_sample": inc("SELECT number, priority FROM src", SMP),
    "audit_summary": inc(COUNTS, f"{P12},{AUD}"),
    "audit_prompts": inc(PROMPT),
    "priority_definitions": inc(f"""SELECT priority, label, tickets FROM (SELECT priority, count(*) AS tickets FROM inc GROUP BY 1)
        JOIN (VALUES {', '.join(f"({p}, {q(d['label'])})" for p, d in DEFINITIONS.items())}) AS d(p, label) ON p = priority"""),
    "text_features": inc("SELECT id AS number, term, round(weight, 9) AS weight FROM fwt", f"{INC_TEXT},{tfidf('txt', 'id', 'f', 2, True)}"),
    "text_features_documents": f"WITH {tfidf('documents', 'doc_id', 'f', 2, True)} SELECT id AS doc_id, count(*) AS terms, round(sum(weight), 6) AS total, max(term) AS last_term FROM fwt GROUP BY 1",
    "similar_incidents": f"""WITH {similar('benchmark', 'item_id', 'documents', 'doc_id', 5)}
        SELECT qid AS item_id, rank, did AS doc_id, source, lang, round_even(s, 3) AS similarity, substr(text, 1, 120) AS description
        FROM best JOIN documents ON doc_id = did""",
    "similarity_join": f"""WITH {similar('benchmark', 'item_id', 'documents', 'doc_id', 5)} SELECT qid, did, rank, round_even(s, 3) AS similarity FROM best""",
    "doc_kb_recommender": f"""WITH tickets AS (SELECT conv_id || '-' || turn AS ticket, text FROM conversations WHERE role = 'user'),
        {similar('tickets', 'ticket', 'documents', 'doc_id', 1)}
        SELECT qid AS ticket, did AS article, round_even(s, 3) AS similarity FROM best""",
    "similar_tickets": inc(f"""SELECT qid AS asked, rank, did AS number, category, priority, state, assignment_group AS "group",
        substr(resolution_notes, 1, 250) AS resolution, round_even(mttr_hours, 1) AS mttr_hours, round_even(s, 3) AS similarity,
        substr(short_description, 1, 120) AS description FROM best JOIN inc ON number = did""",
        f"{INC_TEXT}, old AS (SELECT txt.* FROM txt JOIN inc ON number = txt.id WHERE state IN ('Resolved', 'Closed')), ask AS (SELECT txt.id AS qnumber, txt.text FROM txt JOIN inc ON number = txt.id WHERE state = 'Open' AND priority = 1), "
        + similar('ask', 'qnumber', 'old', 'id', 5)),
}
