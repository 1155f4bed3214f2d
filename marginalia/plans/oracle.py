"""DuckDB SQL that returns the rows of the queries, written on its own from their meaning."""

from __future__ import annotations

from marginalia.operators import answers as A
from marginalia.operators import prompts as P


def text(s: str) -> str:
    """A string constant."""
    return "E'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


def prefix(t: str, n: int) -> str:
    return f"left({t}, list_max(list_filter(range({n // 4}, {n + 1}), lambda k: strlen(left({t}, k)) <= {n})))"


def cut(t: str, n: int, suffix: str) -> str:
    return f"CASE WHEN strlen({t}) > {n} THEN {prefix(t, n)} || {text(suffix)} ELSE {t} END"


WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) doc_id, 'doc_' || doc_id || '.pdf' filename, text, 1 pages, source session_id, doc_id no FROM documents)"
PAGES = "pg AS (SELECT doc_id, n page_no, nullif(l[n], '') text FROM (SELECT doc_id, string_split(text, chr(10)) l FROM docs), LATERAL (SELECT unnest(range(1, len(l) + 1)) n))"
LINKS = "links AS (SELECT session_id, doc_id, filename, pages, CAST(row_number() OVER (PARTITION BY session_id ORDER BY no) - 1 AS INTEGER) doc_pos FROM docs)"
CHUNKS = f"""w AS (SELECT doc_id, i, ws[i] word, strlen(ws[i]) n, sum(strlen(ws[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) s
  FROM (SELECT doc_id, {WORDS.format('text')} ws FROM docs WHERE strlen(text) > 2000), LATERAL (SELECT unnest(range(1, len(ws) + 1)) i)),
nxt AS (SELECT a.doc_id, a.i a, greatest(a.i, b.i) b FROM w a ASOF LEFT JOIN w b ON a.doc_id = b.doc_id AND a.s - a.n - 1 + 2001 >= b.s),
r AS (SELECT doc_id, 0 k, a, b FROM nxt WHERE a = 1 UNION ALL SELECT n.doc_id, r.k + 1, n.a, n.b FROM r JOIN nxt n ON n.doc_id = r.doc_id AND n.a = r.b + 1),
chunks AS (SELECT r.doc_id, r.k chunk_index, string_agg(w.word, ' ' ORDER BY w.i) text FROM r JOIN w ON w.doc_id = r.doc_id AND w.i BETWEEN r.a AND r.b GROUP BY r.doc_id, r.k
  UNION ALL SELECT doc_id, 0, text FROM docs WHERE strlen(text) <= 2000),
cs AS (SELECT l.session_id, l.doc_pos, c.doc_id, c.chunk_index, c.text, lower(c.text) lc, sha256(c.doc_id || ':' || c.chunk_index) chunk_id FROM chunks c JOIN links l USING (doc_id))"""
BASE = f"WITH RECURSIVE {DOCS}, {LINKS}, {CHUNKS}"
QUESTIONS = "q AS (SELECT conv_id || '-' || turn question_id, 'src' || (conv_id % 20) session_id, turn msg_seq, text message, lower(text) lq FROM conversations WHERE role = 'user')"
SCORED = f"""{QUESTIONS}, qw AS (SELECT *, {WORDS.format('lq')} ws FROM q),
sc AS (SELECT question_id, chunk_id, doc_pos, chunk_index, text, len(list_filter(ws, lambda x: contains(lc, x))) k, CASE WHEN contains(lc, lq) THEN 5 ELSE 0 END b FROM cs JOIN qw USING (session_id)),
rk AS (SELECT * FROM (SELECT *, k + b score, row_number() OVER (PARTITION BY question_id ORDER BY k + b DESC, doc_pos, chunk_index) rank, max(k + b) OVER (PARTITION BY question_id) most FROM sc)
  WHERE rank <= 20 AND (score > 0 OR most = 0))"""
RANKED = f"{BASE}, {SCORED}"
PART = "'[Chunk ' || rank || ' - Page 1]' || chr(10) || text || chr(10) || chr(10)"
MSG = "msg AS (SELECT conv_id || '-' || turn id, conv_id session_id, turn msg_seq, role, text content FROM conversations)"
HIST = f"""{MSG}, own AS (SELECT *, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || content line, row_number() OVER (PARTITION BY session_id ORDER BY msg_seq) p FROM msg WHERE role IN ('user', 'assistant')),
h AS (SELECT u.id, u.content, coalesce(list(o.line ORDER BY o.p) FILTER (o.line IS NOT NULL), []) lines FROM own u LEFT JOIN own o ON o.session_id = u.session_id AND o.p < u.p WHERE u.role = 'user' GROUP BY u.id, u.content)"""
VERDICT = f"WITH {MSG}, v AS (SELECT id, content || ' ' || ['I Cannot Find it', 'Not in the document', 'it is NOT FOUND', 'not available', 'yes'][msg_seq % 5 + 1] answer FROM msg)"
SUMMARIES = r"""s AS (SELECT doc_id, CASE no % 3
  WHEN 0 THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 2 = 0 THEN ' • - ' || x ELSE x END), chr(10))
  WHEN 1 THEN 'Main Topics: First, Second : rest' || chr(10) || text ELSE text END summary FROM docs)"""
SESSIONS = "ses AS (SELECT o_orderkey session_id, o_custkey user_id, o_orderpriority title, o_orderdate created_at, o_orderdate last_activity FROM orders)"
FILES = "f AS (SELECT l_orderkey * 10 + l_linenumber doc_id, l_orderkey session_id, 'part_' || l_partkey || '.pdf' filename, CAST(l_quantity AS INTEGER) pages, l_shipdate uploaded_at FROM lineitem)"
USERS = "us AS (SELECT c_custkey id, 'c' || c_custkey || '@example.com' email, md5(c_name) password_hash, c_name AS name FROM customer)"
REQUESTS = "rq AS (SELECT session_id, user_id + session_id % 2 user_id FROM ses)"
ATTACH = f"""{FILES}, cur AS (SELECT session_id, doc_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY doc_id) - 1 AS INTEGER) doc_pos FROM (SELECT DISTINCT session_id, doc_id FROM f WHERE pages <= 25)),
bat AS (SELECT DISTINCT session_id, doc_id, pages * 1000000 + date_diff('day', DATE '1970-01-01', CAST(uploaded_at AS DATE)) seq FROM f WHERE pages > 20),
fresh AS (SELECT session_id, doc_id, min(seq) seq FROM bat ANTI JOIN cur USING (session_id, doc_id) GROUP BY ALL)"""
REGISTER = f"""{USERS}, reg AS (SELECT CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'no-at-sign' WHEN 2 THEN 'c' || c_custkey || '@example.com' ELSE 'new' || (c_custkey // 12) || '@example.com' END email,
  CASE WHEN c_custkey % 6 = 3 THEN 'short' ELSE 'long enough' END pw, c_name AS name, c_custkey seq FROM customer),
rated AS (SELECT *, CASE WHEN email = '' THEN 'email required' WHEN NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'email malformed' WHEN length(pw) < 6 THEN 'password too short' END reason FROM reg),
good AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY seq) = 1 AND email NOT IN (SELECT email FROM us) ok FROM rated WHERE reason IS NULL)""".replace("\\\\", "\\")
NOW = "TIMESTAMP '1998-12-01'"


def body(system: str, user: str, limits: tuple[int, float]) -> str:
    """A request body of two messages."""
    return f"""'{{"messages":[{{"role":"system","content":' || to_json({system}) || '}},{{"role":"user","content":' || to_json({user}) || '}}],"model":"{P.MODEL}","max_tokens":{limits[0]},"temperature":{limits[1]}}}'"""


ORACLE = {
    "src_upload_dir": f"WITH {DOCS} SELECT doc_id, CAST(strlen(text) AS INTEGER) bytes, md5(text) digest FROM docs",
    "src_text": f"WITH {DOCS} SELECT doc_id, CAST(strlen(text) AS INTEGER) bytes, md5(text) digest FROM docs",
    "src_upload_source": f"WITH {DOCS} SELECT doc_id, CAST(strlen(text) AS INTEGER) bytes, md5(text) digest FROM docs",
    "src_upload_stream": f"WITH {DOCS} SELECT doc_id, CAST(strlen(text) AS INTEGER) bytes, md5(text) digest FROM docs",
    "snk_tables": f"""WITH {SESSIONS}, {FILES}, {MSG}, {USERS} SELECT 'sessions' AS name, CAST(session_id AS VARCHAR) AS key, title AS value FROM ses UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), filename FROM f
UNION ALL SELECT 'messages', id, md5(content) FROM msg UNION ALL SELECT 'users', CAST(id AS VARCHAR), email FROM us""",
    "src_tables": f"WITH {SESSIONS}, {FILES}, {USERS} SELECT session_id, us.name, (SELECT count(*) FROM f WHERE f.session_id = ses.session_id) n FROM ses LEFT JOIN us ON us.id = ses.user_id",
    "src_upload_gate": f"WITH {FILES}, g AS (SELECT *, CASE WHEN pages % 7 = 0 THEN 'text/plain' ELSE 'application/pdf' END mime FROM f) SELECT doc_id, filename, mime, CASE WHEN mime <> 'application/pdf' THEN 'not a PDF' WHEN pages * 1200000 > 52428800 THEN 'over 50 MB' ELSE 'accepted' END outcome FROM g",
    "src_upload_batch": """WITH x AS (SELECT l_orderkey batch_id, l_linenumber * 100000 + l_partkey file_no, 'part_' || l_partkey || '.pdf' filename, max(l_quantity > 5) ok FROM lineitem GROUP BY 1, 2, 3),
y AS (SELECT *, first_value(ok) OVER (PARTITION BY batch_id ORDER BY file_no) first_ok FROM x)
SELECT batch_id, filename, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY file_no) - 1 AS INTEGER) doc_pos FROM y WHERE first_ok AND ok""",
    "src_last_written": f"WITH {FILES}, x AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY uploaded_at DESC, 'uploads/' || doc_id DESC) n FROM f) SELECT filename, 'uploads/' || doc_id path, uploaded_at \"modificationTime\" FROM x WHERE n = 1",
    "snk_json": "SELECT '{\"question_id\":\"' || conv_id || '-' || turn || '\",\"session_id\":\"src' || (conv_id % 20) || '\",\"msg_seq\":' || turn || ',\"message\":' || to_json(text) || '}' AS value FROM conversations WHERE role = 'user'",
    "assemble_pages": f"WITH {DOCS}, {PAGES} SELECT doc_id, coalesce(string_agg(text || chr(10) || chr(10), '' ORDER BY page_no), '') text, count(*) pages FROM pg GROUP BY doc_id",
    "assemble_pages_marked": f"WITH {DOCS}, {PAGES} SELECT doc_id, coalesce(string_agg('--- Page ' || page_no || ' ---' || chr(10) || text || chr(10) || chr(10), '' ORDER BY page_no), '') text, count(*) pages FROM pg GROUP BY doc_id",
    "reject_blank": f"WITH {DOCS}, {PAGES} SELECT doc_id || '-' || page_no doc_id, 'PDF_PROCESSING_ERROR' code FROM pg WHERE page_no % 5 = 0 OR text IS NULL",
    "chunk_documents": f"{BASE} SELECT doc_id, chunk_index, CAST(strlen(text) AS INTEGER) bytes, md5(text) digest FROM chunks",
    "chunk_rows": f"{BASE} SELECT sha256(doc_id || ':' || chunk_index) chunk_id, doc_id, chunk_index, 1 page_number FROM chunks",
    "document_status": f"{BASE}, rq AS (SELECT CAST(doc_id * 2 AS VARCHAR) doc_id FROM documents) SELECT rq.doc_id, d.filename, d.pages, (SELECT count(*) FROM chunks c WHERE c.doc_id = d.doc_id HAVING count(*) > 0) chunks, CASE WHEN d.doc_id IS NULL THEN 'not found' ELSE 'processed' END status FROM rq LEFT JOIN docs d USING (doc_id)",
    "session_chunks": f"{BASE} SELECT session_id, doc_id, doc_pos, chunk_index FROM cs",
    "keyword_score": f"{RANKED} SELECT question_id, chunk_id, CAST(k AS INTEGER) keyword_score FROM sc",
    "phrase_bonus": f"{BASE}, fq AS (SELECT chunk_id question_id, session_id, lc lq FROM cs WHERE CAST(doc_id AS BIGINT) % 20 = 0) SELECT question_id, chunk_id, 5 phrase_bonus FROM fq JOIN cs USING (session_id) WHERE contains(lc, lq)",
    "phrase_bonus_all": f"{BASE}, {QUESTIONS} SELECT question_id, chunk_id, 5 phrase_bonus FROM q JOIN cs USING (session_id) WHERE contains(lc, lq)",
    "top_k_chunks": f"{RANKED} SELECT question_id, CAST(rank AS INTEGER) rank, chunk_id, score FROM rk WHERE score > 0",
    "fallback_first_k": f"{BASE}, {QUESTIONS} SELECT question_id, CAST(rank AS INTEGER) rank, chunk_id FROM (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY doc_pos, chunk_index) rank FROM q JOIN cs USING (session_id)) WHERE rank <= 5",
    "build_context": f"{RANKED}, c AS (SELECT question_id, 'Document Context:' || chr(10) || chr(10) || string_agg({PART}, '' ORDER BY rank) context FROM rk GROUP BY 1) SELECT question_id, CAST(strlen(context) AS INTEGER) bytes, md5(context) digest FROM c",
    "context_fulltext": f"WITH {DOCS}, {LINKS}, x AS (SELECT session_id, string_agg('--- ' || filename || ' ---' || chr(10) || text || chr(10) || chr(10), '' ORDER BY doc_pos) t FROM links JOIN docs USING (session_id, doc_id, filename) GROUP BY 1) SELECT session_id, 'Document Context:' || chr(10) || chr(10) || {cut('t', 15000, chr(10) + '... [truncated]')} context FROM x",
    "citations": f"{RANKED} SELECT question_id, 1 page, {cut('text', 100, '...')} text FROM rk WHERE rank = 1",
    "relevant_previews": f"{RANKED} SELECT question_id, CAST(rank AS INTEGER) rank, {cut('text', 200, '...')} preview FROM rk",
    "answer_record": f"""{RANKED}, c AS (SELECT question_id, lower('Document Context:' || chr(10) || chr(10) || string_agg({PART}, '' ORDER BY rank)) context, string_agg({cut('text', 200, '...')}, chr(10) ORDER BY rank) previews FROM rk GROUP BY 1),
a AS (SELECT q.*, c.previews, len(list_filter({WORDS.format('lq')}, lambda x: strlen(x) > 3 AND contains(c.context, x))) > 0 found FROM q LEFT JOIN c USING (question_id)), k AS (SELECT *, session_id <> 'src3' AND session_id IN (SELECT source FROM documents) ok FROM a)
SELECT question_id, session_id, CASE WHEN ok THEN CASE WHEN found THEN {text(A.MOCK_FOUND[0])} || message || {text(A.MOCK_FOUND[1])} ELSE {text(A.MOCK_NOT_FOUND)} END END response, CASE WHEN ok THEN found END answer_found,
  CASE WHEN ok THEN previews END relevant_chunks, CASE WHEN ok THEN 1 END n_citations, CASE WHEN NOT ok THEN 'SESSION_NOT_FOUND' END error FROM k""",
    "history_lines": f"WITH {HIST} SELECT id, CAST(len(lines) AS INTEGER) n, md5(array_to_string(lines, '|')) digest FROM h",
    "history_blocks": f"WITH {HIST} SELECT session_id, CAST((p - 1) // 32 AS BIGINT) block, CAST(count(*) AS INTEGER) n, md5(string_agg(line, '|' ORDER BY p)) digest FROM own GROUP BY 1, 2",
    "history_lengths": f"WITH {HIST} SELECT id, session_id, CAST(p - 1 AS BIGINT) n_lines FROM own WHERE role = 'user'",
    "question_prompt": f"""{RANKED}, c AS (SELECT question_id id, 'Document Context:' || chr(10) || chr(10) || string_agg({PART}, '' ORDER BY rank) context FROM rk GROUP BY 1), {HIST},
p AS (SELECT id, coalesce(context, 'Document Context:' || chr(10) || chr(10)) || chr(10) || chr(10) || CASE WHEN len(lines) > 0 THEN 'Previous conversation:' || chr(10) || array_to_string(list_transform(lines[-4:], lambda x: '- ' || x || chr(10)), '') || chr(10) ELSE '' END || 'Question: ' || content || {text(chr(10) * 2 + P.INSTRUCTION)} prompt FROM h LEFT JOIN c USING (id))
SELECT id, CAST(strlen(prompt) AS INTEGER) bytes, md5(prompt) digest FROM p""",
    "chat_messages_array": f"""{RANKED}, c AS (SELECT question_id id, 'Document Context:' || chr(10) || chr(10) || string_agg({PART}, '' ORDER BY rank) t FROM rk GROUP BY 1), {HIST}, x AS (SELECT h.id, h.content, h.lines, coalesce(c.t, 'Document Context:' || chr(10) || chr(10)) t FROM h LEFT JOIN c USING (id))
SELECT id, CAST(n AS INTEGER) n, role, md5(content) digest FROM (SELECT id, 0 n, 'system' AS role, {text(P.SYSTEM_HEAD)} || {cut('t', P.CHAT_BYTES, P.CHAT_SUFFIX)} || {text(P.SYSTEM_TAIL_CHAT)} content FROM x
  UNION ALL SELECT id, i, CASE WHEN i % 2 = 0 THEN 'assistant' ELSE 'user' END, lines[i] FROM x, LATERAL (SELECT unnest(range(1, len(lines) + 1)) i) UNION ALL SELECT id, len(lines) + 1, 'user', content FROM x)""",
    "chat_single_turn": f"WITH {DOCS} SELECT doc_id, 0 n, 'system' AS role, md5({text(P.SYSTEM_HEAD)} || text || {text(P.SYSTEM_TAIL_SINGLE)}) digest FROM docs UNION ALL SELECT doc_id, 1, 'user', md5('What is this about?') FROM docs",
    "summary_prompt": f"WITH {DOCS} SELECT doc_id, md5({text(P.SUMMARY_TEMPLATE.split('%s')[0])} || {cut('text', 8000, '...')} || {text(P.SUMMARY_TEMPLATE.split('%s')[1])}) digest FROM docs",
    "summary_messages": f"WITH {DOCS} SELECT doc_id, 0 n, 'system' AS role, md5({text(P.SUMMARY_SYSTEM)}) digest FROM docs UNION ALL SELECT doc_id, 1, 'user', md5({text(P.SUMMARY_USER)} || {cut('text', 12000, '... [content truncated]')}) FROM docs",
    "explain_prompt": f"WITH {MSG} SELECT id, 'Please explain the following text from page ' || CASE WHEN msg_seq % 4 = 0 THEN 'unknown' ELSE CAST(msg_seq % 4 AS VARCHAR) END || ':' || chr(10) || chr(10) || '\"' || content || '\"' prompt, CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END preview FROM msg",
    "inference_requests": f"""WITH {DOCS}, b AS (SELECT doc_id, 'summary' kind, {body(text(P.SUMMARY_SYSTEM), f"{text(P.SUMMARY_USER)} || {cut('text', P.SUMMARY_BYTES, P.SUMMARY_SUFFIX)}", P.SUMMARY_LIMITS)} body FROM docs
UNION ALL SELECT doc_id, 'chat', {body(f"{text(P.SYSTEM_HEAD)} || text || {text(P.SYSTEM_TAIL_SINGLE)}", "'What is in ' || filename || '?'", P.CHAT_LIMITS)} FROM docs) SELECT doc_id, kind, CAST(strlen(body) AS INTEGER) bytes, md5(body) digest FROM b""",
    "parse_completion": f"WITH {MSG}, x AS (SELECT *, (session_id + msg_seq) % 4 n FROM msg WHERE role = 'assistant') SELECT id, CASE WHEN n = 3 THEN {TRIM.format('content')} END answer, CASE n WHEN 0 THEN 'no choices' WHEN 1 THEN 'quota' WHEN 2 THEN 'malformed' END error FROM x",
    "answer_found_a": f"{VERDICT} SELECT id, NOT contains(lower(answer), 'cannot find') AND NOT contains(lower(answer), 'not in the document') found FROM v",
    "answer_found_b": f"{VERDICT} SELECT id, NOT contains(lower(answer), 'not found') AND NOT contains(lower(answer), 'not available') AND NOT contains(lower(answer), 'cannot find') found FROM v",
    "mock_answer": f"""{RANKED}, c AS (SELECT question_id, lower('Document Context:' || chr(10) || chr(10) || string_agg({PART}, '' ORDER BY rank)) t FROM rk GROUP BY 1),
x AS (SELECT q.question_id, message, len(list_filter({WORDS.format('lq')}, lambda x: strlen(x) > 3 AND contains(coalesce(t, 'document context:' || chr(10) || chr(10)), x))) > 0 found FROM q LEFT JOIN c USING (question_id))
SELECT question_id, found, CASE WHEN found THEN {text(A.MOCK_FOUND[0])} || message || {text(A.MOCK_FOUND[1])} ELSE {text(A.MOCK_NOT_FOUND)} END answer FROM x""",
    "mock_summary": f"WITH {DOCS}, x AS (SELECT doc_id, CAST(len({WORDS.format('text')}) AS VARCHAR) n FROM docs) SELECT doc_id, replace({text(A.MOCK_SUMMARY)}, '%d', n) summary, replace({text('|'.join(A.MOCK_TAKEAWAYS))}, '%d', n) takeaways, {text('|'.join(A.MOCK_TOPICS))} topics FROM x",
    "with_answers": f"WITH {QUESTIONS}, t AS (SELECT source session_id, min('doc_' || doc_id || '.pdf') t FROM documents GROUP BY 1) SELECT question_id, CASE WHEN length(t) % 2 = 1 THEN 'Based on ' || t || ': ' || message ELSE 'nothing found' END response FROM q JOIN t USING (session_id)",
    "extract_takeaways": rf"""WITH {DOCS}, {SUMMARIES}, x AS (SELECT doc_id, summary, list_filter(list_transform(list_filter(list_transform(string_split(summary, chr(10)), lambda x: {TRIM.format('x')}), lambda x: starts_with(x, '•') OR starts_with(x, '-')), lambda x: {TRIM.format("regexp_replace(regexp_replace(x, '^•', ''), '^-', '')")}), lambda x: x <> '') m FROM s)
SELECT doc_id, array_to_string(CASE WHEN len(m) > 0 THEN m ELSE list_transform(list_filter(list_transform(string_split(summary, '.')[1:3], lambda x: {TRIM.format('x')}), lambda x: strlen(x) > 20), lambda x: x || '.') END, '|') takeaways FROM x""",
    "extract_topics": rf"""WITH {DOCS}, {SUMMARIES}, x AS (SELECT doc_id, summary, list_filter(list_transform(list_filter(list_transform(string_split(summary, chr(10)), lambda x: lower({TRIM.format('x')})), lambda x: contains(x, 'topic') OR contains(x, 'theme')), lambda x: coalesce({TRIM.format("string_split(x, ':')[2]")}, '')), lambda x: x <> '') m FROM s)
SELECT doc_id, array_to_string(CASE WHEN len(m) > 0 THEN m ELSE list_filter(list_transform({WORDS.format('summary')}, lambda x: trim(x, '.,!?;:')), lambda x: strlen(x) > 3 AND ascii(x) < 128 AND NOT (ascii(x) BETWEEN 97 AND 122))[1:3] END, '|') topics FROM x""",
    "session_summaries": f"""WITH {DOCS}, c AS (SELECT DISTINCT conv_id FROM conversations), s AS (SELECT session_id, arg_min(doc_id, no) doc_id FROM docs GROUP BY 1 UNION ALL SELECT CAST(conv_id AS VARCHAR), 'missing' || conv_id FROM c WHERE conv_id % 2 = 0), r AS (SELECT DISTINCT session_id FROM docs UNION ALL SELECT CAST(conv_id AS VARCHAR) FROM c),
x AS (SELECT r.session_id, s.doc_id, d.text, CAST(len({WORDS.format('d.text')}) AS VARCHAR) n FROM r LEFT JOIN s USING (session_id) LEFT JOIN docs d ON d.doc_id = s.doc_id)
SELECT session_id, CASE WHEN text IS NOT NULL THEN replace({text(A.MOCK_SUMMARY)}, '%d', n) END summary, CASE WHEN text IS NOT NULL THEN replace({text('|'.join(A.MOCK_TAKEAWAYS))}, '%d', n) END takeaways, CASE WHEN doc_id IS NULL THEN 'SESSION_NOT_FOUND' WHEN text IS NULL THEN 'DOCUMENT_NOT_FOUND' END error FROM x""",
    "token_groups": rf"WITH {MSG}, x AS (SELECT id, regexp_extract_all(content, '[ \n]*[^ \n]+(?:[ \n]+[^ \n]+){{2}}|(?s:.+)') p FROM msg) SELECT id, CAST(i - 1 AS INTEGER) pos, p[i] piece FROM x, LATERAL (SELECT unnest(range(1, len(p) + 1)) i)",
    "parse_stream_log": rf"WITH {MSG}, x AS (SELECT id, content, regexp_extract_all(content, '[ \n]*[^ \n]+(?:[ \n]+[^ \n]+){{2}}|(?s:.+)') p FROM msg WHERE role = 'assistant') SELECT id stream_id, 'token' kind, len(p) n, strlen(content) bytes FROM x WHERE len(p) > 0 UNION ALL SELECT id, 'done', 1, strlen(content) FROM x",
    "reassemble_stream": f"WITH {MSG} SELECT id stream_id, content text, true complete FROM msg WHERE role = 'assistant'",
    "upsert_sessions": f"WITH {SESSIONS} SELECT session_id, user_id, CASE WHEN session_id % 3 = 0 THEN 'changed' ELSE title END title, created_at, CASE WHEN session_id % 3 = 0 THEN last_activity + INTERVAL 1 DAY ELSE last_activity END last_activity FROM ses UNION ALL SELECT -session_id - 1, user_id, title, created_at, last_activity FROM ses WHERE session_id % 5 = 0",
    "insert_ignore": f"WITH {FILES} SELECT doc_id, CASE WHEN session_id % 2 = 0 THEN arg_max(filename, (uploaded_at, filename, pages)) ELSE arg_min(filename, (uploaded_at, filename, pages)) END filename FROM f GROUP BY doc_id, session_id",
    "persist_turn": "WITH x AS (SELECT conv_id || '-' || turn k, 'src' || (conv_id % 20) session_id, text FROM conversations WHERE role = 'user' AND turn % 4 <> 0) SELECT session_id, k || ':u' id, 'user' AS role, text content, NULL citations FROM x UNION ALL SELECT session_id, k || ':a', 'assistant', 'ok', '[{\"page\":1,\"text\":\"t\"}]' FROM x",
    "persist_upload": f"WITH {DOCS} SELECT d.doc_id, d.session_id, d.filename, '' file_path, s.filename title FROM docs d LEFT JOIN docs s ON s.session_id = d.session_id AND s.no < 20",
    "user_sessions": f"WITH {SESSIONS}, {FILES}, s AS (SELECT user_id, session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last_activity DESC, session_id) AS INTEGER) session_rank FROM ses), d AS (SELECT session_id, doc_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY uploaded_at, doc_id) AS INTEGER) doc_rank FROM f) SELECT user_id, session_id, session_rank, doc_id, doc_rank FROM s LEFT JOIN d USING (session_id)",
    "session_documents": f"WITH {SESSIONS}, {FILES}, d AS (SELECT session_id, doc_id, CASE WHEN pages > 10 THEN '/up/' || filename ELSE '' END file_path, CAST(row_number() OVER (PARTITION BY session_id ORDER BY uploaded_at, doc_id) AS INTEGER) doc_rank FROM f WHERE session_id IN (SELECT session_id FROM ses)) SELECT session_id, doc_id, min(doc_rank) doc_rank, min(file_path) file_path FROM d GROUP BY 1, 2",
    "session_messages": f"WITH {MSG} SELECT id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY msg_seq) AS INTEGER) n, CASE WHEN msg_seq % 2 = 1 THEN 3 END page FROM msg",
    "owned_messages": f"WITH {SESSIONS}, {FILES} SELECT session_id, count(*) n FROM f WHERE session_id IN (SELECT session_id FROM ses WHERE session_id % 2 = 0) GROUP BY 1",
    "refused_requests": f"WITH {SESSIONS}, {REQUESTS} SELECT session_id, user_id FROM rq ANTI JOIN ses USING (session_id, user_id)",
    "delete_cascade": f"WITH {SESSIONS}, {FILES}, {MSG}, gone AS (SELECT session_id FROM ses WHERE session_id % 6 = 0) SELECT 'sessions' AS name, CAST(session_id AS VARCHAR) AS key FROM ses ANTI JOIN gone USING (session_id) UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR) FROM f ANTI JOIN gone USING (session_id) UNION ALL SELECT 'messages', id FROM msg ANTI JOIN gone USING (session_id)",
    "delete_user_cascade": f"WITH {SESSIONS}, {FILES}, {MSG}, {USERS}, gone AS (SELECT session_id FROM ses WHERE user_id % 4 = 1) SELECT 'users' AS name, CAST(id AS VARCHAR) AS key FROM us WHERE id % 4 <> 1 UNION ALL SELECT 'sessions', CAST(session_id AS VARCHAR) FROM ses ANTI JOIN gone USING (session_id) UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR) FROM f ANTI JOIN gone USING (session_id) UNION ALL SELECT 'messages', id FROM msg ANTI JOIN gone USING (session_id)",
    "delete_document_rows": f"WITH {FILES} SELECT doc_id, filename FROM f WHERE doc_id NOT IN (SELECT doc_id FROM f WHERE pages > 10)",
    "touch_last_activity": f"WITH {SESSIONS}, {FILES} SELECT ses.session_id, greatest(any_value(ses.last_activity), max(f.uploaded_at)) last_activity FROM ses LEFT JOIN f USING (session_id) GROUP BY 1",
    "expire_inactive": f"WITH {SESSIONS} SELECT CASE WHEN last_activity < TIMESTAMP '1997-06-01' THEN 'gone' ELSE 'kept' END AS name, CAST(session_id AS VARCHAR) AS key FROM ses",
    "clear_messages": f"WITH {MSG}, c AS (SELECT session_id, max(msg_seq) s FROM msg WHERE msg_seq IN (1, 3) AND session_id % 2 = 0 GROUP BY 1) SELECT id FROM msg LEFT JOIN c USING (session_id) WHERE s IS NULL OR msg_seq > s",
    "clear_sessions": f"WITH {SESSIONS}, {MSG}, c AS (SELECT session_id, max(TIMESTAMP '1997-01-01' + to_days(CAST(msg_seq AS INTEGER))) ts FROM msg WHERE msg_seq IN (1, 3) AND session_id % 2 = 0 GROUP BY 1) SELECT session_id, greatest(last_activity, ts) last_activity FROM ses LEFT JOIN c USING (session_id)",
    "attach_documents": f"WITH {ATTACH} SELECT session_id, doc_id, doc_pos FROM cur UNION ALL SELECT session_id, doc_id, CAST(coalesce(m, 0) + row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS INTEGER) FROM fresh LEFT JOIN (SELECT session_id, max(doc_pos) + 1 m FROM cur GROUP BY 1) USING (session_id)",
    "attach_to_sessions": f"WITH {SESSIONS}, {ATTACH}, c AS (SELECT session_id, max(uploaded_at) ts FROM f JOIN fresh USING (session_id, doc_id) WHERE pages > 20 GROUP BY 1) SELECT session_id, greatest(last_activity, ts) last_activity FROM ses LEFT JOIN c USING (session_id)",
    "attach_refused": f"WITH {ATTACH} SELECT session_id, doc_id, seq FROM bat ANTI JOIN fresh USING (session_id, doc_id, seq)",
    "detach_documents": f"WITH {ATTACH} SELECT session_id, doc_id, doc_pos FROM cur ANTI JOIN bat USING (session_id, doc_id)",
    "detach_refused": f"WITH {ATTACH} SELECT session_id, doc_id, seq FROM bat ANTI JOIN cur USING (session_id, doc_id)",
    "session_document_count": f"WITH {DOCS} SELECT session_id, count(*) OVER (PARTITION BY session_id) n_documents, doc_id, filename, pages FROM docs",
    "session_history": f"WITH {DOCS}, {MSG} SELECT id, 'src' || (session_id % 20) session_id, role, p.filename, p.pages FROM msg JOIN (SELECT session_id k, arg_min(filename, no) filename, 1 pages FROM docs GROUP BY 1) p ON p.k = 'src' || (msg.session_id % 20)",
    "document_store": f"WITH {FILES}, x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY uploaded_at DESC, filename DESC, pages DESC) n FROM f) SELECT doc_id, filename text, CASE WHEN pages > 10 THEN uploaded_at ELSE {NOW} END created_at, {NOW} updated_at FROM x WHERE n = 1",
    "register_users": f"WITH {REGISTER} SELECT email, name, seq FROM good WHERE ok",
    "register_refused": f"WITH {REGISTER} SELECT email, seq, reason FROM rated WHERE reason IS NOT NULL UNION ALL SELECT email, seq, 'email present' FROM good WHERE NOT ok",
    "lookup_users": f"WITH {REGISTER} SELECT id, email, name FROM us WHERE email IN (SELECT email FROM reg)",
    "constraint_audit": f"""WITH {SESSIONS}, {FILES}, {MSG}, u AS (SELECT c_custkey id, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE 'c' || (c_custkey // 2) || '@example.com' END email FROM customer), s AS (SELECT * FROM ses WHERE session_id % 7 <> 0),
x AS (SELECT 'users.email null' rule, CAST(id AS VARCHAR) AS key FROM u WHERE email IS NULL UNION ALL SELECT 'users.email repeated', email FROM u WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1
UNION ALL SELECT 'users.email repeated', NULL FROM u WHERE email IS NULL HAVING count(*) > 1 UNION ALL SELECT 'documents.doc_id repeated', CAST(doc_id AS VARCHAR) FROM f GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'documents.session_id orphan', CAST(session_id AS VARCHAR) FROM f ANTI JOIN s USING (session_id) UNION ALL SELECT 'messages.role unknown', id FROM msg WHERE role NOT IN ('user', 'assistant'))
SELECT rule, count(*) n, min(key) least FROM x GROUP BY 1""",
    "relative_date": f"WITH {SESSIONS}, x AS (SELECT session_id, last_activity t, CAST(floor((epoch_us(TIMESTAMP '1997-06-05 12:00:00') - epoch_us(last_activity)) / 86400000000) AS BIGINT) d FROM ses) SELECT session_id, CASE WHEN d = 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN d || ' days ago' ELSE month(t) || '/' || day(t) || '/' || year(t) END AS label FROM x",
    "session_title": f"WITH {SESSIONS} SELECT session_id, CASE WHEN session_id % 3 = 1 THEN title ELSE 'Untitled Session' END title FROM ses",
    "text_fields": f"WITH {DOCS} SELECT doc_id, CAST(len({WORDS.format('text')}) AS INTEGER) n, CAST(strlen(text) AS INTEGER) bytes FROM docs",
    "text_cuts": f"WITH {DOCS} SELECT doc_id, CASE WHEN strlen(text) > 100 THEN {prefix('text', 100)} ELSE text END head, md5({TRIM.format('text')}) trimmed FROM docs",
    "stream_chunks": f"{BASE} SELECT doc_id, sha256(doc_id || ':' || chunk_index) chunk_id, chunk_index FROM chunks",
    "stream_dedup_messages": "SELECT DISTINCT CAST(event_id // 4 AS VARCHAR) id FROM events",
    "stream_last_activity": "SELECT user_id session_id, max(ts) last_activity FROM events GROUP BY 1",
    "stream_sessions": """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END b FROM events), y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) g FROM x)
SELECT user_id session_id, min(ts) started, max(ts) last_activity, count(*) n_events FROM y GROUP BY user_id, g HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(date_trunc('millisecond', ts)) FROM events)""",
    "stream_session_state": """WITH RECURSIVE e AS (SELECT *, CASE WHEN act IN ('message', 'clear', 'delete') THEN NULL ELSE 'd' || event_id % 5 END doc, row_number() OVER (PARTITION BY u ORDER BY us, event_id) k
  FROM (SELECT user_id u, event_id, epoch_us(ts) us, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'message' WHEN 'error' THEN 'detach' WHEN 'purchase' THEN ['clear', 'delete', 'attach'][event_id % 3 + 1] ELSE 'attach' END act FROM events)),
s AS (SELECT DISTINCT u, CAST(0 AS BIGINT) k, CAST(NULL AS BIGINT) last_us, CAST(0 AS BIGINT) n, CAST([] AS VARCHAR[]) docs, CAST(NULL AS BIGINT) seq, CAST(NULL AS BIGINT) event_id, CAST(NULL AS VARCHAR) reason FROM e
  UNION ALL SELECT u, k, CASE WHEN reason IS NOT NULL THEN last_us WHEN act = 'delete' THEN NULL ELSE greatest(us, last_us) END, CASE WHEN reason IS NOT NULL THEN n WHEN act IN ('create', 'clear') THEN 0 WHEN act = 'message' THEN n + 1 ELSE n END,
    CASE WHEN reason IS NOT NULL THEN docs WHEN act = 'create' THEN [doc] WHEN act = 'attach' THEN list_append(docs, doc) WHEN act = 'detach' THEN list_filter(docs, lambda x: x <> doc) ELSE docs END, CASE WHEN reason IS NULL THEN event_id ELSE seq END, event_id, reason
  FROM (SELECT *, CASE WHEN act = 'create' THEN NULL WHEN last_us IS NULL THEN 'session not found: ' || u WHEN act = 'attach' AND list_contains(docs, doc) THEN 'document already exists in session: ' || doc WHEN act = 'detach' AND NOT list_contains(docs, doc) THEN 'document not found in session: ' || doc END reason
    FROM (SELECT e.u, e.k, e.us, e.act, e.doc, e.event_id, s.n, s.docs, s.seq, CASE WHEN e.us - s.last_us <= 172800000000 THEN s.last_us END last_us FROM s JOIN e ON e.u = s.u AND e.k = s.k + 1)))
SELECT u session_id, seq, 'state' outcome, n n_messages, array_to_string(docs, '|') documents, last_us FROM s WHERE last_us IS NOT NULL AND k = (SELECT max(k) FROM e WHERE e.u = s.u) AND (SELECT max(us) FROM e) - last_us <= 172800000000
UNION ALL SELECT u, event_id, reason, NULL, NULL, NULL FROM s WHERE reason IS NOT NULL""",
    "docs_per_user": f"WITH {SESSIONS}, {FILES} SELECT count(DISTINCT user_id) users, CAST(count(*) AS BIGINT) documents, round(count(*) / count(DISTINCT user_id), 6) average FROM f JOIN ses USING (session_id)",
    "weekly_active_share": "SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(DISTINCT user_id) active, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 6) share FROM events GROUP BY 1",
    "upload_success_rate": f"WITH {DOCS}, {PAGES} SELECT count(*) uploads, count(*) FILTER (text IS NULL) failures, round(avg(CASE WHEN text IS NULL THEN 0 ELSE 1 END), 6) rate FROM pg",
    "answer_found_rate": f"{VERDICT} SELECT count(*) answers, round(avg(CASE WHEN contains(lower(answer), 'not found') OR contains(lower(answer), 'not available') OR contains(lower(answer), 'cannot find') THEN 0 ELSE 1 END), 6) rate FROM v",
    "monthly_quota": f"WITH {SESSIONS}, {FILES}, b AS (SELECT user_id, uploaded_at ts, 1 d, 0 q FROM f JOIN ses USING (session_id) UNION ALL SELECT user_id, created_at, 0, 1 FROM ses) SELECT user_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, CAST(sum(d) AS BIGINT) pdfs, CAST(sum(q) AS BIGINT) questions, sum(d) > 10 OR sum(q) > 50 exceeded FROM b GROUP BY 1, 2",
}

#: Earlier names of queries that take whole tables.
for _name, _now in (("user_sessions_all", "user_sessions"), ("session_documents_all", "session_documents"), ("session_messages_all", "session_messages"), ("weekly_active_share_counted", "weekly_active_share")):
    ORACLE[_name] = ORACLE[_now]
