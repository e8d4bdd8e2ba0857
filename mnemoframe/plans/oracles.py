"""DuckDB SQL for the queries that SQL can express. RE2 has no lookaround, so those patterns are spelled out otherwise."""

from __future__ import annotations

from mnemoframe.functions.text import CODE_LINE, LATIN, MACHINE_LINE, STOPWORDS, UMLAUTS
from mnemoframe.operators import recall

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _tokens(c: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"


_POST = f"post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY 1, 2)"
_LEN = f"lens AS (SELECT doc_id, len({_tokens('text')}) AS dl FROM documents)"
_STATS = "stats AS (SELECT count(*) AS n, coalesce(avg(dl)::double, 1.0) AS avgdl FROM lens)"
_WEIGHT = "ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl)))"
_BM25 = f"""{_POST}, {_LEN}, {_STATS}, dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
wanted AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_tokens('text')}) AS term FROM benchmark)),
scored AS (SELECT item_id, doc_id, round(sum({_WEIGHT}), 6) AS score FROM wanted JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), stats GROUP BY 1, 2)"""
_FIRST_TEXT = "(SELECT text FROM documents WHERE length(text) >= 400 ORDER BY doc_id LIMIT 1)"
_TERMS = f"""q AS (SELECT {_tokens(_FIRST_TEXT)} AS t),
nth AS (SELECT w, min(i) AS i FROM (SELECT unnest(t) AS w, generate_subscripts(t, 1) AS i FROM q) GROUP BY w ORDER BY i LIMIT 3)"""
_MATCH = "m AS (SELECT doc_id, text, count(*) FILTER (WHERE contains(lower(text), w)) AS matched_terms, count(*) AS n FROM documents, nth GROUP BY doc_id, text)"
_EMAIL = r"len(list_filter(regexp_extract_all(text, '(?i)[A-Z0-9._%+~-]+@([A-Z0-9.-]+\.[A-Z]{2,})', 1), lambda d: NOT regexp_matches(d, '^[0-9]x\.'))) > 0"
_GENERIC = r"""(?i:[A-Z0-9_]*(?:API_?KEY|SECRET|TOKEN|PASSWORD|PASSWD))\b["'']?\s*[=:]\s*["'']?"""
_FIXED = r"(^|[^A-Za-z0-9])sk-[A-Za-z0-9_-]{20,}|github_pat_[A-Za-z0-9_]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|an_sk_[A-Za-z0-9_-]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abpr]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20,}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
_SECRET = rf"(regexp_matches(text, '{_FIXED}') OR len(list_filter(regexp_extract_all(text, '{_GENERIC}([A-Za-z0-9_\-./+]{{24,}})', 1), lambda v: regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]'))) > 0)"
_DENY = r"regexp_matches(text, '(?i)(^|[^0-9A-Za-z_])(acme|globex|docparse|interviewkit|storybot|ini\.tech|ini-tech|ini tech|Umbrella Energie|Umbrella-Energie|hooli mag|hooli-mag|Teamco Website|Teamco-Website)($|[^0-9A-Za-z_])')"
_CLAIMS = """claims AS (SELECT 'customer ' || o_custkey AS topic, o_orderpriority AS key, CASE WHEN o_orderstatus = 'O' THEN 'offen' ELSE 'fakt' END AS kind, o_orderstatus AS text,
  CAST(o_orderdate AS date) AS stated_on, lpad(o_orderkey::varchar, 12, '0') AS source_doc_id FROM orders),
won AS (SELECT *, row_number() OVER (PARTITION BY topic, key ORDER BY stated_on DESC, source_doc_id DESC, text DESC) AS n,
  first_value(text) OVER (PARTITION BY topic, key ORDER BY stated_on DESC, source_doc_id DESC, text DESC) AS new_text,
  first_value(source_doc_id) OVER (PARTITION BY topic, key ORDER BY stated_on DESC, source_doc_id DESC, text DESC) AS new_source_doc_id FROM claims)"""
_LABELLED = """docs AS (SELECT d.doc_id::varchar AS doc_id, source, lang, CASE WHEN toxic = 1 THEN 'nda' WHEN quality = 0 THEN 'copyright' ELSE 'clean' END AS sensitivity,
  substr(sha256(text), 1, 16) AS fp, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_TALK = "talk AS (SELECT conv_id::varchar AS doc_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant'))"
_FIRST = "fst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') ORDER BY turn) AS n FROM talk) WHERE n = 1)"
_EVENTS = "ev AS (SELECT event_id::varchar AS doc_id, event_type AS source, 'user-' || user_id AS project, CAST(ts AS date) AS started_day, CASE WHEN event_type = 'error' THEN 'nda' ELSE 'clean' END AS sensitivity FROM events)"
_DENSE = """WITH scored AS (SELECT q.vec_id AS query, e.vec_id, round(list_dot_product(list_transform(e.embedding, lambda x: x::double), list_transform(q.embedding, lambda x: x::double)), 6) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 <= 1), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM scored)"""
_EDGES = """edges AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
top AS (SELECT e.child, CASE WHEN e.parent[1] = 'r' THEN e.parent ELSE p.parent END AS root FROM edges e LEFT JOIN edges p ON e.parent = p.child)"""

#: What Java's Unicode classes mean, spelled out.
_WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_MACHINE = MACHINE_LINE.replace(r"\s", f"[{_WS}]").replace(r"\d", r"\p{Nd}").replace(r"\w", r"\p{L}\p{M}\p{N}_").replace("'", "''")
_CODE = CODE_LINE.replace(r"#(?!\s)", r"#([^\s]|$)").replace("'", "''")
_BARE = f"regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_IS_MACHINE = (
    rf"(regexp_matches(x, '^[{_WS}]*(?:{_MACHINE})') OR length({_BARE}) > 200 AND NOT regexp_matches({_BARE}, '[.!?:]\s*$')"
    rf" AND length(regexp_replace({_BARE}, '[\p{{L}}\p{{N}}\s]', '', 'g'))::double / length({_BARE}) > 0.12)"
)
_PROSE = rf"""parts AS (SELECT doc_id, text, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda b: regexp_matches(b, '[^{_WS}]'))) AS b FROM documents),
cut AS (SELECT doc_id, length(b) AS n, list_filter(regexp_split_to_array(b, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_matches(x, '[^{_WS}]')) AS ls FROM parts),
good AS (SELECT doc_id, sum(n) AS n, sum(CASE WHEN len(ls) >= 8 AND len(list_filter(ls, lambda x: regexp_matches(x, '{_CODE}'))) >= 0.25 * len(ls) THEN 0
  ELSE coalesce(list_sum(list_transform(list_filter(ls, lambda x: NOT {_IS_MACHINE}), lambda x: length(x))), 0) END) AS g FROM cut GROUP BY doc_id),
prose AS (SELECT d.doc_id, text, coalesce(g::double / n, 0.0) AS prose FROM documents d LEFT JOIN good ON d.doc_id = good.doc_id)"""


def _slug(c: str, longest: int = 48) -> str:
    for a, b in UMLAUTS:
        c = f"replace({c}, '{a}', '{b}')"
    plain = f"regexp_replace(lower(translate({c}, '{LATIN[0]}', '{LATIN[1]}')), '[^\\x00-\\x7F]', '', 'g')"
    cut = f"rtrim(substr(trim(regexp_replace({plain}, '[^a-z0-9]+', '-', 'g'), '-'), 1, {longest}), '-')"
    return f"coalesce(nullif({cut}, ''), 'untitled')"


_CUES = recall.CUES.replace("'", "''")
_RECALL = rf"""names AS (SELECT DISTINCT lower(n_name) AS name FROM nation),
said AS (SELECT conv_id, turn, trim(regexp_replace(text, '{recall.SYSTEM}', '', 'g'), ' ') AS own FROM conversations WHERE role = 'user'),
hit AS (SELECT conv_id, turn, own, arg_min(name, length(name) * -1000000 + pos) AS name FROM (SELECT *, row_number() OVER (ORDER BY name) AS pos FROM names), said
  WHERE regexp_matches(lower(own), '(^|[^\w-])' || regexp_escape(name) || '($|[^\w-])') GROUP BY ALL),
judged AS (SELECT s.*, CASE WHEN {" OR ".join(f"starts_with(s.own, '{a}')" for a in recall.AUTOMATION)} THEN 'automation' WHEN length(s.own) < {recall.MIN_CHARS} THEN 'too short'
    WHEN length(s.own) < {recall.SHORT_REPLY_CHARS} AND regexp_matches(s.own, '{recall.SHORT_REPLY}') THEN 'short reply' END AS silent,
  CASE WHEN regexp_matches(s.own, '{_CUES}') THEN 'recall cue' WHEN h.name IS NOT NULL THEN 'mentions ' || h.name END AS loud
  FROM said s LEFT JOIN hit h ON s.conv_id = h.conv_id AND s.turn = h.turn AND s.own = h.own)"""
_BULLET = "'- **' || strftime(stated_on, '%Y-%m-%d') || '**: ' || trim(text)"
_NOTES = f"""claims AS (SELECT 'customer ' || o_custkey AS topic, o_orderpriority AS key, CASE WHEN o_orderstatus = 'O' THEN 'offen' ELSE 'fakt' END AS kind, o_orderstatus AS text, CAST(o_orderdate AS date) AS stated_on,
  lpad(o_orderkey::varchar, 12, '0') AS source_doc_id FROM orders),
refs AS (SELECT topic, source_doc_id, n, 'Q' || n AS ref FROM (SELECT topic, source_doc_id, row_number() OVER (PARTITION BY topic ORDER BY source_doc_id) AS n FROM (SELECT DISTINCT topic, source_doc_id FROM claims))),
w AS (SELECT *, row_number() OVER k AS n, first_value(text) OVER k AS new_text, first_value(stated_on) OVER k AS new_on, first_value(source_doc_id) OVER k AS new_id FROM claims
  WINDOW k AS (PARTITION BY topic, key ORDER BY stated_on DESC, source_doc_id DESC, text DESC)),
now AS (SELECT w.topic, kind, stated_on, w.source_doc_id, {_BULLET} || ' *(indirekt belegt)* [' || ref || ']' AS line FROM w JOIN refs ON w.topic = refs.topic AND w.source_doc_id = refs.source_doc_id WHERE w.n = 1),
sec AS (SELECT topic, kind, string_agg(line, chr(10) ORDER BY stated_on DESC, source_doc_id DESC, line DESC) AS lines FROM now GROUP BY topic, kind),
gone AS (SELECT w.topic, stated_on, w.source_doc_id, {_BULLET} || ' [' || a.ref || ']' || chr(10) || '  ersetzt am ' || strftime(new_on, '%Y-%m-%d') || ' durch: ' || trim(new_text) || ' [' || b.ref || ']' || chr(10) AS line
  FROM w JOIN refs a ON w.topic = a.topic AND w.source_doc_id = a.source_doc_id JOIN refs b ON w.topic = b.topic AND w.new_id = b.source_doc_id WHERE w.n > 1 AND trim(text) <> trim(new_text)),
old AS (SELECT topic, string_agg(line, '' ORDER BY stated_on DESC, source_doc_id DESC, line DESC) AS lines FROM gone GROUP BY topic),
src AS (SELECT topic, string_agg('- **' || ref || '** `corpus/' || source_doc_id || '`' || chr(10), '' ORDER BY n) AS lines FROM refs GROUP BY topic)"""
_SECTION = "coalesce(chr(10) || '## {head}' || chr(10) || chr(10) || {of}.lines || {end}, '')"

_TOLD = r"""told AS (SELECT conv_id::varchar AS conv_id, count(*) AS n_turns, md5(string_agg(role || ':' || regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY turn)) AS told_md5
  FROM conversations WHERE role IN ('user', 'assistant') AND regexp_matches(text, '\S') GROUP BY conv_id)"""

ORACLE: dict[str, str] = {
    "tokenize_tf": f"WITH {_POST} SELECT term, doc_id, tf FROM post",
    "doc_lengths": f"WITH {_LEN} SELECT doc_id, dl::bigint AS dl FROM lens",
    "term_df": f"WITH {_POST} SELECT term, count(*) AS df FROM post GROUP BY term",
    "corpus_stats": f"WITH {_LEN}, {_STATS} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_top10": f"WITH {_BM25} SELECT item_id, rank::int AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10",
    "bm25_top100": f"WITH {_BM25} SELECT item_id, rank::int AS rank, doc_id::varchar AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id::varchar) AS rank FROM scored) WHERE rank <= 100",
    "index_totals": f"WITH {_POST} SELECT (SELECT count(*) FROM documents) AS docs, sum(tf)::bigint AS tokens, count(DISTINCT term) AS terms, count(*) AS postings FROM post",
    "all_terms_many": f"""WITH t AS (SELECT doc_id AS query, {_tokens('text')} AS t FROM documents WHERE doc_id % 50 = 0),
        w AS (SELECT query, term FROM (SELECT query, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM t) GROUP BY query, term QUALIFY row_number() OVER (PARTITION BY query ORDER BY min(i)) <= 3),
        n AS (SELECT query, count(*) AS n FROM w GROUP BY query)
        SELECT w.query, d.doc_id FROM w JOIN documents d ON contains(lower(d.text), w.term) JOIN n ON n.query = w.query GROUP BY w.query, d.doc_id, n.n HAVING count(*) = n.n""",
    "name_mentions": f"""WITH t AS (SELECT doc_id, {_tokens('text')} AS t FROM documents WHERE doc_id % 50 = 0),
        n AS (SELECT DISTINCT term FROM (SELECT doc_id, term FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM t) GROUP BY doc_id, term QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) = 10)),
        m AS (SELECT doc_id, min({{'a': -length(term), 'term': term}}).term AS entity FROM documents JOIN n ON contains(lower(text), term) AND regexp_matches(lower(text), '(^|[^\\w-])' || term || '($|[^\\w-])') GROUP BY doc_id)
        SELECT d.doc_id, entity FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id""",
    "added_claims": "SELECT lang AS entity, CASE WHEN lang = 'es' THEN 't' ELSE 'new' END AS text, count(*) AS claims FROM documents WHERE lang IN ('de', 'fr', 'es') GROUP BY lang",
    "bm25_filtered_after_stats": f"""WITH {_BM25} SELECT item_id, rank::int AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
        FROM scored WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'de')) WHERE rank <= 10""",
    "known_item_eval": f"""WITH {_BM25}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10),
        hit AS (SELECT b.item_id, min(b.rank) AS rank FROM best b JOIN documents d USING (doc_id) JOIN benchmark i ON i.item_id = b.item_id WHERE contains(d.text, i.text) GROUP BY b.item_id)
        SELECT count(*) AS questions, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END)::double, 6) AS hit1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END)::double, 6) AS hit3,
        round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END)::double, 6) AS hit10, round(avg(coalesce(1.0::double / rank, 0.0)), 6) AS mrr FROM benchmark LEFT JOIN hit USING (item_id)""",
    "all_terms_match": f"WITH {_TERMS}, {_MATCH} SELECT doc_id FROM m WHERE matched_terms = n",
    "any_terms_partial": f"WITH {_TERMS}, {_MATCH} SELECT doc_id, matched_terms::int AS matched_terms FROM m WHERE matched_terms > 0",
    "phrase_required": rf"SELECT doc_id FROM documents WHERE contains(lower(text), (SELECT lower(regexp_extract(text, '(?s)(?:\S+\s){{3}}(.{{40}})', 1)) FROM {_FIRST_TEXT}))",
    "role_weighted_score": f"WITH {_TALK} SELECT doc_id, sum((CASE WHEN role = 'user' THEN 2.0 ELSE 1.0 END) * len(regexp_extract_all(text, '(?i)tion|the')))::double AS score FROM talk GROUP BY doc_id",
    "recency_score": "SELECT event_type AS source, round(sum(pow(0.5::double, greatest(date_diff('day', CAST(ts AS date), DATE '2024-02-15'), 0) / 120.0::double)), 4) AS recency FROM events GROUP BY 1",
    "search_substring": f"""WITH {_TERMS}, {_MATCH}, hits AS (SELECT doc_id, matched_terms, n, 2.0 * len(regexp_extract_all(lower(text), (SELECT string_agg(w, '|' ORDER BY length(w) DESC, i) FROM nth))) * 0.5 AS score FROM m),
        anyone AS (SELECT count(*) FILTER (WHERE matched_terms = n) > 0 AS any_full FROM hits)
        SELECT doc_id::varchar AS doc_id, round(score::double, 6) AS score, matched_terms::int AS matched_terms, n::int AS total_terms FROM hits, anyone
        WHERE matched_terms > 0 AND (matched_terms = n OR NOT any_full) ORDER BY matched_terms DESC, score DESC, doc_id::varchar LIMIT 20""",
    "search_fused": f"""WITH {_TERMS}, {_MATCH}, {_POST}, {_LEN}, {_STATS}, dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
        pat AS (SELECT string_agg(w, '|' ORDER BY length(w) DESC, i) AS p FROM nth),
        full_list AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id::varchar) AS rank FROM (SELECT doc_id, 2.0 * len(regexp_extract_all(lower(text), p)) * 0.5 AS score FROM m, pat WHERE matched_terms = n)),
        lex AS (SELECT doc_id, sum({_WEIGHT}) AS score FROM nth JOIN post ON nth.w = post.term JOIN dfs ON dfs.term = post.term JOIN lens USING (doc_id), stats GROUP BY 1),
        lex_list AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id::varchar) AS rank FROM lex ORDER BY rank LIMIT 100),
        rrf AS (SELECT doc_id, sum(1.0::double / (60 + rank)) AS score FROM (SELECT * FROM full_list UNION ALL SELECT * FROM lex_list) GROUP BY 1)
        SELECT r.doc_id::varchar AS doc_id, round(r.score, 6) AS score, m.matched_terms::int AS matched_terms, m.n::int AS total_terms FROM rrf r JOIN m USING (doc_id)
        ORDER BY (m.matched_terms = m.n) DESC, r.score DESC, r.doc_id::varchar LIMIT 20""",
    "dense_topk": f"{_DENSE} SELECT query, vec_id, score, rank::int AS rank FROM ranked WHERE rank <= 10 AND query % 50 = 0",
    "dense_topk_cells": f"{_DENSE} SELECT query, vec_id, score, rank::int AS rank FROM ranked WHERE rank <= 10 AND query % 50 = 0",
    "dense_best_per_owner": f"{_DENSE} SELECT query, label, max(score) AS score FROM ranked JOIN embeddings USING (vec_id) WHERE query % 50 = 0 GROUP BY query, label",
    "rrf_hybrid": f"{_DENSE} SELECT query - query % 50 AS query, vec_id, round(sum((CASE WHEN query % 50 = 0 THEN 1.0::double ELSE 0.5::double END) / (60 + rank)), 9) AS score FROM ranked WHERE rank <= 100 GROUP BY 1, 2",
    "chunk_windows": r"""WITH b AS (SELECT doc_id, source, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM documents),
        c AS (SELECT doc_id, source, i, substr(body, (i * 1500 + 1)::bigint, 1500) AS piece FROM (SELECT *, unnest(range(greatest((length(body) + 1499) // 1500, 1))) AS i FROM b)),
        k AS (SELECT * FROM c WHERE length(piece) > 40),
        f AS (SELECT doc_id, source, 0 AS i, substr(body, 1, 1500) AS piece FROM b WHERE doc_id NOT IN (SELECT doc_id FROM k) UNION ALL SELECT * FROM k)
        SELECT f.doc_id, (row_number() OVER (PARTITION BY f.doc_id ORDER BY i) - 1)::bigint AS chunk_no, md5(' |  | ' || f.source || chr(10) || piece) AS chunk_md5, substr(sha256(chr(10) || b.text), 1, 20) AS content_key FROM f JOIN b USING (doc_id)""",
    "timeline_recent": f"WITH {_EVENTS} SELECT doc_id, source, started_day, sensitivity FROM ev WHERE sensitivity <> 'nda' ORDER BY started_day DESC, doc_id LIMIT 15",
    "since_source_project_filter": f"WITH {_EVENTS} SELECT doc_id, project, started_day FROM ev WHERE source = 'purchase' AND contains(project, 'user-1') AND started_day >= DATE '2024-01-10'",
    "visible_by_default": f"WITH {_EVENTS} SELECT source, count(*) AS docs FROM ev WHERE sensitivity <> 'nda' GROUP BY source",
    "stats_by_source": f"WITH {_EVENTS} SELECT source, count(*) AS docs, count(*) FILTER (WHERE sensitivity = 'clean') AS clean, count(*) FILTER (WHERE sensitivity = 'copyright') AS copyright, count(*) FILTER (WHERE sensitivity = 'nda') AS nda FROM ev GROUP BY source",
    "get_doc_window": f"""WITH {_TALK}, w AS (SELECT doc_id, sum(length(text)) AS size, string_agg('## ' || role || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY turn) AS whole FROM talk GROUP BY doc_id ORDER BY size DESC, doc_id LIMIT 1)
        SELECT doc_id, substr(whole, 101, 500) AS body, length(whole)::int AS n_chars, CASE WHEN length(whole) > 600 THEN 600 END::int AS next_offset FROM w""",
    "nda_classify": f"SELECT doc_id, CASE WHEN {_EMAIL} OR {_SECRET} OR {_DENY} THEN 'nda' ELSE 'clean' END AS sensitivity FROM documents",
    "email_flag": f"SELECT doc_id, {_EMAIL} AS has_email FROM documents",
    "secret_flag": f"SELECT doc_id, {_SECRET} AS has_secret FROM documents",
    "redact_secrets": rf"SELECT doc_id, md5(CASE WHEN {_SECRET} THEN regexp_replace(text, '{_GENERIC}[A-Za-z0-9_\-./+]{{24,}}', '[secret removed]', 'g') ELSE text END) AS redacted_md5 FROM documents",
    "override_join": "SELECT source, CASE WHEN (source = 'src1' AND doc_id = 1) OR (source = 'src2' AND doc_id = 2) OR (source = 'src3' AND doc_id = 3) THEN 'nda' ELSE 'clean' END AS sensitivity, count(*) AS docs FROM documents GROUP BY 1, 2",
    "leak_gate": f"SELECT doc_id::varchar AS doc_id, 'clean but confidential' AS reason FROM documents WHERE {_EMAIL} OR {_SECRET} OR {_DENY}",
    "classifier_eval": f"""WITH r AS (SELECT quality = 0 AS e, ({_EMAIL} OR {_SECRET}) AS p FROM documents JOIN labels USING (doc_id)),
        c AS (SELECT count(*) FILTER (WHERE e AND p) AS tp, count(*) FILTER (WHERE NOT e AND p) AS fp, count(*) FILTER (WHERE e AND NOT p) AS fn, count(*) FILTER (WHERE NOT e AND NOT p) AS tn FROM r)
        SELECT *, round(tp / nullif(tp + fp, 0)::double, 6) AS precision, round(tp / nullif(tp + fn, 0)::double, 6) AS recall FROM c""",
    "turn_dedup": f"WITH {_TALK}, {_FIRST} SELECT doc_id, turn::int AS idx, role FROM fst",
    "user_text_concat": f"""WITH {_TALK}, {_FIRST}, ids AS (SELECT DISTINCT doc_id FROM talk), u AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t, sum(length(text)) AS n FROM fst WHERE role = 'user' GROUP BY doc_id)
        SELECT doc_id, md5(coalesce(t, '')) AS user_text_md5, coalesce(n, 0)::bigint AS user_chars FROM ids LEFT JOIN u USING (doc_id)""",
    "show_user_text": f"""WITH {_TALK}, ids AS (SELECT DISTINCT doc_id FROM talk), u AS (SELECT doc_id, string_agg('[????-??-??] ' || text, chr(10) || chr(10) ORDER BY turn) AS t FROM talk WHERE role = 'user' AND trim(text) <> '' GROUP BY doc_id)
        SELECT doc_id, md5(substr(coalesce(t, ''), 1, 40000)) AS shown_md5 FROM ids LEFT JOIN u USING (doc_id)""",
    "content_key": "SELECT doc_id, substr(sha256(source || chr(10) || text), 1, 20) AS content_key FROM documents",
    "short_id": "SELECT doc_id, substr(sha1(doc_id::varchar), 1, 8) AS short_id FROM documents",
    "doc_signature": "SELECT doc_id, 'memory|' || lang || '--' || source || '|' || substr(sha1(doc_id::varchar), 1, 8) AS signature FROM documents",
    "strip_noise": "SELECT conv_id, turn, md5('/run' || text) AS clean_md5 FROM conversations",
    "machine_authored": "SELECT role, role <> 'user' AS machine, count(*) AS turns FROM conversations GROUP BY 1, 2",
    "wikilink_extract": "SELECT s_suppkey, unnest([0, 1])::bigint AS pos, unnest([replace(s_name, '#', '-'), 'nation/' || s_nationkey]) AS target, '2' AS bad_lines FROM supplier",
    "grade_answers": "SELECT doc_id, NOT contains(lower(text), '###') AND (contains(lower(text), 'the') OR contains(lower(text), 'und') OR contains(lower(text), 'les') OR contains(lower(text), 'los')) AND (contains(lower(text), 'tion') OR contains(lower(text), 'ung') OR contains(lower(text), 'eau') OR contains(lower(text), 'ci')) AS correct FROM documents",
    "latest_wins": f"WITH {_CLAIMS} SELECT topic, key, text, stated_on, source_doc_id FROM won WHERE n = 1",
    "superseded_pairs": f"WITH {_CLAIMS} SELECT topic, key, source_doc_id, text, new_source_doc_id, new_text FROM won WHERE n > 1 AND trim(text) <> trim(new_text)",
    "pending_antijoin": f"WITH {_LABELLED} SELECT doc_id FROM docs WHERE quality IS NULL OR quality <> 1",
    "review_signature_match": f"WITH {_LABELLED} SELECT 'memory/2024/2024-02-01--memory--x--' || substr(sha1(doc_id), 1, 8) || '.md' AS doc_id, CASE WHEN quality IS NOT NULL THEN quality = 1 END AS covered FROM docs",
    "claim_upsert": f"""WITH {_CLAIMS}, r AS (SELECT topic, key, stated_on, text, row_number() OVER (PARTITION BY topic, key, stated_on ORDER BY CASE text WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END DESC) AS n FROM claims)
        SELECT topic, key, stated_on, text FROM r WHERE n = 1""",
    "claim_upsert_counts": f"""WITH {_CLAIMS}, a AS (SELECT DISTINCT topic, key FROM claims WHERE text <> 'F'), b AS (SELECT DISTINCT topic, key, true AS old FROM claims WHERE text = 'F')
        SELECT count(*) FILTER (WHERE old IS NULL) AS added, count(*) FILTER (WHERE old) AS replaced FROM a LEFT JOIN b USING (topic, key)""",
    "route_mixed_topics": f"""WITH {_LABELLED}, lv AS (SELECT source || ' ' || lang AS topic, count(DISTINCT sensitivity) AS n FROM docs GROUP BY 1)
        SELECT doc_id AS source_doc_id, topic, CASE WHEN sensitivity = 'nda' THEN 'private' ELSE 'clean' END AS layer,
        CASE WHEN sensitivity = 'copyright' THEN 'copyright source' WHEN n > 1 THEN 'mixed topic' END AS error FROM (SELECT *, source || ' ' || lang AS topic FROM docs) JOIN lv USING (topic)""",
    "provenance_errors": f"""WITH {_LABELLED} SELECT DISTINCT 'reviews' AS store, CASE WHEN l.toxic = 1 THEN '../' ELSE '' END || l.doc_id AS source_doc_id, CASE WHEN l.toxic = 1 THEN 'unsafe path' WHEN d.doc_id IS NULL THEN 'source missing' ELSE 'copyright source' END AS error
        FROM labels l LEFT JOIN docs d ON d.doc_id = l.doc_id::varchar WHERE l.toxic = 1 OR d.doc_id IS NULL OR d.sensitivity = 'copyright'""",
    "review_errors": f"WITH {_LABELLED} SELECT doc_id, 'reason contradicts claims' AS error FROM docs WHERE quality IS NOT NULL AND (quality <> 1) <> (toxic = 1)",
    "new_claims": f"WITH {_CLAIMS} SELECT topic, key, source_doc_id FROM claims WHERE kind <> 'fakt'",
    "progress_counts": f"""WITH {_LABELLED} SELECT count(*) AS candidates, count(*) FILTER (WHERE toxic = 1) AS extracted, count(*) FILTER (WHERE quality = 1) AS reviewed,
        count(*) FILTER (WHERE coalesce(quality, 0) <> 1 AND coalesce(toxic, 0) <> 1) AS open, (SELECT count(DISTINCT source) FROM docs WHERE toxic = 1) AS topics FROM docs""",
    "facet_topic_counts": f"WITH {_CLAIMS} SELECT topic, count(*) AS claims FROM claims GROUP BY topic",
    "source_numbers": f"WITH {_CLAIMS} SELECT topic, source_doc_id, 'Q' || row_number() OVER (PARTITION BY topic ORDER BY source_doc_id) AS ref FROM (SELECT DISTINCT topic, source_doc_id FROM claims)",
    "topic_spans": f"""WITH {_CLAIMS}, s AS (SELECT topic, min(stated_on) AS first_day, max(stated_on) AS last_day, count(*) AS claims FROM claims GROUP BY topic), o AS (SELECT topic, count(*) FILTER (WHERE kind = 'offen') AS open FROM won WHERE n = 1 GROUP BY topic)
        SELECT topic, first_day, last_day, claims, open, '- [[' || replace(topic, ' ', '-') || '|' || topic || ']] — ' || CASE WHEN first_day = last_day THEN first_day::varchar ELSE first_day || ' bis ' || last_day END || ', ' || claims ||
        CASE WHEN claims = 1 THEN ' Claim' ELSE ' Claims' END || CASE WHEN open > 0 THEN ', ' || open || ' offen' ELSE '' END AS line FROM s JOIN o USING (topic)""",
    "graph_components": f"""WITH {_EDGES}, u AS (SELECT child AS node, root FROM top UNION SELECT root, root FROM top), c AS (SELECT root, min(node) AS component FROM u GROUP BY root) SELECT node AS node_id, component FROM u JOIN c USING (root)""",
    "parent_chain": f"WITH {_EDGES} SELECT child, root = 'r1' AS reaches, false AS cyclic FROM top",
    "incremental_changed_files": "SELECT doc_id::varchar AS path, n_chars AS size FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality <> 1",
    "ingest_counts": f"""WITH {_EVENTS} SELECT count(*) AS seen, 0::bigint AS empty, count(*) FILTER (WHERE sensitivity = 'clean') AS clean, 0::bigint AS copyright, count(*) FILTER (WHERE sensitivity = 'nda') AS nda,
        count(*) FILTER (WHERE source <> 'click') AS added, count(*) FILTER (WHERE source = 'click') AS replaced FROM ev""",
    "run_averages": "SELECT event_type AS condition, count(*) AS answers, count(*) FILTER (WHERE value > 50) AS correct, round(avg(value), 4) AS cost_usd, round(avg(user_id + 1)::double, 4) AS tokens, round(avg(value), 4) AS seconds FROM events GROUP BY 1",
    "memory_routing": rf"""SELECT d.doc_id::varchar AS path, CASE WHEN {_SECRET} THEN 'refused' WHEN l.doc_id IS NOT NULL OR lang = 'fr' OR {_EMAIL} OR regexp_matches(text, '(?i)acme|globex|docparse|interviewkit|storybot|ini\.tech|ini-tech|ini tech|umbrella energie|umbrella-energie|hooli mag|hooli-mag|teamco website|teamco-website') THEN 'private' ELSE 'clean' END AS layer
        FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id""",
    "private_unindexed": "SELECT d.doc_id::varchar AS path FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality <> 1",
    "slugs": f"SELECT doc_id, {_slug('text')} AS slug FROM documents",
    "doc_paths": f"SELECT doc_id, 'codex/0000/0000-00-00--codex--' || {_slug('text')} || '--' || substr(sha1(doc_id::varchar), 1, 8) || '.md' AS path FROM documents",
    "fingerprint": f"""WITH {_TALK}, {_FIRST}, said AS (SELECT doc_id, string_agg('{{"machine_summary":false,"text":' || to_json(text)::varchar || '}}', ',' ORDER BY turn) AS rows FROM fst WHERE role = 'user' GROUP BY doc_id)
        SELECT t.doc_id, substr(sha256('[' || coalesce(rows, '') || ']'), 1, 16) AS fingerprint FROM (SELECT DISTINCT doc_id FROM talk) t LEFT JOIN said ON t.doc_id = said.doc_id""",
    "prose_ratio_lines": f"WITH {_PROSE} SELECT doc_id, round(prose, 6) AS prose FROM prose",
    "select_candidates": rf"""WITH {_PROSE} SELECT doc_id::varchar AS doc_id, length(text) AS user_chars, round(prose, 6) AS prose, round(length(text) * prose * 0.5::double, 4) AS score FROM prose
        WHERE length(text) >= 2000 AND prose >= 0.45 AND NOT regexp_matches(text, '(?i)^\s*<(scheduled|automated)-task(\s|>)')""",
    "recall_decisions": f"WITH {_RECALL} SELECT conv_id, turn, silent IS NULL AND loud IS NOT NULL AS fire, coalesce(silent, loud, 'no cue') AS reason FROM judged",
    "note_bodies": f"""WITH {_NOTES} SELECT src.topic, {_SECTION.format(head='Fakten', of='f', end='chr(10)')} || {_SECTION.format(head='Offen', of='o', end='chr(10)')} || {_SECTION.format(head='Ueberholt', of='old', end="''")}
        || {_SECTION.format(head='Quellen', of='src', end="''")} AS body FROM src LEFT JOIN sec f ON f.topic = src.topic AND f.kind = 'fakt' LEFT JOIN sec o ON o.topic = src.topic AND o.kind = 'offen' LEFT JOIN old ON old.topic = src.topic""",
    "emission_errors": f"""WITH c AS (SELECT doc_id, lang AS topic, substr(doc_id::varchar, 1, 1) AS e FROM documents), n AS (SELECT DISTINCT {_slug('e', 60)} AS slug, e AS name, 'entity' AS what FROM c UNION SELECT {_slug('topic', 60)}, topic, 'topic' FROM c)
        SELECT topic AS subject, 'needs exactly one entity' AS error FROM c GROUP BY topic HAVING count(DISTINCT e) <> 1 OR count(*) FILTER (WHERE e = '') > 0
        UNION ALL SELECT array_to_string(list_sort(list(DISTINCT name)), ', '), 'share the file name ' || slug FROM n GROUP BY slug HAVING count(*) > 1""",
    "corpus_signature": "SELECT count(*) AS files, sum(n_chars)::bigint AS bytes, sum(doc_id::hugeint * 1000000007)::varchar AS mtime_ns FROM documents",
    "layer_leaks": f"""WITH r AS (SELECT CASE WHEN toxic = 1 THEN 'private/' ELSE 'notes/' END || d.doc_id || '.md' AS rel, text, coalesce(toxic, 0) AS toxic, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
        SELECT rel AS subject, CASE WHEN toxic = 1 THEN 'secret in the private layer' ELSE 'clean layer holds confidential text' END AS reason FROM r WHERE CASE WHEN toxic = 1 THEN {_SECRET} ELSE {_EMAIL} OR {_SECRET} OR {_DENY} END
        UNION ALL SELECT rel, 'private note without a document' FROM r WHERE toxic = 1 AND quality IS DISTINCT FROM 1""",
    "store_leaks": f"""WITH {_LABELLED}, c AS (SELECT d.doc_id, d.source, d.text, s.sensitivity FROM documents d LEFT JOIN (SELECT * FROM docs WHERE quality IS NULL OR toxic = 0) s ON d.doc_id::varchar = s.doc_id),
        j AS (SELECT *, CASE WHEN sensitivity IS NULL THEN 'claim without a source' WHEN sensitivity = 'copyright' THEN 'claim from foreign material'
          WHEN sensitivity = 'clean' AND ({_EMAIL} OR {_SECRET} OR {_DENY}) THEN 'clean claim holds confidential text' END AS reason FROM c)
        SELECT source || ' k ' || doc_id AS subject, reason FROM j WHERE reason IS NOT NULL""",
    "snippet_window": f"""WITH {_TERMS}, hit AS (SELECT doc_id, text, arg_min(length(w), pos * 1000 - length(w)) AS n, min(pos) AS a FROM (SELECT doc_id, text, w, strpos(lower(text), w) - 1 AS pos FROM documents, nth) WHERE pos >= 0 GROUP BY doc_id, text),
        low AS (SELECT *, greatest(a - 60, 0) AS low, least(a + n + 90, length(text)) AS high FROM hit),
        ends AS (SELECT *, CASE WHEN strpos(reverse(left(text, low)), ' ') = 0 THEN 0 ELSE low - strpos(reverse(left(text, low)), ' ') + 1 END AS l,
          CASE WHEN high < length(text) AND strpos(substr(text, high + 1), ' ') > 0 THEN high + strpos(substr(text, high + 1), ' ') - 1 ELSE length(text) END AS r FROM low)
        SELECT d.doc_id, coalesce(trim(regexp_replace(substr(e.text, l + 1, r - l), '\\s+', ' ', 'g')), '') AS snippet FROM documents d LEFT JOIN ends e ON d.doc_id = e.doc_id""",
    "claude_code_documents": f"WITH {_TOLD} SELECT conv_id, 'p' || (conv_id::int % 5) AS project, n_turns, told_md5 FROM told",
    "codex_documents": f"WITH {_TOLD} SELECT conv_id, 'p' || (conv_id::int % 3) AS project, n_turns, told_md5 FROM told",
    "chatgpt_documents": f"WITH {_TOLD} SELECT conv_id, 'chatgpt' AS project, n_turns, told_md5 FROM told",
    "rendered_documents": f"WITH {_TOLD} SELECT conv_id, 'chatgpt' AS project, n_turns, told_md5 FROM told",
    "note_documents": f"""SELECT CASE WHEN toxic = 1 THEN 'private/' ELSE 'notes/' END || lang || '/' || d.doc_id || '.md' AS conv_id, 'Note ' || d.doc_id AS title, 'p' || source AS project, DATE '2024-01-01' + (d.doc_id % 9)::int AS started_day,
        CASE WHEN toxic = 1 THEN 'private/' ELSE 'notes/' END || lang AS cwd, 1::bigint AS n_turns, coalesce(toxic = 1, false) OR {_EMAIL} OR {_SECRET} OR {_DENY} AS private FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "changed_chunks": "SELECT doc_id::varchar AS doc_id FROM labels WHERE quality = 0 AND doc_id IN (SELECT doc_id FROM documents)",
    "removed_sources": "SELECT CASE WHEN o_orderstatus = 'O' THEN 'offen' ELSE 'fakt' END AS kind, count(*) AS claims FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1",
    "rejected_claims": r"SELECT doc_id::varchar AS source_doc_id FROM documents WHERE coalesce(length(text), 0) < 2000 OR regexp_matches(text, '(?i)^\s*<(scheduled|automated)-task(\s|>)')",
    "graph_audit_errors": "SELECT 'notes/s' || s_suppkey AS node_id, 1::bigint AS errors FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 11 = 0",
}
