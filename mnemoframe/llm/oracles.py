"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from mnemoframe.llm import licenses, lines, quality

_BASE32 = """list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * i + 1, 5))::bigint >> (15 - 5 * j)) & 31)::int, 1)), 'string_agg', '')), 'string_agg', '')"""

ORACLE: dict[str, str] = {}

ORACLE["op1_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, strlen(html)::bigint AS payload_bytes, {_BASE32.replace("substr(h,", "substr(p.h,")} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN w ON p.h = w.h
"""

_HOST = r"coalesce(lower(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)), '')"
_PATH = r"coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"
_QUERY = r"""array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&')"""

ORACLE["op8_url_filter"] = f"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS q FROM pages),
c AS (SELECT page_id, url, host, path, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
             || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical_url FROM p),
bad AS (SELECT DISTINCT canonical_url FROM c WHERE canonical_url <> '' AND
        try_cast(nullif(regexp_extract(url, '^[^?#]*/([0-9]{{1,18}})(?:[./?#]|$)', 1), '') AS bigint) IN (SELECT doc_id FROM labels WHERE toxic = 1)),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT c.page_id, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.verdict, length(r.h || r.p)) AS ruled
      FROM c JOIN r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p) GROUP BY c.page_id)
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.ruled, CASE WHEN b.canonical_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       c.canonical_url, b.canonical_url IS NOT NULL AS listed
FROM c LEFT JOIN m ON c.page_id = m.page_id LEFT JOIN bad b ON c.canonical_url = b.canonical_url
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE["op2_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::varchar, '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
        FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dwin AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS words FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, size, i, words FROM dwin WHERE words IN (SELECT words FROM win)),
spans AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS ids FROM (SELECT DISTINCT doc_id, words FROM hit) JOIN win USING (words) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(len(ids), 0)::bigint AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spans ON d.doc_id = spans.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

# Lines within one edit agree before or behind the middle of the shorter one; of what agrees there, the edit is checked character by character.
ORACLE["op7_line_dedup"] = f"""
WITH t AS (SELECT doc_id, text, n_chars, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM t),
w AS (SELECT * FROM l WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
u AS (SELECT x, length(x) AS n, min((doc_id, i)) AS place FROM w GROUP BY x),
k AS (SELECT x, place, m, n, unnest([left(x, m // 2), right(x, m - m // 2)]) AS part, unnest([0, 1]) AS side FROM (SELECT *, unnest([n, n - 1]) AS m FROM u WHERE n >= {lines.MIN_FUZZY})),
near AS (SELECT DISTINCT a.x AS a, b.x AS b, a.n AS n, b.n AS o FROM k a JOIN k b ON a.m = b.m AND a.side = b.side AND a.part = b.part AND a.place > b.place AND abs(a.n - b.n) <= 1 WHERE levenshtein(a.x, b.x) <= 4),
fuzzy AS (SELECT DISTINCT a AS x FROM near WHERE CASE WHEN n = o THEN len(list_filter(range(1, n + 1), lambda j: a[j] <> b[j])) = 1
  WHEN n < o THEN len(list_filter(range(0, n + 1), lambda j: left(a, j) = left(b, j) AND right(a, n - j) = right(b, n - j))) > 0
  ELSE len(list_filter(range(0, o + 1), lambda j: left(a, j) = left(b, j) AND right(a, o - j) = right(b, o - j))) > 0 END),
gone AS (SELECT w.doc_id, w.i FROM w JOIN u ON w.x = u.x LEFT JOIN fuzzy f ON w.x = f.x WHERE (w.doc_id, w.i) <> u.place OR f.x IS NOT NULL),
kept AS (SELECT l.doc_id, count(gone.i) AS n_dropped, coalesce(string_agg(CASE WHEN gone.i IS NULL THEN x END, chr(10) ORDER BY l.i), '') AS text FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT t.doc_id, coalesce(len(ls), 0)::bigint AS n_lines, coalesce(n_dropped, 0)::bigint AS n_dropped, CASE WHEN n_dropped > 0 THEN length(kept.text) ELSE n_chars END AS n_chars,
       sha256(CASE WHEN n_dropped > 0 THEN kept.text ELSE t.text END) AS text_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""

_KNOWN = ", ".join(f"('{v}', '{k}')" for k, v in licenses.SENTENCES.items())
_RULES = ", ".join(f"({i}, '{name}', ',{','.join(seq)},')" for i, (name, seq) in enumerate(licenses.RULES))

ORACLE["op9_license_scan"] = f"""
WITH known(sentence, id) AS (VALUES {_KNOWN}), rules(n, name, seq) AS (VALUES {_RULES}),
s AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]+\\s+|\\n+') AS parts FROM documents)),
ids AS (SELECT doc_id, string_agg(id, ',' ORDER BY i) AS ids, count(*) AS n FROM s JOIN known ON trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) = sentence GROUP BY doc_id),
fits AS (SELECT doc_id, name, min(n) AS n FROM (SELECT doc_id, rules.name, rules.n FROM ids JOIN rules ON contains(',' || ids || ',', seq)
  WHERE NOT (rules.name = 'proprietary' AND regexp_matches(',' || ids || ',', ',({"|".join(licenses.GRANTS)}),'))) GROUP BY doc_id, name),
lic AS (SELECT doc_id, string_agg(name, ',' ORDER BY n) AS licenses, min_by(name, n) AS license FROM fits GROUP BY doc_id)
SELECT d.doc_id, coalesce(ids, '') AS license_sentences, coalesce(licenses, '') AS licenses, license, coalesce(ids.n, 0)::bigint AS n_license_sentences
FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id LEFT JOIN lic ON d.doc_id = lic.doc_id
"""

_RATES = {k: f"1000 * {a} // greatest({b}, 1)" for k, (a, b, _, _) in quality.FEATURES.items()} | {"word_len": "100 * word_chars // greatest(n_words, 1)"}
_LONG = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS feature, {v} AS v FROM c WHERE n_words > 0" for k, v in {**_RATES, **{k: k for k in quality.SIZES}}.items())
_FLOOR = "CASE feature " + " ".join(f"WHEN '{k}' THEN least(greatest(high, {1000 * n} // greatest(mids['{b}'], 1), 1), {most})" for k, (_, b, n, most) in quality.FEATURES.items()) + " END"
_REACHED = f"{quality.REACH} * greatest({{}}, mid // {1 << quality.SUB_BITS})"
_LIMITS = [*[f"tail_{k}" for k in quality.FEATURES], "min_word_len", "max_word_len"]


def _beyond(k: str) -> str:
    a, b, n, _ = quality.FEATURES[k]
    ahead, mean = f"(1000.0::double * {a} - f['tail_{k}']::double * {b})", f"f['tail_{k}']::double * {b}"
    return f"CASE WHEN {ahead} > 0 AND {ahead} * {ahead} > {quality.DEVIATIONS**2 * 1000 * n}.0::double * {mean} THEN '{k}' END"


_OVER = [_beyond(k) for k in quality.FEATURES]
_OVER.insert(1, f"CASE WHEN {_RATES['word_len']} > f['max_word_len'] OR {_RATES['word_len']} < f['min_word_len'] THEN 'word_len' END")


def _toward(n: str, own: str, wider: str) -> str:
    return f"map_from_entries([{', '.join(f"('{k}', ({n} * {own}['{k}'] + {quality.EVIDENCE} * {wider}['{k}']) // ({n} + {quality.EVIDENCE}))" for k in _LIMITS)}])"


ORACLE["op10_quality_rules"] = f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) > 2),
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g3 WHERE n > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
c AS (SELECT t.doc_id, lang, source, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint AS n_symbols,
      coalesce(n_dup, 0)::bigint AS n_dup_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words, coalesce(n_lines, 0)::bigint AS n_lines
      FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id LEFT JOIN ln ON t.doc_id = ln.doc_id),
x AS (SELECT lang, source, feature, (v >> spare) << spare AS bucket FROM (SELECT *, greatest(length(bin(v)) - {quality.SUB_BITS + 1}, 0)::int AS spare FROM ({_LONG}))),
sk AS (SELECT 2 AS level, lang, source, feature, bucket, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 1, lang, NULL, feature, bucket, count(*) FROM x GROUP BY ALL UNION ALL SELECT 0, NULL, NULL, feature, bucket, count(*) FROM x GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, feature ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY level, lang, source, feature) AS total FROM sk),
q AS (SELECT level, lang, source, feature, min(CASE WHEN below * 100 >= total * {100 - quality.TAIL} THEN bucket END) AS low, min(CASE WHEN below * 100 >= total * 50 THEN bucket END) AS mid,
      min(CASE WHEN below * 100 >= total * {quality.TAIL} THEN bucket END) AS high, max(total) AS n FROM run GROUP BY ALL),
m AS (SELECT level, lang, source, map_from_entries(list((feature, mid))) AS mids FROM q WHERE feature IN ({", ".join(f"'{k}'" for k in quality.SIZES)}) GROUP BY ALL),
u AS (SELECT q.*, mids FROM q JOIN m ON q.level = m.level AND q.lang IS NOT DISTINCT FROM m.lang AND q.source IS NOT DISTINCT FROM m.source),
v AS (SELECT level, lang, source, n, 'tail_' || feature AS k, {_FLOOR} AS x FROM u WHERE feature IN ({", ".join(f"'{k}'" for k in quality.FEATURES)})
      UNION ALL SELECT level, lang, source, n, 'min_word_len', greatest(low - {_REACHED.format("mid - low")}, 0) FROM u WHERE feature = 'word_len'
      UNION ALL SELECT level, lang, source, n, 'max_word_len', high + {_REACHED.format("high - mid")} FROM u WHERE feature = 'word_len'),
f AS (SELECT level, lang, source, max(n) AS n, map_from_entries(list((k, x))) AS f FROM v GROUP BY ALL),
f1 AS (SELECT a.lang, {_toward("a.n", "a.f", "b.f")} AS f FROM f a, f b WHERE a.level = 1 AND b.level = 0),
f2 AS (SELECT a.lang, a.source, {_toward("a.n", "a.f", "b.f")} AS f FROM f a JOIN f1 b ON a.lang IS NOT DISTINCT FROM b.lang WHERE a.level = 2),
j AS (SELECT c.*, f FROM c LEFT JOIN f2 ON f2.lang IS NOT DISTINCT FROM c.lang AND f2.source IS NOT DISTINCT FROM c.source),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, array_to_string(list_filter([{', '.join(_OVER)}], lambda k: k IS NOT NULL), ',') AS reasons FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND reasons = '' AS kept, reasons FROM r
"""

ORACLE["op13_collocations"] = f"""
WITH p AS (SELECT lang, unnest(range(len(ps))) AS i, ps, doc_id FROM (SELECT doc_id, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents)),
w AS (SELECT lang, regexp_extract_all(ps[i + 1], '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
c AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::bigint AS n FROM c WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM c WHERE k > 1 AND a >= 30),
cut AS (SELECT lang, k, g, a, unnest(range(1, k)) AS cp FROM cand),
s AS (SELECT u.lang, u.k, u.g, u.a, u.cp, x.a AS l, y.a AS r, (2000000::hugeint * u.a // (x.a::hugeint + y.a))::bigint AS score FROM cut u
      JOIN c x ON x.lang = u.lang AND x.g = u.g[1:u.cp] JOIN c y ON y.lang = u.lang AND y.g = u.g[u.cp + 1:u.k]),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cp) = 1),
sub AS (SELECT lang, g[i:i + m - 1] AS g, max(a) AS longer FROM (SELECT lang, g, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN sub ON low.lang = sub.lang AND low.g = sub.g WHERE longer IS NULL OR 100 * longer < 80 * low.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, array_to_string(g, ' '))::int AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n.n, score
FROM kept JOIN n ON kept.lang = n.lang QUALIFY rank <= 2000
"""

# Sets that share no shingle aren't linked; of the pairs that do, all shared ones are counted.
ORACLE["op11_minhash_dedup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shares AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shares JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
root AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(root, d.doc_id)) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN root ON d.doc_id = root.a
"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE["op12_lexical_search"] = f"""
WITH d AS (SELECT doc_id, w, len(w)::bigint AS n FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) GROUP BY ALL),
c AS (SELECT count(*) AS docs, sum(n)::bigint AS words FROM d),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM t, c GROUP BY term),
s AS (SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::bigint AS score FROM q JOIN t USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
"""
