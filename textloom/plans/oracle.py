"""DuckDB twins of the core queries: written on their own, over the same tables."""

from __future__ import annotations

from textloom.functions import text as fx
from textloom.functions import words
from textloom.operators import translate

STEM = f"regexp_replace(w, '{fx.STEM_RX}', '\\1')"
CLEAN = r"trim(regexp_replace(regexp_replace(lower(text), '[^a-zıſа-яё\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^{fx.SPACE}+|{fx.SPACE}+$', '', 'g')"


def _rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


STOP = _list([w for w in words.SEARCH_STOPWORDS if "'" not in w])
TOKENS = f"""
WITH raw AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '') || ' ' || coalesce(title, '')), '[a-zA-Z]+')) AS w FROM documents),
tok AS (SELECT doc_id, {STEM} AS term FROM raw WHERE length(w) > 1 AND w NOT IN {STOP}),
post AS (SELECT doc_id, term, CAST(count(*) AS INT) AS tf FROM tok GROUP BY ALL)"""
IDF = TOKENS + """,
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, df, ln((SELECT count(*) FROM documents) / df) AS idf FROM df)"""
WEIGHTS = IDF + """,
raww AS (SELECT p.doc_id, p.term, p.tf, p.tf * i.idf AS w FROM post p JOIN idf i ON i.term = p.term),
wt AS (SELECT doc_id, term, tf, coalesce(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0), w) AS weight FROM raww)"""
WORDS_CLEAN = f"""
src AS (SELECT doc_id, lang, list_filter(string_split({CLEAN}, ' '), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
tr AS (SELECT lang, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM src WHERE lang IN ('en', 'ru')),
wc AS (SELECT lang, word, count(*) AS n, min((doc_id, pos)) AS first FROM tr GROUP BY ALL)"""
FREQ = WORDS_CLEAN + """,
kept AS (SELECT lang, word, n FROM wc QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, first) <= 250),
prof AS (SELECT lang, word, n, n / sum(n) OVER (PARTITION BY lang) AS prob FROM kept)"""
SHORT = WORDS_CLEAN + """,
sh AS (SELECT lang, word, n, max(n > 3) OVER (PARTITION BY lang) AS passing FROM wc WHERE length(word) <= 5),
kept AS (SELECT lang, word, n FROM sh WHERE n > 3 OR NOT passing),
prof AS (SELECT lang, word, n, n / sum(n) OVER (PARTITION BY lang) AS prob FROM kept)"""
SCORES = """,
fl AS (SELECT lang, 0.1 * min(prob) AS floor FROM prof GROUP BY lang),
dw AS (SELECT doc_id, unnest(ws) AS word FROM src),
dws AS (SELECT doc_id, word FROM dw WHERE length(word) <= {letters}),
hit AS (SELECT w.doc_id, f.lang, sum(ln(coalesce(p.prob, f.floor))) AS s FROM dws w CROSS JOIN fl f LEFT JOIN prof p ON p.lang = f.lang AND p.word = w.word GROUP BY ALL),
sc AS (SELECT d.doc_id, f.lang, coalesce(h.s, CAST('-infinity' AS DOUBLE)) AS score FROM documents d CROSS JOIN fl f LEFT JOIN hit h ON h.doc_id = d.doc_id AND h.lang = f.lang),
pred AS (SELECT doc_id, lang AS predicted FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, CASE lang WHEN 'ru' THEN 0 ELSE 1 END) = 1)"""


def _escaped(x: str) -> str:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{char}', '{name}')"
    return x


def _sentences(source: str, name: str = "sent") -> str:
    """CTEs that end in `name` (doc_id, index, text, document_offset, paragraph_offset, paragraph_length) of `source` (doc_id, text)."""
    return f"""
{name}_p0 AS (SELECT doc_id, regexp_extract_all(text, {_rx(fx.PARAGRAPH_RX)}) AS l FROM {source} WHERE text IS NOT NULL),
{name}_p1 AS (SELECT doc_id, unnest(l) AS par, generate_subscripts(l, 1) AS pi FROM {name}_p0),
{name}_p2 AS (SELECT doc_id, pi, par, coalesce(sum(length(par)) OVER (PARTITION BY doc_id ORDER BY pi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0 FROM {name}_p1),
{name}_s0 AS (SELECT doc_id, pi, p0, length(par) AS pl, length(regexp_extract(par, '^[.!?]+')) AS lead, regexp_extract_all(par, {_rx(fx.SENTENCE_RX)}) AS l FROM {name}_p2 WHERE NOT starts_with(par, chr(10))),
{name}_s1 AS (SELECT doc_id, pi, p0, pl, lead, unnest(l) AS raw, generate_subscripts(l, 1) AS si FROM {name}_s0),
{name}_s2 AS (SELECT *, lead + coalesce(sum(length(raw)) OVER (PARTITION BY doc_id, pi ORDER BY si ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(regexp_extract(raw, '^{fx.SPACE}*')) AS po FROM {name}_s1),
{name} AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p0 + po) - 1 AS INT) AS index, {_strip('raw')} AS text, CAST(p0 + po AS INT) AS document_offset, CAST(po AS INT) AS paragraph_offset, CAST(pl AS INT) AS paragraph_length
    FROM {name}_s2 WHERE regexp_matches(raw, '{fx.NOT_SPACE}'))"""


def _articles(lang: str) -> str:
    stop = _list(words.SUMMARY_STOPWORDS[lang])
    terms = f"list_filter(list_transform(regexp_extract_all(text, {_rx(fx.LATIN_RX)}), lambda x: lower(x)), lambda x: length(x) > 1 AND x NOT IN {stop})"
    a = f"a_{lang}"
    return f"""
{a} AS (SELECT doc_id, content AS text FROM documents WHERE lang = '{lang}' AND content IS NOT NULL),
{a}_t AS (SELECT doc_id, unnest({terms}) AS term FROM {a}),
{a}_tf AS (SELECT doc_id, term, count(*) AS tf FROM {a}_t GROUP BY ALL),
{a}_df AS (SELECT term, count(*) AS df FROM {a}_tf GROUP BY ALL),
{a}_w AS (SELECT doc_id, t.term, 0.5 * (1 + tf / max(tf) OVER (PARTITION BY doc_id)) * ln((SELECT count(*) FROM {a}) / df) AS weight FROM {a}_tf t JOIN {a}_df d ON d.term = t.term),
{_sentences(a, a + '_s')},
{a}_st AS (SELECT doc_id, index, unnest({terms}) AS term FROM {a}_s),
{a}_ss AS (SELECT s.doc_id, s.index, sum(w.weight) AS s FROM {a}_st s JOIN {a}_w w ON w.doc_id = s.doc_id AND w.term = s.term GROUP BY ALL),
{a}_sc AS (SELECT p.doc_id, p.index, p.text, coalesce(s.s, 0) * ((1 - p.document_offset / greatest(length(d.text), 1)) * (1 - p.paragraph_offset / greatest(p.paragraph_length, 1))) AS score
    FROM {a}_s p JOIN {a} d ON d.doc_id = p.doc_id LEFT JOIN {a}_ss s ON s.doc_id = p.doc_id AND s.index = p.index),
{a}_sel AS (SELECT * FROM {a}_sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, index) <= 10)"""


def _tag(w: str) -> str:
    return f"CASE WHEN ends_with({w}, 'ing') THEN 'VBG' WHEN ends_with({w}, 'ed') THEN 'VBD' WHEN ends_with({w}, 'ly') THEN 'RB' WHEN ends_with({w}, 's') THEN 'NNS' ELSE 'NN' END"


def _dictionary(domain: str) -> str:
    return f"""
ent AS (SELECT DISTINCT id, english, pos_tag, german, domain, created_at FROM dictionary_entries),
dict AS (SELECT english, pos_tag AS pos, coalesce(german, '') AS german, id FROM ent WHERE domain IN ('general', '{domain}') AND english IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY english, pos_tag ORDER BY (coalesce(german, '') <> '') DESC, (domain = '{domain}') DESC, id) = 1),
runs AS (SELECT DISTINCT id, source_text AS text FROM translation_runs),
sp0 AS (SELECT id, list_filter(regexp_extract_all(text, {_rx(fx.SPAN_RX)}), lambda s: regexp_matches(s, {_rx(fx.WORD_RX)})) AS l FROM runs WHERE text IS NOT NULL),
sp AS (SELECT id, unnest(l) AS span, generate_subscripts(l, 1) - 1 AS i FROM sp0),
tk0 AS (SELECT id, i, regexp_extract_all(span, {_rx(fx.WORD_RX)}) AS l FROM sp),
tk1 AS (SELECT id, i, lower(unnest(l)) AS word, generate_subscripts(l, 1) - 1 AS j FROM tk0),
tk AS (SELECT id, i * 100000 + j AS pos, word, {_tag('word')} AS tag FROM tk1),
ask AS (SELECT DISTINCT word, tag FROM tk)"""


LOOKUP = """,
form AS (
    SELECT word, tag, word AS form, 0 AS f FROM ask
    UNION ALL SELECT word, tag, left(word, length(word) - 3) || 'y', 1 FROM ask WHERE ends_with(word, 'ies') AND length(word) > 4
    UNION ALL SELECT word, tag, left(word, length(word) - 3), 2 FROM ask WHERE ends_with(word, 'ing') AND length(word) > 5
    UNION ALL SELECT word, tag, left(word, length(word) - 3) || 'e', 3 FROM ask WHERE ends_with(word, 'ing') AND length(word) > 5
    UNION ALL SELECT word, tag, left(word, length(word) - 2), 4 FROM ask WHERE ends_with(word, 'ed') AND length(word) > 4
    UNION ALL SELECT word, tag, left(word, length(word) - 1), 5 FROM ask WHERE ends_with(word, 'ed') AND length(word) > 4
    UNION ALL SELECT word, tag, left(word, length(word) - 2), 6 FROM ask WHERE ends_with(word, 'es') AND length(word) > 4
    UNION ALL SELECT word, tag, left(word, length(word) - 1), 7 FROM ask WHERE ends_with(word, 's') AND length(word) > 3
),
keyed AS (
    SELECT word, tag, form, f, tag AS pos, 0 AS k FROM form
    UNION ALL SELECT word, tag, form, f, '*', 1 FROM form
    UNION ALL SELECT word, tag, form, f, CASE tag WHEN 'NNS' THEN 'NN' ELSE 'VB' END, 2 FROM form WHERE tag IN ('NNS', 'VBG', 'VBD')
    UNION ALL SELECT word, tag, form, f, pos, 2 FROM form, (VALUES ('')) AS v(pos) WHERE false
),
cand AS (
    SELECT k.word, k.tag, 0 AS pass, k.f, k.k, d.german FROM keyed k JOIN dict d ON d.english = k.form AND d.pos = k.pos WHERE d.german <> ''
    UNION ALL SELECT k.word, k.tag, 1, k.f, d.id, d.german FROM form k JOIN dict d ON d.english = k.form WHERE d.german <> ''
),
best AS (SELECT word, tag, german FROM cand QUALIFY row_number() OVER (PARTITION BY word, tag ORDER BY pass, f, k) = 1),
look AS (SELECT a.word, a.tag, coalesce(b.german, '') AS german FROM ask a LEFT JOIN best b ON b.word = a.word AND b.tag = a.tag)"""

def _tagged(domain: str) -> str:
    """CTEs up to tg (id, span, j, gap, word, low, tag), look2 (low, tag, german) and ph (id, span, j, size, phrase) of the translator."""
    closed = " ".join(f"WHEN low IN {_list(ws.split())} THEN '{tag}'" for tag, ws in translate._CLOSED.items())
    endings = " ".join(f"WHEN ends_with(low, '{e}') AND length(low) > {len(e) + 2} THEN '{tag}'" for e, tag in translate._ENDINGS)
    fallback = ", ".join(f"('{tag}', '{other}', {k})" for tag, others in words.TAG_FALLBACKS.items() for k, other in enumerate(others, 2))
    forms = LOOKUP[LOOKUP.index("form AS (") : LOOKUP.index("keyed AS (")].replace("form AS (", "form2 AS (").replace("ask", "ask2").rstrip().rstrip(",")
    return f"""WITH RECURSIVE {_dictionary(domain)},
pc AS (SELECT id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS span FROM (SELECT id, regexp_extract_all(text, {_rx(translate._TILE)}) AS l FROM runs WHERE text IS NOT NULL)),
se AS (SELECT *, regexp_matches(s, '^[^.!?\\n]') AND NOT ends_with(s, chr(10)) AND regexp_matches(s, '[A-Za-z]') AS sentence, regexp_extract_all(s, {_rx(fx.WORD_RX + '|[^A-Za-z]+')}) AS l FROM pc),
pa AS (SELECT id, span, CASE WHEN NOT sentence THEN [s] WHEN regexp_matches(s, '^[A-Za-z]') THEN list_prepend('', l) ELSE l END AS l FROM se),
tk2 AS (SELECT id, span, j, l[2 * j + 1] AS gap, l[2 * j + 2] AS word, lower(l[2 * j + 2]) AS low FROM (SELECT id, span, l, unnest(range(0, len(l) // 2 + 1)) AS j FROM pa)),
kt AS (SELECT english AS w, pos AS t FROM dict WHERE pos <> '*' AND NOT contains(english, ' ') QUALIFY row_number() OVER (PARTITION BY english ORDER BY id) = 1),
tg0 AS (SELECT tk2.*, CASE {closed} END AS t1, k0.t AS t2, coalesce(k1.t, k2.t) AS base FROM tk2 LEFT JOIN kt k0 ON k0.w = low
    LEFT JOIN kt k1 ON ends_with(low, 's') AND k1.w = left(low, -1) AND k1.t IN ('NN', 'VB') LEFT JOIN kt k2 ON ends_with(low, 's') AND k2.w = left(low, -2) AND k2.t IN ('NN', 'VB')),
tg AS (SELECT id, span, j, coalesce(gap, '') AS gap, word, low, CASE WHEN word IS NOT NULL THEN coalesce(t1, t2, CASE base WHEN 'NN' THEN 'NNS' WHEN 'VB' THEN 'VBZ' END, CASE WHEN regexp_matches(word, '^[A-Z]') AND j > 0 THEN 'NNP' END, CASE {endings} ELSE 'NN' END) END AS tag FROM tg0),
ask2 AS (SELECT DISTINCT low AS word, tag FROM tg WHERE word IS NOT NULL),
{forms},
fb(tag, pos, k) AS (VALUES {fallback}),
key2 AS (SELECT word, tag, form, f, tag AS pos, 0 AS k FROM form2 UNION ALL SELECT word, tag, form, f, '*', 1 FROM form2 UNION ALL SELECT word, form2.tag, form, f, fb.pos, fb.k FROM form2 JOIN fb ON fb.tag = form2.tag),
can2 AS (SELECT k.word, k.tag, 0 AS pass, k.f, k.k, d.german FROM key2 k JOIN dict d ON d.english = k.form AND d.pos = k.pos WHERE d.german <> ''
    UNION ALL SELECT k.word, k.tag, 1, k.f, d.id, d.german FROM form2 k JOIN dict d ON d.english = k.form WHERE d.german <> ''),
look2 AS (SELECT a.word AS low, a.tag, coalesce(b.german, '') AS german FROM ask2 a LEFT JOIN (SELECT * FROM can2 QUALIFY row_number() OVER (PARTITION BY word, tag ORDER BY pass, f, k) = 1) b ON b.word = a.word AND b.tag = a.tag),
nx AS (SELECT id, span, j, low, lead(low, 1) OVER w AS l1, lead(low, 2) OVER w AS l2, lead(low, 3) OVER w AS l3, regexp_matches(lead(gap, 1) OVER w, '^{fx.SPACE}+$') AS g1, regexp_matches(lead(gap, 2) OVER w, '^{fx.SPACE}+$') AS g2, regexp_matches(lead(gap, 3) OVER w, '^{fx.SPACE}+$') AS g3 FROM tg WINDOW w AS (PARTITION BY id, span ORDER BY j)),
gr AS (SELECT id, span, j, 2 AS size, low || ' ' || l1 AS g FROM nx WHERE g1 UNION ALL SELECT id, span, j, 3, low || ' ' || l1 || ' ' || l2 FROM nx WHERE g1 AND g2 UNION ALL SELECT id, span, j, 4, low || ' ' || l1 || ' ' || l2 || ' ' || l3 FROM nx WHERE g1 AND g2 AND g3),
hit2 AS (SELECT gr.id, span, j, size, german AS phrase FROM gr JOIN dict d ON d.english = g AND d.pos = '*' WHERE d.german <> '' QUALIFY row_number() OVER (PARTITION BY gr.id, span, j ORDER BY size DESC) = 1),
ph AS (SELECT id, span, min(j) AS j, arg_min(size, j) AS size, arg_min(phrase, j) AS phrase FROM hit2 GROUP BY id, span
    UNION ALL SELECT h.id, h.span, min(h.j), arg_min(h.size, h.j), arg_min(h.phrase, h.j) FROM ph JOIN hit2 h ON h.id = ph.id AND h.span = ph.span AND h.j >= ph.j + ph.size GROUP BY h.id, h.span),
un AS (SELECT tg.*, l.german, p.size, p.phrase, EXISTS (SELECT 1 FROM ph o WHERE o.id = tg.id AND o.span = tg.span AND o.j < tg.j AND o.j + o.size > tg.j) AND tg.word IS NOT NULL AS inside
    FROM tg LEFT JOIN look2 l ON l.low = tg.low AND l.tag = tg.tag LEFT JOIN ph p ON p.id = tg.id AND p.span = tg.span AND p.j = tg.j)"""


def _translated(domain: str, direct: bool) -> str:
    cap = lambda x: f"upper(left({x}, 1)) || substring({x}, 2)"
    first = " OR (j = 0 AND regexp_matches(word, '^[A-Z]'))" if direct else ""
    asked = "german = '' AND NOT inside AND phrase IS NULL" if direct else "german = ''"
    if direct:
        text = f"tx AS (SELECT id, {_strip('string_agg(CASE WHEN word IS NULL THEN gap ELSE gap || shown END, chr(0) ORDER BY span, j)').replace('chr(0)', repr(''))} AS translated_text FROM sh GROUP BY id)"
    else:
        text = f"""us AS (SELECT *, row_number() OVER (PARTITION BY id, span ORDER BY j) - 1 AS u FROM sh WHERE word IS NOT NULL),
vb AS (SELECT id, span, min(u) FILTER (phrase IS NULL AND (tag = 'MD' OR starts_with(tag, 'VB'))) AS v, bool_or(u = 0 AND phrase IS NULL AND low IN ('if', 'because', 'although', 'while')) AS sub FROM us GROUP BY ALL),
st AS (SELECT us.id, us.span, string_agg(shown, ' ' ORDER BY CASE WHEN sub AND v > 1 AND u = v THEN 1000000 ELSE u END) FILTER (shown <> '') AS body FROM us JOIN vb ON vb.id = us.id AND vb.span = us.span GROUP BY ALL),
tx AS (SELECT st.id, {_strip("string_agg(" + cap("trim(body)") + " || regexp_extract(s, '[.!?]+$'), ' ' ORDER BY st.span)")} AS translated_text FROM st JOIN pc ON pc.id = st.id AND pc.span = st.span GROUP BY st.id)"""
    return _tagged(domain) + f""",
sh AS (SELECT *, coalesce(phrase, CASE WHEN german = '' THEN '[[' || word || ']]' WHEN starts_with(tag, 'NN'){first} THEN {cap('german')} ELSE german END) AS shown FROM un WHERE NOT inside),
{text},
ct AS (SELECT id, count(word) AS wc, sum(CASE WHEN phrase IS NOT NULL THEN size WHEN word IS NOT NULL AND NOT inside AND german <> '' THEN 1 ELSE 0 END) AS tc,
    list_sort(list(DISTINCT (low, tag)) FILTER (word IS NOT NULL)) AS seen, list_sort(list(DISTINCT (low, tag)) FILTER ({asked})) AS unknown FROM un GROUP BY id)
SELECT r.id, coalesce(translated_text, '') AS translated_text, CAST(coalesce(wc, 0) AS INT) AS word_count, CAST(coalesce(tc, 0) AS INT) AS translated_count,
    coalesce(array_to_string(list_transform(seen, lambda x: x[1] || '/' || x[2]), ' '), '') AS seen, coalesce(array_to_string(list_transform(unknown, lambda x: x[1] || '/' || x[2]), ' '), '') AS unknown
FROM runs r LEFT JOIN ct ON ct.id = r.id LEFT JOIN tx ON tx.id = r.id"""


PHRASES = """
WITH said AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'signup' THEN 'Dictate.' WHEN 'click' THEN 'analyze essay' WHEN 'view' THEN 'Read results!'
    WHEN 'purchase' THEN 'show plan' WHEN 'error' THEN 'clear essay' ELSE event_type END AS phrase FROM events),
num AS (SELECT *, trim(regexp_replace(lower(phrase), '[.!?]+$', '')) AS c, row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM said WHERE trim(coalesce(phrase, '')) <> ''),
isl AS (SELECT *, CASE WHEN c = 'dictate' THEN i - row_number() OVER (PARTITION BY session, c = 'dictate' ORDER BY seq) END AS island FROM num),
runs AS (SELECT *, CASE WHEN c = 'dictate' THEN row_number() OVER (PARTITION BY session, island ORDER BY seq) END AS k FROM isl),
prev AS (SELECT *, lag(k) OVER (PARTITION BY session ORDER BY seq) AS before FROM runs),
logged AS (SELECT session, seq, phrase, CASE WHEN coalesce(before, 0) % 2 = 1 THEN 'content' WHEN c IN ('analyze essay', 'dictate', 'read results', 'show plan', 'clear essay', 'help') THEN c ELSE 'no match' END AS outcome FROM prev)"""

CHANGES = """
WITH known AS (SELECT file_path AS path, max(file_hash) AS hash FROM documents WHERE file_path IS NOT NULL AND file_hash IS NOT NULL GROUP BY 1),
ch AS (SELECT d.file_path AS path, CASE WHEN k.path IS NULL THEN 'new' WHEN md5(coalesce(d.text, '')) = k.hash THEN 'unchanged' ELSE 'changed' END AS status
    FROM documents d LEFT JOIN known k ON k.path = d.file_path WHERE d.file_path IS NOT NULL)"""


def _search(searches: list[tuple[int, str, str]]) -> str:
    values = ", ".join(f"({i}, '{q}', '{s}')" for i, q, s in searches)
    return WEIGHTS + f""",
q(query_id, query, subject) AS (VALUES {values}),
q0 AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-zA-Z]+')) AS w FROM q),
qt AS (SELECT DISTINCT query_id, {STEM} AS term FROM q0 WHERE length(w) > 1 AND w NOT IN {STOP}),
qn AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY 1),
voc AS (SELECT query_id, count(*) AS known FROM qt WHERE term IN (SELECT term FROM df) GROUP BY 1),
hit AS (SELECT qt.query_id, wt.doc_id, sum(wt.weight) AS dot, string_agg(wt.term, ',' ORDER BY wt.term) AS matched_terms, count(*) AS n FROM wt JOIN qt ON qt.term = wt.term GROUP BY 1, 2),
sc AS (SELECT h.query_id, h.doc_id, round(dot / sqrt(known), 9) AS rank, matched_terms, n, n_terms FROM hit h JOIN voc v ON v.query_id = h.query_id JOIN qn ON qn.query_id = h.query_id)"""


def _placed(where: str = "", limit: str = "WHERE rank_pos <= 50") -> str:
    return f""",
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, doc_id) AS rank_pos FROM sc WHERE rank > 0 {where})
SELECT query_id, CAST(rank_pos AS INT) AS rank_pos, doc_id, round(rank, 6) AS rank, matched_terms FROM pl {limit}"""


def _metrics(searches: list[tuple[int, str, str]]) -> str:
    return _search(searches) + """,
pl AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, doc_id) AS rank_pos FROM sc WHERE rank > 0),
jd AS (SELECT DISTINCT query_id, doc_id FROM labels JOIN q ON q.subject = labels.subject),
rl AS (SELECT p.query_id, p.rank_pos, CASE WHEN j.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM pl p LEFT JOIN jd j ON j.query_id = p.query_id AND j.doc_id = p.doc_id),
hs AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank_pos) AS hits FROM rl),
nr AS (SELECT q.query_id, count(jd.doc_id) AS n_rel FROM q LEFT JOIN jd ON jd.query_id = q.query_id GROUP BY 1),
ag AS (SELECT n.query_id, n.n_rel, count(h.rank_pos) AS found, coalesce(sum(rel), 0) AS good, coalesce(sum(CASE WHEN rel = 1 THEN hits / rank_pos END), 0) AS ap,
    coalesce(sum(rel) FILTER (rank_pos <= n_rel), 0) AS in_r, coalesce(sum(rel) FILTER (rank_pos <= 5), 0) AS in_5, coalesce(sum(rel) FILTER (rank_pos <= 10), 0) AS in_10
    FROM nr n LEFT JOIN hs h ON h.query_id = n.query_id GROUP BY 1, 2),
pr AS (SELECT *, good / nullif(found, 0) AS "precision", good / nullif(n_rel, 0) AS recall FROM ag),
mt AS (SELECT query_id, "precision", recall, CASE WHEN "precision" IS NULL OR recall IS NULL OR "precision" + recall = 0 THEN 0.0 ELSE 2.0 * "precision" * recall / ("precision" + recall) END AS f1,
    ap / nullif(n_rel, 0) AS average_precision, in_r / nullif(n_rel, 0) AS r_precision, in_5 / 5.0 AS p_at_5, in_10 / 10.0 AS p_at_10 FROM pr),
lv AS (SELECT n.query_id, CAST(l.level AS INT) AS level, n.n_rel FROM nr n, range(11) AS l(level)),
cv AS (SELECT v.query_id, v.level, coalesce(max(h.hits / h.rank_pos), 0.0) AS "precision" FROM lv v LEFT JOIN hs h ON h.query_id = v.query_id AND v.n_rel > 0 AND h.hits / v.n_rel >= v.level / CAST(10 AS DOUBLE) GROUP BY 1, 2)"""


def sql(searches: list[tuple[int, str, str]], prefixes: list[str], snippet: list[str], domain: str) -> dict[str, str]:
    names = ["precision", "recall", "f1", "average_precision", "r_precision", "p_at_5", "p_at_10"]
    contents = "con AS (SELECT doc_id, content AS text FROM documents)"
    both = f"WITH {_articles('en')}, {_articles('es')}"
    dictionary = f"WITH {_dictionary(domain)}"
    essay_stop = _list(words.ESSAY_STOPWORDS)
    marker = lambda kind: " OR ".join(f"contains(lower(text), '{p}')" for p in words.ESSAY_MARKERS[kind])
    meaning = "CASE tag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.TAG_MEANINGS.items()) + f" ELSE '{words.OTHER_TAG}' END"
    titled = r"regexp_replace(regexp_extract(file_path, '[^/]*$'), '(.)\.[^.]*$', '\1')"
    correct = lambda p: f"CASE WHEN coalesce(t, '') = '' THEN NULL ELSE {p} = t END"
    tagged_rows = _tagged(domain) + f""",
fn AS (SELECT id, low AS word, tag, count(*) AS n, min((span, j)) AS first FROM tg WHERE word IS NOT NULL GROUP BY ALL),
fo AS (SELECT fn.*, l.german, {meaning.replace('CASE tag', 'CASE fn.tag')} AS meaning FROM fn JOIN look2 l ON l.low = fn.word AND l.tag = fn.tag),
fm AS (SELECT id, word, meaning, min((-n, first)) AS m FROM fo GROUP BY ALL), fj AS (SELECT id, word, string_agg(meaning, '; ' ORDER BY m) AS meaning FROM fm GROUP BY ALL),
fr AS (SELECT fo.id, fo.word, CAST(sum(n) AS BIGINT) AS frequency, string_agg(tag, ', ' ORDER BY n DESC, first) AS tag, any_value(fj.meaning) AS meaning, coalesce(first(german ORDER BY n DESC, first) FILTER (german <> ''), '') AS translation FROM fo JOIN fj ON fj.id = fo.id AND fj.word = fo.word GROUP BY ALL)"""
    return {
        "tokens_en": f"""WITH l AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(lower(coalesce(text, '') || ' ' || coalesce(title, '')), '[a-zA-Z]+'), lambda w: length(w) > 1 AND w NOT IN {STOP}), lambda w: {STEM}) AS t FROM documents)
SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INT) AS pos, unnest(t) AS term FROM l""",
        "postings_tf": TOKENS + " SELECT doc_id, term, tf FROM post",
        "doc_frequency_idf": IDF + " SELECT term, df, round(idf, 6) AS idf FROM idf",
        "tfidf_weights": WEIGHTS + " SELECT doc_id, term, tf, round(weight, 6) AS weight FROM wt",
        "vector_search_top50": _search(searches) + _placed(),
        "search_everything": _search(searches) + _placed(limit=""),
        "index_reindexed": TOKENS.replace("coalesce(text, '')", "coalesce(CASE WHEN lang = 'es' THEN content ELSE text END, '')") + " SELECT doc_id, term, tf FROM post",
        "search_all_words": _search(searches) + _placed("AND n >= n_terms"),
        "search_filtered": _search(searches) + _placed("AND doc_id IN (SELECT doc_id FROM documents WHERE doc_date >= '2024-01-05' AND doc_date <= '2024-02-20')"),
        "top_terms_per_doc": WEIGHTS + ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS k FROM wt) SELECT doc_id, CAST(k AS INT) AS rank_pos, term, round(weight, 4) AS weight FROM r WHERE k <= 15",
        "suggest": TOKENS + f""",
pf(prefix) AS (VALUES {', '.join(f"('{p}')" for p in prefixes)}),
al AS (SELECT DISTINCT prefix, 0 AS kind, term AS s FROM post JOIN pf ON length(prefix) >= 2 AND term ILIKE prefix || '%'
    UNION ALL SELECT DISTINCT prefix, 1, title FROM documents JOIN pf ON length(prefix) >= 2 AND title ILIKE '%' || prefix || '%'),
f AS (SELECT *, row_number() OVER (PARTITION BY prefix, kind ORDER BY s) AS i FROM al QUALIFY i <= 8),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY prefix, lower(s) ORDER BY kind, i) = 1),
p AS (SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY kind, i) AS place, s AS suggestion FROM o)
SELECT prefix, CAST(place AS INT) AS place, suggestion FROM p WHERE place <= 8""",
        "snippet_window": f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z]+') AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, len(l) AS n, lower(unnest(l)) AS w, generate_subscripts(l, 1) - 1 AS i FROM t),
f AS (SELECT doc_id, n, i, CASE WHEN {STEM} IN {_list(snippet)} THEN 1 ELSE 0 END AS flag FROM u),
s AS (SELECT doc_id, n, i, sum(flag) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 27 FOLLOWING) AS hits FROM f)
SELECT doc_id, CAST(i AS INT) AS best_start, CAST(hits AS INT) AS hits FROM s WHERE i <= n - least(n, 28) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i) = 1""",
        "snippets": f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[a-zA-Z]+|[^a-zA-Z]+') AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM t),
v AS (SELECT doc_id, i, p, lower(p) AS w, regexp_matches(p, '^[a-zA-Z]') AS word, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u),
f AS (SELECT *, word AND {STEM} IN {_list(snippet)} AS flag, CASE WHEN word THEN row_number() OVER (PARTITION BY doc_id, word ORDER BY i) - 1 END AS k, sum(CAST(word AS INT)) OVER (PARTITION BY doc_id) AS n FROM v),
s AS (SELECT doc_id, n, k, sum(CAST(flag AS INT)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 27 FOLLOWING) AS hits FROM f WHERE word),
b AS (SELECT doc_id, k AS b FROM s WHERE k <= n - least(n, 28) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, k) = 1),
x AS (SELECT f.*, e - length(p) AS a FROM f JOIN b ON b.doc_id = f.doc_id WHERE word AND k BETWEEN b AND b + 27),
y AS (SELECT doc_id, min(a) AS a, least(max(e), min(a) + 320) AS e, min(i) AS i0 FROM x GROUP BY doc_id),
z AS (SELECT y.doc_id, y.a, y.e, i0, max(x.i) FILTER (x.e <= y.a + 320) AS i1 FROM y JOIN x ON x.doc_id = y.doc_id GROUP BY ALL),
h AS (SELECT z.doc_id, string_agg(CASE WHEN flag THEN '<strong>' || {_escaped('p')} || '</strong>' ELSE {_escaped('p')} END, '' ORDER BY i) AS html FROM z JOIN f ON f.doc_id = z.doc_id AND f.i BETWEEN i0 AND i1 GROUP BY z.doc_id)
SELECT t.doc_id, CASE WHEN z.doc_id IS NULL THEN {_escaped('substring(text, 1, 320)')} ELSE CASE WHEN z.a > 0 THEN '…' ELSE '' END || coalesce(html, '') || CASE WHEN z.e < length(text) THEN '…' ELSE '' END END AS snippet
FROM t LEFT JOIN z ON z.doc_id = t.doc_id LEFT JOIN h ON h.doc_id = t.doc_id""",
        "dictated_essays": PHRASES + """, cl AS (SELECT session, coalesce(max(seq) FILTER (outcome = 'clear essay'), -1) AS c FROM logged GROUP BY session)
SELECT l.session, left(string_agg(trim(phrase), ' ' ORDER BY seq), 10000) AS essay FROM logged l JOIN cl ON cl.session = l.session WHERE outcome = 'content' AND seq > c GROUP BY l.session""",
        "rank_metrics": _metrics(searches) + " SELECT query_id, " + ", ".join(f'round("{n}", 6) AS "{n}"' for n in names) + " FROM mt",
        "pr_curve_11pt": _metrics(searches) + ' SELECT query_id, level, round("precision", 6) AS "precision" FROM cv',
        "rank_metrics_summary": _metrics(searches) + " " + " UNION ALL ".join(f"SELECT '{n}' AS metric, round(coalesce(avg(\"{n}\"), 0.0), 4) AS mean FROM mt" for n in names),
        "pr_curve_mean": _metrics(searches) + ' SELECT level, round(avg("precision"), 4) AS "precision" FROM cv GROUP BY level',
        "index_after_delete": TOKENS + """, lf AS (SELECT doc_id FROM documents WHERE coalesce(lang, '') <> 'es')
SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM lf) / count(*)), 6) AS idf FROM post WHERE doc_id IN (SELECT doc_id FROM lf) GROUP BY term""",
        "freq_profile": "WITH " + FREQ + " SELECT lang, word, n, round(prob, 9) AS prob, round(0.1 * min(prob) OVER (PARTITION BY lang), 9) AS min_prob FROM prof",
        "short_profile": "WITH " + SHORT + " SELECT lang, word, n, round(prob, 9) AS prob, round(0.1 * min(prob) OVER (PARTITION BY lang), 9) AS min_prob FROM prof",
        "langid_scores": "WITH " + FREQ + SCORES.format(letters=10**9) + """, b AS (SELECT doc_id, lang, CASE WHEN isinf(score) THEN -1e9 ELSE score END AS score FROM sc)
SELECT doc_id, lang, round(score, 4) AS score, round((score - min(score) OVER w) / coalesce(nullif(max(score) OVER w - min(score) OVER w, 0), 1) * 100, 4) AS percent FROM b WINDOW w AS (PARTITION BY doc_id)""",
        "langid_freq": "WITH " + FREQ + SCORES.format(letters=10**9) + " SELECT doc_id, predicted FROM pred",
        "langid_short": "WITH " + SHORT + SCORES.format(letters=5) + " SELECT doc_id, predicted FROM pred",
        "langid_summary": f"""WITH a AS (SELECT 'freq_words' AS method, doc_id, predicted FROM (WITH {FREQ + SCORES.format(letters=10**9)} SELECT * FROM pred)
    UNION ALL SELECT 'short_words', doc_id, predicted FROM (WITH {SHORT + SCORES.format(letters=5)} SELECT * FROM pred))
SELECT method, CAST(sum(CASE WHEN predicted = true_language THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total, round(sum(CASE WHEN predicted = true_language THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS accuracy
FROM a JOIN documents d ON d.doc_id = a.doc_id WHERE coalesce(true_language, '') <> '' GROUP BY method""",
        "char_windows": f"""WITH c AS (SELECT doc_id, {CLEAN} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, t, unnest(range(0, length(t), 60)) AS i FROM c), w AS (SELECT doc_id, i, trim(substring(t, i + 1, 120)) AS win FROM s)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS i, win AS "window" FROM w WHERE length(win) > 20""",
        "char_ngrams": f"""WITH c AS (SELECT doc_id, unnest(list_filter(string_split({CLEAN}, ' '), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, '_' || w || '_' AS w FROM c), n AS (SELECT doc_id, w, unnest(range(1, 6)) AS k FROM p),
g AS (SELECT doc_id, k, substring(w, i, k) AS gram FROM (SELECT doc_id, w, k, unnest(range(1, length(w) - k + 2)) AS i FROM n WHERE k <= length(w)))
SELECT doc_id, CAST(k AS INT) AS n, count(*) AS grams, count(DISTINCT gram) AS different FROM g GROUP BY 1, 2""",
        "sentences_offsets": f"WITH {contents}, {_sentences('con')} SELECT doc_id, index, text, document_offset, paragraph_offset, paragraph_length FROM sent",
        "summary_sentence": both + " " + " UNION ALL ".join(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY index) AS INT) AS position, index, text, round(score, 4) AS score, '{lang}' AS lang FROM a_{lang}_sel" for lang in ("en", "es")),
        "keywords": both + " " + " UNION ALL ".join(f"SELECT doc_id, CAST(k AS INT) AS position, term, round(weight, 4) AS weight, '{lang}' AS lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS k FROM a_{lang}_w WHERE weight > 0) WHERE k <= 12" for lang in ("en", "es")),
        "summary_evaluation": f"""WITH {_articles('en')}, ref AS (SELECT doc_id, index FROM a_en_s WHERE index < 8),
ov AS (SELECT r.doc_id, count(s.index) AS overlap FROM ref r LEFT JOIN a_en_sel s ON s.doc_id = r.doc_id AND s.index = r.index GROUP BY 1)
SELECT doc_id, overlap, round_even(overlap / 10, 2) AS "precision", round_even(overlap / 8, 2) AS recall FROM ov""",
        "dictionary_overlay": dictionary + " SELECT english, pos, german FROM dict",
        "lookup_words": dictionary + LOOKUP + " SELECT word, tag, german FROM look",
        "frequency_dictionary": dictionary + LOOKUP + f""", n AS (SELECT id, word, tag, count(*) AS n, min(pos) AS first FROM tk GROUP BY ALL),
r AS (SELECT n.*, l.german, {meaning.replace('CASE tag', 'CASE n.tag')} AS meaning FROM n JOIN look l ON l.word = n.word AND l.tag = n.tag)
SELECT id, word, CAST(sum(n) AS BIGINT) AS frequency, string_agg(tag, ', ' ORDER BY n DESC, first) AS tag, string_agg(meaning, '; ' ORDER BY n DESC, first) AS meaning, coalesce(first(german ORDER BY n DESC, first) FILTER (german <> ''), '') AS translation FROM r GROUP BY 1, 2""",
        "unknown_words": dictionary + LOOKUP + f""", kn AS (SELECT DISTINCT english, pos_tag FROM ent WHERE domain IN ('general', '{domain}'))
SELECT word AS english, tag AS pos, german, '{domain}' AS domain FROM look l WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.english = l.word AND kn.pos_tag = l.tag)""",
        "tagged_words": _tagged(domain) + " SELECT id, CAST(span AS INT) AS span, CAST(j AS INT) AS j, gap, word, tag FROM tg WHERE word IS NOT NULL",
        "phrase_hits": _tagged(domain) + " SELECT id, CAST(span AS INT) AS span, CAST(j AS INT) AS j, CAST(size AS INT) AS size, phrase FROM ph",
        "tagged_frequency": tagged_rows + " SELECT id, word, frequency, tag, meaning, translation FROM fr",
        "tagged_unknown": _tagged(domain) + f""", kn AS (SELECT DISTINCT english, pos_tag FROM ent WHERE domain IN ('general', '{domain}'))
SELECT low AS english, tag AS pos, german, '{domain}' AS domain FROM look2 l WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.english = l.low AND kn.pos_tag = l.tag)""",
        "translate_direct": _translated(domain, True),
        "translate_transfer": _translated(domain, False),
        "translation_report": tagged_rows + """,
ln AS (SELECT id, string_agg(concat_ws(chr(9), CAST(frequency AS VARCHAR), word, CASE WHEN coalesce(translation, '') = '' THEN '—' ELSE translation END, tag, meaning), chr(10) ORDER BY frequency DESC, word) AS lines FROM fr GROUP BY id),
ru AS (SELECT DISTINCT * FROM translation_runs)
SELECT ru.id, 'Title: ' || coalesce(title, '') || chr(10) || 'Domain: ' || coalesce(domain, '') || chr(10) || 'Method: transfer' || chr(10) || 'Date: ' || coalesce(strftime(created_at, '%Y-%m-%d %H:%M'), '') || chr(10)
    || 'Words: ' || coalesce(CAST(word_count AS VARCHAR), '') || chr(10) || 'Translated: ' || coalesce(CAST(translated_count AS VARCHAR), '') || chr(10) || chr(10) || 'Source text:' || chr(10) || coalesce(source_text, '') || chr(10) || chr(10)
    || 'Translation:' || chr(10) || coalesce(translated_text, '') || chr(10) || chr(10) || 'Frequency dictionary:' || chr(10) || coalesce(lines, '') AS report FROM ru LEFT JOIN ln ON ln.id = ru.id""",
        "dictionary_seeded": f"""WITH k AS (SELECT english, pos_tag AS pos, domain, max(german) AS german FROM (SELECT DISTINCT * FROM dictionary_entries) GROUP BY ALL),
s AS (SELECT english, pos, '{domain}' AS domain, german FROM k WHERE domain = 'general')
SELECT coalesce(k.english, s.english) AS english, coalesce(k.pos, s.pos) AS pos, coalesce(k.domain, s.domain) AS domain, CASE WHEN coalesce(k.german, '') <> '' THEN k.german ELSE coalesce(s.german, k.german) END AS german
FROM k FULL JOIN s ON k.english = s.english AND k.pos = s.pos AND k.domain = s.domain""",
        "dictionary_inserted": """WITH e AS (SELECT DISTINCT english, pos_tag, domain FROM dictionary_entries), a AS (SELECT * FROM e UNION SELECT english, pos_tag, 'general' FROM e WHERE domain <> 'general')
SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.pos_tag = '*' AND e.english = a.english AND e.pos_tag = a.pos_tag)""",
        "dictionary_page": "SELECT DISTINCT id, english, pos_tag, german, domain FROM dictionary_entries WHERE english ILIKE '%e%' OR german ILIKE '%e%' ORDER BY english, pos_tag, id LIMIT 20 OFFSET 20",
        "essay_indicators": f"""WITH {contents}, c AS (SELECT doc_id, len(regexp_extract_all(text, {_rx(fx.ESSAY_WORD_RX)})) AS word_count,
    len(list_filter(string_split_regex(text, '[.!?]+'), lambda p: regexp_matches(p, '{fx.NOT_SPACE}'))) AS sentence_count,
    len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda p: regexp_matches(p, '{fx.NOT_SPACE}'))) AS paragraph_count,
    {', '.join(f'({marker(k)}) AS {k}' for k in words.ESSAY_MARKERS)} FROM con WHERE text IS NOT NULL)
SELECT doc_id, CAST(word_count AS INT) AS word_count, CAST(sentence_count AS INT) AS sentence_count, CAST(paragraph_count AS INT) AS paragraph_count, thesis, evidence, conclusion,
    CAST(thesis AS INT) + CAST(evidence AS INT) + CAST(conclusion AS INT) AS signals,
    format('{{}} words, {{}} sentences, {{}} paragraphs. {{}} of 3 structure signals found.', word_count, sentence_count, paragraph_count, CAST(thesis AS INT) + CAST(evidence AS INT) + CAST(conclusion AS INT)) AS spoken FROM c""",
        "essay_top_words": f"""WITH {contents}, l AS (SELECT doc_id, regexp_extract_all(text, {_rx(fx.ESSAY_WORD_RX)}) AS l FROM con WHERE text IS NOT NULL),
u AS (SELECT doc_id, lower(unnest(l)) AS word, generate_subscripts(l, 1) AS pos FROM l),
n AS (SELECT doc_id, word, count(*) AS count, min(pos) AS first FROM u WHERE length(word) > 3 AND word NOT IN {essay_stop} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, first) AS place FROM n) SELECT doc_id, CAST(place AS INT) AS place, word, count FROM r WHERE place <= 5""",
        "speech_chunks": f"WITH {contents}, l AS (SELECT doc_id, regexp_extract_all(text, {_rx(fx.CHUNK_RX)}) AS l FROM con WHERE text IS NOT NULL) SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS i, unnest(l) AS chunk FROM l",
        "translation_spans": f"{dictionary} SELECT id, CAST(i AS INT) AS i, {_strip('span')} AS span FROM sp",
        "command_log": PHRASES + " SELECT session, seq, phrase, outcome FROM logged",
        "crawl_changes": CHANGES + " SELECT path, status FROM ch",
        "crawl_tally": CHANGES + " SELECT s.status, count(ch.path) AS files FROM (VALUES ('new'), ('changed'), ('unchanged'), ('unsupported'), ('error')) AS s(status) LEFT JOIN ch ON ch.status = s.status GROUP BY 1",
        "nested_correct_update": f"""WITH r AS (SELECT original_filename AS file, CASE WHEN true_language IS NULL THEN 'en' ELSE true_language END AS t, lang AS f, lower(true_language) AS n, uploaded_at FROM documents)
SELECT file, coalesce(t, '') AS true_language, f AS freq_words_predicted, {correct('f')} AS freq_words_correct, 'en' AS short_words_predicted, {correct("'en'")} AS short_words_correct, n AS neural_predicted, {correct('n')} AS neural_correct, uploaded_at FROM r""",
        "upsert_latest": "SELECT * FROM (SELECT DISTINCT * FROM summaries) QUALIFY row_number() OVER (PARTITION BY document_id, method ORDER BY created_at DESC, id DESC) = 1",
        "summary_keywords": """WITH l AS (SELECT * FROM (SELECT DISTINCT * FROM summaries) QUALIFY row_number() OVER (PARTITION BY document_id, method ORDER BY created_at DESC, id DESC) = 1),
k AS (SELECT id, from_json(keywords, '[{"term": "VARCHAR", "weight": "DOUBLE"}]') AS k FROM l WHERE keywords IS NOT NULL), u AS (SELECT id, unnest(k) AS x, generate_subscripts(k, 1) AS position FROM k)
SELECT id AS summary_id, CAST(position AS INT) AS position, x.term AS term, x.weight AS weight FROM u""",
        "recent_documents": "SELECT doc_id, title, uploaded_at FROM documents ORDER BY uploaded_at DESC, doc_id DESC LIMIT 10",
        "file_facts": f"""SELECT doc_id, CASE WHEN contains(file_path, '.') THEN lower(regexp_extract(file_path, '[^.]*$')) ELSE '' END AS extension, CASE WHEN contains(file_path, '.') THEN lower(regexp_extract(file_path, '[^.]*$')) ELSE '' END IN ('txt', 'docx', 'pdf') AS allowed,
{titled} AS title, substring(text, 1, 600) AS preview, CAST(length(text) AS INT) AS length, md5(text) AS md5 FROM documents WHERE file_path IS NOT NULL""",
        "escaped_titles": """SELECT doc_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS title FROM documents""",
    }
