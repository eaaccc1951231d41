"""The same results as plain SQL for the correctness check. Written from the operators' definitions, whole tables only."""
from __future__ import annotations

import re

from ..functions import prompts as P
from ..operators import extract
from .queries import BUDGET, ENGLISH_PAGES, EXCLUDED_PAGES, MIN_SHARED

TOKS = "regexp_extract_all(lower({c}), '[a-z0-9]+')"
WORDS = r"regexp_extract_all({c}, '\S+')"


def _decode(c: str) -> str:
    """The entities that occur in the tables, the ampersand last."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        c = f"replace({c}, '&{name};', '{char}')"
    return c


def _clean(c: str) -> str:
    flat = _decode(rf"regexp_replace(regexp_replace({c}, '</p>|<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')")
    lines = rf"list_transform(string_split({flat}, chr(10)), lambda ln: trim(regexp_replace(ln, '[ \t\x{{a0}}]+', ' ', 'g')))"
    return f"array_to_string(list_filter({lines}, lambda ln: ln <> ''), chr(10))"


def _norm(c: str) -> str:
    straight = f"translate({_decode(c)}, '’‘“”', repeat(chr(39), 2) || repeat(chr(34), 2))"
    return rf"lower(trim(regexp_replace({straight}, '\s+', ' ', 'g')))"


def _shown(c: str) -> str:
    for tag in ("script", "style"):
        c = f"regexp_replace({c}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return _norm(f"regexp_replace({c}, '<[^>]+>', ' ', 'g')")


SENTS = (r"list_filter(list_transform(string_split(replace(regexp_replace({c}, '([.!?])\s+([A-Z0-9\"''(])', '\1' || chr(1) || '\2', 'g'), "
         r"chr(10), chr(1)), chr(1)), lambda s: trim(s)), lambda s: s <> '')")


def _pieces(parts: str, size: int, stop: str, step: int, out: str) -> str:
    starts = f"CASE WHEN len(s) = 0 THEN [] WHEN len(s) <= {size} THEN [0] ELSE range(0, {stop}, {step}) END"
    return f"""WITH l AS (SELECT doc_id, {parts} AS s FROM documents),
  st AS (SELECT doc_id, s, {starts} AS a FROM l),
  x AS (SELECT doc_id, s, unnest(a) AS i, generate_subscripts(a, 1) - 1 AS k FROM st)
  SELECT doc_id, k::BIGINT AS k, array_to_string(s[i + 1:i + {size}], ' ') AS {out} FROM x"""


ENTRIES = r"""SELECT doc_id, source || ':' || doc_id AS id, 'https://' || source || '.example/' || lang || '/' AS url,
  '2024-' || lpad((n_chars % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((n_chars % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00' AS modified,
  'faq-' || n_chars AS block, regexp_extract(text, '^[^.!?\n]*') AS question, text AS answer FROM documents"""
HELD = r"""SELECT item_id, 'bench:' || item_id AS id, 'https://bench.example/' AS url, 'faq-' || length(text) AS block,
  regexp_extract(text, '^[^.!?\n]*') AS question, text AS answer FROM benchmark"""
TURNS = r"""SELECT conv_id, turn::BIGINT AS turn, 'https://conv.example/' || role || '/' AS url,
  '2024-01-' || lpad((length(text) % 28 + 1)::VARCHAR, 2, '0') AS modified, regexp_extract(text, '^[^.!?\n]*') AS question, text AS answer FROM conversations"""
HEAD = "'[' || url || ' | page updated ' || substr(modified, 1, 10) || ' | entry: ' || question || ']'"

SHINGLES = "CASE WHEN len(t) >= 8 THEN list_distinct(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' '))) ELSE [] END"


def _jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))))"


def _signals(held_whole: str, held_answer: str) -> str:
    """CTEs jac(item_id, doc_id, j) and con(item_id, doc_id, held_in_other, other_in_held)."""
    whole = "text" if held_whole == "text" else "regexp_extract(text, '^[^.!?\\n]*') || ' ' || text"
    return f"""h AS (SELECT item_id, list_distinct({TOKS.format(c=whole)}) AS w, {TOKS.format(c='text')} AS t FROM benchmark),
  d AS (SELECT doc_id, list_distinct({TOKS.format(c=whole)}) AS w, {TOKS.format(c='text')} AS t FROM documents),
  jac AS (SELECT item_id, doc_id, {_jaccard('h.w', 'd.w')} AS j FROM h, d WHERE len(h.w) > 0 AND len(d.w) > 0),
  hs AS (SELECT item_id, {SHINGLES} AS s FROM h), ds AS (SELECT doc_id, {SHINGLES} AS s FROM d),
  hx AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM hs), dx AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM ds),
  con AS (SELECT item_id, doc_id, count(*) / hx.n AS held_in_other, count(*) / dx.n AS other_in_held
          FROM hx JOIN dx USING (g) GROUP BY item_id, doc_id, hx.n, dx.n)"""


VARIANTS = f"""he AS ({HELD}), en AS ({ENTRIES}), {_signals('whole', 'text')},
  rm AS (SELECT item_id, doc_id FROM jac WHERE j >= 0.3
    UNION SELECT item_id, doc_id FROM con WHERE held_in_other >= 0.2 OR other_in_held >= 0.2
    UNION SELECT item_id, doc_id FROM he JOIN en USING (id)
    UNION SELECT item_id, doc_id FROM he JOIN en ON he.block = en.block AND he.url <> en.url)"""

# ratio of matching blocks of lower-cased titles: the longest common stretch, first in a, then in b, and so on to its left and right. Characters that are frequent
# in a second title of 200 or more start no stretch, but extend one. ev and di are maximal equal stretches on a diagonal, with all and with infrequent characters.
TITLES = r"""ti AS (SELECT item_id, lower(regexp_extract(text, '^[^.!?\n]*')) AS a FROM benchmark),
  td AS (SELECT doc_id, lower(regexp_extract(text, '^[^.!?\n]*')) AS b FROM documents),
  ua AS (SELECT a, row_number() OVER () AS x FROM (SELECT DISTINCT a FROM ti)), ub AS (SELECT b, row_number() OVER () AS y FROM (SELECT DISTINCT b FROM td)),
  ca AS (SELECT x, unnest(range(0, length(a))) AS i, substr(a, i + 1, 1) AS c FROM ua), cb AS (SELECT y, unnest(range(0, length(b))) AS j, substr(b, j + 1, 1) AS c FROM ub),
  na AS (SELECT x, c, count(*) AS n FROM ca GROUP BY ALL), nb AS (SELECT y, c, count(*) AS n FROM cb GROUP BY ALL),
  may AS (SELECT x, y, sum(least(na.n, nb.n)) AS m FROM na JOIN nb USING (c) GROUP BY ALL),
  pr AS MATERIALIZED (SELECT x, y, length(a) AS la, length(b) AS lb FROM may JOIN ua USING (x) JOIN ub USING (y) WHERE 2 * m >= 0.6 * (length(a) + length(b)) - 1e-6),
  eq AS (SELECT pr.x, pr.y, ca.i, cb.j, lb >= 200 AND nb.n > lb // 100 + 1 AS often FROM pr JOIN ca ON ca.x = pr.x JOIN cb ON cb.y = pr.y AND cb.c = ca.c
         JOIN nb ON nb.y = pr.y AND nb.c = ca.c),
  ev AS MATERIALIZED (SELECT x, y, i - j AS d, min(i) AS i0, max(i) + 1 AS i1
    FROM (SELECT *, i - row_number() OVER (PARTITION BY x, y, i - j ORDER BY i) AS g FROM eq) GROUP BY x, y, d, g),
  di AS MATERIALIZED (SELECT x, y, i - j AS d, min(i) AS i0, max(i) + 1 AS i1
    FROM (SELECT *, i - row_number() OVER (PARTITION BY x, y, i - j ORDER BY i) AS g FROM eq WHERE NOT often) GROUP BY x, y, d, g),
  ma AS (SELECT x, y, 0::BIGINT AS alo, la::BIGINT AS ahi, 0::BIGINT AS blo, lb::BIGINT AS bhi, 0::BIGINT AS k, false AS hit FROM pr
    UNION ALL SELECT x, y, u.alo, u.ahi, u.blo, u.bhi, u.k, u.hit FROM (
      SELECT x, y, unnest([{'alo': alo, 'ahi': i, 'blo': blo, 'bhi': i - d, 'k': 0, 'hit': false}, {'alo': i + k, 'ahi': ahi, 'blo': i + k - d, 'bhi': bhi, 'k': 0, 'hit': false},
                           {'alo': i, 'ahi': i, 'blo': i - d, 'bhi': i - d, 'k': k, 'hit': true}]) AS u
      FROM (SELECT s.*, e.d, greatest(e.i0, s.alo, s.blo + e.d) AS i, least(e.i1, s.ahi, s.bhi + e.d) - greatest(e.i0, s.alo, s.blo + e.d) AS k
            FROM (SELECT r.x, r.y, r.alo, r.ahi, r.blo, r.bhi,
                         max({'k': least(di.i1, r.ahi, r.bhi + di.d) - greatest(di.i0, r.alo, r.blo + di.d), 'i': -greatest(di.i0, r.alo, r.blo + di.d),
                              'j': di.d - greatest(di.i0, r.alo, r.blo + di.d)}) AS best
                  FROM ma r LEFT JOIN di ON di.x = r.x AND di.y = r.y AND least(di.i1, r.ahi, r.bhi + di.d) > greatest(di.i0, r.alo, r.blo + di.d)
                  WHERE NOT r.hit AND r.ahi > r.alo AND r.bhi > r.blo GROUP BY ALL) s
            JOIN ev e ON e.x = s.x AND e.y = s.y AND e.d = CASE WHEN best.k IS NULL THEN alo - blo ELSE best.j - best.i END
              AND e.i0 <= CASE WHEN best.k IS NULL THEN alo ELSE -best.i END AND e.i1 > CASE WHEN best.k IS NULL THEN alo ELSE -best.i END))),
  rt AS (SELECT x, y, 2.0::DOUBLE * sum(k) / (la + lb) AS ratio FROM ma JOIN pr USING (x, y) GROUP BY x, y, la, lb
         UNION ALL SELECT x, y, 1.0 FROM ua, ub WHERE a = '' AND b = ''),
  tr AS (SELECT item_id, doc_id, ratio FROM rt JOIN ua USING (x) JOIN ti USING (a) JOIN ub USING (y) JOIN td USING (b) WHERE ratio >= 0.6)"""

LEXICAL = f"""q AS (SELECT item_id, unnest({TOKS.format(c='text')}) AS t FROM benchmark),
  dt AS (SELECT doc_id, {TOKS.format(c='text')} AS ts FROM documents),
  ll AS (SELECT doc_id, len(ts) AS len FROM dt), av AS (SELECT count(*) AS n, sum(len) / count(*) AS a FROM ll),
  tf AS (SELECT doc_id, t, count(*) AS f FROM (SELECT doc_id, unnest(ts) AS t FROM dt) GROUP BY ALL),
  df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
  sc AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * len / a))) AS s
         FROM q JOIN tf USING (t) JOIN df USING (t) JOIN ll USING (doc_id), av GROUP BY item_id, doc_id),
  every AS (SELECT b.item_id, d.doc_id, round(coalesce(s, 0.0), 6) AS score
            FROM benchmark b CROSS JOIN documents d LEFT JOIN sc ON sc.item_id = b.item_id AND sc.doc_id = d.doc_id),
  lex AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM every QUALIFY rank < 40)"""

DENSE = """em AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  un AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-9)) AS v FROM em),
  dn AS (SELECT b.item_id, u.vec_id AS doc_id, round(list_dot_product(a.v, u.v), 6) AS score
         FROM benchmark b JOIN un a ON a.vec_id = b.item_id CROSS JOIN un u),
  den AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM dn QUALIFY rank < 40)"""

CANDS = f"""{LEXICAL}, ca AS (SELECT lex.item_id, lex.doc_id, lex.rank, d.text, b.text AS question, len({WORDS.format(c='d.text')}) AS nw
  FROM lex JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id))"""

PACK_STEPS = f"""li AS (SELECT item_id, list({{'u': doc_id, 'n': nw, 't': text}} ORDER BY rank) AS c FROM ca GROUP BY item_id),
  go AS (SELECT item_id, 1 AS i, 0::BIGINT AS used, []::BIGINT[] AS ids, c FROM li
    UNION ALL SELECT item_id, i + 1, CASE WHEN used + c[i].n <= {BUDGET} THEN used + c[i].n ELSE used END,
      CASE WHEN used + c[i].n <= {BUDGET} THEN list_append(ids, i) ELSE ids END, c FROM go WHERE i <= len(c)),
  pk AS (SELECT item_id, used AS context_words, array_to_string(list_transform(ids, lambda i: c[i].u), ',') AS units,
    array_to_string(list_transform(ids, lambda i: c[i].t), chr(10) || chr(10)) AS context FROM go WHERE i = len(c) + 1)"""
PACKED = f"{CANDS}, {PACK_STEPS}"

# passages ranked by BM25, then packed hit by hit: w holds the windows taken so far, n, z and hw are the entry's sentences, their words and its header's words
PASSAGES = rf"""en AS ({ENTRIES}), sn AS (SELECT doc_id, {HEAD} AS head, {SENTS.format(c='answer')} AS s FROM en),
  st AS MATERIALIZED (SELECT doc_id, head, len({WORDS.format(c='head')}) AS hw, s, len(s) AS n, list_transform(s, lambda x: len({WORDS.format(c='x')})) AS z,
    CASE WHEN len(s) <= 3 THEN least(len(s), 1) ELSE len(s) // 2 END AS nw FROM sn),
  pu AS MATERIALIZED (SELECT doc_id, k, doc_id * {1 << extract.WINDOW_BITS} + k AS u, {TOKS.format(c="head || ' ' || array_to_string(CASE WHEN n <= 3 THEN s ELSE s[2 * k + 1:2 * k + 3] END, ' ')")} AS ts
    FROM (SELECT *, unnest(range(0, nw)) AS k FROM st)),
  q AS (SELECT item_id, unnest({TOKS.format(c='text')}) AS t FROM benchmark), av AS (SELECT count(*) AS n, sum(len(ts)) / count(*) AS a FROM pu),
  tf AS (SELECT u, t, count(*) AS f FROM (SELECT u, unnest(ts) AS t FROM pu) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
  sc AS (SELECT item_id, u, sum(ln(1 + (av.n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * len(ts) / a))) AS s
         FROM q JOIN tf USING (t) JOIN df USING (t) JOIN pu USING (u), av GROUP BY item_id, u),
  hits AS MATERIALIZED (SELECT b.item_id, pu.doc_id, pu.k, row_number() OVER (PARTITION BY b.item_id ORDER BY round(coalesce(s, 0.0), 6) DESC, pu.u) AS pos
           FROM benchmark b CROSS JOIN pu LEFT JOIN sc ON sc.item_id = b.item_id AND sc.u = pu.u QUALIFY pos <= 40)"""


def _covered(ks: str) -> str:
    return f"list_filter(range(0, n), lambda i: len(list_filter({ks}, lambda x: n <= 3 OR (i >= 2 * x AND i <= 2 * x + 2))) > 0)"


def _passage_pack(version: int) -> str:
    def words(cov: str) -> str:
        return (f"CASE WHEN len({cov}) = 0 THEN 0 ELSE hw + list_sum(list_transform({cov}, lambda i: z[i + 1])) "
                f"+ len(list_filter(range(2, len({cov}) + 1), lambda j: {cov}[j] - {cov}[j - 1] > 1)) END")

    single = "list_sum(list_transform(CASE WHEN n <= 3 THEN range(0, n) ELSE range(2 * x, least(n, 2 * x + 3)) END, lambda i: z[i + 1]))"
    cost = f"{words('c1')} - {words('c0')}" if version == 2 else f"list_sum(list_transform(near, lambda x: hw + {single}))"
    block = ("array_to_string(list_transform(range(1, len(cov) + 1), lambda j: CASE WHEN j > 1 AND cov[j] - cov[j - 1] > 1 THEN '[...] ' ELSE '' END || s[cov[j] + 1]), ' ')"
             if version == 2 else
             "array_to_string(list_transform(list_sort(ks), lambda x: array_to_string(CASE WHEN n <= 3 THEN s ELSE s[2 * x + 1:2 * x + 3] END, ' ')), ' [...] ')")
    return rf"""WITH RECURSIVE {PASSAGES},
  go AS (SELECT item_id, 0::BIGINT AS i, 0::BIGINT AS used, []::STRUCT(e BIGINT, k BIGINT)[] AS w FROM benchmark
    UNION ALL SELECT item_id, i + 1, (CASE WHEN fits THEN used + extra ELSE used END)::BIGINT,
      CASE WHEN fits THEN list_concat(w, list_transform(near, lambda x: {{'e': doc_id, 'k': x}})) ELSE w END
    FROM (SELECT *, len(near) > 0 AND used + extra <= {BUDGET} AS fits FROM (SELECT *, {cost} AS extra
      FROM (SELECT *, {_covered('old')} AS c0, {_covered('list_concat(old, near)')} AS c1
        FROM (SELECT *, list_filter([k - 1, k, k + 1], lambda x: x >= 0 AND x < nw AND NOT list_contains(old, x)) AS near
          FROM (SELECT g.*, h.doc_id, h.k, st.hw, st.n, st.z, st.nw, list_transform(list_filter(w, lambda x: x.e = h.doc_id), lambda x: x.k) AS old
            FROM go g JOIN hits h ON h.item_id = g.item_id AND h.pos = g.i + 1 JOIN st USING (doc_id))))))),
  ended AS (SELECT item_id, w FROM go QUALIFY i = max(i) OVER (PARTITION BY item_id)),
  taken AS (SELECT item_id, x.e AS doc_id, x.k AS k, o FROM (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) AS o FROM ended)),
  blocks AS (SELECT item_id, doc_id, list(k) AS ks, min(o) AS o FROM taken GROUP BY ALL),
  shown AS (SELECT item_id, o, head || chr(10) || {block} AS t FROM (SELECT *, {_covered('ks')} AS cov FROM blocks JOIN st USING (doc_id))),
  done AS (SELECT item_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY o), '') AS context FROM ended LEFT JOIN shown USING (item_id) GROUP BY item_id)
  SELECT item_id, context, len({WORDS.format(c='context')})::BIGINT AS context_words FROM done"""


WRAPPED = """pg AS (SELECT doc_id, 'https://' || source || '.example/' || lang || '/' AS url, '<div class="schema-faq-section" id="faq-' AS h, text FROM documents),
  body AS (SELECT doc_id, url, array_to_string(list_transform(string_split(text, chr(10)), lambda ln, i: h || ((i - 1) % 3)
    || '"><strong class="schema-faq-question">' || regexp_extract(ln, '^[^.!?]*') || '</strong> <p class="schema-faq-answer">' || ln || '</p></div>'), '') AS b FROM pg),
  sec AS (SELECT doc_id, url, regexp_extract_all(b, '(?s)<div class="schema-faq-section" id="[^"]+">.*?</div>') AS s FROM body),
  one AS (SELECT doc_id, url, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM sec)"""

PARAGRAPHS = rf"""pr AS (SELECT page_id, url, regexp_extract_all(html, '(?s)<p>.*?</p>|<ul>.*?</ul>') AS ps, {_shown('html')} AS shown FROM pages),
  px AS (SELECT page_id || ':' || (generate_subscripts(ps, 1) - 1) AS id, url, shown, unnest(ps) AS raw FROM pr),
  ck AS (SELECT url, id, NOT contains(shown, {_norm(_clean('raw'))}) AS missing FROM px)"""

REPLIES = """gr AS (SELECT doc_id, lang, source, n_chars, toxic, CASE WHEN quality = 1 AND toxic <> 1 THEN 'correct' WHEN quality = 1 THEN 'unsupported'
  WHEN toxic <> 1 THEN 'clarified' ELSE 'lost condition' END AS outcome FROM documents JOIN labels USING (doc_id)),
  gs AS (SELECT *, CASE WHEN outcome = 'correct' OR (lang = 'en' AND outcome = 'clarified') THEN 1 ELSE 0 END AS success FROM gr)"""

_ESC = r"""array_to_string(list_transform(string_split({c}, ''), lambda ch: CASE WHEN ch = '"' THEN '\"' WHEN ch = '\' THEN '\\'
  WHEN ch = chr(10) THEN '\n' WHEN ch = chr(9) THEN '\t' WHEN ch = chr(13) THEN '\r'
  WHEN unicode(ch) > 126 THEN '\u' || lpad(lower(to_hex(unicode(ch))), 4, '0') ELSE ch END), '')"""


def _key(*parts: str) -> str:
    listed = " || ', ' || ".join(f"'\"' || {_ESC.format(c=p)} || '\"'" for p in parts)
    return f"substr(sha256('[' || {listed} || ']'), 1, 20)"


def _filled(template: str, **slots: str) -> str:
    names = "|".join(slots)
    out = []
    for i, piece in enumerate(re.split(r"\{(%s)\}" % names, template)):
        if i % 2:
            out.append(f"({slots[piece]})")
        elif piece:
            out.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(out)


def _grader() -> str:
    site = _filled(P.DEFAULTS["site_block"], notes=f"'{P.NO_NOTES}'", site="m.text")
    rule = "'" + P.DEFAULTS["site_rule"].replace("'", "''") + "'"
    return _filled(P.DEFAULTS["grader"], question="m.text", does="'answers'", must_not=f"'{P.NO_RULE}'", conditions="'keeps it short'",
                   clarify_ok="CASE WHEN a.turn > 1 THEN 'yes' ELSE 'no' END", sources="'none'", candidate="a.text",
                   site_block=f"CASE WHEN m.text <> '' THEN {site} ELSE '' END", site_rule=f"CASE WHEN m.text <> '' THEN {rule} ELSE '' END")


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def oracle_sql() -> dict[str, str]:
    shared = f"len(list_intersect(list_distinct({TOKS.format(c='question')}), list_distinct({TOKS.format(c='text')})))"
    pairs = " UNION ALL ".join(
        f"SELECT experiment, '{a} vs {b}' AS pair, {a} AS a, {b} AS b FROM wide" for a, b in (("A", "B"), ("A", "C"), ("B", "C")))
    return {
        "token_counts": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct "
                        f"FROM (SELECT doc_id, {TOKS.format(c='text')} AS t FROM documents)",
        "nwords": f"SELECT doc_id, len({WORDS.format(c='text')})::BIGINT AS n_words FROM documents",
        "sentences": f"SELECT doc_id, (generate_subscripts(s, 1) - 1)::BIGINT AS sent_ord, unnest(s) AS sentence "
                     f"FROM (SELECT doc_id, {SENTS.format(c='text')} AS s FROM documents)",
        "windows3": _pieces(SENTS.format(c="text"), 3, "len(s) - 1", 2, "window").replace("AS window", 'AS "window"'),
        "chunk_words": _pieces(WORDS.format(c="text"), 200, "len(s) - 40", 160, "chunk"),
        "shingle_counts": f"SELECT doc_id, len({SHINGLES})::BIGINT AS n_shingles FROM (SELECT doc_id, {TOKS.format(c='text')} AS t FROM documents)",
        "html_clean": f"SELECT page_id, {_clean('html')} AS cleaned FROM pages",
        "visible_text": f"SELECT page_id, {_shown('html')} AS shown FROM pages",
        "quote_check": rf"""WITH x AS (SELECT doc_id, quality = 1 AS claimed, lower(trim(regexp_replace(replace(text, '’', ''''), '\s+', ' ', 'g'))) AS hay,
            list_concat({SENTS.format(c='text')}, [lang, lang || ' sentence that no document holds']) AS qs FROM documents JOIN labels USING (doc_id)),
          y AS (SELECT doc_id, claimed, len(qs) AS n, len(list_filter(qs, lambda q: length(q) > 20
            AND contains(hay, lower(trim(regexp_replace(replace(q, '’', ''''), '\s+', ' ', 'g')))))) AS v FROM x)
          SELECT doc_id, n::BIGINT AS n_quotes, v::BIGINT AS n_verified, CASE WHEN claimed AND v > 0 THEN 1 ELSE 0 END AS answerable FROM y""",
        "received_headers": f"SELECT doc_id, url, substr(modified, 1, 10) AS updated, question AS entry FROM ({ENTRIES})",
        "json_fields": "SELECT event_id, props AS j, (props::JSON->>'k')::BIGINT AS k FROM events",
        "faq_extract": rf"""WITH {WRAPPED}, qa AS (SELECT doc_id, url, i, regexp_extract(x, 'id="([^"]+)"', 1) AS block,
            {_clean("regexp_extract(x, '(?s)<strong class=.schema-faq-question.>(.*?)</strong>', 1)")} AS question,
            {_clean("regexp_extract(x, '(?s)</strong>(.*)</div>$', 1)")} AS answer FROM one),
          ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY i) AS nth FROM qa WHERE question <> '' AND answer <> '')
          SELECT doc_id || ':' || block || CASE WHEN nth > 1 THEN '#' || nth ELSE '' END AS id, url, '2024-05-06T07:08:09' AS modified,
            block, question, answer FROM ok""",
        "exclude_urls": f"SELECT url, count(*) AS entries FROM ({ENTRIES}) WHERE url NOT IN ({_in(EXCLUDED_PAGES)}) GROUP BY url",
        "page_verify": f"WITH {PARAGRAPHS} SELECT url, count(*) AS entries, count(*) FILTER (missing) AS n_missing FROM ck GROUP BY url",
        "page_missing": f"WITH {PARAGRAPHS} SELECT url, id FROM ck WHERE missing",
        "jaccard_pairs": f"WITH {_signals('text', 'text')} SELECT item_id, doc_id, round(j, 6) AS jaccard FROM jac WHERE j >= 0.3",
        "containment": f"WITH {_signals('text', 'text')} SELECT item_id, doc_id, round(held_in_other, 6) AS held_in_other, "
                       f"round(other_in_held, 6) AS other_in_held FROM con",
        "holdout_semi": f"WITH {VARIANTS} SELECT item_id, doc_id FROM rm",
        "holdout_anti": f"WITH {VARIANTS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM rm)",
        "title_ratio": f"WITH RECURSIVE {TITLES} SELECT item_id, doc_id, round(ratio, 6) AS ratio FROM tr",
        "variants_all": f"WITH RECURSIVE {TITLES}, {VARIANTS} SELECT item_id, doc_id FROM rm UNION SELECT item_id, doc_id FROM tr",
        "bm25_stats": f"""WITH tf AS (SELECT unnest(list_distinct({TOKS.format(c='text')})) AS term FROM documents), c AS (SELECT count(*) AS n FROM documents)
          SELECT term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM tf, c GROUP BY term""",
        "bm25_top40": f"WITH {LEXICAL} SELECT item_id, doc_id, score, rank::BIGINT AS rank FROM lex",
        "bm25_scores": f"WITH {LEXICAL} SELECT item_id, doc_id, round(s, 6) AS score FROM sc",
        "dense_scores": f"WITH {DENSE} SELECT item_id, doc_id, score FROM dn",
        "dense_top40": f"WITH {DENSE} SELECT item_id, doc_id, score, rank::BIGINT AS rank FROM den",
        "rrf": f"""WITH {LEXICAL}, {DENSE}, lists AS (SELECT item_id, doc_id, rank FROM lex UNION ALL SELECT item_id, doc_id, rank FROM den),
          fu AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS s FROM lists GROUP BY item_id, doc_id)
          SELECT item_id, doc_id, round(s, 6) AS score, (row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) - 1)::BIGINT AS rank
          FROM fu QUALIFY rank < 40""",
        "rerank_shared": f"""WITH {CANDS}, sc2 AS (SELECT item_id, doc_id, rank, {shared}::DOUBLE AS rerank_score FROM ca)
          SELECT item_id, doc_id, rerank_score, (row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, rank) - 1)::BIGINT AS position
          FROM sc2 WHERE rerank_score >= {MIN_SHARED}""",
        "rerank_listwise": f"""WITH {CANDS} SELECT item_id, doc_id, (row_number() OVER (PARTITION BY item_id ORDER BY nw, rank) - 1)::BIGINT AS position
          FROM ca QUALIFY position < 15""",
        "hybrid_pack": f"""WITH RECURSIVE {LEXICAL}, {DENSE}, lists AS (SELECT item_id, doc_id, rank FROM lex UNION ALL SELECT item_id, doc_id, rank FROM den),
          fu AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS s FROM lists GROUP BY item_id, doc_id),
          fz AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) - 1 AS rank FROM fu QUALIFY rank < 40),
          cf AS (SELECT fz.*, d.text, b.text AS question, len({WORDS.format(c='d.text')}) AS nw FROM fz JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
          rs AS (SELECT *, {shared} AS score FROM cf), ca AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank) - 1 AS rank, text, nw
          FROM rs WHERE score >= {MIN_SHARED}), {PACK_STEPS} SELECT item_id, context_words, units, sha256(context) AS context_sha FROM pk""",
        "budget_pack": f"WITH RECURSIVE {PACKED} SELECT item_id, context_words, units, sha256(context) AS context_sha FROM pk",
        "passage_units": rf"""WITH e AS ({ENTRIES}), l AS (SELECT doc_id, {HEAD} AS head, {SENTS.format(c='answer')} AS s FROM e),
          st AS (SELECT *, CASE WHEN len(s) = 0 THEN [] WHEN len(s) <= 3 THEN [0] ELSE range(0, len(s) - 1, 2) END AS a FROM l),
          x AS (SELECT doc_id, head, s, unnest(a) AS i, generate_subscripts(a, 1) - 1 AS k FROM st)
          SELECT (doc_id * {1 << extract.WINDOW_BITS} + k)::BIGINT AS unit_ord, doc_id, k::BIGINT AS k, head || ' ' || array_to_string(s[i + 1:i + 3], ' ') AS text FROM x""",
        "passage_pack": _passage_pack(2),
        "passage_pack_v1": _passage_pack(1),
        "context_full": f"""WITH e AS ({ENTRIES}), f AS (SELECT url, arg_min(modified, doc_id) AS page_modified FROM e GROUP BY url)
          SELECT page_modified, url, doc_id, {HEAD} AS header, sha256({HEAD} || chr(10) || answer) AS text_sha FROM e JOIN f USING (url) ORDER BY page_modified, url, doc_id""",
        "page_contexts": rf"""WITH e AS ({TURNS}) SELECT conv_id, url, length(c)::BIGINT AS n_chars, sha256(c) AS context_sha FROM (
          SELECT conv_id, url, string_agg({HEAD} || chr(10) || answer, chr(10) || chr(10) ORDER BY turn) AS c FROM e GROUP BY ALL)""",
        "held_contexts": rf"""WITH e AS ({TURNS}), w AS (SELECT *, regexp_extract(answer, '^\S*') AS w FROM e),
          v AS (SELECT h.turn AS held, s.* FROM w h JOIN w s ON s.conv_id = h.conv_id AND s.w <> h.w),
          f AS (SELECT conv_id, held, url, arg_min(modified, turn) AS page_modified FROM v GROUP BY ALL),
          t AS (SELECT conv_id, held, string_agg({HEAD} || chr(10) || answer, chr(10) || chr(10) ORDER BY page_modified, url, turn) AS c
                FROM v JOIN f USING (conv_id, held, url) GROUP BY ALL)
          SELECT e.conv_id, turn, length(coalesce(c, ''))::BIGINT AS n_chars, sha256(coalesce(c, '')) AS context_sha
          FROM e LEFT JOIN t ON t.conv_id = e.conv_id AND t.held = e.turn""",
        "pool_filter": f"SELECT doc_id, id FROM ({ENTRIES}) WHERE url IN ({_in(ENGLISH_PAGES)}) AND len({WORDS.format(c='answer')}) >= 25",
        "reply_overlap": rf"""WITH p AS (SELECT a.conv_id, a.turn, {TOKS.format(c='a.text')} AS r, {TOKS.format(c='m.text')} AS m FROM conversations a
          JOIN conversations m ON m.conv_id = a.conv_id AND m.turn + 1 = a.turn AND m.role = 'user' WHERE a.role = 'assistant'),
          w AS (SELECT conv_id, turn, list_distinct(r) AS r, list_distinct(m) AS m, list_distinct([array_to_string(r[i:i + 2], ' ') for i in range(1, len(r) - 1)]) AS rs,
            list_distinct([array_to_string(m[i:i + 2], ' ') for i in range(1, len(m) - 1)]) AS ms FROM p)
          SELECT conv_id, turn, CASE WHEN len(r) = 0 OR len(m) = 0 THEN 0 ELSE round(len(list_intersect(r, m))::DOUBLE / len(list_distinct(r || m)), 6) END AS jaccard,
            CASE WHEN len(rs) = 0 THEN 0 ELSE round(len(list_intersect(rs, ms))::DOUBLE / len(rs), 6) END AS held_in_mail FROM w""",
        "lookup_strict": "SELECT conv_id, turn, source FROM conversations JOIN documents ON doc_id = conv_id",
        "lookup_lenient": "SELECT doc_id, coalesce('label ' || quality, doc_id::VARCHAR) AS label FROM documents LEFT JOIN labels USING (doc_id)",
        "only_cases": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
        "grade_parse": f"""WITH {REPLIES} SELECT doc_id, outcome, lang || ' ' || source AS evidence, lang || '|' || source AS keeps,
          CASE WHEN toxic = 1 THEN 'rude' ELSE '' END AS loses, n_chars AS size, success FROM gs""",
        "outcome_summary": f"""WITH {REPLIES} SELECT lang AS experiment, source AS reader, 'n' AS measure, count(*)::BIGINT AS count FROM gs GROUP BY ALL
          UNION ALL SELECT lang, source, 'success', sum(success)::BIGINT FROM gs GROUP BY ALL
          UNION ALL SELECT lang, source, outcome, count(*)::BIGINT FROM gs GROUP BY lang, source, outcome""",
        "paired": f"""WITH ev AS (SELECT strftime(ts, '%Y-%m-%d') AS experiment, user_id, event_id, value >= 5 AS ok,
            CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'B' WHEN 'purchase' THEN 'C' END AS reader FROM events),
          la AS (SELECT experiment, user_id, reader, arg_max(ok, event_id) AS ok FROM ev WHERE reader IS NOT NULL GROUP BY ALL),
          wide AS (SELECT experiment, user_id, any_value(ok) FILTER (reader = 'A') AS A, any_value(ok) FILTER (reader = 'B') AS B,
            any_value(ok) FILTER (reader = 'C') AS C FROM la GROUP BY experiment, user_id), p AS ({pairs})
          SELECT experiment, pair, count(*) FILTER (a AND NOT b) AS wins, count(*) FILTER (b AND NOT a) AS losses,
            count(*) FILTER (a = b) AS ties, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n FROM p GROUP BY experiment, pair""",
        "call_key": f"""SELECT conv_id, turn, CASE WHEN turn > 0 THEN {_key('role', "('conversation ' || conv_id)", 'text', "('sample-' || turn)")}
          ELSE {_key('role', "('conversation ' || conv_id)", 'text')} END AS key FROM conversations""",
        "missing_calls": f"""WITH k AS (SELECT conv_id, turn, {_key("'model'", "''", 'text')} AS key FROM conversations WHERE role = 'user')
          SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM k JOIN conversations c ON c.conv_id = k.conv_id AND c.turn = k.turn + 1
            AND c.role = 'assistant')""",
        "texts_to_embed": """SELECT DISTINCT sha256(text) AS text_key FROM documents WHERE sha256(text) NOT IN
          (SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""",
        "answer_prompts": f"""WITH RECURSIVE {PACKED} SELECT item_id, sha256({_filled(P.DEFAULTS['answer'], notes="'none'", context='context', question='b.text')})
          AS prompt_sha, context_words FROM pk JOIN benchmark b USING (item_id)""",
        "grader_prompts": f"""SELECT a.conv_id, a.turn, sha256({_grader()}) AS prompt_sha FROM conversations a JOIN conversations m
          ON m.conv_id = a.conv_id AND m.turn = a.turn - 1 WHERE a.role = 'assistant' AND m.role = 'user'""",
    }
