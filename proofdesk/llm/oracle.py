"""SQL of the queries that SQL can express. The others are tested against brute force, exact round trips and held-out labels."""
from __future__ import annotations

from . import quality

WORDS = r"list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS text FROM documents)),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id)
"""

RATIOS = ", ".join(f"coalesce({ratio.replace(' / ', '::DOUBLE / nullif(')}, 0), 0)" for ratio in quality.RULES.values())
NEVER = len(quality.CUTOFFS) + 1
ENOUGH = f"ln({quality.CONFIDENCE} / {len(quality.RULES)} / greatest(1, (SELECT count(*) FROM state0)))"
TAIL = f"""ln((SELECT sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN n = i THEN 0 ELSE lgamma(n - i + 1) END
                            + i * ln({quality.RISK}) + (n - i) * ln(1 - {quality.RISK}))) FROM (SELECT unnest(range(0, k + 1)) AS i)))"""
# one rule after the other: what it adds to what the rules before it reject
TURNS = ",\n".join(f"""every{j} AS (SELECT lang, n, level, {ENOUGH} - ln(list_product(choices[1:{j + 1}]) / list_max(choices[1:{j + 1}])) AS enough, sum(good)::BIGINT AS good, sum(bad) AS bad
  FROM (SELECT s.*, good, bad, CASE WHEN len(list_filter(range(1, {len(quality.RULES) + 1}), lambda i: levels[i] >= limits[i])) > 0 THEN {NEVER} ELSE levels[rules[{j + 1}]] END AS level
        FROM labelled r JOIN state{j} s USING (lang) WHERE len(rules) > {j}) GROUP BY ALL),
best{j} AS (SELECT lang, min(level) AS level FROM (SELECT *, (sum(good) OVER (PARTITION BY lang ORDER BY level DESC))::BIGINT AS k FROM every{j})
  WHERE bad > 0 AND level BETWEEN 1 AND {NEVER - 1} AND k < n * {quality.RISK} AND {TAIL} <= enough GROUP BY lang),
state{j + 1} AS (SELECT s.* REPLACE (list_transform(range(1, {len(quality.RULES) + 1}), lambda i: CASE WHEN i = rules[{j + 1}] AND level IS NOT NULL THEN level ELSE limits[i] END) AS limits)
  FROM state{j} s LEFT JOIN best{j} b USING (lang))""" for j in range(len(quality.RULES)))
OP3 = fr"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, {WORDS} AS w FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
l AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.rid, doc_id, lang, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(l.n, 0) AS n_lines,
             coalesce(c.n, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
             length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks
      FROM d JOIN w USING (rid) LEFT JOIN c ON c.rid = d.rid LEFT JOIN l ON l.rid = d.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
levels AS (SELECT rid, list_transform([{RATIOS}], lambda v: len(list_filter({quality.CUTOFFS}::DOUBLE[], lambda c: v > c))) AS levels FROM m),
good AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
labelled AS (SELECT lang, levels, sum(good) AS good, sum(1 - good) AS bad FROM f JOIN good USING (doc_id) JOIN levels USING (rid) WHERE NOT base_failed GROUP BY ALL),
caught AS (SELECT lang, rule, sum(bad) AS caught, 1 + count(DISTINCT levels[rule]) AS choices FROM labelled, range(1, {len(quality.RULES) + 1}) r(rule)
           WHERE bad > 0 AND levels[rule] > 0 GROUP BY ALL),
sizes AS (SELECT lang, sum(good)::BIGINT AS n FROM labelled GROUP BY lang HAVING sum(good) >= ln({quality.CONFIDENCE} / {len(quality.RULES)}) / ln(1 - {quality.RISK})),
state0 AS (SELECT lang, n, list(rule ORDER BY caught DESC, rule) AS rules, list(choices::DOUBLE ORDER BY caught DESC, rule) AS choices,
                  list_transform(range(0, {len(quality.RULES)}), lambda i: {NEVER}::BIGINT) AS limits FROM caught JOIN sizes USING (lang) GROUP BY lang, n),
{TURNS},
bad AS (SELECT rid FROM f JOIN levels USING (rid) JOIN state{len(quality.RULES)} USING (lang)
        WHERE len(list_filter(range(1, {len(quality.RULES) + 1}), lambda i: levels[i] >= limits[i])) > 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM f
"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(b) AS component_id, vec_id = min(b) AS kept
FROM v JOIN reach ON a = vec_id GROUP BY vec_id
"""

OP10 = """
WITH behind AS (
  SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END, '') AS b FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(b, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(b, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM behind),
rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'),
         ('block', 'com', '/de/')),
fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict, length(rhost || rpath) AS n
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
best AS (SELECT page_id, arg_max(rule, n) AS rule, arg_max(verdict, n) AS verdict FROM fits GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""

# crc32 byte by byte over a table of 256; features are single words
OP13 = fr"""
WITH steps AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
               FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT rid, unnest(w) AS w FROM d), bw AS (SELECT unnest(w) AS w FROM b),
words AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS bytes
          FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM words, steps),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY bucket),
gain AS (SELECT k AS bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0)::BIGINT FROM s) + 10000))::DOUBLE
                                             / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0)::BIGINT FROM t) + 10000))))::BIGINT AS g
         FROM range(10000) r(k) LEFT JOIN s ON s.bucket = k LEFT JOIN t ON t.bucket = k),
weighed AS (SELECT rid, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY rid),
scored AS (SELECT rid, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
           FROM d LEFT JOIN weighed USING (rid)),
placed AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS fit FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * fit // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (rid)
"""

ORACLE_SQL = {"op2_ngram_jaccard": OP2, "op3_quality_rules": OP3, "op9_pivot_index": OP9, "op10_url_trie": OP10, "op13_importance_resampling": OP13}
