"""DuckDB SQL of the queries that SQL can express, written from their contracts."""

op9_exact_dedup = """
WITH d AS (
  SELECT doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

op5_mixing = r"""
WITH d AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR) AS k, text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w,
         source_size * (3.0::DOUBLE) AS lim
  FROM s),
r AS (SELECT *, lim / w AS ratio FROM w),
lv AS (
  SELECT *, row_number() OVER up AS rn,
         (sum(source_size) OVER () - coalesce(sum(lim) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r WINDOW up AS (ORDER BY ratio, source NULLS LAST)),
l AS (SELECT arg_min(level, rn) FILTER (level <= ratio) AS level FROM lv),
t AS (SELECT source, source_size, coalesce(least(lim, w * (SELECT level FROM l)), lim) AS target FROM lv),
b AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN target - epochs * source_size > 0
                               AND 2 * before + size <= 2 * (target - epochs * source_size)
                          THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b
"""

op6_chat_format = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|><|body|><|end|>')
           + length(replace(replace(role, '\', '\\'), '<|', '<\|'))
           + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

op8_exact_topk = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

op10_line_dedup = r"""
WITH d AS (SELECT doc_id, text, md5(text) AS doc, string_split(text, chr(10)) AS ls FROM documents),
t AS (SELECT DISTINCT doc, ls FROM d WHERE text IS NOT NULL),
e AS (SELECT doc, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS no FROM t),
k AS (
  SELECT doc, no, line, list_filter(regexp_split_to_array(line, '[ \t\r\f\x0B]+'), lambda x: x <> '') AS raw FROM e),
w AS (
  SELECT doc, no, raw, len(raw) AS n,
         list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9@]|://') THEN '<*>' ELSE x END) AS m,
         len(list_filter(raw, lambda x: regexp_matches(x, '\p{L}') AND NOT regexp_matches(x, '[0-9@]|://'))) AS words
  FROM k WHERE len(raw) >= 3 OR regexp_matches(line, '\p{L}')),
l AS (
  SELECT doc, no, n, CASE WHEN words >= greatest(3, ceil(n * 0.7)) THEN m ELSE raw END AS toks, m[1:3] AS head,
         CASE WHEN n < 3 THEN 100 WHEN n >= 20 THEN 2 ELSE 5 END AS enough
  FROM w),
leaves AS (SELECT n, head FROM l GROUP BY n, head, enough HAVING count(DISTINCT doc) >= enough),
picked AS (SELECT l.* FROM l JOIN leaves USING (n, head)),
kinds AS (SELECT DISTINCT n, head, enough, toks FROM picked),
v AS (SELECT n, head, enough, toks, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM kinds),
often AS (SELECT n, head, pos, tok, count(*) AS cnt FROM v WHERE pos > 3 AND tok <> '<*>' GROUP BY n, head, enough, pos, tok HAVING count(*) >= enough),
br AS (SELECT v.n, v.head, v.toks, min(struct_pack(cnt, pos, tok)) AS b FROM v JOIN often USING (n, head, pos, tok) GROUP BY v.n, v.head, v.toks),
bv AS (SELECT n, head, b.pos AS bp, b.tok AS bt, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM br),
c AS (SELECT n, head, bp, bt, pos, tok, count(*) AS cnt FROM bv GROUP BY ALL),
p AS (SELECT n, head, bp, bt, pos, sum(cnt) AS tot, max(cnt) AS top, max(struct_pack(cnt, tok)).tok AS tok FROM c GROUP BY n, head, bp, bt, pos),
f AS (
  SELECT n, head, bp, bt, list(struct_pack(pos, tok)) AS fixed FROM p WHERE top >= 0.6 * tot
  GROUP BY n, head, bp, bt HAVING count(*) FILTER (tok <> '<*>') >= greatest(4, ceil(n * 0.7)) AND max(tot) > 1),
fit AS (
  SELECT br.n, br.head, br.toks, struct_pack(bp, bt) AS branch FROM br JOIN f ON br.n = f.n AND br.head = f.head AND br.b.pos = f.bp AND br.b.tok = f.bt
  WHERE len(list_filter(f.fixed, lambda x: br.toks[x.pos] <> x.tok)) = 0),
m AS (
  SELECT s.n, s.head, s.enough, s.doc, s.no, fit.branch, CASE WHEN fit.branch IS NULL THEN s.toks END AS template
  FROM picked s LEFT JOIN fit ON s.n = fit.n AND s.head = fit.head AND s.toks = fit.toks),
r AS (SELECT n, head, branch, template, min(doc) AS first FROM m GROUP BY n, head, enough, branch, template HAVING count(DISTINCT doc) >= enough),
g AS (
  SELECT m.doc, list(m.no) AS gone FROM m
  JOIN r ON m.n = r.n AND m.head = r.head AND m.branch IS NOT DISTINCT FROM r.branch AND m.template IS NOT DISTINCT FROM r.template
  WHERE m.doc <> r.first GROUP BY m.doc)
SELECT d.doc_id,
       coalesce(len(d.ls), 0)::BIGINT AS n_lines,
       coalesce(len(g.gone), 0)::BIGINT AS n_dropped,
       CASE WHEN g.gone IS NULL THEN d.text
            ELSE coalesce(array_to_string(list_transform(list_filter(list_zip(d.ls, range(len(d.ls))), lambda x: NOT list_contains(g.gone, x[2])), lambda x: x[1]), chr(10)), '') END AS text
FROM d LEFT JOIN g ON d.doc = g.doc
"""

op2_url_filter = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?:.|\n)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?:.|\n)*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
p AS (
  SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs,
         list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda s: s <> '') AS keys
  FROM u),
t AS (
  SELECT page_id, host, path, list_sort(list_distinct(CASE WHEN contains(url, '://') THEN
      ['scheme=' || regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)]
      || list_transform(range(1, len(labels) + 1), lambda i: 'host=' || array_to_string(labels[i:], '.'))
      || list_transform(range(1, len(segs) + 1), lambda i: 'path' || (i - 1) || '=' || regexp_replace(segs[i], '[0-9]+', '#', 'g'))
      || list_transform(keys, lambda k: 'key=' || string_split(k, '=')[1]) ELSE []::VARCHAR[] END)) AS toks
  FROM p),
lab AS (SELECT doc_id AS page_id, bool_or(toxic = 1 OR quality = 0) AS bad FROM labels GROUP BY doc_id),
tr AS (SELECT t.toks, lab.bad FROM t JOIN lab USING (page_id) WHERE lab.bad IS NOT NULL),
sub AS (SELECT toks, bad, unnest(range(1, (2 ^ len(toks))::BIGINT)) AS m FROM tr),
sets AS (SELECT list_transform(list_filter(range(1, len(toks) + 1), lambda i: (m >> (i - 1)) & 1 = 1), lambda i: toks[i]) AS s, bad FROM sub),
rules AS (
  SELECT s, sum(bad::INT) / count(*)::DOUBLE AS confidence FROM sets GROUP BY s
  HAVING sum(bad::INT) >= (SELECT CASE WHEN len(s) = 1 THEN 8 ELSE ceil(greatest(0.005 * count(*), 8)) END FROM tr) AND sum(bad::INT) / count(*)::DOUBLE >= 0.8),
kept AS (
  SELECT r.* FROM rules r WHERE NOT EXISTS (
    SELECT 1 FROM rules q WHERE len(q.s) = len(r.s) - 1 AND list_has_all(r.s, q.s) AND q.confidence >= r.confidence)),
hit AS (SELECT t.page_id, max(k.confidence) AS confidence FROM t JOIN kept k ON list_has_all(t.toks, k.s) GROUP BY t.page_id),
st AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) v(action, rh, rp)),
fit AS (SELECT t.page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action FROM t JOIN st ON (t.host = rh OR ends_with(t.host, '.' || rh)) AND starts_with(t.path, rp) GROUP BY t.page_id)
SELECT t.page_id, t.host, t.path, fit.rule, coalesce(fit.action, CASE WHEN hit.confidence IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, hit.confidence
FROM t LEFT JOIN hit USING (page_id) LEFT JOIN fit USING (page_id)
"""

op7_jaccard_join = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END)) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, comp) AS (SELECT x, x FROM e UNION SELECT e.y, r.comp FROM r JOIN e ON e.x = r.doc_id WHERE r.comp < e.y),
m AS (SELECT doc_id, min(comp) AS comp FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.comp, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""


def _license_sql() -> str:
    from lodestone.llm.license import TEMPLATES

    term = r"'[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*'"
    rows = ", ".join("({}, '{}', '{}')".format(i, k, t.replace("'", "''")) for i, (k, t) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT doc_id, concat_ws('/', '', source, lang, doc_id) AS path, concat_ws('/', '', source, lang) AS folder, text, md5(text) AS doc FROM documents),
tpl AS (SELECT i, lic, regexp_extract_all(lower(txt), {term}) AS t FROM (VALUES {rows}) v(i, lic, txt)),
tp AS (SELECT i, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS off, len(t) AS long FROM tpl),
tt AS (SELECT i, term, count(*) AS tf, min(off) AS off, any_value(long) AS long FROM tp GROUP BY i, term),
txt AS (SELECT doc, any_value(text) AS text FROM d WHERE text IS NOT NULL GROUP BY doc),
ln AS (SELECT doc, unnest(l) AS l, generate_subscripts(l, 1) - 1 AS line FROM (SELECT doc, string_split(text, chr(10)) AS l FROM txt)),
lt AS (SELECT doc, line, regexp_extract_all(lower(l), {term}) AS t FROM ln),
tk AS (SELECT doc, line, unnest(t) AS term, generate_subscripts(t, 1) AS j FROM lt),
w AS (SELECT doc, line, term, row_number() OVER (PARTITION BY doc ORDER BY line, j) - 1 AS pos, count(*) OVER (PARTITION BY doc) AS n FROM tk),
copies AS (SELECT doc, count(*) AS c FROM d WHERE text IS NOT NULL GROUP BY doc),
n AS (SELECT count(text) AS n FROM d),
df AS (SELECT term, sum(c) AS df FROM (SELECT DISTINCT doc, term FROM w) JOIN copies USING (doc) GROUP BY term),
idf AS (SELECT v.term, ln((1 + (SELECT n FROM n)) / (1 + coalesce(df, 0))::DOUBLE) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) v LEFT JOIN df USING (term)),
raw AS (SELECT i, term, tf, off, long, tf * idf AS x FROM tt JOIN idf USING (term)),
tw AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY i)) AS w FROM raw),
sig AS (
  SELECT * FROM (SELECT *, 1 - coalesce(sum(w * w) OVER (PARTITION BY i ORDER BY w DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM tw)
  WHERE rest >= 0.75 * 0.75 - 1e-9),
anchor AS (SELECT * FROM (SELECT *, min(tf) OVER (PARTITION BY i) AS least FROM sig) WHERE tf = 1 OR least > 1),
able AS (SELECT doc, i FROM (SELECT DISTINCT doc, term FROM w) JOIN tw USING (term) GROUP BY doc, i HAVING sum(tw.w * tw.w) >= 0.75 * 0.75 - 1e-9),
span AS (
  SELECT DISTINCT w.doc, a.i, greatest(w.pos - a.off, 0) AS lo, least(w.pos - a.off + a.long, w.n) AS hi
  FROM w JOIN anchor a USING (term) JOIN able ON able.doc = w.doc AND able.i = a.i),
bag AS (
  SELECT s.doc, s.i, s.lo, s.hi, w.term, count(*) AS tf FROM (SELECT *, unnest(range(lo, hi)) AS pos FROM span) s JOIN w ON w.doc = s.doc AND w.pos = s.pos GROUP BY ALL),
wt AS (
  SELECT b.doc, b.i, b.lo, b.hi, b.tf * coalesce(idf.idf, ln(1 + (SELECT n FROM n)::DOUBLE) + 1) AS x, coalesce(tw.w, 0) AS v
  FROM bag b LEFT JOIN idf ON idf.term = b.term LEFT JOIN tw ON tw.i = b.i AND tw.term = b.term),
found AS (SELECT doc, i, lo, hi, round(sum(x * v) / sqrt(sum(x * x)), 6) AS score FROM wt GROUP BY doc, i, lo, hi HAVING round(sum(x * v) / sqrt(sum(x * x)), 6) >= 0.75),
best AS (
  SELECT doc, pos, max(struct_pack(score, long := hi - lo, first := -lo, template := -i)) AS r
  FROM (SELECT *, unnest(range(lo, hi)) AS pos FROM found) GROUP BY doc, pos),
wins AS (SELECT doc, r, count(*) AS k FROM best GROUP BY doc, r HAVING 2 * count(*) > r.long),
own AS (
  SELECT wins.doc, list(DISTINCT tpl.lic) AS lics, string_agg(DISTINCT tpl.lic, ' AND ' ORDER BY tpl.lic) AS lic, max(r.score) AS score, min(-r.first) AS lo, sum(k) AS k
  FROM wins JOIN tpl ON tpl.i = -r.template GROUP BY wins.doc),
f AS (
  SELECT d.*, own.lic, own.lics, own.score, w.line AS no, coalesce(own.k / w.n::DOUBLE >= 0.5, false) AS is_file
  FROM d LEFT JOIN own ON own.doc = d.doc LEFT JOIN w ON w.doc = own.doc AND w.pos = own.lo),
h AS (SELECT folder, string_agg(DISTINCT lic, ' AND ' ORDER BY lic) AS lic FROM (SELECT folder, unnest(lics) AS lic FROM f WHERE is_file) GROUP BY folder),
near AS (
  SELECT g.folder, arg_max(h.folder, length(h.folder)) AS up, arg_max(h.lic, length(h.folder)) AS lic
  FROM (SELECT DISTINCT folder FROM f) g JOIN h ON starts_with(g.folder || '/', h.folder || '/') GROUP BY g.folder)
SELECT f.doc_id, f.path, f.lic AS own_licence, f.score, f.no::INTEGER AS line, f.is_file AS is_licence_file, near.up AS inherited_from, coalesce(f.lic, near.lic) AS licence
FROM f LEFT JOIN near ON near.folder = f.folder
"""


op1_license_scan = _license_sql()

# CRC-32 of every distinct n-gram, a byte at a time by a table of its 256 remainders.
op12_resample = r"""
WITH bits AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c
    FROM range(256) r(i))),
w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
g AS (
  SELECT side, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS gram FROM w),
e AS (SELECT gram, hex(encode(gram)) AS x FROM (SELECT DISTINCT gram FROM g)),
c AS (
  SELECT gram, xor(4294967295, list_reduce(
           list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT),
           lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295)) % 10000 AS bucket
  FROM e, bits),
f AS (SELECT side, id, bucket FROM g JOIN c USING (gram)),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f GROUP BY bucket),
a AS (SELECT sum(s)::BIGINT AS big_s, sum(t)::BIGINT AS big_t FROM n),
q AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (big_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (big_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM n, a),
p AS (SELECT id, count(*) AS m, sum(gain)::BIGINT AS g FROM f JOIN q USING (bucket) WHERE side = 'd' GROUP BY id),
h AS (
  SELECT w.id AS doc_id, len(ws) AS n_words, coalesce(m, 0)::BIGINT AS n_features,
         coalesce((g - ((g % m) + m) % m) // m, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || w.id::VARCHAR), 1, 8))::BIGINT AS h
  FROM w LEFT JOIN p ON p.id = w.id WHERE side = 'd'),
k AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
o AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
         (25 * count(*) OVER (PARTITION BY n_words >= 20)) // 100 AS draw FROM k)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= draw THEN place END AS rank FROM o
"""

op13_infill = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls,
         sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
h AS (
  SELECT *, len(ls) AS n, list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS r FROM d),
f AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
              WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, array_to_string(ls[1:a], '') AS p, array_to_string(ls[a + 1:b], '') AS m, array_to_string(ls[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
