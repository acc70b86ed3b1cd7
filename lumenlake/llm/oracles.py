"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _jaccard(k: int, percent: int, more: str = "") -> str:
    """Components of documents over links of k-word shingle sets, by every pair that shares one."""
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT node, y FROM reach JOIN links ON seen = x),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id{more}
FROM documents d JOIN least ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


OP1 = _jaccard(4, 80, ", d.doc_id = component_id AS kept")
OP13 = _jaccard(3, 90)

OP3 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS s FROM bw WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM windows),
places AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM dw, lengths WHERE len(w) >= k),
hits AS (SELECT doc_id, i, p.k, item_id FROM places p JOIN windows q ON p.k = q.k AND p.s = q.s),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id
"""

OP10 = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256(concat('1:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS h FROM documents),
n AS (SELECT *, CAST(len(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = rf"""
WITH q AS (SELECT DISTINCT item_id, text, unnest({_TERMS}) AS term FROM benchmark),
d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM d WHERE len(w) > 0),
places AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM places SEMI JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
part AS (SELECT doc_id, tf.term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // nt))) AS x FROM tf JOIN df ON df.term = tf.term, s),
total AS (SELECT item_id, text, doc_id, CAST(sum(x) AS BIGINT) AS score FROM q JOIN part ON part.term = q.term GROUP BY ALL HAVING sum(x) > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM total)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def _fill(name: str, source: str, parent: str, tie: str) -> str:
    """CTEs: budget of every child of a parent, by water-filling."""
    return f"""
{name}_level AS (SELECT *, cap / w AS fill, (total - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {tie} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM {source} WHERE cap > 0),
{name}_at AS (SELECT *, max(CASE WHEN lvl <= fill THEN lvl END) OVER (PARTITION BY {parent}) AS pick FROM {name}_level),
{name} AS (SELECT *, CAST(CASE WHEN pick IS NULL OR fill < pick THEN cap ELSE floor(w * pick) END AS BIGINT) AS budget FROM {name}_at)"""


OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
  CASE WHEN substr(md5(coalesce(source, 'unknown')), 1, 1) < '6' THEN 'web' WHEN substr(md5(coalesce(source, 'unknown')), 1, 1) < 'b' THEN 'reference' ELSE 'forum' END AS domain FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM d GROUP BY ALL),
top AS (SELECT CAST(floor(sum(n_tokens) * 0.6e0) AS BIGINT) AS total FROM leaf),
dom AS (SELECT domain, CAST(sum(n_tokens) * 4 AS BIGINT) AS cap, total, CASE domain WHEN 'web' THEN 5 WHEN 'reference' THEN 3 ELSE 2 END AS w, '' AS root FROM leaf, top GROUP BY domain, total),
{_fill("dom_b", "dom", "root", "domain")},
lng AS (SELECT l.domain, lang, CAST(sum(n_tokens) * 4 AS BIGINT) AS cap, b.budget AS total, CASE lang WHEN 'en' THEN 4 ELSE 1 END AS w FROM leaf l JOIN dom_b b ON b.domain = l.domain GROUP BY l.domain, lang, b.budget),
{_fill("lng_b", "lng", "domain", "lang")},
src AS (SELECT l.domain, l.lang, source, n_tokens, n_tokens * 4 AS cap, b.budget AS total, 1 AS w FROM leaf l JOIN lng_b b ON b.domain = l.domain AND b.lang = l.lang),
{_fill("src_b", "src", "domain, lang", "source")},
x AS (SELECT d.*, coalesce(budget // s.n_tokens, 0) AS epochs, coalesce(budget % s.n_tokens, 0) AS rest FROM d LEFT JOIN src_b s ON s.domain = d.domain AND s.lang = d.lang AND s.source = d.source),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('7-', epochs, '-', doc_id))) AS upto FROM x)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM o
"""

ORACLES = {"op1_minhash_near_dedup": OP1, "op2_source_mixing": OP2, "op3_benchmark_decontamination": OP3, "op10_warc": OP10, "op11_fill_in_middle": OP11, "op12_ranked_search": OP12, "op13_ngram_join": OP13}
