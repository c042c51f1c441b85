"""DuckDB SQL for the queries that SQL can express, written from the contracts
and sharing nothing with the operators."""

_WORDS = r"COALESCE(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'), [])"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
win AS (SELECT r, s, array_to_string(w[s:s + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, s + k AS p FROM win JOIN rep USING (g), range(0, 35) AS t(k)),
word AS (SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN hit USING (r, p) GROUP BY r),
gone AS (SELECT r, count(*) AS n FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n, 0)::BIGINT AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)
"""

_PLAIN = r"COALESCE(regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM bl)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks)),
m AS (SELECT r, dw.k AS k, s, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(hit.n, 0)::BIGINT AS n_hit, COALESCE(it.n, 0)::BIGINT AS n_items,
       sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(hit.n, 0) > 0 AND 20 * COALESCE(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format('text')})::BIGINT AS size,
                  (('0x' || substr(md5('mix-1:' || COALESCE(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight,
              2.0 * source_size AS cap FROM s0),
lev AS (SELECT a.source, (1.5 * (SELECT sum(source_size) FROM s0) - COALESCE(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0))
               / sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS level FROM s1 a, s1 b GROUP BY ALL),
tgt AS (SELECT s1.*, least(cap, (SELECT max(level) FROM lev JOIN s1 x ON lev.source IS NOT DISTINCT FROM x.source
                                 WHERE level * x.weight <= x.cap) * weight) AS target FROM s1),
f AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share
      FROM d JOIN tgt ON d.source IS NOT DISTINCT FROM tgt.source),
need AS (SELECT source, round(sum((share - floor(share)) * size), 6) AS need FROM f GROUP BY source),
odds AS (SELECT *, (u / (1 - u)) / ((share - floor(share)) / (1 - (share - floor(share)))) AS o FROM f WHERE share > floor(share) AND size > 0),
ranked AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY o / (1 + o), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM odds),
drawn AS (SELECT doc_id FROM ranked JOIN need ON ranked.source IS NOT DISTINCT FROM need.source WHERE upto - size / 2.0 < need)
SELECT doc_id, size, source_size, target, ((floor(share) + (doc_id IN (SELECT doc_id FROM drawn))::INTEGER) * size)::BIGINT AS taken FROM f
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, COALESCE(regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, COALESCE(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM d JOIN reach ON d.doc_id = reach.a LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP10 = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_ITEM = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_ITEM.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
# crc32, eight shifts a byte
_CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))")
# nodes of every level over (s, i, n, h): tree, place, nodes in the level, hash; and what stands beside each
_TREE = """
{0}_n AS (SELECT 0 AS l, s, i, n, h FROM {0} UNION ALL
          SELECT l + 1, s, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {0}_n WHERE n > 1 GROUP BY l + 1, s, i // 3, (n + 2) // 3),
{0}_s AS (SELECT l, s, i, COALESCE(string_agg(h, '') OVER (PARTITION BY l, s, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
                 COALESCE(string_agg(h, '') OVER (PARTITION BY l, s, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {0}_n WHERE n > 1)"""

OP11 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_LEAF.format('text')} AS leaf,
         CASE WHEN {_CRC.format('doc_id::VARCHAR')} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format('text')} END AS changed FROM documents),
src AS (SELECT source, count(*)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM d GROUP BY source),
x AS (SELECT d.*, s, n, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
low AS (SELECT s, i, n, leaf AS h FROM x),{_TREE.format('low')},
sub AS (SELECT s, h FROM low_n WHERE n = 1),
high AS (SELECT 0 AS s, s AS i, (SELECT count(*) FROM src)::BIGINT AS n, h FROM sub),{_TREE.format('high')},
step AS (SELECT r, l, a, b FROM x JOIN low_s ON x.s = low_s.s AND x.i // (3 ** l)::BIGINT = low_s.i
         UNION ALL SELECT r, 100 + l, a, b FROM x JOIN high_s ON x.s // (3 ** l)::BIGINT = high_s.i),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY l) AS k FROM step),
fold AS (SELECT r, 0::BIGINT AS k, changed AS h FROM d UNION ALL SELECT fold.r, k.k, sha256(a || h || b) FROM fold JOIN k ON k.r = fold.r AND k.k = fold.k + 1),
proof AS (SELECT r, string_agg(a || b, '' ORDER BY k) AS p FROM k GROUP BY r),
done AS (SELECT r, arg_max(h, k) AS folded_root FROM fold GROUP BY r),
root AS (SELECT h AS root FROM high_n WHERE n = 1)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(COALESCE(p, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM x JOIN sub USING (s) JOIN done USING (r) LEFT JOIN proof USING (r), root
"""

_RUN = "regexp_extract_all(" + _LOWER.format("text") + ", '[a-zÀ-ÿ]+')"
OP12 = rf"""
WITH RECURSIVE run AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest({_RUN}) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
h AS (SELECT w, c, {_CRC.replace("string_split({0}, '')", "regexp_extract_all(hex(encode({0})), '..')").replace("ord(c)", "('0x' || c)").format("doc_id || ':' || w")} AS h FROM run),
word AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM word WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
less AS (SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1))::INTEGER AS k FROM v)),
near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT less.word, v.word FROM less JOIN v ON rest = v.word UNION SELECT v.word, less.word FROM less JOIN v ON rest = v.word),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-v.n, other)) AS form, max(v.n) AS form_n FROM near JOIN v ON other = v.word GROUP BY near.word),
f AS (SELECT v.word, v.n, COALESCE(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
      FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk w USING (word) JOIN f e ON w.at = e.word AND e.form IS NULL
"""

ORACLE_SQL = {
    "op2_substring_dedup": OP2,
    "op3_decontaminate": OP3,
    "op4_mix_sources": OP4,
    "op8_ngram_join": OP8,
    "op10_nearest": OP10,
    "op11_merkle_manifest": OP11,
    "op12_spelling_variants": OP12,
}
