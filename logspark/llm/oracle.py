"""DuckDB twins of the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op2_wu_manber"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(ws)) AS k,
         array_to_string(ws[j:j + least(13, len(ws)) - 1], ' ') AS win
  FROM b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS t(j)
  WHERE len(ws) > 0),
dw AS (
  SELECT r, s.k, p, array_to_string(ws[p:p + s.k - 1], ' ') AS win
  FROM d, (SELECT DISTINCT k FROM bw) AS s, unnest(range(1, len(ws) - s.k + 2)) AS t(p)),
m AS (SELECT r, p, k, item FROM dw JOIN bw USING (k, win)),
h AS (
  SELECT r, count(DISTINCT q) AS n_hit
  FROM (SELECT DISTINCT r, p, k FROM m), unnest(range(p, p + k)) AS t(q) GROUP BY r),
i AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""

# The text without lines on ten or more sites, and what was removed; the same for op7 and the pipeline.
LINE_SPREAD = r"""
{name}_l AS (
  SELECT r, doc_id, source, i, line, trim(line, ' ' || chr(9) || chr(13)) AS norm
  FROM (SELECT r, doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS i
        FROM (SELECT r, doc_id, source, string_split(text, chr(10)) AS ls FROM {docs}))),
{name}_b AS (
  SELECT norm FROM {name}_l
  WHERE len(string_split_regex(norm, '[ \t\r]+')) >= 3
  GROUP BY norm HAVING count(DISTINCT source) >= 10),
{name}_k AS (
  SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE norm NOT IN (SELECT norm FROM {name}_b))
         AS kept,
         count(*) FILTER (WHERE norm IN (SELECT norm FROM {name}_b)) AS gone, count(*) AS n
  FROM {name}_l GROUP BY r),
{name} AS (
  SELECT d.* REPLACE (CASE WHEN gone > 0 AND length(text) - length(coalesce(kept, ''))
                            <= 0.5 * length(text) THEN coalesce(kept, '') ELSE text END AS text),
         coalesce(n, 0) AS n_lines,
         CASE WHEN gone > 0 AND length(text) - length(coalesce(kept, '')) <= 0.5 * length(text)
              THEN gone ELSE 0 END AS n_removed
  FROM {docs} AS d LEFT JOIN {name}_k USING (r))"""

ORACLE["op7_line_spread"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
{LINE_SPREAD.format(name="c", docs="d")}
SELECT doc_id, n_lines, n_removed, sha256(text) AS text_sha256 FROM c
"""

ORACLE["op3_jaccard_groups"] = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, doc_id, array_to_string(ws[i:i + least(3, len(ws)) - 1], ' ') AS g
  FROM d, unnest(range(1, len(ws) - least(3, len(ws)) + 2)) AS t(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
l AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM (SELECT p.r AS r1, q.r AS r2, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.r <> q.r
        GROUP BY p.r, q.r) AS c
  JOIN n x ON x.r = r1 JOIN n y ON y.r = r2
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN n USING (r, doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

ORACLE["op11_merkle_text"] = r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, sha256(coalesce(text, ''))) AS r, doc_id,
         coalesce(text, '') AS t
  FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS nt FROM d),
e AS (SELECT *, left(t, length(t) - length(t) // 4) || left(nt, length(t) // 4) AS et FROM n),
u AS (SELECT t FROM e UNION SELECT et FROM e),
p AS (
  SELECT t, list_transform(string_split(t, chr(10) || chr(10)), lambda s:
           list_transform(string_split(s, chr(10)), lambda l:
             list_transform(regexp_extract_all(l, '(?: *[^ ]{1,16}){1,4}| +'), lambda w:
               {d: sha256(w), n: length(w)}))) AS sections
  FROM u),
q AS (
  SELECT t, list_transform(sections, lambda s: list_transform(s, lambda l:
           {d: sha256('-' || coalesce(array_to_string(list_transform(l, lambda w: w.d), ''), '')),
            ps: list_transform(l, lambda w: left(w.d, 8) || w.n)})) AS sections
  FROM p),
s AS (
  SELECT t, list_transform(sections, lambda s:
           {d: sha256('/' || array_to_string(list_transform(s, lambda l: l.d), '')), ls: s}) AS sections
  FROM q),
f AS (
  SELECT t, '#' || sha256('#' || array_to_string(list_transform(sections, lambda s: s.d), ''))
           || array_to_string(list_transform(sections, lambda s: ' /' || left(s.d, 16)
                || array_to_string(list_transform(s.ls, lambda l: ' -' || left(l.d, 16)
                     || CASE WHEN len(l.ps) > 0 THEN ' ' || array_to_string(l.ps, ' ') ELSE '' END), '')),
              '') AS fp
  FROM s),
k AS (
  SELECT fp, token, count(*) AS n, count(*) * CAST(substr(token, 9) AS BIGINT) AS chars
  FROM (SELECT fp, unnest(string_split(fp, ' ')) AS token FROM (SELECT DISTINCT fp FROM f))
  WHERE ascii(token) >= 48 GROUP BY fp, token),
w AS (SELECT fp, CAST(sum(chars) AS BIGINT) AS chars FROM k GROUP BY fp),
y AS (
  SELECT e.*, a.fp AS fingerprint, b.fp AS edited_fingerprint, c.fp AS next_fingerprint
  FROM e JOIN f a ON a.t = e.t JOIN f b ON b.t = e.et JOIN f c ON c.t = e.nt),
z AS (SELECT fingerprint AS f1, edited_fingerprint AS f2 FROM y UNION SELECT fingerprint, next_fingerprint FROM y),
c AS (
  SELECT f1, f2, CAST(sum(least(k1.n, k2.n) * CAST(substr(k1.token, 9) AS BIGINT)) AS BIGINT) AS both
  FROM z JOIN k k1 ON k1.fp = f1 JOIN k k2 ON k2.fp = f2 AND k2.token = k1.token GROUP BY f1, f2),
x AS (
  SELECT y.*, coalesce(w1.chars, 0) AS wa, coalesce(w2.chars, 0) AS wb, coalesce(w3.chars, 0) AS wc,
         coalesce(c1.both, 0) AS ab, coalesce(c2.both, 0) AS ac
  FROM y LEFT JOIN w w1 ON w1.fp = fingerprint LEFT JOIN w w2 ON w2.fp = edited_fingerprint
  LEFT JOIN w w3 ON w3.fp = next_fingerprint
  LEFT JOIN c c1 ON c1.f1 = fingerprint AND c1.f2 = edited_fingerprint
  LEFT JOIN c c2 ON c2.f1 = fingerprint AND c2.f2 = next_fingerprint)
SELECT doc_id, length(t) AS n_chars, sha256(et) AS edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE WHEN wa + wb > 0
            THEN CAST(2 * ab AS DOUBLE) / CAST(wa + wb AS DOUBLE) ELSE 0.0::DOUBLE END AS near_edited,
       CASE WHEN fingerprint = next_fingerprint THEN 1.0::DOUBLE WHEN wa + wc > 0
            THEN CAST(2 * ac AS DOUBLE) / CAST(wa + wc AS DOUBLE) ELSE 0.0::DOUBLE END AS near_next
FROM x
"""

ORACLE["op4_rp_forest"] = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
l AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b
  FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
  WHERE p.usable AND q.usable AND list_cosine_similarity(p.e, q.e) >= 0.93),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN n ON n.a = vec_id
LEFT JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) AS c ON c.a = vec_id
"""

ORACLE["op9_run_index"] = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (  -- parts of 400 bytes and 49 more, as a place in a long text takes long to find
  SELECT r, doc_id, 400 * j AS first, substr(h, 800 * j + 1, 898) AS part
  FROM d, unnest(range(len(h) // 800 + 1)) AS t(j)),
p AS (
  SELECT r, doc_id, first + i AS i, substr(part, 2 * i + 1, 100) AS s
  FROM q, unnest(range(0, greatest(0, len(part) // 2 - 49))) AS t(i)),
m AS MATERIALIZED (SELECT s, min(doc_id) AS first FROM p GROUP BY s HAVING count(DISTINCT doc_id) > 1),
c AS MATERIALIZED (SELECT r, i FROM p JOIN m USING (s) WHERE first < doc_id),
s AS (
  SELECT r, i, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS span
  FROM (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 50, true) AS starts FROM c)),
g AS MATERIALIZED (
  SELECT *, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before
  FROM (SELECT r, span, min(i) AS a, max(i) + 50 AS b FROM s GROUP BY r, span)),
k AS (
  SELECT r, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a)
         || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM g JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


def _climb(name: str, key: str, levels: int) -> str:
    """Runs, proofs and foldings of a tree of sixteen children, level by level, as common tables.

    ``{name}0`` holds ``r``, the tree's key, ``pos``, ``h``, and ``proof`` and ``now`` so far. A node
    alone in its tree stays what it is. Nodes are those of ``{name}n0``: key, ``pos``, ``h``.
    """
    out = []
    for i in range(levels):
        out.append(f"""
{name}t{i} AS MATERIALIZED (SELECT {key}, count(*) AS total FROM {name}n{i} GROUP BY {key}),
{name}r{i} AS MATERIALIZED (
  SELECT {key}, pos // 16 AS pos, total, string_agg(h, '' ORDER BY pos) AS run
  FROM {name}n{i} JOIN {name}t{i} USING ({key}) GROUP BY {key}, pos // 16, total),
{name}n{i + 1} AS MATERIALIZED (
  SELECT {key}, pos, CASE WHEN total > 1 THEN sha256(run) ELSE run END AS h FROM {name}r{i}),
{name}{i + 1} AS MATERIALIZED (
  SELECT x.r, {key}, x.pos // 16 AS pos,
         CASE WHEN total > 1 THEN proof || left(run, 64 * (x.pos % 16)) || substr(run, 64 * (x.pos % 16) + 65)
              ELSE proof END AS proof,
         CASE WHEN total > 1 THEN sha256(left(run, 64 * (x.pos % 16)) || now
                                         || substr(run, 64 * (x.pos % 16) + 65)) ELSE now END AS now
  FROM {name}{i} x JOIN {name}r{i} y USING ({key}) WHERE x.pos // 16 = y.pos)""")
    return ",".join(out)


def _leaf(text: str) -> str:
    values = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(
        f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


# Levels enough for 16 ** 5 documents of a source and 16 ** 3 sources. CRC-32 is worked out bit by bit.
ORACLE["op13_merkle_manifest"] = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(':' || source, '') AS src, {_leaf("text")} AS leaf,
         {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lower_leaf,
         list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
  FROM documents),
e AS MATERIALIZED (
  SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b:
      list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i:
        CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)),
    4294967295::BIGINT) % 5 = 0, false) AS changed,
    row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM d),
an0 AS MATERIALIZED (SELECT src, pos, leaf AS h FROM e),
a0 AS MATERIALIZED (
  SELECT r, src, pos, '' AS proof, CASE WHEN changed THEN lower_leaf ELSE leaf END AS now FROM e),
{_climb("a", "src", 5)},
bn0 AS MATERIALIZED (SELECT 1 AS one, src, row_number() OVER (ORDER BY src) - 1 AS pos, h FROM an5),
b0 AS MATERIALIZED (
  SELECT r, one, bn0.pos, proof, now FROM a5 JOIN bn0 USING (src)),
{_climb("b", "one", 3)}
SELECT doc_id, leaf, an5.h AS subroot, bn3.h AS root, sha256(proof) AS proof_sha256, now AS folded_root,
       now = bn3.h AS verified
FROM e JOIN an5 USING (src) JOIN b3 USING (r) CROSS JOIN bn3
"""
