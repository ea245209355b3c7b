"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS win
  FROM b, unnest(range(0, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0
),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM bw) AS ns, unnest(range(0, greatest(len(w) - n + 1, 0))) AS t(i)
),
hits AS (SELECT DISTINCT doc_id, i, dw.n, win FROM dw SEMI JOIN bw USING (win, n)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids
  FROM hits JOIN bw USING (win, n) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s
  FROM d, unnest(range(0, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 5 * k >= 4 * (x.n + y.n - k)
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size,
  (SELECT count(*) FROM links WHERE links.a = reach.a) AS n_links
FROM reach GROUP BY a
"""

OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS s
  FROM d, unnest(range(0, greatest(len(w) - 12, 0))) AS t(i)
),
firsts AS (SELECT s, min(doc_id) AS owner FROM win GROUP BY s HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, i FROM win JOIN firsts USING (s) WHERE owner < doc_id
  ), unnest(range(i, i + 13)) AS t(p)
),
lost AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d) ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP7 = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP9 = r"""
WITH u AS (
  SELECT page_id, url, coalesce(strpos(url, '://'), 0) AS p FROM pages
),
h AS (
  SELECT page_id,
    CASE WHEN p > 0 THEN translate(regexp_extract(substr(url, p + 3), '^[^/?#]*', 0),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN p > 0 THEN regexp_extract(substr(url, p + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM u
),
rules(rhost, rpath, rverdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
),
fits AS (
  SELECT page_id, arg_max(rhost || rpath, len(rhost || rpath)) AS rule, arg_max(rverdict, len(rhost || rpath)) AS v
  FROM h, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN fits USING (page_id)
"""



def _tree_levels(name: str, nodes: str, depth: int) -> str:
    """CTEs name0 ... of a tree's levels (tree, pos, n, h), and nameN_of: what stands left and right of each node."""
    parts = [f"{name}0 AS ({nodes})"]
    for i in range(1, depth + 1):
        parts.append(
            f"{name}{i} AS (SELECT tree, pos // 8 AS pos, (n + 7) // 8 AS n,"
            f" CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h FROM {name}{i - 1} GROUP BY tree, pos // 8, n)"
        )
    for i in range(depth):
        parts.append(
            f"{name}{i}_of AS (SELECT tree, pos, n, coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
            f" coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{i})"
        )
    return ",\n".join(parts)


def _climbed(source: str, name: str, depth: int) -> str:
    """CTEs that carry (tree, place, up: hash so far, sib: siblings so far) of ``source`` to the top of the tree."""
    parts, last = [], source
    for i in range(depth):
        parts.append(
            f"{source}_{name}{i} AS (SELECT x.* EXCLUDE (up, sib), CASE WHEN o.n > 1 THEN sha256(o.l || x.up || o.r) ELSE x.up END AS up, x.sib || o.l || o.r AS sib"
            f" FROM {last} x JOIN {name}{i}_of o ON o.tree = x.tree AND o.pos = x.place // {8**i})"
        )
        last = f"{source}_{name}{i}"
    return ",\n".join(parts)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIELD = lambda v: f"coalesce(strlen({v}::VARCHAR) || ':' || ({v}::VARCHAR), '-')"
_LEAF = lambda text: "sha256(" + " || ".join(map(_FIELD, ["doc_id", "source", "lang", "n_chars", text])) + ")"
#: crc32 of the decimal digits of doc_id.
_CRC = """xor(4294967295::UBIGINT, list_reduce(
  list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]),
    lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))))"""
#: Levels of a language's tree (2,097,152 leaves) and of the tree over languages (512).
_DEPTH, _ROOT_DEPTH = 7, 3

OP11 = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF("text")} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF(_LOWER)} END AS tampered FROM documents
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves
),
{_tree_levels("t", "SELECT tree, place AS pos, n, leaf AS h FROM placed", _DEPTH)},
tops AS (SELECT '' AS tree, tree AS lang, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n, h AS subroot FROM t{_DEPTH}),
{_tree_levels("g", "SELECT tree, place AS pos, n, subroot AS h FROM tops", _ROOT_DEPTH)},
begin_ AS (SELECT doc_id, tree, place, leaf, coalesce(tampered, leaf) AS up, '' AS sib FROM placed),
{_climbed("begin_", "t", _DEPTH)},
upper_ AS (
  SELECT x.doc_id, x.leaf, '' AS tree, p.place, p.subroot, x.up, x.sib FROM begin__t{_DEPTH - 1} x JOIN tops p ON p.lang = x.tree
),
{_climbed("upper_", "g", _ROOT_DEPTH)}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(sib) AS proof_sha256, up AS folded_root, up = r.h AS verified
FROM upper__g{_ROOT_DEPTH - 1}, g{_ROOT_DEPTH} r
"""

def _assign(number: int) -> str:
    """CTEs of one assignment to the centroids c<number>, and of the centroids after it."""
    return f"""
a{number} AS (
  SELECT rid, vec_id, e, list_sum(list_transform(range(1, 65), lambda i: (e[i] - c[i]) * (e[i] - c[i])))::BIGINT AS distance, cluster,
    row_number() OVER (PARTITION BY rid ORDER BY list_sum(list_transform(range(1, 65), lambda i: (e[i] - c[i]) * (e[i] - c[i]))), cluster) AS r
  FROM v, c{number}
),
n{number} AS (SELECT * FROM a{number} WHERE r = 1),
m{number} AS (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
    SELECT cluster, i, sum(e[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM n{number}, unnest(range(1, 65)) AS t(i) GROUP BY cluster, i
  ) GROUP BY cluster
),
c{number + 1} AS (SELECT cluster, coalesce(m{number}.c, c{number}.c) AS c FROM c{number} LEFT JOIN m{number} USING (cluster))"""


OP12 = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
f AS (SELECT *, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS cluster FROM v),
c0 AS (SELECT cluster, e AS c FROM f WHERE cluster < 16),{",".join(map(_assign, range(4)))}
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM n3 JOIN c3 USING (cluster)
"""

ORACLES = {
    "op1_decontaminate": OP1,
    "op2_jaccard_join": OP2,
    "op5_substrings": OP5,
    "op7_neighbours": OP7,
    "op9_url_filter": OP9,
    "op11_merkle": OP11,
    "op12_centroids": OP12,
}
