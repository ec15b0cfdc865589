"""DuckDB SQL for the queries that SQL can express; each is written from the contract, not from the operator."""

from __future__ import annotations

from subseg.llm import secret_scan as S

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def op8() -> str:
    """Matches by the text between them; a window's entropy from its characters."""
    assign = _q(S.ASSIGN)
    allow = " AND ".join(f"NOT regexp_matches(hit, {_q(p)})" for p in S.ALLOW)
    kinds = ((0, S.ASSIGN), (1, S.ACCESS), (2, "[0-9a-f]+"), (3, S.CANDIDATE % S.WINDOW))
    found = "\n  UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, unnest(h) AS hit, unnest(p[1:len(h)]) AS piece, generate_subscripts(h, 1) AS i "
        f"FROM (SELECT doc_id, regexp_extract_all(t, {_q(p)}, 0) AS h, string_split_regex(t, {_q(p)}) AS p FROM d) WHERE len(h) > 0"
        for k, p in kinds
    )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
loc AS (
  SELECT *, sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM f),
s AS (SELECT doc_id, kind, hit, (e - length(hit))::BIGINT AS a, e::BIGINT AS e FROM loc),
base AS (
  SELECT * FROM s WHERE kind = 0 AND length(regexp_extract(hit, {assign}, 1)) >= 12
  UNION ALL SELECT * FROM s WHERE kind = 1 AND length(hit) >= 18
  UNION ALL SELECT * FROM s WHERE kind = 2 AND length(hit) >= 16),
more AS (
  SELECT * FROM s WHERE kind = 3 AND regexp_matches(hit, '[0-9]') AND {allow}
    AND list_max([round(list_aggregate(string_split(substr(hit, k, {S.WINDOW}), ''), 'entropy'), 9) FOR k IN range(1, length(hit) - {S.WINDOW} + 2)])
        >= CASE WHEN regexp_full_match(hit, '[0-9a-f]+|[0-9A-F]+') THEN {S.THRESHOLDS['hex']} ELSE {S.THRESHOLDS['mixed']} END
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.a <= s.a AND b.e >= s.e)),
spans AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || a || ':' || e AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM more)),
sums AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
         string_agg(x, ',' ORDER BY a, kind) FILTER (kind < 3) AS b, string_agg(x, ',' ORDER BY a, kind) AS every
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
       coalesce(every, '') AS spans
FROM d LEFT JOIN sums USING (doc_id)"""


def op9() -> str:
    """All pairs that share a shingle, their overlaps, and the closure of the links."""
    return f"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
sh AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)]) END AS s FROM d),
g AS (SELECT doc_id, hash(unnest(s)) AS h FROM sh),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM sh),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN reach r ON r.a = n.doc_id GROUP BY 1, 2"""


def op11() -> str:
    """Every inner product of an anchor, ranked; no index."""
    return """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""


def op12() -> str:
    """Every window as a string; the earliest of equal ones by a window function."""
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d)),
again AS (SELECT doc_id, k FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, k) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS j FROM again),
kept AS (
  SELECT doc_id, j, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d) ANTI JOIN gone USING (doc_id, j)),
text AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN text USING (doc_id)"""


def op13() -> str:
    """Every prefix as a string of turn digests; subtrees by joining each node with all its ancestors."""
    crc = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"
    return f"""WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, n, {crc} % 6 AS h FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
convs AS (SELECT x.c, x.h, least(x.h, coalesce(b.n, 0)) AS head FROM h x LEFT JOIN h b ON b.c = x.c - x.c % 100),
turns AS (
  SELECT x.c, t.pos, g, chars FROM convs x JOIN t ON t.c = x.c - x.c % 100 AND t.pos < x.head
  UNION ALL SELECT x.c, head + t.pos - x.h, g, chars FROM convs x JOIN t ON t.c = x.c AND t.pos >= x.h),
pre AS (
  SELECT c, pos + 1 AS d, string_agg(g, '') OVER (PARTITION BY c ORDER BY pos) AS p, chars, pos + 1 = count(*) OVER (PARTITION BY c) AS last FROM turns
  UNION ALL SELECT c, 0, '', 0, NOT EXISTS (SELECT 1 FROM turns y WHERE y.c = convs.c) FROM convs),
node AS (
  SELECT p, d, min(c) AS c, count(*) AS n, min(chars) AS chars, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last) AS ends FROM pre GROUP BY p, d),
kid AS (SELECT left(p, 32 * (d - 1)::INTEGER) AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
below AS (
  SELECT left(u.p, 32 * k::INTEGER) AS p, sum(CASE WHEN kid.p IS NULL THEN 1 ELSE 0 END) AS leaves, sum((u.n - 1) * u.chars) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM node) u LEFT JOIN kid ON kid.p = u.p GROUP BY 1)
SELECT node.c AS conv_id, node.d AS depth, up.c AS parent_conv_id, node.n AS n_convs, coalesce(kid.n, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN below ON below.p = node.p LEFT JOIN kid ON kid.p = node.p
LEFT JOIN node up ON node.d > 0 AND up.p = left(node.p, 32 * (node.d - 1)::INTEGER)"""


ORACLE_SQL = {"op8_secret_scan": op8(), "op9_jaccard_join": op9(), "op11_hard_negatives": op11(), "op12_substring_dedup": op12(), "op13_prefix_trie": op13()}
