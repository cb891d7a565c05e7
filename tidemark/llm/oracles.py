"""SQL for the queries of conversations and centroids: the same results by plain dynamic programming and by plain Lloyd rounds."""

from __future__ import annotations


def _plus(value: str, cost: str, letter: str) -> str:
    """A string of nine digits of cost and an audit, with more of both; null stays null."""
    return f"lpad(CAST(CAST(substr({value}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({value}, 10) || '{letter}'"


def _read(letter: str, value: str) -> str:
    """A row kept, if its role begins with the letter, or read as that role."""
    keep = f"CASE WHEN must = 0 AND ini = '{letter}' THEN {_plus(value, '3 * cutoff', 'K')} END"
    return keep if letter == "s" else f"least({keep}, CASE WHEN must = 0 THEN {_plus(value, '3 + 3 * cutoff', 'R')} END)"


#: Nothing said, only a system row said, the assistant's turn, the user's turn after a pair.
_STEP = f"""
  SELECT c, i, {_plus('v0', '4', 'D')} AS n0, least({_plus('v1', '4', 'D')}, {_read('s', 'v0')}) AS n1,
         least({_plus('v2', '4', 'D')}, {_read('u', 'v0')}, {_read('u', 'v1')}, {_read('u', 'v3')}) AS n2,
         least({_plus('v3', '4', 'D')}, {_read('a', 'v2')}) AS n3
  FROM walk JOIN ranked USING (c, i)"""

OP11_SQL = f"""
WITH RECURSIVE plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') AS c,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), summed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(key) + 1), lambda k: CAST(ascii(substr(key, k, 1)) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS fate
  FROM plain
), damaged AS (
  SELECT c, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM summed WHERE fate <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged
), ranked AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, again) - 1 AS i, substr(role, 1, 1) AS ini,
         CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         CASE WHEN body = '' OR again THEN 1 ELSE 0 END AS must, CASE WHEN body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cutoff
  FROM numbered
), walk AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, '000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, '000000003I' AS v2, '000000006II' AS v3 FROM plain
  UNION ALL
  SELECT c, i + 1, n0, n1, i2, least(n3, {_plus('i2', '3', 'I')}) FROM (
    SELECT *, least(n2, {_plus('n0', '3', 'I')}, {_plus('n1', '3', 'I')}, {_plus('n3', '3', 'I')}) AS i2 FROM ({_STEP})
  )
), best AS (
  SELECT c, least(arg_max(v0, i), arg_max(v3, i)) AS v FROM walk GROUP BY c
), edit AS (
  SELECT c, j, substr(v, 9 + j, 1) AS e FROM (SELECT c, v, unnest(range(1, length(v) - 8)) AS j FROM best)
), located AS (
  SELECT c, j, e, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER w - 1 AS i, sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER w AS said FROM edit WINDOW w AS (PARTITION BY c ORDER BY j)
), opened AS (
  SELECT l.c, max(CASE WHEN l.said = 1 AND e = 'K' AND r.ini = 's' THEN 1 ELSE 0 END) AS sys FROM located l LEFT JOIN ranked r ON r.c = l.c AND r.i = l.i WHERE e <> 'D' GROUP BY l.c
), line AS (
  SELECT l.c, l.j, CASE WHEN e = 'K' THEN r.role WHEN (l.said - 1 - o.sys) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE r.text END AS line
  FROM located l JOIN opened o USING (c) LEFT JOIN ranked r ON r.c = l.c AND r.i = l.i WHERE e <> 'D'
), repaired AS (
  SELECT c, string_agg(line, chr(10) ORDER BY j) AS whole FROM line GROUP BY c
), pair AS (
  SELECT c, lag(ini) OVER (PARTITION BY c ORDER BY i) || ini AS p FROM ranked
), fault_of AS (
  SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM ranked GROUP BY c
), illegal_of AS (
  SELECT c, count(*) FILTER (p NOT IN ('su', 'ua', 'au')) AS illegal FROM pair GROUP BY c
)
SELECT p.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(substr(v, 1, 9) AS BIGINT) AS cost, substr(v, 10) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM plain) p JOIN best USING (c) LEFT JOIN repaired USING (c) LEFT JOIN fault_of USING (c) LEFT JOIN illegal_of USING (c)
"""


def _round(n: int) -> str:
    """Assignment to the centroids of a round, and the centroids after it."""
    return f"""near{n} AS (
  SELECT v.r, min(CAST(list_sum(list_transform(range(1, 65), lambda j: (v.q[j] - c.q[j]) * (v.q[j] - c.q[j]))) AS BIGINT) * 16 + c.k) AS best FROM vec v CROSS JOIN cent{n} c GROUP BY v.r
), own{n} AS (
  SELECT r, CAST(best % 16 AS INTEGER) AS cluster, best // 16 AS distance FROM near{n}
), part{n} AS (
  SELECT cluster, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT o.cluster, unnest(range(1, 65)) AS j, unnest(v.q) AS x FROM own{n} o JOIN vec v USING (r)) GROUP BY cluster, j
), cent{n + 1} AS (
  SELECT c.k, coalesce(p.q, c.q) AS q FROM cent{n} c LEFT JOIN (SELECT cluster AS k, list(x ORDER BY j) AS q FROM part{n} GROUP BY cluster) p USING (k)
)"""


OP13_SQL = f"""
WITH vec AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cent0 AS (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, q FROM vec ORDER BY h NULLS LAST, q LIMIT 16)
), {_round(0)}, {_round(1)}, {_round(2)}, {_round(3)}
SELECT v.vec_id, o.cluster, o.distance, CAST(sum(o.distance) OVER (PARTITION BY o.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(o.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM own3 o JOIN vec v USING (r) JOIN cent3 c ON c.k = o.cluster
"""
