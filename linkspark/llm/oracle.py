"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from linkspark.llm import shard as _shard

EXACT = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, url, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS low FROM p),
b AS (SELECT *, list_transform(range(1, 9), lambda i: CAST(('0x' || substring(h, CAST(5 * i - 4 AS BIGINT), 5)) AS BIGINT)) AS parts FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(parts, lambda v: concat(
           substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 15) & 31 AS BIGINT) + 1, 1), substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 10) & 31 AS BIGINT) + 1, 1),
           substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 5) & 31 AS BIGINT) + 1, 1), substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v & 31 AS BIGINT) + 1, 1))), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to, url
FROM b
"""


def _crc_table() -> str:
    """The 256 remainders of the reflected polynomial EDB88320, by their rule."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ 0xEDB88320 * (i & 1)
        out.append(i)
    return ", ".join(map(str, out))


def shards(count: int = 8, seed: int = 20240607) -> str:
    """op1: crc-32 by table, global numbers, and the Feistel walk as a recursive query."""
    p, keys = _shard.PRIME, _shard.round_keys(seed)
    step = "SELECT rn, ((cur - cur % b) // b) AS l, cur % b AS r, n, a, b FROM todo"
    for i, (add, mul) in enumerate(keys):
        src, dst, mod = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        other = "r" if dst == "l" else "l"
        t = f"((({src} + {add}) % {p}) * {mul} % {p})"
        step = f"SELECT rn, ({dst} + ({t} * {t} % {p})) % {mod} AS {dst}, {other}, n, a, b FROM ({step})"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
bytes AS (SELECT doc_id, strlen(t) + 1 AS size, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST(('0x' || h) AS BIGINT)) AS bs FROM t),
tab AS (SELECT [{_crc_table()}]::BIGINT[] AS tab),
c AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(bs, lambda acc, b: xor(acc >> 8, tab[CAST((xor(acc, b) & 255) AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM bytes, tab),
o AS (SELECT *, row_number() OVER (ORDER BY ((coalesce(doc_id, -1) % {p} + {p}) % {p} * 40503 + text_crc32) % {_shard.BUCKETS}, doc_id NULLS FIRST, text_crc32, size) - 1 AS rn FROM c),
s AS (SELECT count(*) AS n, CAST(floor(sqrt(greatest(count(*) - 1, 0))) AS BIGINT) + 1 AS a FROM t),
walk AS (
  SELECT rn, rn AS cur, n, a, CAST(ceil(n / a) AS BIGINT) AS b, 0 AS depth FROM o, s
  UNION ALL
  SELECT rn, l * b + r, n, a, b, depth FROM (SELECT x.rn, x.l, x.r, x.n, x.a, x.b, w.depth + 1 AS depth FROM ({step.replace('FROM todo', 'FROM walk WHERE depth = 0 OR cur >= n')}) x JOIN walk w ON w.rn = x.rn)
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(cur % {count} AS INTEGER) AS shard, CAST(cur // {count} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM o JOIN (SELECT rn, arg_max(cur, depth) AS cur FROM walk GROUP BY rn) USING (rn)
"""
