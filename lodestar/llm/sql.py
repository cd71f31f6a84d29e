"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Brute force: every aligned pair of equal tokens, counted in spans of 13.
DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark),
dw AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS p FROM d),
bw AS (SELECT item_id, len(t) AS n, unnest(t) AS w, unnest(range(len(t))) AS p FROM b),
m AS (SELECT doc_id, item_id, n, dw.p - bw.p AS shift, dw.p AS p FROM dw JOIN bw USING (w)),
c AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k FROM m)
SELECT doc_id, item_id, max(k) AS n_matched FROM c WHERE k >= CASE WHEN n >= 13 THEN 11 ELSE n END GROUP BY doc_id, item_id
"""

TOP_K = r"""
WITH v AS (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (
    SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.n <> c.n
),
r AS (SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

def mixing(weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 11, rounds: int = 3) -> str:
    """Plain windows over whole sources where the operator cuts by ranges of the rank."""
    u = f"(CAST('0x' || substr(md5('mix:{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0"
    weight = " ".join(f"WHEN {i} THEN {w}.0" for i, w in enumerate(weights))
    whole = "floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)"
    out = f"""
WITH m AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, {u} AS u FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM m GROUP BY source),
b AS (SELECT *, {most} * source_size AS most, CASE sid % {len(weights)} {weight} END AS w FROM a),
c AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY most / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b),
l AS (SELECT min_by(level, most / w) AS level FROM c WHERE level <= most / w),
t AS (SELECT source, sid, source_size, least(most, w * l.level) AS target FROM b, l),
s AS (SELECT *, {whole} AS whole, target - {whole} * source_size AS need FROM t),
d AS (SELECT m.*, sid, need FROM m JOIN s ON m.source IS NOT DISTINCT FROM s.source),
n AS (SELECT sid, size, need, count(*) AS n FROM d WHERE size > 0 AND need > 0 GROUP BY sid, size, need),
f AS (SELECT sid, size, (need - coalesce(sum(n * size) OVER (PARTITION BY sid ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(n * size * sqrt(size)) OVER (PARTITION BY sid ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scale FROM n),
p AS (SELECT sid, max_by(scale, size) AS scale FROM f WHERE scale * sqrt(size) <= 1 GROUP BY sid),
q AS (SELECT d.doc_id, d.sid, d.size, d.need, d.u, least(scale * sqrt(size), 1.0) AS p FROM d JOIN p USING (sid) WHERE size > 0 AND scale > 0),
x0 AS (SELECT sid, doc_id, size FROM q WHERE p >= 1),
r0 AS (SELECT *, u * (1 - p) / (u * (1 - p) + (1 - u) * p) AS r FROM q WHERE p < 1),
g0 AS (SELECT sid, need - coalesce(sum(x.size), 0) AS goal FROM (SELECT DISTINCT sid, need FROM q) LEFT JOIN x0 x USING (sid) GROUP BY sid, need)"""
    for k in range(rounds):
        last = k == rounds - 1
        out += f""",
o{k} AS (SELECT r{k}.*, goal, sum(size) OVER (PARTITION BY sid, r) AS tie, sum(size) OVER (PARTITION BY sid ORDER BY r) AS upto FROM r{k} JOIN g{k} USING (sid) WHERE size <= {2.0 if last else 1.0} * goal),
x{k + 1} AS (SELECT sid, doc_id, size FROM o{k} WHERE upto - tie + {0.5 if last else 1.0} * tie <= goal),
r{k + 1} AS (SELECT * FROM r{k} WHERE NOT EXISTS (SELECT 1 FROM x{k + 1} x WHERE x.sid = r{k}.sid AND x.doc_id IS NOT DISTINCT FROM r{k}.doc_id AND x.size = r{k}.size)),
g{k + 1} AS (SELECT sid, goal - coalesce(sum(x.size), 0) AS goal FROM g{k} LEFT JOIN x{k + 1} x USING (sid) GROUP BY sid, goal)"""
    union = " UNION ALL ".join(f"SELECT DISTINCT doc_id, sid, size FROM x{k}" for k in range(rounds + 1))
    return out + f""",
x AS ({union})
SELECT d.doc_id, d.size, s.source_size, s.target, CAST((s.whole + CASE WHEN x.sid IS NULL THEN 0 ELSE 1 END) * d.size AS BIGINT) AS taken, CAST(s.whole + CASE WHEN x.sid IS NULL THEN 0 ELSE 1 END AS BIGINT) AS copies
FROM d JOIN s USING (sid) LEFT JOIN x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.sid = x.sid AND d.size = x.size
"""


GROUP_RANKS = r"""
WITH ids AS (
    SELECT sale_id, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) AS crc
    FROM (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL)
),
l AS (
    SELECT s.*, coalesce(xor(crc, 4294967295) % 5 = 0, FALSE) AS alone FROM sale_lines s LEFT JOIN ids USING (sale_id)
),
k AS (
    SELECT CASE WHEN alone THEN -1 ELSE vendor_id END AS vendor_id, CASE WHEN alone THEN -1 ELSE coalesce(item_id % 10, -1) END AS part,
        CASE WHEN alone THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS month,
        CAST(floor(quantity / 10) AS BIGINT) AS tens, CAST(floor(100 * discount + 0.5) AS BIGINT) AS percent,
        sale_id, CAST(line_no AS BIGINT) AS line_no, CAST(quantity AS BIGINT) AS quantity, CAST(floor(100 * amount + 0.5) AS BIGINT) AS amount_cents
    FROM l
),
r AS (
    SELECT *, rank() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent NULLS FIRST) AS place,
        row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent NULLS FIRST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
        count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied
    FROM k
)
SELECT CAST(vendor_id AS BIGINT) AS vendor_id, CAST(part AS BIGINT) AS part, CAST(month AS BIGINT) AS month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied FROM r WHERE place <= 3
"""

ORACLES: dict[str, str] = {"op3_norm_buckets": TOP_K, "op4_mixing": mixing(), "op9_decontaminate": DECONTAMINATE, "op12_group_ranks": GROUP_RANKS}
