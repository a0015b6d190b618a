"""DuckDB SQL for the training-data queries that SQL can express."""

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP1 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))] ELSE list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i : i + 4], ' '))) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1),
o AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT *, doc_id = component_id AS kept FROM o
"""

OP3 = rf"""
WITH d AS (
  SELECT doc_id, source, {WORDS}::BIGINT AS size,
         (('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
w AS (SELECT doc_id, CASE WHEN max(quality) = 1 THEN 1.0 ELSE 0.25 END::DOUBLE AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
k AS (SELECT d.doc_id, source, size, coalesce(weight, 0.5)::DOUBLE AS weight, -ln(u) / coalesce(weight, 0.5)::DOUBLE AS key FROM d LEFT JOIN w USING (doc_id)),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS wt
  FROM k GROUP BY source),
c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
           - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size / wt, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY source_size / wt, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM s),
l AS (SELECT min(left_over / left_weight) FILTER (WHERE cap > left_over / left_weight * wt) AS least, arg_min(left_over / left_weight, source_size / wt) FILTER (WHERE cap > left_over / left_weight * wt) AS water FROM c),
t AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * wt) END AS target FROM c, l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
         floor(target + 0.5)::BIGINT - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size AS rest
  FROM t)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - (sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size))))::BIGINT AS taken,
       k.source AS source, weight
FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id AND len(q.v) = len(r.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_POLYNOMIAL = 0xEDB88320
_SEGMENT = 192


def _zeros(register: int, octets: int) -> int:
    """The CRC register after so many zero bytes."""
    for _ in range(8 * octets):
        register = register >> 1 ^ _POLYNOMIAL * (register & 1)
    return register


def _prefix() -> str:
    """Hex of the 4 bytes that take the register from 0 to all ones: run the register backwards over 32 bits."""
    register = 0xFFFFFFFF
    for _ in range(32):
        high = register >> 31
        register = ((register ^ _POLYNOMIAL * high) << 1 | high) & 0xFFFFFFFF
    return register.to_bytes(4, "little").hex().upper()


def crc32_ctes(source: str, key: str, text: str) -> str:
    """CTEs that end in crc(key, value): CRC-32 of the text column of source, a relation with unique keys.

    CRC is linear, so segments of _SEGMENT bytes fold side by side from 0 (leading zeros don't count), half a
    byte a step (the polynomial's low 5 bits are 0, so 4 steps never feed back), and then join by the fixed linear map of _SEGMENT zero bytes."""
    step = "xor(a, b) >> 4"
    for bit in range(4):
        step = f"xor({step}, ((xor(a, b) >> {bit}) & 1) * {_POLYNOMIAL >> 3 - bit}::UBIGINT)"
    join = "b"
    for bit in range(32):
        join = f"xor({join}, ((a >> {bit}) & 1) * {_zeros(1 << bit, _SEGMENT)}::UBIGINT)"
    n = 2 * _SEGMENT
    return f"""
crc_hex AS (SELECT {key} AS k, '{_prefix()}' || hex(encode({text})) AS h FROM {source}),
crc_padded AS (SELECT k, repeat('0', (({n} - length(h) % {n}) % {n})::INT) || h AS h FROM crc_hex),
crc_cut AS (SELECT k, unnest(range(length(h) // {n})) AS i, h FROM crc_padded),
crc_digits AS (SELECT k, i, substr(h, i * {n} + 1, {n}) AS h FROM crc_cut),
crc_part AS (
  SELECT k, i, list_reduce(list_transform(range({n}), lambda j: ('0x' || substr(h, j + 1 + CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END, 1))::UBIGINT), lambda a, b: {step}, 0::UBIGINT) AS v
  FROM crc_digits),
crc_parts AS (SELECT k, list(v ORDER BY i) AS v FROM crc_part GROUP BY k),
crc AS (SELECT k AS key, xor(list_reduce(v, lambda a, b: {join}, 0::UBIGINT), 4294967295::UBIGINT)::BIGINT AS value FROM crc_parts)"""


OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS x FROM documents),
{crc32_ctes("d", "n", "x")},
c AS (SELECT doc_id, (octet_length(encode(x)) + 16)::BIGINT AS size, value AS text_crc32 FROM d JOIN crc ON n = key),
o AS (SELECT *, row_number() OVER w AS nth, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total
      FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)),
p AS (SELECT *, least(39, ((2 * upto - size) * 40) // (2 * total))::INT AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (nth - min(nth) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM p
"""


BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT n, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT k.*, last IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY n, doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1, "op3_mixing": OP3, "op4_exact_topk": OP4, "op9_sharding": OP9, "op13_line_dedup": OP13}
