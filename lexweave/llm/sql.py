"""DuckDB SQL for the queries that SQL can express, over whole tables."""

OP6_MIXING = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(md5(text), ''))), 1, 15))::BIGINT AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM s
), r AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place,
         coalesce(sum(2.0 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM w
), lv AS (
  SELECT *, (1.5 * (SELECT sum(source_size) FROM s) - full_before)::DOUBLE / ((SELECT sum(weight) FROM w) - weight_before) AS level FROM r
), t AS (
  SELECT source, source_size, CASE WHEN 2.0 * source_size <= l.level * weight THEN (2.0 * source_size)::DOUBLE ELSE l.level * weight END AS target
  FROM w, (SELECT arg_min(level, place) AS level FROM lv WHERE level * weight < 2.0 * source_size) AS l
), b AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs, floor(target)::BIGINT AS words FROM t
), p AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(size) OVER (PARTITION BY source, key) AS here
  FROM d
)
SELECT p.doc_id, p.size, b.source_size, b.target,
       (b.epochs * p.size + CASE WHEN before > words - epochs * source_size THEN 0
          WHEN before + here <= words - epochs * source_size THEN p.size
          ELSE floor((words - epochs * source_size - before) * p.size / here) END)::BIGINT AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""

OP8_TOP_K = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The rounds of codebooks, one after another: n has the parts of the vectors, e0 the first entries, d and e those of each round."""
    near = """
d{r} AS MATERIALIZED (
  SELECT n.row, n.part, min(list_sum(list_transform(list_zip(n.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 256 + e.entry) AS best
  FROM n JOIN e{r} AS e ON n.part = e.part GROUP BY n.row, n.part
)"""
    means = """
s{r} AS (
  SELECT d.part, d.best % 256 AS entry, i.i, sum(n.v[i.i])::BIGINT AS s, count(*) AS c
  FROM d{r} AS d JOIN n ON d.row = n.row AND d.part = n.part, range(1, (SELECT max(len(v)) FROM n) + 1) AS i(i) GROUP BY ALL
), e{q} AS MATERIALIZED (
  SELECT e.part, e.entry, coalesce(m.v, e.v) AS v FROM e{r} AS e
  LEFT JOIN (SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY i) AS v FROM s{r} GROUP BY part, entry) AS m ON e.part = m.part AND e.entry = m.entry
)"""
    steps = [near.format(r=r) + "," + means.format(r=r, q=r + 1) for r in range(rounds)] + [near.format(r=rounds)]
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, label) AS row, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS MATERIALIZED (
  SELECT row, p.p AS part, v[p.p * (len(v) // {parts}) + 1 : (p.p + 1) * (len(v) // {parts})] AS v FROM k, range({parts}) AS p(p)
), e0 AS MATERIALIZED (
  SELECT n.part, f.entry, n.v FROM n JOIN (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}) AS f ON n.row = f.row
),{",".join(steps)}, c AS (
  SELECT row, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM d{rounds} GROUP BY row
)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM e{rounds}) AS codebooks_sha256
FROM k JOIN c ON k.row = c.row
"""


OP11_VECTOR_CODES = vector_codes()
