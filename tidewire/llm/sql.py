"""DuckDB SQL of the corpus queries that SQL can express and that is long or repetitive."""

from __future__ import annotations

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = (
    r"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all("""
    + _LOW.format("coalesce(text, '')")
    + r""", '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
    SELECT r, doc_id, list_sort(list_distinct(
        CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
    FROM docs),
classes AS MATERIALIZED (SELECT row_number() OVER () AS c, s, len(s) AS n, min(doc_id) AS first FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS MATERIALIZED (SELECT c, n, unnest(s) AS g FROM classes),
common AS (
    SELECT a.c AS a, b.c AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS k
    FROM grams a JOIN grams b USING (g) WHERE a.c < b.c GROUP BY a.c, b.c),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * k >= 85 * (n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
roots AS (SELECT reach.a AS c, min(first) AS component FROM reach JOIN classes ON classes.c = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component END AS component_id,
    doc_id IS NOT DISTINCT FROM CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component END AS kept
FROM sets LEFT JOIN classes USING (s) LEFT JOIN roots USING (c)
"""
)


def _features(table: str) -> str:
    """Rows (r, g): every run of one to three words of every text of a table."""
    low = _LOW.format("text")
    return rf"""
    SELECT r, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, greatest(len(w) - k + 2, 1)),
        lambda i: array_to_string(w[i : i + k - 1], ' '))))) AS g
    FROM (SELECT r, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table} WHERE text IS NOT NULL)"""


OP12 = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
wanted AS (SELECT row_number() OVER () AS r, text FROM benchmark),
source AS MATERIALIZED ({_features("docs")}),
target AS MATERIALIZED ({_features("wanted")}),
crc_table AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
codes AS MATERIALIZED (
    SELECT g, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)),
        lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 10000 AS b
    FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM source UNION SELECT g FROM target)), crc_table),
s AS (SELECT b, count(*) AS n FROM source JOIN codes USING (g) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM target JOIN codes USING (g) GROUP BY b),
gains AS MATERIALIZED (
    SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM source) + 10000)::DOUBLE
        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM target) + 10000)::DOUBLE))) AS BIGINT) AS gain
    FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
weights AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM source JOIN codes USING (g) JOIN gains USING (b) GROUP BY r),
scored AS MATERIALIZED (
    SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE)
            / 4294967296))) AS BIGINT) AS score,
        n >= 57 AS able -- a text of w words has 3 * w - 3 features, from two words up
    FROM docs LEFT JOIN weights USING (r)),
ranks AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE able)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM ranks) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranks USING (r)
"""


def _round(i: int) -> str:
    """Nearest centroids `near{i}` by the centroids `cent{i}`, and the centroids after that."""
    return f""",
dist{i} AS (SELECT r, c, sum((k.x - m.x) * (k.x - m.x)) AS dist FROM parts k JOIN cent{i} m USING (d) GROUP BY r, c),
near{i} AS MATERIALIZED (SELECT r, c, dist FROM dist{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, c) = 1),
sum{i} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM near{i} JOIN parts USING (r) GROUP BY c, d),
cent{i + 1} AS MATERIALIZED (
    SELECT c, d, CASE WHEN n IS NULL THEN x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x
    FROM cent{i} LEFT JOIN sum{i} USING (c, d))"""


OP13 = (
    """
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS MATERIALIZED (SELECT r, unnest(range(64)) AS d, unnest(v) AS x FROM kept),
first AS (
    SELECT r, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM kept QUALIFY c < 16),
cent0 AS MATERIALIZED (SELECT c, d, x FROM first JOIN parts USING (r))"""
    + "".join(_round(i) for i in range(4))
    + """,
inertias AS (SELECT c, CAST(sum(dist) AS BIGINT) AS cluster_inertia FROM near3 GROUP BY c),
digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM cent3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, cluster_inertia,
    CAST((SELECT sum(dist) FROM near3) AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN near3 USING (r) JOIN inertias USING (c) JOIN digests USING (c)
"""
)
