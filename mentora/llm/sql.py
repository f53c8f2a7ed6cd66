"""DuckDB SQL of the clustering, phrase and repeat queries."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def centroid_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Whole rounds of Lloyd's algorithm, one pair of tables each."""
    steps = [f"""rows AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
cells AS MATERIALIZED (SELECT row, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM rows),
c0 AS MATERIALIZED (
  SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM rows) WHERE c < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT row, min(struct_pack(d := d, c := c)) AS a FROM (
    SELECT row, c, CAST(sum((cells.v - c{r}.v) * (cells.v - c{r}.v)) AS BIGINT) AS d FROM cells JOIN c{r} USING (i) GROUP BY row, c) GROUP BY row)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c, i, CASE WHEN n IS NULL THEN v ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS v FROM c{r} LEFT JOIN (
    SELECT a.c AS c, i, sum(v) AS s, count(*) AS n FROM cells JOIN a{r} USING (row) GROUP BY ALL) USING (c, i))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS "cluster", a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM rows JOIN a{rounds} USING (row) JOIN (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) AS h ON h.c = a.c"""


CENTROID_SQL = centroid_sql()

PHRASE_SQL = rf"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, unnest(string_split_regex({LOWER.format("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM lists
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS a FROM runs GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM candidates, range(1, 3) AS t(k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, c.a, min(struct_pack(score := CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT), k := k, l := x.a, r := y.a)) AS b
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp GROUP BY ALL),
inner_ones AS (
  SELECT lang, phrase, max(longer) AS longer FROM (
    SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a AS longer FROM candidates WHERE size = 3) GROUP BY ALL),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY b.score DESC, a DESC, s.phrase) AS rank, s.phrase, a, b.l AS l, b.r AS r, b.score AS score
  FROM scored s LEFT JOIN inner_ones i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

REPEAT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT row, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
windows AS MATERIALIZED (SELECT row, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM places),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT row, i + k AS i FROM windows JOIN again USING (h), range(0, 35) AS t(k)),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (row, i) GROUP BY row),
removed AS (SELECT row, count(*) AS n FROM gone GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(text, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (row) LEFT JOIN kept USING (row)
"""
