"""SQL for the text operators that SQL can state."""

LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents
), windows AS (
  SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS w
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS pos FROM lines WHERE len(l) >= 3)
), placed AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth
  FROM windows WHERE length(trim(replace(w, chr(10), ''))) > 0
), gone AS (
  SELECT doc_id, list(DISTINCT pos + k) AS g FROM placed, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1 GROUP BY doc_id
)
SELECT doc_id,
  CASE WHEN g IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(g, i - 1)), chr(10)) END AS text,
  CAST(len(l) AS BIGINT) AS n_lines,
  CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed
FROM lines LEFT JOIN gone USING (doc_id)
"""

URL_FILTERS = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), fits AS (
  SELECT *, '.' || host AS h FROM parts
)
SELECT page_id, host, path,
  CASE WHEN h LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
       WHEN h LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
       WHEN h LIKE '%.org' AND path LIKE '/%' THEN 'org/'
       WHEN h LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
       WHEN h LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/' END AS rule,
  CASE WHEN h LIKE '%.example.org' AND (path LIKE '/es/%' OR path LIKE '/en/1%') OR h LIKE '%.com' AND path LIKE '/de/%'
       THEN 'block' ELSE 'allow' END AS verdict
FROM fits
"""



def centroid_clusters(rounds: int) -> str:
    """K-means round by round: nearest by (distance, number), then the mean rounded down."""
    nearest = """SELECT vec_id, row, e, min_by(k, (d, k)) AS k, min(d) AS d FROM (
  SELECT v.vec_id, v.row, v.e, c.k, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.c[i]) * (v.e[i] - c.c[i]))) AS d
  FROM v, c{n} AS c) GROUP BY vec_id, row, e"""
    moved = """SELECT c.k, coalesce(m.c, c.c) AS c FROM c{n} AS c LEFT JOIN (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c
  FROM (SELECT k, p, sum(e[p]) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{n}, (SELECT unnest(range(1, 65)) AS p) GROUP BY k, p)
  GROUP BY k) AS m ON c.k = m.k"""
    tables = [
        """v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS k, e AS c
  FROM (SELECT e, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h, e LIMIT 8))""",
    ]
    for n in range(rounds):
        tables += [f"a{n} AS MATERIALIZED ({nearest.format(n=n)})", f"c{n + 1} AS MATERIALIZED ({moved.format(n=n)})"]
    tables.append(f"last AS MATERIALIZED ({nearest.format(n=rounds)})")
    return (
        "WITH "
        + ",\n".join(tables)
        + f"""
SELECT last.vec_id, CAST(last.k AS INTEGER) AS cluster, CAST(last.d AS BIGINT) AS distance,
  CAST(sum(last.d) OVER (PARTITION BY last.k) AS BIGINT) AS cluster_inertia, CAST(sum(last.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.c, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM last JOIN c{rounds} AS c ON last.k = c.k
"""
    )


JACCARD_JOIN = r"""
WITH RECURSIVE split AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS node, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, node, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM split
), items AS MATERIALIZED (
  SELECT node, len(s) AS n, unnest(s) AS e FROM sets
), shared AS MATERIALIZED (
  SELECT * FROM items WHERE e IN (SELECT e FROM items GROUP BY e HAVING count(*) > 1)
), pairs AS MATERIALIZED (
  SELECT a.node AS u, b.node AS v FROM shared AS a JOIN shared AS b ON a.e = b.e AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT node, node AS other FROM sets UNION SELECT reach.node, v FROM reach JOIN pairs ON other = u
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT reach.node, min(doc_id) AS component_id FROM reach JOIN sets ON other = sets.node GROUP BY reach.node) AS c ON c.node = sets.node
"""

ORACLES = {
    "op3_line_dedup": LINE_DEDUP,
    "op10_url_filters": URL_FILTERS,
    "op12_centroid_clustering": centroid_clusters(10),
    "op13_ngram_jaccard_join": JACCARD_JOIN,
}
