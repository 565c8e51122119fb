"""SQL of the similarity scores, shared by several oracles."""

CENTROIDS_SQL = """cent AS (
  SELECT label AS query_id, list(m ORDER BY pos) AS q FROM (
    SELECT label, pos, CAST(sum(CAST(embedding[pos] AS DECIMAL(28,18))) AS DOUBLE) / count(*) AS m
    FROM embeddings, range(1, 65) t(pos) GROUP BY 1, 2) GROUP BY label),
scored AS (
  SELECT query_id, vec_id, label, list_dot_product(CAST(embedding AS DOUBLE[]), q) / sqrt(list_dot_product(q, q))
    / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS score FROM embeddings CROSS JOIN cent)"""
