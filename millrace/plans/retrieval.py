"""Text, vectors, retrieval (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import chunking, retrieval
from ..session import scratch_dir, stored
from .catalog import query
from .retrieval_sql import CENTROIDS_SQL
from .tables import table


def centroid_queries(spark, sf):
    """One query per label: the mean of its vectors."""
    return retrieval.centroids(table(spark, sf, "embeddings"), "label").withColumnRenamed("label", "query_id")


def document_hits(spark, sf, k):
    """Top ``k`` documents per query with text and source. Vectors without a document are not part of the corpus."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), "source")
    corpus = table(spark, sf, "embeddings").join(docs, "vec_id", "left_semi")
    hits = retrieval.search(corpus, centroid_queries(spark, sf), k)
    return hits.join(docs, "vec_id").withColumn("query_text", F.concat(F.lit("label "), "query_id"))


# The packing rule as a recursive query, one paragraph per step.
CHUNKS_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
f AS (
  SELECT doc_id, parts, 0 AS i, '' AS cur, 0 AS start, CAST(NULL AS VARCHAR) AS content, 0 AS start_idx FROM d
  UNION ALL
  SELECT doc_id, parts, i + 1,
    CASE WHEN cur = '' THEN parts[i + 1] WHEN length(cur) + length(parts[i + 1]) + 1 <= 512 THEN cur || chr(10) || parts[i + 1]
      WHEN length(cur) > 50 THEN right(cur, 50) || chr(10) || parts[i + 1] ELSE parts[i + 1] END,
    CASE WHEN cur <> '' AND length(cur) + length(parts[i + 1]) + 1 > 512 THEN start + length(cur) - CASE WHEN length(cur) > 50 THEN 50 ELSE 0 END ELSE start END,
    CASE WHEN cur <> '' AND length(cur) + length(parts[i + 1]) + 1 > 512 THEN cur END, start
  FROM f WHERE i < len(parts)),
chunks AS (
  SELECT doc_id, i, content, start_idx FROM f WHERE content IS NOT NULL
  UNION ALL SELECT doc_id, i + 1, cur, start FROM f WHERE i = len(parts) AND regexp_replace(cur, '[\s\p{Z}]', '', 'g') <> '')"""


@query("v1_chunks", CHUNKS_SQL + r"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, start_idx, start_idx + length(content) AS end_idx,
  regexp_replace(regexp_replace(content, '^[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', ''), '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+$', '') AS content FROM chunks""")
def v1_chunks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return chunking.chunk_documents(docs, separator="\n").select("doc_id", "chunk_index", "start_idx", "end_idx", "content")


@query("x6_chunk_table_function", CHUNKS_SQL + """
SELECT doc_id, count(*) AS chunks, CAST(max(start_idx + length(content)) AS BIGINT) AS last_end FROM chunks GROUP BY 1""")
def x6_chunk_table_function(spark, sf):
    chunking.register_chunk_text(spark)
    table(spark, sf, "documents").createOrReplaceTempView("chunk_source")
    return spark.sql("""SELECT doc_id, count(*) AS chunks, cast(max(end_idx) AS bigint) AS last_end
        FROM chunk_source, LATERAL chunk_text(text, 512, 50, '\n') GROUP BY doc_id""")


@query("v2_embeddings")
def v2_embeddings(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    out = retrieval.embed(docs, retrieval.fit_lexical_embedder(docs))
    return out.select("doc_id", F.size("embedding").alias("dim"), F.round(vectors.norm(F.col("embedding")), 4).alias("norm"))


@query("v2_model_embeddings", """WITH w AS (SELECT doc_id, md5(unnest(regexp_extract_all(text, '[a-z0-9]+'))) AS h FROM documents),
s AS (SELECT doc_id, """ + ", ".join(f"CAST(sum(CASE WHEN substr(h, {i + 1}, 1) >= '8' THEN 1 ELSE -1 END) AS DOUBLE) AS x{i}" for i in range(8)) + """ FROM w GROUP BY 1)
SELECT doc_id, """ + ", ".join(f"coalesce(x{i}, 0) AS x{i}" for i in range(8)) + """ FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN s USING (doc_id)""")
def v2_model_embeddings(spark, sf):
    """Batches of texts through a model that each worker loads once."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = retrieval.embed_with_model(docs, retrieval.model_embedder(retrieval.sign_projection(8)), "text")
    return out.select("doc_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(8)])


@query("v3_l2_normalize", """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id % 7)) AS v FROM embeddings)
SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS before, CAST(CASE WHEN vec_id % 7 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS after FROM s""")
def v3_l2_normalize(spark, sf):
    """Every seventh vector is the zero vector and stays zero."""
    scaled = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7)).alias("v"))
    return scaled.select("vec_id", F.round(vectors.norm(F.col("v")), 6).alias("before"),
                         F.round(vectors.norm(vectors.l2_normalize(F.col("v"))), 6).alias("after"))


@query("v4_exact_search", f"""WITH {CENTROIDS_SQL} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10""")
def v4_exact_search(spark, sf):
    hits = retrieval.search(table(spark, sf, "embeddings"), centroid_queries(spark, sf), 10)
    return hits.withColumn("score", F.round("score", 6))


def cells_of(spark, sf):
    """The table's index of k-means cells, saved and loaded again: rows, centres, radii."""
    celled, model = retrieval.build_cells(table(spark, sf, "embeddings"))
    path = scratch_dir(spark, "cells")
    retrieval.save_index(celled, path, model=model)
    return retrieval.load_index(spark, path), retrieval.load_centres(spark, path), retrieval.load_radii(spark, path)


@query("v5_cell_search")
def v5_cell_search(spark, sf):
    """Search over k-means cells until their radii rule the rest out: recall against the exact search, cells asked, recall of ten probes."""
    celled, centres, radii = cells_of(spark, sf)
    queries = centroid_queries(spark, sf)
    found, visited = retrieval.bounded_search(celled, centres, radii, queries, 10)
    exact = stored(retrieval.search(table(spark, sf, "embeddings"), queries, 10), "exact")
    probed = retrieval.recall(retrieval.probe_search(celled, centres, queries, 10), exact).withColumnRenamed("recall", "recall_10_probes")
    return retrieval.recall(found, exact).join(visited, "query_id").join(probed, "query_id")


@query("v5_bounded_search", f"""WITH {CENTROIDS_SQL} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10""")
def v5_bounded_search(spark, sf):
    """The hits of the cell search: those of the exact one."""
    celled, centres, radii = cells_of(spark, sf)
    found, _ = retrieval.bounded_search(celled, centres, radii, centroid_queries(spark, sf), 10)
    return found.withColumn("score", F.round("score", 6))


_OTHER_SQL = """cent AS (
  SELECT label AS query_id, list(m ORDER BY pos) AS q FROM (
    SELECT label, pos, CAST(sum(CAST(embedding[pos] AS DECIMAL(28,18))) AS DOUBLE) / count(*) AS m FROM embeddings, range(1, 65) t(pos) GROUP BY 1, 2) GROUP BY label),
scored AS (SELECT query_id, vec_id, label, list_distance(CAST(embedding AS DOUBLE[]), q) AS dist, list_dot_product(CAST(embedding AS DOUBLE[]), q) AS dot FROM embeddings CROSS JOIN cent)"""


@query("v6_euclidean_search", f"""WITH {_OTHER_SQL} SELECT query_id, vec_id, rank, round(-dist, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM scored) WHERE rank <= 5""")
def v6_euclidean_search(spark, sf):
    return retrieval.search(table(spark, sf, "embeddings"), centroid_queries(spark, sf), 5, metric="euclidean").withColumn("score", F.round("score", 6))


@query("v6_dot_search", f"""WITH {_OTHER_SQL} SELECT query_id, vec_id, rank, round(dot, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, vec_id) AS rank FROM scored) WHERE rank <= 5""")
def v6_dot_search(spark, sf):
    return retrieval.search(table(spark, sf, "embeddings"), centroid_queries(spark, sf), 5, metric="dot").withColumn("score", F.round("score", 6))


@query("v6_filtered_search", f"""WITH {CENTROIDS_SQL} SELECT query_id, vec_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored WHERE label = (query_id + 1) % 10) WHERE rank <= 5""")
def v6_filtered_search(spark, sf):
    """Each query may only find vectors of the next label."""
    queries = centroid_queries(spark, sf).withColumn("label", ((F.col("query_id") + 1) % 10).cast("int"))
    return retrieval.search(table(spark, sf, "embeddings"), queries, 5, filter_on="label").select("query_id", "vec_id", "rank")


@query("v7_document_ingest", CHUNKS_SQL + " SELECT doc_id, count(*) AS chunks, true AS all_unit FROM chunks GROUP BY 1")
def v7_document_ingest(spark, sf):
    """documents -> chunks -> embeddings -> cells -> stored index, read back."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), "source")
    embedded = retrieval.embed_corpus(chunking.chunk_documents(docs, separator="\n"))
    celled, _ = retrieval.build_cells(stored(embedded, "embedded"))
    path = scratch_dir(spark, "index")
    retrieval.save_index(celled, path)
    length = vectors.norm(F.col("embedding"))
    # A chunk without a single word has the zero vector.
    unit = (F.abs(length - 1) < 1e-3) | (length == 0)
    return retrieval.load_index(spark, path).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.bool_and(unit).alias("all_unit"))


_HITS_SQL = """h AS (SELECT query_id, vec_id, score, text, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored JOIN documents ON vec_id = doc_id)"""


@query("v8_prompts", f"""WITH {CENTROIDS_SQL}, {_HITS_SQL}, u AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h WHERE rank <= 5)
SELECT query_id, 'label ' || query_id AS query_text, 'You are a helpful assistant. Answer the user''s question based on the provided context.' || chr(10) || 'If the context doesn''t contain relevant information, say so.'
  || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || string_agg('[Source: ' || source || ']' || chr(10) || substring(text, 1, 2000 - CAST(used AS BIGINT)), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)
  || chr(10) || chr(10) || 'USER QUESTION: label ' || query_id || chr(10) || chr(10) || 'ANSWER:' AS prompt FROM u WHERE used < 2000 GROUP BY query_id""")
def v8_prompts(spark, sf):
    return retrieval.build_prompts(document_hits(spark, sf, 5))


@query("v8_template_answers", f"""WITH {CENTROIDS_SQL}, {_HITS_SQL} SELECT query_id, 'label ' || query_id AS query_text, 'Based on the knowledge base, here''s what I found about ''label ' || query_id || ''':' || chr(10) || chr(10)
  || string_agg('**Finding ' || rank || '** (Score: ' || format('{{:.2f}}', score) || ', Source: ' || source || ')' || chr(10) || substring(text, 1, 300) || '...' || chr(10) || chr(10), '' ORDER BY rank) AS answer
  FROM h WHERE rank <= 3 GROUP BY query_id""")
def v8_template_answers(spark, sf):
    return retrieval.template_answers(document_hits(spark, sf, 3))


@query("v9_result_records", f"""WITH {CENTROIDS_SQL}, {_HITS_SQL} SELECT query_id, string_agg(vec_id || ':' || source, ',' ORDER BY rank) AS results, count(*) AS total_results FROM h WHERE rank <= 5 GROUP BY 1""")
def v9_result_records(spark, sf):
    """At most ``k`` hits per query are collected into the record."""
    records = document_hits(spark, sf, 5).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "vec_id", "source", "score"))).alias("results"), F.count("*").alias("total_results"))
    return records.withColumn("results", F.array_join(F.transform("results", lambda r: F.concat_ws(":", r["vec_id"].cast("string"), r["source"])), ","))
