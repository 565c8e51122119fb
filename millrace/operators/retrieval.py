"""Vector index tables, exact and cell-pruned similarity search, prompt assembly.

A search is a join of blocks: index rows and queries are dealt by hash into groups of bounded bytes, and each pair of groups is a tile
with a task of its own, one matrix product at a time. A tile gives at most ``k`` hits per query, so only those are merged by Spark.
Neither side passes through the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .ordered import top_per_group

TILE_BYTES = 16 << 20  # vectors of one side of a tile
MAX_SCORES = 4_000_000  # scores held at once by a task
TOP_K = 10
# Cells of the approximate index and cells probed per query.
NLIST = 128
NPROBE = 10
#: Rows that fit the cell centres, 512 for each of ``NLIST`` cells: tables up to this size are fitted whole. Every row is put into a cell.
FIT_ROWS = 512 * NLIST


def save_index(df: DataFrame, path: str, mode: str = "overwrite", model=None, metric: str = "cosine") -> None:
    """One Parquet table partitioned by cell; vectors and chunk metadata stay together.

    With the fitted ``model`` its centres, the metric and the dimension are stored beside the rows, so a reload can probe.
    """
    df.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(path)
    if model is not None:
        radii = cell_radii(df, np.array(model.clusterCenters()))
        centres = [(i, [float(x) for x in c], float(radii[i]), metric, len(c)) for i, c in enumerate(model.clusterCenters())]
        kind = "cell int, centre array<double>, radius double, metric string, dim int"
        df.sparkSession.createDataFrame(centres, kind).write.mode(mode).parquet(f"{path}/_centres")


def load_index(spark: SparkSession, path: str, cells: Sequence[int] | None = None) -> DataFrame:
    index = spark.read.parquet(path)
    return index.filter(F.col("cell").isin([int(c) for c in cells])) if cells is not None else index


def load_centres(spark: SparkSession, path: str) -> np.ndarray:
    """The stored centres, one row per cell: as many as the index was built with."""
    rows = spark.read.parquet(f"{path}/_centres").orderBy("cell").collect()
    if any(r["metric"] != "cosine" or r["dim"] != len(r["centre"]) for r in rows):
        raise ValueError(f"index at {path} cannot be probed by cosine")
    return np.array([r["centre"] for r in rows])


def load_radii(spark: SparkSession, path: str) -> np.ndarray:
    """The greatest angle between a cell's centre and its vectors, one per cell."""
    return np.array([r["radius"] for r in spark.read.parquet(f"{path}/_centres").orderBy("cell").collect()])


def _tiles(index: DataFrame, queries: DataFrame, score, schema: str, item_id: str, query_id: str, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """``score(index frame, query frame)`` for every pair of groups, within equal ``keys``."""
    spark = index.sparkSession
    n, width = index.agg(F.count("*"), F.max(F.size(vector))).first()
    q, distinct = queries.agg(F.count("*"), F.countDistinct(query_id, *keys)).first()
    if q == 0:
        raise ValueError("no queries")
    if q != distinct:
        raise ValueError("query ids must be unique")
    rows = max(1, TILE_BYTES // (8 * max(1, width or 1)))
    index_groups, query_groups = max(1, -(-n // rows)), max(1, -(-q // rows))

    def dealt(df, row_id, mine, groups, theirs, others):
        return df.withColumn(mine, F.pmod(F.xxhash64(row_id), F.lit(groups)).cast("int")).withColumn(
            theirs, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    tile = [*keys, "_ig", "_qg"]
    left = dealt(index, item_id, "_ig", index_groups, "_qg", query_groups)
    right = dealt(queries, query_id, "_qg", query_groups, "_ig", index_groups)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def both(items: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if items.empty or asked.empty:
            return pd.DataFrame()
        return score(items, asked)

    return left.repartition(parts, *tile).groupBy(*tile).cogroup(right.repartition(parts, *tile).groupBy(*tile)).applyInPandas(both, schema)


def _stack(frame: pd.DataFrame, vector: str) -> np.ndarray:
    return np.stack(frame[vector].to_numpy()).astype(np.float64)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(lengths == 0, 1.0, lengths)


def _similarity(metric: str, index: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(rows, queries) scores, larger is nearer."""
    if metric == "cosine":
        return _unit_rows(index) @ _unit_rows(queries).T
    if metric == "dot":
        return index @ queries.T
    if metric == "euclidean":
        squares = (index * index).sum(axis=1)[:, None] + (queries * queries).sum(axis=1)[None, :] - 2 * index @ queries.T
        return -np.sqrt(np.maximum(squares, 0.0))
    raise ValueError(f"unknown metric: {metric}")


def _row_blocks(batch: pd.DataFrame, queries: int) -> Iterator[pd.DataFrame]:
    """Pieces of a batch whose score matrix stays within ``MAX_SCORES``."""
    step = max(1, MAX_SCORES // max(1, queries))
    for start in range(0, len(batch), step):
        yield batch.iloc[start:start + step]


def _best_per_query(best: pd.DataFrame | None, scores: np.ndarray, items: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """Running top ``k`` per query. Everything at or above the k-th score is kept until ties are settled by id."""
    scores = np.where(np.isfinite(scores), scores, -np.inf)  # NaN must not take the place of a hit
    if len(items) > k:
        floor = np.partition(scores, len(items) - k, axis=0)[len(items) - k]
        rows, cols = np.nonzero((scores >= floor[None, :]) & np.isfinite(scores))
    else:
        rows, cols = np.nonzero(np.isfinite(scores))
    found = pd.DataFrame({"q": ids[cols], "i": items[rows], "s": scores[rows, cols]})
    merged = found if best is None else pd.concat([best, found])
    return merged.sort_values(["s", "i"], ascending=[False, True]).groupby("q", sort=False).head(k)


def _ranked_hits(hits: DataFrame, item_id: str, query_id: str, k: int) -> DataFrame:
    ranked = top_per_group(hits, ["q"], [F.desc("s"), F.asc("i")], k, rank="rank")
    return ranked.select(F.col("q").alias(query_id), F.col("i").alias(item_id), F.col("s").alias("score"), "rank")


def search(index: DataFrame, queries: DataFrame, k: int = TOP_K, metric: str = "cosine", item_id: str = "vec_id",
           query_id: str = "query_id", vector: str = "embedding", filter_on: str | None = None) -> DataFrame:
    """Exact top ``k`` per query: ``query_id, item_id, score, rank``. Score ties go to the smaller id.

    ``filter_on`` names a column of both sides: a hit must carry the query's value (metadata filter before ranking).
    """
    extra = [filter_on] if filter_on else []
    item_type, query_type = index.schema[item_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()

    def score(items: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        matrix, ids, best = _stack(asked, vector), asked[query_id].to_numpy(), None
        for rows in _row_blocks(items, len(ids)):
            scores = _similarity(metric, _stack(rows, vector), matrix)
            if filter_on:
                scores = np.where(rows[filter_on].to_numpy()[:, None] == asked[filter_on].to_numpy()[None, :], scores, -np.inf)
            best = _best_per_query(best, scores, rows[item_id].to_numpy(), ids, k)
        return best

    hits = _tiles(index.select(item_id, vector, *extra), queries.select(query_id, vector, *extra), score,
                  f"q {query_type}, i {item_type}, s double", item_id, query_id, vector)
    return _ranked_hits(hits, item_id, query_id, k)


def nearest_query(index: DataFrame, queries: DataFrame, item_id: str = "vec_id", query_id: str = "query_id",
                  vector: str = "embedding") -> DataFrame:
    """For each index row the most similar query, a row out per row in. Ties go to the smaller query."""
    item_type, query_type = index.schema[item_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()

    def score(items: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        asked = asked.sort_values(query_id)
        matrix, ids, out = _stack(asked, vector), asked[query_id].to_numpy(), []
        for rows in _row_blocks(items, len(ids)):
            scores = _similarity("cosine", _stack(rows, vector), matrix)
            top = scores.argmax(axis=1)
            out.append(pd.DataFrame({"i": rows[item_id].to_numpy(), "q": ids[top], "s": scores[np.arange(len(top)), top]}))
        return pd.concat(out)

    found = _tiles(index.select(item_id, vector), queries.select(query_id, vector), score, f"i {item_type}, q {query_type}, s double",
                   item_id, query_id, vector)
    best = top_per_group(found, ["i"], [F.desc("s"), F.asc("q")], 1)
    return best.select(F.col("i").alias(item_id), F.col("q").alias(query_id), F.col("s").alias("score"))


def centroids(index: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per group, from partial vector sums."""
    mean = Summarizer.metrics("mean").summary(array_to_vector(vector))["mean"]
    return index.groupBy(group).agg(vector_to_array(mean).alias(vector))


# ---------------------------------------------------------------- approximate search

def build_cells(index: DataFrame, nlist: int = NLIST, vector: str = "embedding", seed: int = 42, fit_rows: int = FIT_ROWS):
    """Index rows with their k-means cell, and the fitted model (its centres are ``nlist`` vectors).

    Of more than ``fit_rows`` rows, a random sample of about that many fits the centres: the twenty passes of the fit are over bounded data.
    """
    rows = index.count()
    raw = index.withColumn("_raw", array_to_vector(vector))
    prepared = Normalizer(inputCol="_raw", outputCol="_v", p=2.0).transform(raw)
    model = KMeans(k=nlist, seed=seed, featuresCol="_v", predictionCol="cell", maxIter=20).fit(
        prepared.sample(fit_rows / rows, seed) if rows > fit_rows else prepared)
    return model.transform(prepared).drop("_raw", "_v"), model


def cell_radii(celled: DataFrame, centres: np.ndarray, vector: str = "embedding") -> np.ndarray:
    """The greatest angle between each centre and the vectors of its cell: a number per cell reaches the driver."""
    unit = _unit_rows(np.asarray(centres, dtype=np.float64))

    def widest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cells = frame["cell"].to_numpy()
                cosine = (_unit_rows(_stack(frame, vector)) * unit[cells]).sum(axis=1)
                angle = np.arccos(np.clip(np.nan_to_num(cosine, nan=1.0), -1, 1))
                yield pd.DataFrame({"cell": cells, "angle": angle}).groupby("cell", as_index=False).max()

    found = celled.select(vector, F.col("cell").cast("int").alias("cell")).mapInPandas(widest, "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("angle"))
    radii = np.zeros(len(unit))
    for r in found.collect():
        radii[r["cell"]] = r["angle"]
    radii[~unit.any(axis=1)] = np.pi  # a centre without a direction bounds nothing
    return radii


def best_possible(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The highest cosine a vector of each cell can have with each query: the angle to the centre less the cell's radius."""
    angle = np.arccos(np.clip(np.nan_to_num(_unit_rows(queries) @ _unit_rows(centres).T), -1, 1))
    return np.cos(np.maximum(0.0, angle - radii[None, :]))


def _cell_hits(celled: DataFrame, asked: DataFrame, k: int, item_id: str, query_id: str, vector: str) -> DataFrame:
    """(q, i, s): the ``k`` best of each tile, for queries that name the cell they ask."""
    item_type, query_type = celled.schema[item_id].dataType.simpleString(), asked.schema[query_id].dataType.simpleString()

    def score(items: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        unit, ids, best = _unit_rows(_stack(wanted, vector)), wanted[query_id].to_numpy(), None
        for rows in _row_blocks(items, len(ids)):
            best = _best_per_query(best, _unit_rows(_stack(rows, vector)) @ unit.T, rows[item_id].to_numpy(), ids, k)
        return best

    return _tiles(celled.select(item_id, vector, F.col("cell").cast("int").alias("cell")), asked, score, f"q {query_type}, i {item_type}, s double",
                  item_id, query_id, vector, ["cell"])


def _with_cells(queries: DataFrame, query_id: str, vector: str, choose, *extra: str) -> DataFrame:
    """A row for each query and each cell that ``choose(frame)`` lists for it."""
    kinds = ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in (query_id, vector, *extra))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(cell=choose(frame)).explode("cell").dropna(subset=["cell"]).astype({"cell": "int32"})

    return queries.select(query_id, vector, *extra).mapInPandas(run, f"{kinds}, cell int").drop(*extra)


def probe_search(celled: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = TOP_K, nprobe: int = NPROBE, item_id: str = "vec_id",
                 query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """Search only the ``nprobe`` cells whose centres are nearest to each query.

    ``centres`` holds one vector per cell. A query goes to its cells, and tiles are formed within a cell.
    """
    unit_centres = _unit_rows(np.asarray(centres, dtype=np.float64))

    def nearest(frame: pd.DataFrame) -> list:
        return list(np.argsort(-(_unit_rows(_stack(frame, vector)) @ unit_centres.T), axis=1, kind="stable")[:, :nprobe])

    return _ranked_hits(_cell_hits(celled, _with_cells(queries, query_id, vector, nearest), k, item_id, query_id, vector), item_id, query_id, k)


def bounded_search(celled: DataFrame, centres: np.ndarray, radii: np.ndarray, queries: DataFrame, k: int = TOP_K, nprobe: int = NPROBE,
                   item_id: str = "vec_id", query_id: str = "query_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The exact top ``k`` from as few cells as their radii allow, and (query_id, cells) with the number of cells asked.

    Cells are visited in the order of the best score they can hold. After each round, which doubles the cells visited, a query is done
    when no cell that is left can hold more than its k-th hit so far. A cell that might is always visited, so no hit is lost.
    """
    centres, radii = np.asarray(centres, dtype=np.float64), np.asarray(radii, dtype=np.float64)
    hits = visited = None
    begin, end = 0, max(1, nprobe)
    todo = queries.select(query_id, vector).withColumn("floor", F.lit(float("-inf")))
    while begin < len(centres):

        def open_cells(frame: pd.DataFrame, begin=begin, end=end) -> list:
            bound = best_possible(_stack(frame, vector), centres, radii)
            order = np.argsort(-bound, axis=1, kind="stable")[:, begin:end]
            reach = np.take_along_axis(bound, order, axis=1) + 1e-9 >= frame["floor"].to_numpy()[:, None]
            return [cells[ok] for cells, ok in zip(order, reach)]

        asked = stored(_with_cells(todo, query_id, vector, open_cells, "floor"), "asked-cells")
        if not asked.count():
            break
        new = _cell_hits(celled, asked, k, item_id, query_id, vector)
        hits = stored(top_per_group(new if hits is None else hits.unionByName(new), ["q"], [F.desc("s"), F.asc("i")], k), "cell-hits")
        count = asked.groupBy(query_id).agg(F.count("*").alias("cells"))
        visited = count if visited is None else visited.unionByName(count)
        # With fewer than k hits so far, every cell is still open.
        floors = hits.groupBy(F.col("q").alias(query_id)).agg(F.when(F.count("*") >= k, F.min("s")).alias("floor"))
        known = F.coalesce("floor", F.lit(float("-inf")))
        todo = queries.select(query_id, vector).join(floors, query_id, "left").withColumn("floor", known)
        begin, end = end, 2 * end
    return _ranked_hits(hits, item_id, query_id, k), visited.groupBy(query_id).agg(F.sum("cells").alias("cells"))


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", item_id: str = "vec_id") -> DataFrame:
    """Share of the exact hits that the approximate search also returned, per query."""
    marked = exact.select(query_id, item_id).join(
        found.select(query_id, item_id, F.lit(1).alias("_hit")), [query_id, item_id], "left")
    return marked.groupBy(query_id).agg((F.count("_hit") / F.count("*")).alias("recall"))


# ---------------------------------------------------------------- lexical embedder

def fit_lexical_embedder(texts: DataFrame, text: str = "content", dim: int = 384):
    """Default embedder without a model download: hashed term counts weighted by inverse document frequency."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ]).fit(texts)


def embed_corpus(texts: DataFrame, text: str = "content", dim: int = 384, vector: str = "embedding") -> DataFrame:
    """The texts with the vectors that the default embedder gives when it is fitted on them; each text is cut into words once."""
    words = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"\W+", toLowercase=True).transform(texts)
    counted = stored(HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim).transform(words).drop("_tokens"), "term-counts")
    weights = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted.select("_tf"))
    unit = Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0).transform(weights.transform(counted))
    return unit.withColumn(vector, vector_to_array("_unit", "float32")).drop("_tf", "_tfidf", "_unit")


def embed(texts: DataFrame, embedder, vector: str = "embedding") -> DataFrame:
    out = embedder.transform(texts)
    return out.withColumn(vector, vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_tfidf", "_unit")


def model_embedder(load_model, batch_size: int = 64):
    """A column function for a model that embeds batches of texts.

    ``load_model()`` runs once in each Python worker and returns ``encode(list of texts) -> matrix``, a row per text. Null texts count as
    empty; vectors are float32.
    """
    def make():
        encode = load_model()

        def predict(texts: np.ndarray) -> np.ndarray:
            return np.asarray(encode(list(texts)), dtype=np.float32)

        return predict

    predict = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return lambda text: predict(F.coalesce(text, F.lit("")))


def embed_with_model(texts: DataFrame, embedder, text: str = "content", vector: str = "embedding") -> DataFrame:
    return texts.withColumn(vector, embedder(F.col(text)))


def sign_projection(dim: int = 8):
    """A small model of fixed weights: every word (a run of a-z and 0-9) has +1 or -1 in each dimension, by the hex digits of its md5."""
    def load():
        known: dict[str, np.ndarray] = {}

        def weights(word: str) -> np.ndarray:
            if word not in known:
                if len(known) >= 100_000:  # bounds the worker's memory
                    known.clear()
                known[word] = np.array([1.0 if c >= "8" else -1.0 for c in hashlib.md5(word.encode()).hexdigest()[:dim]])
            return known[word]

        return lambda texts: np.array([sum((weights(w) for w in re.findall("[a-z0-9]+", t)), np.zeros(dim)) for t in texts]).reshape(-1, dim)

    return load


# ---------------------------------------------------------------- prompt assembly

PROMPT_HEAD = (
    "You are a helpful assistant. Answer the user's question based on the provided context.\n"
    "If the context doesn't contain relevant information, say so.\n\nCONTEXT:\n"
)


def context_budget(hits: DataFrame, query_id: str = "query_id", rank: str = "rank", content: str = "content",
                   max_length: int = 2000) -> DataFrame:
    """Ranked contents cut to a total length: the document that crosses the budget is cut, later ones are dropped.

    ``hits`` holds at most top-k rows per query.
    """
    before = Window.partitionBy(query_id).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(content)).over(before), F.lit(0))
    return (
        hits.withColumn("_used", used).filter(F.col("_used") < max_length)
        .withColumn(content, F.substring(F.col(content), F.lit(1), F.lit(max_length).cast("int") - F.col("_used").cast("int")))
        .drop("_used")
    )


def build_prompts(hits: DataFrame, query_id: str = "query_id", query_text: str = "query_text", max_length: int = 2000) -> DataFrame:
    cut = context_budget(hits, query_id, max_length=max_length)
    parts = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("[Source: "), "source", F.lit("]\n"), "content").alias("p"))))
    joined = F.array_join(F.transform(parts, lambda p: p["p"]), "\n\n---\n\n")
    return cut.groupBy(query_id, query_text).agg(F.concat(
        F.lit(PROMPT_HEAD), joined, F.lit("\n\nUSER QUESTION: "), F.first(query_text), F.lit("\n\nANSWER:")).alias("prompt"))


def template_answers(hits: DataFrame, query_id: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """Findings without a language model: rank, score, source and the first 300 characters."""
    line = F.concat(
        F.lit("**Finding "), F.col("rank").cast("string"), F.lit("** (Score: "), F.format_number("score", 2), F.lit(", Source: "),
        F.col("source"), F.lit(")\n"), F.substring("content", 1, 300), F.lit("...\n\n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("p")))), lambda p: p["p"]), "")
    head = F.concat(F.lit("Based on the knowledge base, here's what I found about '"), F.first(query_text), F.lit("':\n\n"))
    return hits.groupBy(query_id, query_text).agg(F.concat(head, lines).alias("answer"))
