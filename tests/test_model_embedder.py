"""A batch model as the embedder."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import retrieval

TEXTS = ["alpha beta", "", None, "beta beta gamma", "Ünïcode only", "x" * 50_000, "one two three " * 400]


def plain(text, dim=8):
    out = [0.0] * dim
    for w in re.findall("[a-z0-9]+", text or ""):
        for i, c in enumerate(hashlib.md5(w.encode()).hexdigest()[:dim]):
            out[i] += 1 if int(c, 16) >= 8 else -1
    return out


def test_any_batch_size_gives_the_same_vectors(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 5)], "id int, content string").repartition(3)
    for size in (1, 3, 64):
        out = retrieval.embed_with_model(rows, retrieval.model_embedder(retrieval.sign_projection(8), size))
        assert out.schema["embedding"].dataType.simpleString() == "array<float>"
        assert {r.id: list(r.embedding) for r in out.collect()} == {i: plain(t) for i, t in enumerate(TEXTS * 5)}


def test_the_model_is_loaded_once_per_worker(spark):
    """The loader leaves a token that every batch of its worker carries."""
    def load():
        import uuid

        token = float(uuid.uuid4().int % 2 ** 20)
        return lambda texts: np.full((len(texts), 1), token)

    rows = spark.range(400).coalesce(1).select(F.col("id").cast("string").alias("content"))
    out = retrieval.embed_with_model(rows, retrieval.model_embedder(load, 10))
    assert out.select(F.col("embedding")[0]).distinct().count() == 1


def test_no_texts(spark):
    rows = spark.createDataFrame([], "content string")
    assert retrieval.embed_with_model(rows, retrieval.model_embedder(retrieval.sign_projection())).count() == 0
