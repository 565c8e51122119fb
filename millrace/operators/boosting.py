"""Gradient boosting on binned features, where trials, folds and classes are the parallel tasks.

Features are cut into ``BINS`` bins once, at quantiles taken over all rows. A model is fitted by one task. In a search every model is
fitted on all labelled rows outside its fold: rows are packed, a byte per feature, and each task is sent a copy of the blocks. All
held-out rows are scored, by every model that did not see their fold. So the number of Spark jobs does not depend on that of the trees.
The models of ``one_vs_rest`` are fitted on a sample of at most ``SAMPLE_ROWS`` labelled rows chosen by a hash of their id.

Rows with a null label take no part in fitting; a null or NaN feature falls into the lowest bin.
"""

from __future__ import annotations

import io
import itertools
import tempfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .evaluate import roc_auc

SAMPLE_ROWS, BINS = 20_000, 64
#: Rows of a packed block, and rows that a fit takes at a time; neither changes a result.
BLOCK_ROWS, PART_ROWS = 4096, 1 << 17
#: Arrays of a fit beyond this size are in mapped files.
ROOM_BYTES = 32 << 20
#: Greatest total size of the models that one scoring job carries to the workers.
MODEL_BYTES = 256 << 20
# The search space of boosted trees, its draws and folds.
SPACE = {"rounds": (100, 200), "depth": (3, 5, 7), "step": (0.01, 0.1), "row_share": (0.8, 1.0), "column_share": (0.8, 1.0)}
DRAWS, FOLDS = 20, 5
_L2, _LEAST_WEIGHT = 1.0, 1.0


@dataclass(frozen=True)
class Params:
    rounds: int = 100
    depth: int = 3
    step: float = 0.1
    row_share: float = 1.0
    column_share: float = 1.0


def draws(count: int = DRAWS, seed: int = 42) -> list[Params]:
    """Different points of the search space, drawn without replacement."""
    grid = [Params(*point) for point in itertools.product(*SPACE.values())]
    return [grid[i] for i in np.random.default_rng(seed).permutation(len(grid))[:count]]


class Trees:
    """Boosted trees as heaps: the children of node i are 2 i + 1 and 2 i + 2; a feature of -1 marks a leaf."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.cut, self.value, self.base = feature, cut, value, base

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Probability of the positive class; all trees of a chunk of rows at a time.

        Nodes of all trees are one flat table. A leaf is its own child and no code is above its cut, so rows wait there.
        """
        out = np.empty(len(codes))
        depth = (self.feature.shape[1] + 1).bit_length() - 2
        size, width = self.feature.shape[1], codes.shape[1]
        roots = np.arange(len(self.feature), dtype=np.int32) * size
        at_leaf = self.feature.ravel() < 0
        place = np.arange(at_leaf.size, dtype=np.int32)
        child = np.where(at_leaf, place, place - place % size + 2 * (place % size) + 1).astype(np.int32)
        feature, cut, value = np.maximum(self.feature, 0).ravel().astype(np.int32), np.where(at_leaf, 255, self.cut.ravel()).astype(np.uint8), self.value.ravel()
        for at in range(0, len(codes), 4096):
            part = codes[at : at + 4096]
            flat, first = part.ravel(), (np.arange(len(part), dtype=np.int32) * width)[:, None]
            node = np.tile(roots, (len(part), 1))
            for _ in range(depth):
                node = child.take(node) + (flat.take(feature.take(node) + first) > cut.take(node))
            out[at : at + 4096] = self.base + value.take(node).sum(1, dtype=np.float64)
        return 1 / (1 + np.exp(-out))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, feature=self.feature, cut=self.cut, value=self.value, base=self.base)
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> Trees:
        with np.load(io.BytesIO(raw)) as z:
            return Trees(z["feature"], z["cut"], z["value"], float(z["base"]))


def _room(shape: int | tuple[int, ...], kind: type) -> np.ndarray:
    """Zeros; large ones are in a mapped file without a name, whose pages the system can write out, so a model's rows may exceed the memory."""
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    if size <= ROOM_BYTES:
        return np.zeros(shape, kind)
    with tempfile.TemporaryFile() as f:
        return np.asarray(np.memmap(f, kind, "w+", shape=shape))


def fit(codes: np.ndarray, y: np.ndarray, p: Params, seed: int = 42, bins: int = BINS) -> Trees:
    """Trees of depth ``p.depth`` for the log loss: histograms of first and second derivatives per node, feature and bin.

    Rows are taken ``PART_ROWS`` at a time. The two derivatives are one complex number and are added up in the order of the rows.
    """
    n, width = codes.shape
    rng = np.random.default_rng(seed)
    rate = min(max(float(y.mean()) if n else 0.5, 1e-6), 1 - 1e-6)
    base = float(np.log(rate / (1 - rate)))
    nodes = (2 << p.depth) - 1
    feature, cut = np.full((p.rounds, nodes), -1, np.int16), np.zeros((p.rounds, nodes), np.uint8)
    value = np.zeros((p.rounds, nodes), np.float32)
    used = max(1, round(p.column_share * width))
    parts = [slice(i, min(i + PART_ROWS, n)) for i in range(0, n, PART_ROWS)]
    by_column = np.ascontiguousarray(codes.T)
    flat_codes, within = by_column.ravel(), np.arange(min(n, PART_ROWS))
    total, both = _room(n, np.float64), _room(n, np.complex128)
    at, live = _room(n, np.int32), _room(n, np.bool_)  # place in the heap
    total[:] = base
    for t in range(p.rounds):
        for s in parts:
            prob = 1 / (1 + np.exp(-total[s]))
            g, h = prob - y[s], np.maximum(prob * (1 - prob), 1e-12)
            if p.row_share < 1:
                seen = rng.random(len(prob)) < p.row_share
                g, h = g * seen, h * seen
            both.real[s], both.imag[s] = g, h
        columns = np.sort(rng.permutation(width)[:used])
        at[:], live[:] = 0, True
        for level in range(p.depth + 1):
            first, count = (1 << level) - 1, 1 << level
            sums, left = np.zeros(count, np.complex128), np.zeros((used, count * bins), np.complex128)
            for s in parts:
                mine, place, rows = both[s], at[s].astype(np.intp) - first, None
                if not live[s].all():
                    rows = np.flatnonzero(live[s])
                    mine, place = mine.take(rows), place.take(rows)
                np.add.at(sums, place, mine)
                if level < p.depth:
                    place *= bins
                    key = np.empty_like(place)
                    for j, c in enumerate(columns):
                        code = by_column[c, s]
                        np.add(place, code if rows is None else code.take(rows), out=key)
                        np.add.at(left[j], key, mine)
            sums_g, sums_h = sums.real, sums.imag
            value[t, first : first + count] = -p.step * sums_g / (sums_h + _L2)
            if level == p.depth or not live.any():
                break
            left = left.reshape(used, count, bins).transpose(1, 0, 2).cumsum(2)
            left_g, left_h = left.real, left.imag
            right_g, right_h = sums_g[:, None, None] - left_g, sums_h[:, None, None] - left_h
            gain = left_g**2 / (left_h + _L2) + right_g**2 / (right_h + _L2) - (sums_g**2 / (sums_h + _L2))[:, None, None]
            gain[(left_h < _LEAST_WEIGHT) | (right_h < _LEAST_WEIGHT)] = -np.inf
            flat = gain.reshape(count, -1)
            best = flat.argmax(1)
            split = flat[np.arange(count), best] > 1e-9
            column, code = columns[best // bins], (best % bins).astype(np.uint8)
            feature[t, first : first + count] = np.where(split, column, -1)
            cut[t, first : first + count] = code
            for s in parts:
                place = np.where(live[s], at[s].astype(np.intp) - first, 0)
                live[s] &= split.take(place)
                right = flat_codes.take((column * n).take(place) + (within[: len(place)] + s.start)) > code.take(place)
                at[s] = np.where(live[s], 2 * at[s] + 1 + right, at[s])
        for s in parts:
            total[s] += value[t].take(at[s])
    return Trees(feature, cut, value, base)


def feature_cuts(df: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Rising cuts between bins of about equal counts: a few numbers per feature, over all rows."""
    shares = [i / bins for i in range(1, bins)]
    clean = [F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), shares, 10_000).alias(c) for c in features]
    row = df.agg(*clean).first()
    return {c: sorted(set(row[c] or [])) for c in features}


def binned(features: Sequence[str], cuts: dict[str, list[float]]) -> Column:
    """The number of cuts below each feature, as an array."""

    def code(c: str) -> Column:
        v = F.col(c).cast("double")
        below = F.size(F.filter(F.array(*[F.lit(x) for x in cuts[c]]).cast("array<double>"), lambda x: x < v))
        return F.when(v.isNull() | F.isnan(v), 0).otherwise(below).cast("int")

    return F.array(*[code(c) for c in features])


def _codes(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.uint8) if len(column) else np.zeros((0, width), np.uint8)


def _sample(rows: DataFrame, row_id: str, label: str, size: int) -> pd.DataFrame:
    """At most ``size`` labelled rows in the order of a hash of their id."""
    return rows.filter(F.col(label).isNotNull()).orderBy(F.xxhash64(row_id), row_id).limit(size).toPandas()


def _packed(coded: DataFrame, row_id: str) -> DataFrame:
    """All labelled rows in the order of a hash of their id: blocks (part, place) of bytes, in the order of these numbers."""

    def pack(batches):
        place = itertools.count()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(at, BLOCK_ROWS)
                raw = {c: b.column(c).to_numpy(zero_copy_only=False).astype(np.int32).tobytes() for c in ("fold", "label")}
                codes = b.column("codes").flatten().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_pydict({"part": b.column("part").slice(0, 1), "place": pa.array([next(place)], pa.int64()),
                                                  "fold": [raw["fold"]], "label": [raw["label"]], "codes": [codes]})

    ordered = coded.filter("label is not null").orderBy(F.xxhash64(row_id), row_id, "label", "codes")
    rows = ordered.select(F.spark_partition_id().alias("part"), "fold", "label", "codes")
    return stored(rows.mapInArrow(pack, "part int, place long, fold binary, label binary, codes binary"), "boosted-rows")


def _fit_all(feed: DataFrame, tasks: list, prepare: Callable[..., Iterator[tuple]], seed: int) -> dict[int, bytes]:
    """A model per task. A partition of ``feed`` is what one model needs, and ``prepare(batches)`` makes (task, codes, labels, params) of it."""

    def run(batches):
        for i, codes, y, params in prepare(batches):
            yield pa.RecordBatch.from_pydict({"task": pa.array([i], pa.int64()), "model": [fit(codes, y, params, seed + i).to_bytes()]})

    # As many partitions as models: a lost executor costs the models it was fitting.
    models = stored(feed.mapInArrow(run, "task long, model binary"), "boosted-models")
    size = models.agg(F.sum(F.octet_length("model"))).first()[0] or 0
    if size > MODEL_BYTES:
        raise ValueError(f"models of {size} bytes exceed {MODEL_BYTES}")
    return {r["task"]: bytes(r["model"]) for r in models.collect()}


def cross_validate(rows: DataFrame, row_id: str, features: Sequence[str], label: str, trials: Sequence[Params], folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """(trial, auc, the trial's parameters): the mean over folds of the area under ROC on all rows of the fold that was held out.

    A model is fitted on all labelled rows of the other folds.
    """
    spark, features = rows.sparkSession, list(features)
    fold = F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(folds)).cast("int").alias("fold")
    coded = stored(rows.select(row_id, F.col(label).cast("int").alias("label"), fold, binned(features, feature_cuts(rows, features)).alias("codes")), "binned")
    tasks = [(t, k) for t in range(len(trials)) for k in range(folds)]
    blocks = _packed(coded, row_id)
    sizes = {r["fold"]: r["n"] for r in coded.filter("label is not null").groupBy("fold").agg(F.count("*").alias("n")).collect()}  # a row per fold

    def prepare(batches):
        given = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("task", "fold", "label", "codes"))))
        for i, mine in itertools.groupby(given, lambda row: row[0]):
            trial, held = tasks[i]
            n, at = sum(v for k, v in sizes.items() if k != held), 0
            by_column, y = _room((len(features), n), np.uint8), _room(n, np.float64)
            for _, fold, label, codes in mine:
                train = np.frombuffer(fold, np.int32) != held
                to = at + int(train.sum())
                by_column[:, at:to] = np.frombuffer(codes, np.uint8).reshape(len(train), -1)[train].T
                y[at:to] = np.frombuffer(label, np.int32)[train]
                at = to
            if at != n:
                raise ValueError(f"task {i} has {at} rows of {n}")
            yield i, by_column.T, y, trials[trial]

    copies = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(len(tasks) - 1))).alias("task"), "*")
    feed = copies.repartitionById(len(tasks), F.col("task")).sortWithinPartitions("task", "part", "place")
    models = spark.sparkContext.broadcast(_fit_all(feed, tasks, prepare, seed))

    def score(frames):
        loaded: dict[int, Trees] = {}
        for frame in frames:
            for k, part in frame.groupby("fold"):
                codes = _codes(part["codes"], len(features))
                for i, (t, held) in enumerate(tasks):
                    if held == k:
                        if i not in loaded:
                            loaded[i] = Trees.from_bytes(models.value[i])
                        yield pd.DataFrame({"trial": t, "fold": k, "label": part["label"].to_numpy(), "score": loaded[i].score(codes)})

    scored = coded.filter("label is not null").select("fold", "label", "codes").mapInPandas(score, "trial int, fold int, label int, score double")
    per_fold = roc_auc(stored(scored, "boosted-scores"), ["trial", "fold"])
    table = spark.createDataFrame([(i, *asdict(p).values()) for i, p in enumerate(trials)], "trial int, rounds int, depth int, step double, row_share double, column_share double")
    return per_fold.groupBy("trial").agg(F.avg("auc").alias("auc"), F.count("auc").alias("folds")).join(F.broadcast(table), "trial", "right")


def one_vs_rest(train: DataFrame, test: DataFrame, row_id: str, features: Sequence[str], target: str, params: Params = Params(), seed: int = 42,
                sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``test`` with ``label`` and ``prediction``, codes of classes in alphabetical order, ``predicted`` and ``confidence``.

    A class is one task; its probability is divided by the sum over classes. Classes of ``test`` that ``train`` lacks get the next code.
    """
    spark, features = train.sparkSession, list(features)
    classes = sorted(r[0] for r in train.filter(F.col(target).isNotNull()).select(target).distinct().collect())  # a row per class
    cuts = feature_cuts(train, features)
    sample = spark.sparkContext.broadcast(
        _sample(train.select(row_id, F.col(target).alias("label"), binned(features, cuts).alias("codes")), row_id, "label", sample_rows))

    def prepare(batches):
        for b in batches:
            for i in b.column("id").to_pylist():
                yield i, _codes(sample.value["codes"], len(features)), (sample.value["label"] == classes[i]).to_numpy(float), params

    models = spark.sparkContext.broadcast(_fit_all(spark.range(0, len(classes), 1, len(classes)), classes, prepare, seed))
    names = [f.name for f in test.schema.fields]

    def score(frames):
        loaded = [Trees.from_bytes(models.value[i]) for i in range(len(classes))]
        for frame in frames:
            p = np.stack([m.score(_codes(frame["codes"], len(features))) for m in loaded], axis=1)
            p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
            yield frame[names].assign(prediction=p.argmax(1).astype(float), confidence=p.max(1))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in test.schema.fields)
    scored = test.withColumn("codes", binned(features, cuts)).mapInPandas(score, f"{kind}, prediction double, confidence double")
    known = F.array(*[F.lit(c) for c in classes])
    label = F.coalesce(F.nullif(F.array_position(known, F.col(target)), F.lit(0)) - 1, F.lit(len(classes))).cast("double")
    return scored.withColumn("label", label).withColumn("predicted", F.get(known, F.col("prediction").cast("int")))
