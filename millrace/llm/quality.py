"""Quality rules: base rules and gradient-boosted trees over document statistics.

The statistics of all documents are computed in Arrow batches. The trees are fitted on a bounded sample of labelled rows
(``SAMPLE_ROWS``), flattened into numpy node arrays and shipped to the scoring tasks. Features in ``MONOTONE`` can only lower
the score as they grow: a split that would break this is refused, and children inherit bounds on their leaf values.

Edge cases: a null or empty text has zero words and fails the base rules; without usable labels the base rules alone decide;
repeated doc_ids are judged row by row; extra columns do not matter, only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Texts, mix, owners, per_group, small_batches

SAMPLE_ROWS = 20_000
MIN_WORDS = 50
#: A document is rejected when its estimated chance of being good is below this.
KEEP_FROM = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_chars")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct", "line_words")
#: -1: the score never rises with the feature.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "marks": -1}

_SYMBOL, _UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_DIGIT[list(b"0123456789")] = True
_MARK[list(b"!?~^=_+")] = True


def statistics(texts: Texts) -> dict[str, np.ndarray]:
    """The counts in ``BASE`` and ``EXTRA`` of every text of a batch."""
    data = texts.data
    starts, ends, first = texts.words()
    group = owners(first)
    n_words = np.diff(first)
    code_point = (data & 0xC0) != 0x80
    hashes = texts.hashes(starts, ends)

    # Words in repeated windows of three.
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= 3:
        window = mix(hashes[:-2] * np.uint64(3) + mix(hashes[1:-1] * np.uint64(5) + mix(hashes[2:])))
        at = np.flatnonzero(group[:-2] == group[2:])
        key = mix(window[at] ^ mix(group[at].astype(np.uint64) + np.uint64(1)))
        _, back, often = np.unique(key, return_inverse=True, return_counts=True)
        at = at[often[back] > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + 3, -1)
    repeated = np.cumsum(covered)[: len(starts)] > 0

    # Lines: byte ranges between line feeds and text ends.
    feeds = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([texts.offsets[:-1], feeds + 1]), kind="stable")
    line_ends = np.sort(np.concatenate([feeds, texts.offsets[1:]]), kind="stable")
    line_group = np.repeat(np.arange(texts.n), texts.counts(data == 10) + 1)
    line_ends = np.maximum(line_starts, np.minimum(line_ends, texts.offsets[line_group + 1]))
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    key = mix(texts.hashes(line_starts, line_ends) ^ mix(line_group.astype(np.uint64) + np.uint64(1)))[with_word]
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False

    distinct = np.unique(mix(hashes ^ mix(group.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    return {
        "n_words": n_words,
        "word_chars": texts.counts(code_point & ~SPACE[data]),
        "n_symbols": texts.counts(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_group[with_word][again], minlength=texts.n),
        "n_repeat_words": per_group(repeated, first),
        "n_lines": np.bincount(line_group[with_word], minlength=texts.n),
        "n_upper": texts.counts(_UPPER[data]),
        "n_digits": texts.counts(_DIGIT[data]),
        "n_marks": texts.counts(_MARK[data]),
        "n_distinct": np.bincount(group[distinct], minlength=texts.n),
        "n_chars": texts.counts(code_point),
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(1, s[k]).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
        s["n_upper"] / chars, s["n_digits"] / chars, s["n_marks"] / chars, s["n_distinct"] / words, np.log1p(s["n_words"] / lines)])


@dataclass
class Trees:
    """All trees as flat node arrays. A leaf points at itself, so scoring takes ``depth`` equal steps for every row."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of being good for each row of features."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] < self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64,
        l2: float = 1.0, least: float = 2.0) -> Trees:
    """Boost logistic loss with histogram trees. ``monotone`` holds -1, 0 or 1 per feature."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)])
    rate_good = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate_good / (1 - rate_good)))
    total = np.full(n, start)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def leaf(g, h, low, high):
        return float(np.clip(-g / (h + l2), low, high))

    def grow(at, g, h, level, low, high):
        me = len(nodes)
        value = leaf(g[at].sum(), h[at].sum(), low, high)
        nodes.append([0, 0.0, me, me, value * rate])
        if level == 0 or len(at) < 2:
            total[at] += value * rate
            return me
        best = None
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            sums = [np.bincount(code[at, j], weights=w[at], minlength=len(cut) + 1).cumsum() for w in (g, h)]
            gl, hl = sums[0][:-1], sums[1][:-1]
            gr, hr = sums[0][-1] - gl, sums[1][-1] - hl
            wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = -(gl * wl + 0.5 * (hl + l2) * wl**2) - (gr * wr + 0.5 * (hr + l2) * wr**2)
            gain[(hl < least) | (hr < least) | (monotone[j] * (wr - wl) < 0)] = -np.inf
            k = int(np.argmax(gain))
            if np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
                best = (gain[k], j, k, wl[k], wr[k])
        gs, hs = g[at].sum(), h[at].sum()
        if best is None or best[0] <= -(gs * value + 0.5 * (hs + l2) * value**2) + 1e-6:
            total[at] += value * rate
            return me
        _, j, k, wl, wr = best
        go = code[at, j] <= k
        middle = (wl + wr) / 2
        bounds = [(low, high), (low, high)]
        if monotone[j]:
            bounds = [(low, middle), (middle, high)] if monotone[j] > 0 else [(middle, high), (low, middle)]
        nodes[me][0], nodes[me][1] = j, float(cuts[j][k])
        nodes[me][2] = grow(at[go], g, h, level - 1, *bounds[0])
        nodes[me][3] = grow(at[~go], g, h, level - 1, *bounds[1])
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), depth, -np.inf, np.inf))
    f, t, left, right, v = zip(*nodes)
    return Trees(np.array(roots), np.array(f), np.array(t), np.array(left), np.array(right), np.array(v), depth, start)


_STATS = "doc_id long, " + ", ".join(f"{c} long" for c in BASE + EXTRA)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document; one pass, no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            s = statistics(Texts(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(s[c].astype(np.int64)) for c in BASE + EXTRA)],
                                             ["doc_id", *BASE, *EXTRA])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _STATS)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Trees | None:
    """Trees fitted on at most ``sample`` labelled documents, chosen by a hash of doc_id; None without both labels.

    A document with several labels counts as good if at least half of them say so.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("good"))
    picked = (known.select("doc_id", (F.col("good") >= 0.5).cast("int").alias("good"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    chosen = docs.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")
    rows = (document_statistics(chosen).join(F.broadcast(picked), "doc_id")
            .orderBy("doc_id", *BASE, *EXTRA).limit(sample).toPandas())
    if rows["good"].nunique() < 2:
        return None
    monotone = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    return fit(features({c: rows[c].to_numpy() for c in BASE + EXTRA}), rows["good"].to_numpy(float), monotone)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(stats: DataFrame, model: Trees | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """Statistics with ``base_failed``, ``score`` (null without a model) and ``kept``."""

    def run(batches):
        for b in batches:
            s = {c: b.column(c).to_numpy() for c in BASE + EXTRA}
            score = model.score(features(s)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "score"])

    scored = stats.mapInArrow(run, _STATS + ", score double") if model else stats.withColumn("score", F.lit(None).cast("double"))
    good = F.coalesce(F.col("score") >= keep_from, F.lit(True))
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & good)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """Judge every document: statistics, base rules and the fitted trees."""
    return judge(document_statistics(docs), fit_quality(docs, labels, sample), keep_from)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that pass, with their own columns. The judgement is made in the batch that holds the text: no join."""
    small_batches(docs.sparkSession)
    model = fit_quality(docs, labels, sample)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = statistics(Texts(b.column("text")))
            ok = (s["n_words"] >= MIN_WORDS) & (100 * s["n_repeat_words"] <= 50 * s["n_words"])
            if model:
                ok &= model.score(features(s)) >= keep_from
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
