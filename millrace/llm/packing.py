"""Packing documents into training sequences as a cutting-stock problem, solved by column generation.

Documents become pieces: full sequences are cut off first, the rest is one shorter piece. The histogram of piece lengths, in classes
of ``quantum`` tokens, is all that reaches the driver: its size depends on the sequence length alone. A linear program over patterns
(how many pieces of each class fill one sequence) is solved by the revised simplex method; an unbounded knapsack over the dual prices
finds the next pattern. Pattern counts are rounded down and the few pieces left over are placed first-fit by falling length. Spark
ranks the pieces of each class in bounded buckets, and a rank names the sequence and the slot of its piece.

Edge cases: a null or empty text is a document of just the end id; rows with equal doc_id are documents of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, small_batches, stored
from .tokens import load

CAPACITY = 4096
QUANTUM = 16
#: The program ends when its bound proves it this close to the best.
GAP = 1e-3
BUCKET_ROWS = 50_000


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest total price within the capacity: an unbounded knapsack."""
    value = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = np.searchsorted(sizes, c, side="right")  # sizes rise
        if fit:
            gain = prices[:fit] + value[c - sizes[:fit]]
            j = int(np.argmax(gain))
            value[c], last[c] = gain[j], j
        if value[c - 1] >= value[c]:
            value[c], last[c] = value[c - 1], -1
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(value[capacity]), pattern


def cut_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each, for the fewest sequences that hold ``demand`` pieces of each of the rising ``sizes``."""
    m = len(sizes)
    patterns = np.diag(capacity // sizes).astype(float)  # column p: pieces of each class in pattern p
    inverse = np.diag(1.0 / np.diag(patterns))
    x = inverse @ demand
    bound = float(sizes @ demand) / capacity  # no packing takes fewer sequences
    for step in range(40 * m + 100):
        prices = np.ones(m) @ inverse
        worth, pattern = best_pattern(sizes, prices, capacity)
        bound = max(bound, x.sum() / max(worth, 1.0))
        if worth <= 1 + 1e-9 or x.sum() <= (1 + gap) * bound:
            break
        direction = inverse @ pattern
        up = direction > 1e-10
        ratio = np.where(up, x / np.where(up, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * direction, 0)
        x[out] = ratio[out]
        patterns[:, out] = pattern
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        if step % 200 == 199:
            inverse = np.linalg.inv(patterns)
            x = np.maximum(inverse @ demand, 0)
    return [(patterns[:, p], x[p]) for p in range(m) if x[p] > 0]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where the pieces of each class go.

    Each entry (class, first rank, pieces per sequence, first sequence, uses) sends ranks to sequences; also the number of sequences.
    """
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes.tolist()], float)
    rules, taken, sequences = [], np.zeros(len(sizes), np.int64), 0
    patterns = cut_patterns(sizes, demand, capacity) if len(sizes) else []
    for pattern, x in sorted(patterns, key=lambda p: -p[1]):
        uses = int(np.floor(x + 1e-9))
        count = pattern.astype(np.int64)
        left = demand.astype(np.int64) - taken
        if count.any():
            uses = min(uses, int((left[count > 0] // count[count > 0]).min()))
        if uses <= 0:
            continue
        for j in np.flatnonzero(count).tolist():
            rules.append((int(sizes[j]), int(taken[j]), int(count[j]), sequences, uses))
        taken += count * uses
        sequences += uses
    # Fewer pieces than classes times a pattern's pieces are left: first fit by falling length.
    room: list[int] = []
    for j in reversed(range(len(sizes))):
        for rank in range(int(taken[j]), int(demand[j])):
            at = next((i for i, r in enumerate(room) if r >= sizes[j]), None)
            if at is None:
                at = len(room)
                room.append(capacity)
            room[at] -= int(sizes[j])
            rules.append((int(sizes[j]), rank, 1, sequences + at, 1))
    return rules, sequences + len(room)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: full sequences from its front, and the rest."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = load(tokenizer)
        for b in batches:
            coded, rows = encoder.ids_of(Texts(b.column("text"))), []
            for doc, raw in zip(b.column("doc_id").to_pylist(), coded):
                raw += end
                n = len(raw) // 4
                for s in range(0, n, capacity):
                    part = raw[4 * s : 4 * (s + capacity)]
                    rows.append((doc, s, len(part) // 4, zlib.crc32(part), n))
            names = [c.split()[0] for c in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, quantum: int = QUANTUM) -> DataFrame:
    """Every piece with its sequence_id and its offset there, gapless from 0."""
    pieces = stored(pieces, "pieces")
    rows = pieces.count()
    # Buckets keep any class, also one that holds most pieces, in groups of bounded size.
    buckets = max(1, -(-rows // BUCKET_ROWS))
    dealt = pieces.withColumns({
        "class": ((F.col("length") + quantum - 1) / quantum).cast("int"),
        "bucket": F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")})
    counts = stored(dealt.groupBy("class", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # capacity / quantum rows at most
    rules, _ = plan(histogram, capacity // quantum)
    by_class: dict[int, np.ndarray] = {}
    for rule in sorted(rules):
        by_class.setdefault(rule[0], []).append(rule[1:])
    by_class = {k: np.array(v, np.int64) for k, v in by_class.items()}

    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    firsts = counts.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("class", "bucket").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (dealt.withColumn("rank", F.row_number().over(inside) - 1).join(firsts, ["class", "bucket"])
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("first") + F.col("rank")).alias("rank")))

    def place(batches):
        for b in batches:
            kind, rank = b.column("class").to_numpy(), b.column("rank").to_numpy()
            sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(kind).tolist():
                mine = kind == k
                first, per, start, _ = by_class[k].T
                rule = np.searchsorted(first, rank[mine], side="right") - 1
                past = rank[mine] - first[rule]
                sequence[mine] = start[rule] + past // per[rule]
                slot[mine] = past
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(kind), pa.array(slot)],
                                             [*b.schema.names[:5], "sequence_id", "class", "slot"])

    placed = ranked.mapInArrow(place, _PIECES + ", sequence_id long, class int, slot long")
    along = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "slot", "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0)))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, end_id, capacity), capacity)
