"""Shared helpers: bounded Arrow batches, words and their hashes as numpy arrays, stored tables, size-checked joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

BATCH_ROWS, BATCH_BYTES = 512, 1 << 20
#: Largest table that is ever broadcast. Larger ones take the shuffled way, with the same rows.
BROADCAST_BYTES = 24 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_U = np.uint64
#: Bytes hashed lane by lane; longer ranges are hashed as a tree of such chunks.
_CHUNK, _LANES = 64, 8
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that close inputs get unrelated hashes."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _chained(item, sizes: np.ndarray, step: int) -> np.ndarray:
    """Hashes of short sequences: ``item(rows, k)`` gives what the given rows hold at place ``k``."""
    h = mix(sizes.astype(np.uint64) * _U(0xD1342543DE82EF95) + _U(0x9E3779B97F4A7C15))
    rows = np.flatnonzero(sizes > 0)
    k = 0
    while len(rows):
        h[rows] = mix(h[rows] ^ item(rows, k))
        k += step
        rows = rows[sizes[rows] > k]
    return h


def _split(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut sequences into parts of ``most`` at most: the owner, the place within it, and the size of each part."""
    counts = -(-sizes // most)
    owner = np.repeat(np.arange(len(sizes)), counts)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * most
    return owner, place, np.minimum(most, sizes[owner] - place)


def _lower(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


class Texts:
    """The texts of one Arrow batch as one byte array; a null text counts as empty.

    ``offsets[i]:offsets[i + 1]`` are the bytes of text ``i``.
    """

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        if column.null_count:
            column = column.fill_null(b"")
        n = len(column)
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = column.buffers()[2] if n else None
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        if lower:
            data = _lower(data)
        self.data, self.offsets, self.n = data, off - off[0], n
        self._lanes = None

    def lowered(self) -> Texts:
        """The same texts with A-Z as a-z."""
        out = object.__new__(Texts)
        out.data, out.offsets, out.n, out._lanes = _lower(self.data), self.offsets, self.n, None
        return out

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def _short_hashes(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if self._lanes is None:
            padded = np.zeros(len(self.data) + 8, np.uint8)
            padded[: len(self.data)] = self.data
            self._lanes = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every place on
        return _chained(lambda rows, k: self._lanes[starts[rows] + k] & _MASKS[np.minimum(sizes[rows] - k, 8)], sizes, 8)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges: the same bytes give the same hash wherever they stand.

        Eight bytes at a time are mixed in; a range of more than 64 bytes is a tree of chunks, so very long ones take few steps.
        Two given different ranges share a hash with a chance of about 2**-64.
        """
        sizes = ends - starts
        long = np.flatnonzero(sizes > _CHUNK)
        if not len(long):
            return self._short_hashes(starts, sizes)
        out = self._short_hashes(starts, np.where(sizes > _CHUNK, 0, sizes))
        owner, place, part = _split(sizes[long], _CHUNK)
        h = self._short_hashes(starts[long][owner] + place, part)
        counts = -(-sizes[long] // _CHUNK)
        while counts.max() > 1:
            first = np.cumsum(counts) - counts
            owner, place, part = _split(counts, _LANES)
            begin = first[owner] + place
            h = _chained(lambda rows, k, h=h, begin=begin: h[begin[rows] + k], part, 1)
            counts = -(-counts // _LANES)
        out[long] = mix(h ^ mix(sizes[long].astype(np.uint64)))
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and ``first`` with the words of text ``i`` at ``first[i]:first[i + 1]``."""
        inside = ~SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before, after = np.ones(len(inside), bool), np.ones(len(inside), bool)
        if len(inside):
            before[1:] = ~inside[:-1] | edge[1:-1]
            after[:-1] = ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def owners(first: np.ndarray) -> np.ndarray:
    """For items grouped as ``first[i]:first[i + 1]``, the group of each."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_group(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a value per item over the groups."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Texts can be long, so a Python worker gets few rows and few bytes at a time; one row that is larger comes alone."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:  # sizes with a unit are larger
            spark.conf.set(key, str(most))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, later readers prune columns."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(table: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """Mark a stored table for broadcast if its counted size allows it; else leave it to a shuffled join."""
    limit = BROADCAST_BYTES if limit is None else limit
    return F.broadcast(table) if table.count() * row_bytes <= limit else table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed_apart(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of the given names moved out of the way, and the new names of those columns."""
    taken, moved = {c.lower() for c in df.columns} | {n.lower() for n in names}, {}
    for c in df.columns:
        if c.lower() in names:
            new = c
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            moved[c] = new
    return df.withColumnsRenamed(moved), moved


def renamed_back(df: DataFrame, moved: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({new: old for old, new in moved.items()})


def with_lists(docs: DataFrame, rows: DataFrame, item: F.Column, how: str, broadcast_bytes: int | None = None) -> DataFrame:
    """doc_id, text and ``items``: the list of a document's rows. Lists are as long as the document at most."""
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    lists = stored(rows.groupBy("doc_id").agg(F.collect_list(item).alias("items")), "lists")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    documents, items = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    return docs.join(F.broadcast(lists) if 64 * documents + 40 * items <= limit else lists, "doc_id", how)
