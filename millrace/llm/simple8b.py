"""Token ids in Simple-8b words: the top four bits of a 64-bit word select how many values of which width share the other sixty.

A file is a run of blocks and a footer. A block holds whole documents: its header has the documents' ids and lengths and the
block's distinct token ids by falling frequency; the values packed are ranks in that list, so frequent ids take few bits. The
footer holds the byte offset of each block, so readers fetch and decode blocks one by one, each vectorised.

Values of more than sixty bits take an escape word (selector 0) and a raw word after it.

Files are written in ascending doc_id order by one task per range of ids, under a name of their own for each attempt; the manifest
names those of successful tasks only, so lost executors and repeated tasks leave no doubt.

Edge cases: a null or empty text has just the end id; null doc_ids come first; rows of equal doc_id are ordered by text; an empty
table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import Texts, small_batches, stored
from .tokens import load

MAGIC = b"S8BIDS1\n"
BLOCK_IDS = 1 << 16
#: (values, bits) by selector; selector 0 is the escape. Fixed values of the format.
SELECTORS = [(1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNTS = np.array([n for n, _ in SELECTORS])
_LIMITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_WIDTH = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def pack(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 64-bit values, each word filled as far as the next values allow."""
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64)
    padded = np.zeros(n + 64, np.uint64)
    padded[:n] = values
    width = _WIDTH[padded] if n and values.max() < len(_WIDTH) else np.searchsorted(_LIMITS, padded, side="right").astype(np.uint8)
    widest = {1: width}
    for k in (1, 2, 4, 8, 16):  # widest[k][i]: most bits among the k values from i on
        w = widest[k]
        widest[2 * k] = np.concatenate([np.maximum(w[:-k], w[k:]), w[-k:]])
    selector = np.zeros(n, np.uint8)
    for s in range(len(SELECTORS) - 1, 0, -1):
        count, bits = SELECTORS[s]
        k = 1 << (count.bit_length() - 1)
        w = np.maximum(widest[k][:n], widest[k][count - k : count - k + n])
        selector[w <= bits] = s
    steps, at, places = _COUNTS[selector].astype(np.uint8).tobytes(), 0, []
    while at < n:
        places.append(at)
        at += steps[at]
    places = np.array(places)
    chosen = selector[places]
    slot = np.cumsum(1 + (chosen == 0)) - 1 - (chosen == 0)
    out = np.zeros(slot[-1] + 1 + (chosen[-1] == 0), np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = chosen == s
        if not mine.any():
            continue
        if s == 0:
            out[slot[mine] + 1] = padded[places[mine]]
            continue
        group = padded[places[mine][:, None] + np.arange(count)]
        shifted = group << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
        out[slot[mine]] = np.bitwise_or.reduce(shifted, axis=1) | np.uint64(s << 60)
    return out


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of Simple-8b words."""
    selector = (words >> np.uint64(60)).astype(np.uint8)
    head = np.ones(len(words), bool)
    raw_until = -1
    for i in np.flatnonzero(selector == 0).tolist():  # a raw word is no head, whatever its bits
        if i > raw_until:
            raw_until = i + 1
    if raw_until >= 0:
        skip = False
        for i in range(len(words)):
            head[i] = not skip
            skip = not skip and selector[i] == 0
    at = np.flatnonzero(head)
    chosen = selector[at]
    ends = np.cumsum(_COUNTS[chosen])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = chosen == s
        if not mine.any():
            continue
        first = ends[mine] - count
        if s == 0:
            out[first] = words[at[mine] + 1]
            continue
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
        out[first[:, None] + np.arange(count)] = (words[at[mine]][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out[:n]


def encode_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, null_ids: np.ndarray) -> bytes:
    often = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)  # as long as the vocabulary at most
    distinct = np.flatnonzero(often)
    distinct = distinct[np.argsort(-often[distinct], kind="stable")]
    rank = np.zeros(len(often), np.uint64)
    rank[distinct] = np.arange(len(distinct), dtype=np.uint64)
    words = pack(rank[ids])
    head = struct.pack("<4Q", len(doc_ids), len(ids), len(distinct), len(words))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), null_ids.astype("u1").tobytes(), lengths.astype("<u8").tobytes(),
                     distinct.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def decode_block(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths, ids and the mask of null doc_ids of a block."""
    docs, n, distinct, words = struct.unpack_from("<4Q", raw)
    at, parts = 32, []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", distinct), ("<u8", words)):
        parts.append(np.frombuffer(raw, kind, count, at))
        at += parts[-1].nbytes
    doc_ids, nulls, lengths, names, packed = parts
    return doc_ids, lengths.astype(np.int64), names[unpack(packed, n).astype(np.int64)], nulls.astype(bool)


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


class Writer:
    def __init__(self, uri: str):
        files, path = _open(uri)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.offsets, self.at = files.open_output_stream(path), [], 0
        self._put(MAGIC)

    def _put(self, raw: bytes):
        self.out.write(raw)
        self.at += len(raw)

    def block(self, *parts):
        self.offsets.append(self.at)
        self._put(encode_block(*parts))

    def close(self):
        offsets = np.array([*self.offsets, self.at], "<u8").tobytes()
        self._put(offsets + struct.pack("<Q", len(self.offsets)) + MAGIC)
        self.out.close()


def read_blocks(uri: str):
    """Blocks of a file, one in memory at a time."""
    files, path = _open(uri)
    with files.open_input_file(path) as f:
        size = f.size()
        count, magic = struct.unpack("<Q8s", f.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"no token file: {uri}")
        offsets = np.frombuffer(f.read_at(8 * (count + 1), size - 16 - 8 * (count + 1)), "<u8").astype(np.int64)
        for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            yield decode_block(f.read_at(end - begin, begin))


def in_ranges(docs: DataFrame, parts: int) -> DataFrame:
    """(part, doc_id, text): every part holds a range of doc_ids, in order; the cuts are quantiles of the ids."""
    cuts = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    part = F.size(F.filter(F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<bigint>"), lambda c: c < F.col("doc_id")))
    return (docs.select(F.when(F.col("doc_id").isNull(), 0).otherwise(part).alias("part"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
            .repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "text"))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the ids of all texts; return the stored manifest (part, path, n_docs, n_ids, start)."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, writer, part, n_docs, n_ids = load(tokenizer), None, 0, 0, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0
        uri = f"{folder}/{uuid.uuid4().hex}.s8b"

        def flush():
            ids = np.frombuffer(b"".join(raw for _, raw in held), "<u4")
            writer.block(np.array([d or 0 for d, _ in held], np.int64), np.array([len(raw) // 4 for _, raw in held]), ids,
                         np.array([d is None for d, _ in held]))

        for b in batches:
            coded = encoder.ids_of(Texts(b.column("text")))
            for p, doc, raw in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), coded):
                if writer is None:
                    writer, part = Writer(uri), p
                raw += end
                held.append((doc, raw))
                size += len(raw) // 4
                n_docs, n_ids = n_docs + 1, n_ids + len(raw) // 4
                if size >= block_ids:
                    flush()
                    held, size = [], 0
        if writer is not None:
            if held:
                flush()
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": [uri], "n_docs": pa.array([n_docs], pa.int64()),
                                              "n_ids": pa.array([n_ids], pa.int64())})

    manifest = stored(in_ranges(docs, parts).mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return stored(manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "token-files")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""

    def run(frames):
        for frame in frames:
            for path, start in zip(frame["path"], frame["start"]):
                for doc_ids, lengths, ids, nulls in read_blocks(path):
                    ends = np.cumsum(lengths)
                    begins = ends - lengths
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist())]
                    yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64").copy(), "start": start + begins, "n_tokens": lengths,
                                        "ids_crc32": np.array(crc, np.int64)}).assign(doc_id=lambda d: d["doc_id"].mask(nulls))
                    start += int(ends[-1])

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (manifest.select("path", "start").repartition(parts, "path")
            .mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write all documents as token files in the shared folder and describe each document as read back from them."""
    folder = scratch_dir(docs.sparkSession, "token-ids")
    return read_token_files(write_token_files(docs, tokenizer, end_id, folder))
