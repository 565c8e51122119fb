"""Token counts by a two-tier lookup, without a shuffle of pre-tokens.

Texts are cut into pieces at places no pre-token can span. Tier one is a compact hash table, broadcast to all tasks: hashes and token
counts of the ``TABLE_PIECES`` pieces that the tokenizer's vocabulary names as the most frequent ones (entries are numbered in the order
they were merged). So it needs no pass over the texts, and nothing of the corpus is shuffled or sent to the driver. Tier two counts the
pieces that miss through the table of the Python worker, which asks the library once for each piece it has not met.
The tables only save work: counts are those of the library whatever they hold.

Edge cases: null and empty texts have no bytes and no tokens; texts with the tokenizer's special strings, and texts for a tokenizer
of another kind, go through the library whole; rows with equal doc_id are counted row by row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, owners, small_batches
from .tokens import CACHE_WORDS, Encoder, WordTable, load, pieces

#: Entries of tier one: 16 bytes each, so the table stays below 2 MB whatever the corpus.
TABLE_PIECES = 1 << 16
_TIERS: dict[str, "Met"] = {}


class Lengths:
    """Open-addressed table from a piece's hash to its token count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        bits = max(4, int(2 * max(1, len(hashes)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.probes = 1
        for h, n in zip(hashes.tolist(), counts.tolist()):
            at, probe = h >> int(self.shift), 1
            while self.values[at] >= 0:
                at, probe = (at + 1) & self.mask, probe + 1
            self.keys[at], self.values[at] = h, n
            self.probes = max(self.probes, probe)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Token counts, -1 where the table has no entry."""
        out = np.full(len(hashes), -1, np.int32)
        open_ = np.arange(len(hashes))
        at = (hashes >> self.shift).astype(np.int64)
        for _ in range(self.probes):
            hit = self.keys[at] == hashes[open_]
            out[open_[hit]] = self.values[at[hit]]
            more = ~hit & (self.values[at] >= 0)
            open_, at = open_[more], (at[more] + 1) & self.mask
            if not len(open_):
                break
        return out


class Met:
    """Tier two: token counts of the pieces a worker has met; a full table starts anew."""

    def __init__(self, encoder: Encoder, most: int = CACHE_WORDS):
        self.encoder, self.table, self.most = encoder, WordTable(), most

    def counts(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if self.table.n > self.most:
            self.table = WordTable()
        entry = self.table.find(hashes)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, where = np.unique(hashes[missing], return_index=True)
            at = missing[where]
            raw = texts.data.tobytes()
            names = [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            known = self.encoder.fill(set(names), b"\n", self.encoder.feed)
            self.table.add(new, np.ones(len(new), np.int32), np.array([len(known[w]) >> 2 for w in names], np.uint32))
            entry[missing] = self.table.find(hashes[missing])
        return self.table.gather(entry)[0].astype(np.int64)


def met(tokenizer: str) -> Met:
    """Tier two of this worker process."""
    if tokenizer not in _TIERS:
        _TIERS[tokenizer] = Met(load(tokenizer))
    return _TIERS[tokenizer]


def vocabulary_pieces(encoder: Encoder, size: int = TABLE_PIECES) -> list[bytes]:
    """The first ``size`` entries of the vocabulary that are whole characters and no special strings."""
    ids = [[i] for i in range(encoder.tokenizer.get_vocab_size())]
    names = encoder.tokenizer.decode_batch(ids, skip_special_tokens=False)
    found = dict.fromkeys(t.encode() for t in names if t and "\ufffd" not in t)
    return [t for t in found if not encoder.has_special(t)][:size]


def build_table(tokenizer: str, size: int = TABLE_PIECES) -> Lengths:
    """Tier one: at most ``size`` pieces; empty for a tokenizer that is not counted by pieces."""
    encoder = Encoder(tokenizer)
    names = vocabulary_pieces(encoder, size) if encoder.by_pieces else []
    texts = Texts(pa.array(names, pa.binary()))
    return Lengths(texts.hashes(texts.offsets[:-1], texts.offsets[1:]), np.array([encoder.count(n) for n in names], np.int64))


def count_batch(texts: Texts, tier: Met, table: Lengths) -> np.ndarray:
    """Tokens of every text of a batch."""
    encoder = tier.encoder
    if not encoder.by_pieces:
        return np.array([len(raw) // 4 for raw in encoder.ids_of(texts)], np.int64)
    starts, ends, first = pieces(texts)
    hashes = texts.hashes(starts, ends)
    n = table.find(hashes).astype(np.int64)
    missing = np.flatnonzero(n < 0)
    n[missing] = tier.counts(texts, starts[missing], ends[missing], hashes[missing])
    out = np.bincount(owners(first), weights=n, minlength=texts.n).astype(np.int64)
    if encoder.has_special(texts.data.tobytes()):
        for i in range(texts.n):
            text = texts.text(i)
            if encoder.has_special(text):
                out[i] = len(encoder.whole(text)) // 4
    return out


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, table_pieces: int = TABLE_PIECES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(build_table(tokenizer, table_pieces))

    def run(batches):
        tier, table = met(tokenizer), shared.value
        for b in batches:
            texts = Texts(b.column("text"))
            n = count_batch(texts, tier, table)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(texts.offsets)), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    counted = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
               .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
