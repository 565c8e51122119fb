"""Substring dedup by recompression.

Every document's words are parsed bottom-up in rounds. A round first names runs of one symbol, then pairs whose first symbol falls on
the left and whose second on the right of a split of all names. Names are 64-bit fingerprints of what they stand for, so all tasks
give equal substrings equal names without asking each other. Each symbol also carries the span of words its derivation looked at:
a window that holds this span gets the same symbol wherever else it stands. So every window has an anchor that depends on nothing but
its own words: of the symbols whose span it holds, the one with the least name, known by that name and the words of its span.

Spark then works with anchors, a row per some twenty words. Anchors whose symbol occurs in one document are dropped. Consecutive
windows with one anchor form a stretch; equal stretches (symbol and fingerprint of all their words) form a class, and a stretch
whose class starts in a smaller document is covered as a whole. Where a symbol has several classes, the documents that own a class
compare their single windows, which verifies the repeats at the borders of shared passages. Windows are judged on the input.

Counts per symbol are partial aggregates, and a symbol or class with many rows is broadcast to them, so a passage in a third of all
documents is never gathered in one task.

Edge cases: a null or empty text has no words and keeps nothing; documents shorter than a window lose nothing; null doc_ids give and
lose nothing; rows with equal doc_id count as one document and do not cover each other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Texts, mix, owners, small_batches, stored, with_lists

WINDOW = 50
LEVELS = 3
#: Words a symbol may span; the limit is local, so it keeps names consistent.
LONGEST = 8
#: Groups with more than one ``HOT_GROUPS``-th of the rows are hot. There are fewer than ``HOT_GROUPS`` of them in a table of any size, so
#: their list is broadcast and their rows are not shuffled.
HOT_GROUPS = 2048
_U = np.uint64


def _name(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = mix(out * _U(0x9FB21C651E98DF25) + p)
    return out


class Symbols:
    """Symbols of all documents of a batch: name, words ``start:end``, and the words ``low:high`` their derivation looked at.

    At a document's edge the span reaches outside, as the parse might differ where the words go on.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray):
        doc = owners(first)
        at = np.arange(len(words))
        self.name, self.start, self.end, self.low, self.high, self.doc = words, at, at + 1, at, at + 1, doc
        self.begin, self.finish = first[:-1], first[1:]

    def _around(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the left neighbour's span starts and where the right neighbour's ends."""
        left, right = self.begin[self.doc] - 1, self.finish[self.doc] + 1
        inner = self.doc[1:] == self.doc[:-1]
        left[1:] = np.where(inner, self.low[:-1], left[1:])
        right[:-1] = np.where(inner, self.high[1:], right[:-1])
        return left, right

    def _keep(self, mask, name, end, low, high):
        self.name, self.start, self.end, self.low, self.high, self.doc = name[mask], self.start[mask], end[mask], low[mask], high[mask], self.doc[mask]

    def runs(self, longest: int) -> None:
        m = len(self.name)
        if not m:
            return
        left, right = self._around()
        new = np.ones(m, bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], m) - 1
        run = np.cumsum(new) - 1
        count = tail - head + 1
        short = self.end[tail] - self.start[head] <= longest
        merged = (count > 1) & short
        # Of a run that is too long, each symbol looks as far as it must to see that.
        at = np.arange(m)
        reach = -(-longest // (self.end - self.start))
        before, after = at - reach, at + reach
        far = ~short[run]
        low = np.where(far & (before >= head[run]), self.low[np.maximum(before, 0)], left[head][run])
        high = np.where(far & (after <= tail[run]), self.high[np.minimum(after, m - 1)], right[tail][run])
        name, end = self.name.copy(), self.end.copy()
        name[head[merged]] = _name(self.name[head[merged]], count[merged].astype(np.uint64))
        end[head[merged]] = self.end[tail[merged]]
        self._keep(new | ~merged[run], name, end, low, high)

    def pairs(self, level: int, longest: int) -> None:
        m = len(self.name)
        if not m:
            return
        left, right = self._around()
        on_left = (mix(self.name + _U(level + 1)) >> _U(63)) == 0
        joined = np.zeros(m, bool)
        joined[:-1] = on_left[:-1] & ~on_left[1:] & (self.doc[1:] == self.doc[:-1]) & (self.end[1:] - self.start[:-1] <= longest)
        second = np.zeros(m, bool)
        second[1:] = joined[:-1]
        first = np.flatnonzero(joined)
        name, end = self.name.copy(), self.end.copy()
        # A symbol on the left looked at its right neighbour only, one on the right at its left neighbour.
        low, high = np.where(on_left, self.low, left), np.where(on_left, right, self.high)
        low[first], high[first] = self.low[first], self.high[first + 1]
        name[first], end[first] = _name(self.name[first], self.name[first + 1]), self.end[first + 1]
        self._keep(~second, name, end, low, high)


class WordRanges:
    """Fingerprints of ranges of words."""

    def __init__(self, words: np.ndarray):
        base = 0xD6E8FEB86659FD93
        steps = np.full((2, len(words) + 1), base, np.uint64)
        steps[1] = pow(base, -1, 1 << 64)
        steps[:, 0] = 1
        powers, self.inverse = np.cumprod(steps, axis=1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def anchors(words: np.ndarray, first: np.ndarray, window: int = WINDOW, levels: int = LEVELS, longest: int = LONGEST):
    """Stretches of windows with one anchor: (document, symbol name, fingerprint, first window, windows)."""
    sizes = np.diff(first)
    starts = [np.arange(a, b - window + 1) for a, b in zip(first[:-1].tolist(), first[1:].tolist()) if b - a >= window]
    if not starts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    p = np.concatenate(starts)
    doc = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - window + 1))
    s = Symbols(words, first)
    for level in range(levels):
        s.runs(longest)
        s.pairs(level, longest)
    # Spans rise along the text, so the symbols a window holds are neighbours.
    least, most = np.searchsorted(s.low, p, side="left"), np.searchsorted(s.high, p + window, side="right") - 1
    none = most < least
    least, most = np.where(none, 0, least), np.where(none, 0, most)
    depth = np.log2(most - least + 1).astype(np.int64)
    tables = [(mix(s.name) & ~_U(0xFFFFFFFF)) | np.arange(len(s.name), dtype=np.uint64)]  # the leftmost wins ties
    for k in range(int(depth.max())):
        half = 1 << k
        tables.append(np.concatenate([np.minimum(tables[-1][:-half], tables[-1][half:]), tables[-1][-half:]]))
    stacked = np.stack(tables)
    best = np.minimum(stacked[depth, least], stacked[depth, most - (1 << depth) + 1])
    chosen = (best & _U(0xFFFFFFFF)).astype(np.int64)
    chosen = np.where(none, -1 - p, chosen)  # a window that holds no symbol's span is its own anchor
    change = np.ones(len(p), bool)
    change[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(change)
    count = np.diff(np.append(at, len(p)))
    begin, end = p[at], p[at] + count - 1 + window
    ranges = WordRanges(words)
    prints = ranges.of(begin, end)
    symbol = np.maximum(chosen[at], 0)
    offset = np.where(chosen[at] < 0, 0, s.start[symbol] - begin)
    # The words a symbol's derivation looked at are in every window it anchors: they make its name rare.
    seen = ranges.of(np.maximum(s.low[symbol], 0), np.minimum(s.high[symbol], len(words)))
    key = np.where(chosen[at] < 0, mix(prints), _name(s.name[symbol], seen))
    prints = _name(prints, offset.astype(np.uint64))
    # Equal windows in a row, as in a run of one word, are one stretch.
    owner = doc[at]
    again = np.zeros(len(at), bool)
    again[1:] = ((key[1:] == key[:-1]) & (prints[1:] == prints[:-1]) & (owner[1:] == owner[:-1]) & (count[1:] == 1) & (count[:-1] == 1))
    head = np.flatnonzero(~again)
    return owner[head], key[head], prints[head], (begin - first[owner])[head], np.add.reduceat(count, head)


def stretches(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, symbol, print, first_window, windows) of every document."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = Texts(b.column("text"))
            starts, ends, first = texts.words()
            doc, key, prints, begin, count = anchors(texts.hashes(starts, ends), first, window)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc)), pa.array(key.view(np.int64)), pa.array(prints.view(np.int64)),
                 pa.array(begin.astype(np.int32)), pa.array(count.astype(np.int32))], ["doc_id", "symbol", "print", "first_window", "windows"])

    return (docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, symbol long, print long, first_window int, windows int"))


def window_prints(docs: DataFrame, wanted: DataFrame, window: int, broadcast_bytes: int) -> DataFrame:
    """(symbol, print, doc_id, at) of every single window of the wanted stretches."""

    def run(batches):
        for b in batches:
            texts = Texts(b.column("text"))
            starts, ends, first = texts.words()
            ranges = WordRanges(texts.hashes(starts, ends))
            items = b.column("items")
            flat = items.flatten()
            owner = np.repeat(np.arange(b.num_rows), np.diff(items.offsets.to_numpy()))
            begin, count = flat.field("first_window").to_numpy(), flat.field("windows").to_numpy()
            each = np.repeat(np.arange(len(begin)), count)
            at = begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            p = first[:-1][owner[each]] + at
            ok = p + window <= first[1:][owner[each]]  # a row that repeats the doc_id may hold another text
            each, at, p = each[ok], at[ok], p[ok]
            yield pa.RecordBatch.from_arrays(
                [flat.field("symbol").take(pa.array(each)), pa.array(ranges.of(p, p + window).view(np.int64)),
                 b.column("doc_id").take(pa.array(owner[each])), pa.array(at.astype(np.int32))], ["symbol", "print", "doc_id", "at"])

    listed = with_lists(docs, wanted, F.struct("symbol", "first_window", "windows"), "inner", broadcast_bytes)
    return listed.mapInArrow(run, "symbol long, print long, doc_id long, at int")


def joined_in_parts(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, spread: str | None = None) -> DataFrame:
    """Inner join of stored ``rows`` with stored ``groups``, one row per key with its number of rows ``n``; ``total`` is no less than the sum of ``n``.

    Rows of hot groups meet the broadcast list of these groups where they are read; only the others are shuffled. So nothing has to be
    spread, and ``spread``, the column for it, is not read any more.
    """
    is_hot = F.col("n") * HOT_GROUPS > total
    hot, others = groups.filter(is_hot).drop("n"), groups.filter(~is_hot).drop("n")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(others, keys))


def shared_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The groups of rows that are in more than one document: their least doc_id ``low`` and number of rows ``n``."""
    found = rows.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    return found.filter("low < high").drop("high")


def covered_ranges(docs: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, begin, end): disjoint ranges of words of a document that lie in windows which also start in a smaller doc_id."""
    every = stored(stretches(docs, window), "stretches")
    shared = stored(shared_by(every, ["symbol"]).drop("low"), "shared-symbols")
    some = stored(joined_in_parts(every, shared, ["symbol"], every.count()), "shared-stretches")

    classes = stored(some.groupBy("symbol", "print").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")), "classes")
    owned = stored(joined_in_parts(some, classes, ["symbol", "print"], some.count()), "owned-stretches")
    whole = owned.filter("owner < doc_id").select("doc_id", F.col("first_window").alias("begin"), (F.col("first_window") + F.col("windows") - 1 + window).alias("end"))

    heads = owned.filter("owner = doc_id").select("doc_id", "symbol", "first_window", "windows")
    mixed = stored(shared_by(heads, ["symbol"]).drop("low"), "mixed-symbols")
    wanted = stored(joined_in_parts(heads, mixed, ["symbol"], owned.count()), "border-stretches")
    prints = stored(window_prints(docs, wanted, window, broadcast_bytes), "border-windows")
    least = stored(shared_by(prints, ["symbol", "print"]), "border-classes")
    single = (joined_in_parts(prints, least, ["symbol", "print"], prints.count()).filter("low < doc_id")
              .select("doc_id", F.col("at").alias("begin"), (F.col("at") + window).alias("end")))

    # Join what overlaps, so a document keeps few ranges.
    along = Window.partitionBy("doc_id").orderBy("begin", "end")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    marked = whole.unionByName(single).withColumn("gap", F.when(F.col("begin") <= F.max("end").over(before), 0).otherwise(1))
    return (marked.withColumn("island", F.sum("gap").over(along.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("doc_id", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("island"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, ``kept``: the words left, joined by one space."""
    ranges = covered_ranges(docs, window, broadcast_bytes)

    def run(batches):
        for b in batches:
            texts = Texts(b.column("text"))
            n_words, n_removed, digest, kept = [], [], [], []
            for i, found in enumerate(b.column("items").to_pylist()):
                words = texts.text(i).split()
                n = len(words)
                if found:
                    keep = np.ones(n, bool)
                    for r in found:
                        keep[r["begin"] : r["end"]] = False
                    words = [words[k] for k in np.flatnonzero(keep).tolist()]
                left = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace"))
            columns = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    listed = with_lists(docs, ranges, F.struct("begin", "end"), "left", broadcast_bytes)
    return listed.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
