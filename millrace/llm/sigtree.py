"""N-gram Jaccard join with signature trees.

1. One pass gives each document's set size, a fingerprint of its whole set and a token bitmap of two to four bits per shingle.
   Documents with equal sets form one class, represented by the smallest doc_id.
2. Two sets of Jaccard similarity t share a shingle among the first ``n - ceil(t n) + 1`` of either, in any common order. The order
   used puts frequent shingles last and salts them. Every shingle of such prefixes has a leader, the smallest document holding it; documents with
   one leader form a block, so a near pair meets in a block, few blocks at that, and rows stay linear in the prefixes.
3. In a block, a signature tree: nodes hold the OR of their members' bitmaps and the range of their set sizes. A dual traversal drops
   node pairs whose greatest possible overlap is too small. Members left with a partner are live.
4. The sets of live members are sent to their blocks, and the same traversal verifies surviving pairs exactly. It keeps components
   while it runs: node pairs inside one component need no more work, so a group of copies costs no square. A first run over one block
   per document joins most of each group; a second one takes just the members that may link different components, again by their
   bitmaps, in pairs of chunks where a block is large. Components of the verified links are found in Spark.

No step emits pairs within a group; only verified links of a spanning forest leave a task.

Edge cases: null or empty texts, or texts without words, have an empty set and are linked with nothing; fewer words than a shingle
give one shingle of all words; equal rows form one class; a null doc_id is kept, gives no link and has the component of a
class with an equal set, or null; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, bounded, mix, renamed_apart, renamed_back, small_batches, stored, with_lists
from .components import components

WORDS, PERCENT = 5, 75
FANOUT = 16
#: Members of one block that a task holds at once; larger blocks are split into chunks, and chunks meet in pairs.
CHUNK = 1024
#: Shingles known to be frequent are put last: a bounded table, and only an order, so it drops nothing.
FREQUENT = 1 << 17
_LOCAL = 4


def shingle_sets(texts: Texts, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    starts, ends, first = texts.words()
    h = texts.hashes(starts, ends)
    n = len(h)
    full = np.zeros(n, np.uint64)
    if n >= words:
        acc = np.zeros(n - words + 1, np.uint64)
        for k in range(words):
            acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + h[k : n - words + 1 + k] + np.uint64(k + 1))
        full[: len(acc)] = acc
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            acc = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + h[k : k + 1])
            out.append(acc)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bitmap(s: np.ndarray) -> np.ndarray:
    """A token bitmap of 2**k bits, two to four per shingle and 64 at least, as uint64 words. Halves fold onto each other by OR."""
    bits = max(64, 1 << int(2 * max(1, len(s)) - 1).bit_length())
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def folded(b: np.ndarray, words: int) -> np.ndarray:
    while len(b) > words:
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return b


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


class Forest:
    """Union-find over the members of a task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.parent[max(a, b)] = min(a, b)


class Block:
    """Members of a block as one signature tree per bitmap width.

    ``sets`` may be None: then pairs whose bounds allow a link only make both members live.
    """

    def __init__(self, sizes: np.ndarray, maps: list[np.ndarray], sets: list[np.ndarray] | None, comp: np.ndarray, percent: int = PERCENT,
                 fanout: int = FANOUT, side: np.ndarray | None = None):
        self.n, self.sets, self.percent, self.fanout = len(sizes), sets, percent, fanout
        # Neighbours in the order of width, size and bitmap share leaves, so their OR stays sparse.
        width = np.array([len(m) for m in maps])
        order = sorted(range(self.n), key=lambda i: (width[i], comp[i], sizes[i], maps[i].tobytes()))
        self.order = np.array(order, np.int64)
        self.sizes, self.comp, self.width = sizes[self.order], comp[self.order], width[self.order]
        self.maps = [maps[i] for i in order]
        self.side = (side if side is not None else np.zeros(self.n, int))[self.order]
        self.crossing = side is not None
        self.live = np.zeros(self.n, bool)
        self.links: list[tuple[int, int]] = []
        self.forest = Forest(self.n)
        seen: dict = {}
        for i, c in enumerate(self.comp.tolist()):
            self.forest.join(seen.setdefault(c, i), i)
        self.checked = 0

    def _levels(self, at: np.ndarray, words: int):
        """Node arrays from leaves up: (bitmaps, least size, greatest size, begin, end, spare, least and greatest component)
        with members ``at[begin:end]``.

        ``spare`` is the most by which a member's size exceeds the bits it sets.
        """
        maps = np.stack([folded(self.maps[i], words) for i in at.tolist()])
        sizes = self.sizes[at]
        levels, begin = [], np.arange(len(at))
        comp = self.comp[at]
        level = (maps, sizes, sizes, begin, begin + 1, sizes - np.bitwise_count(maps).sum(1, dtype=np.int64), comp, comp)
        levels.append(level)
        while len(level[1]) > 1:
            cut = np.arange(0, len(level[1]), self.fanout)
            last = np.minimum(cut + self.fanout, len(level[1])) - 1
            level = (np.bitwise_or.reduceat(level[0], cut, axis=0), np.minimum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut),
                     level[3][cut], level[4][last], np.maximum.reduceat(level[5], cut), np.minimum.reduceat(level[6], cut),
                     np.maximum.reduceat(level[7], cut))
            levels.append(level)
        return levels

    def _possible(self, la, i, lb, j) -> np.ndarray:
        """Whether nodes ``i`` and ``j`` (arrays) may hold a linked pair, by sizes and by the greatest possible overlap."""
        p = self.percent
        low_a, high_a, low_b, high_b = la[1][i], la[2][i], lb[1][j], lb[2][j]
        low, high = np.minimum(la[6][i], lb[6][j]), np.maximum(la[7][i], lb[7][j])
        # Nodes of one component, known from before, need no work; a member meets itself only at the leaves.
        ok = (100 * high_a >= p * low_b) & (100 * high_b >= p * low_a) & (low < high)
        at = np.flatnonzero(ok)
        if len(at):
            # Shared shingles lie on shared bits: one on each, and as many more as a member has shingles beyond its bits.
            bits = np.bitwise_count(la[0][i[at]] & lb[0][j[at]]).sum(1, dtype=np.int64)
            overlap = np.minimum(np.minimum(high_a[at], high_b[at]), bits + np.minimum(la[5][i[at]], lb[5][j[at]]))
            ok[at] = (100 + p) * overlap >= p * (low_a[at] + low_b[at])
        return ok

    def _same(self, at_a, begin_a, end_a, at_b, begin_b, end_b) -> bool:
        """Whether both nodes lie in one component, or need no more work."""
        if self.sets is None:
            return bool(self.live[at_a[begin_a:end_a]].all() and self.live[at_b[begin_b:end_b]].all())
        root = self.forest.find(int(at_a[begin_a]))
        return all(self.forest.find(int(x)) == root for x in at_a[begin_a:end_a]) and all(
            self.forest.find(int(x)) == root for x in at_b[begin_b:end_b])

    def _pair(self, x: int, y: int) -> None:
        if x == y or (self.crossing and self.side[x] == self.side[y]):
            return
        if self.sets is None:
            if self.comp[x] != self.comp[y]:
                self.live[x] = self.live[y] = True
            return
        if self.forest.find(x) == self.forest.find(y):
            return
        self.checked += 1
        a, b = self.sets[self.order[x]], self.sets[self.order[y]]
        shared = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * shared >= self.percent * (len(a) + len(b) - shared):
            self.forest.join(x, y)
            self.links.append((int(self.order[x]), int(self.order[y])))

    def run(self) -> "Block":
        widths = np.unique(self.width)
        for k, w in enumerate(widths.tolist()):
            mine = np.flatnonzero(self.width == w)
            levels = self._levels(mine, w)
            self._dual(mine, levels, mine, levels)
            # Near sets differ in size by a third at most: one step of width.
            for v in widths[k + 1 :].tolist():
                if v == 2 * w:
                    other = np.flatnonzero(self.width == v)
                    self._dual(mine, levels, other, self._levels(other, w))
        return self

    def _dual(self, at_a, la, at_b, lb):
        same = la is lb
        stack = [(len(la) - 1, 0, len(lb) - 1, 0)]
        while stack:
            da, i, db, j = stack.pop()
            a, b = la[da], lb[db]
            if self._same(at_a, a[3][i], a[4][i], at_b, b[3][j], b[4][j]):
                continue
            if da == 0 and db == 0:
                self._pair(int(at_a[i]), int(at_b[j]))
                continue
            # Open the higher node, both when they are level.
            ia = np.arange(i * self.fanout, min((i + 1) * self.fanout, len(la[da - 1][1]))) if da and da >= db else np.array([i])
            jb = np.arange(j * self.fanout, min((j + 1) * self.fanout, len(lb[db - 1][1]))) if db and db >= da else np.array([j])
            na, nb = (da - 1 if da and da >= db else da), (db - 1 if db and db >= da else db)
            ii, jj = np.repeat(ia, len(jb)), np.tile(jb, len(ia))
            if same and na == nb:
                keep = ii <= jj
                ii, jj = ii[keep], jj[keep]
            if na == nb == 0 and same:
                keep = ii < jj
                ii, jj = ii[keep], jj[keep]
            ok = self._possible(la[na], ii, lb[nb], jj)
            stack.extend((na, x, nb, y) for x, y in zip(ii[ok].tolist()[::-1], jj[ok].tolist()[::-1]))


_SIGNATURES = "doc_id long, n_shingles long, key binary, bits binary, frequent array<long>"


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per document: set size, set fingerprint, bitmap; and, once per batch, shingles that are frequent in it."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            sets = shingle_sets(Texts(b.column("text"), lower=True), words)
            frequent: list = [None] * len(sets)
            if sets:
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                frequent[0] = h[n >= _LOCAL].view(np.int64)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), pa.array(frequent, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "key", "bits", "frequent"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SIGNATURES)


def prefixes(docs: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """(shingle, salt, doc_id) for the prefix of every set, with frequent shingles last. Equal sets in one task give their rows once.

    Rows of a frequent shingle are salted by document, from 1 on; the salt of others is 0.
    """
    salts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(frequent))

    def run(batches):
        last, seen = shared.value, set()
        for b in batches:
            tokens, ids, salt = [], [], []
            for doc, s in zip(b.column("doc_id").to_pylist(), shingle_sets(Texts(b.column("text"), lower=True), words)):
                if doc is None or not len(s):
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()  # it only saves work
                name = hash(s.tobytes())
                if name in seen:
                    continue
                seen.add(name)
                hot = np.zeros(len(s), bool)
                if len(last):
                    hot = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                part = np.concatenate([s[~hot], s[hot]])[: prefix_length(len(s), percent)]
                tokens.append(part)
                salt.append(np.where(np.arange(len(part)) < len(s) - hot.sum(), 0, 1 + doc % salts).astype(np.int32))
                ids.append(np.full(len(part), doc, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(salt)), pa.array(np.concatenate(ids))],
                                                 ["shingle", "salt", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "shingle long, salt int, doc_id long")


def memberships(prefix: DataFrame, classes: DataFrame) -> DataFrame:
    """(leader, rep): every class in the blocks of its prefix shingles, without blocks of one class."""
    group = Window.partitionBy("shingle", "salt")
    frequent = F.when(F.col("salt") > 0, F.col("shingle"))
    led = (prefix.select("salt", "doc_id", frequent.alias("frequent"), F.min("doc_id").over(group).alias("leader"), F.max("doc_id").over(group).alias("top"))
           .filter("salt > 0 or leader < top").select("frequent", "leader", "doc_id").distinct())
    led = stored(led, "leaders")
    # The salted groups of a frequent shingle share the least of their leaders. There are FREQUENT such shingles at most.
    hot = led.filter("frequent is not null")
    least = hot.groupBy("frequent").agg(F.min("leader").alias("least"))
    all_led = (led.filter("frequent is null").select("leader", "doc_id")
               .unionByName(hot.join(F.broadcast(least), "frequent").select(F.col("least").alias("leader"), "doc_id").distinct()))
    named = stored(all_led.join(classes.select("doc_id", "rep"), "doc_id").select("leader", "rep").distinct(), "memberships")
    several = named.groupBy("leader").agg(F.count("*").alias("n")).filter("n > 1").select("leader")
    return stored(named.join(several, "leader"), "blocks")


def _chunked(members: DataFrame, chunk: int) -> DataFrame:
    """Blocks as units of bounded size: (leader, a, b) with every pair of chunks of a large block; ``side`` tells the two apart."""
    sizes = members.groupBy("leader").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    return (members.join(sizes, "leader").withColumn("c", mine).withColumn("o", other)
            .withColumns({"a": F.least("c", "o"), "b": F.greatest("c", "o"), "side": (F.col("c") > F.col("o")).cast("int")})
            .drop("c", "o", "chunks"))


def _units(df: DataFrame) -> DataFrame:
    """Deal units to tasks, the rows of each side by side."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, "leader", "a", "b").sortWithinPartitions("leader", "a", "b", "rep")


def _grouped(batches):
    """The rows of one unit after the other; a unit has two chunks at most."""
    held, now = [], None
    for b in batches:
        keys = [b.column(k).to_numpy() for k in ("leader", "a", "b")]
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if s == e:
                continue
            key = tuple(int(k[s]) for k in keys)
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _side(t: pa.Table) -> np.ndarray | None:
    return t["side"].to_numpy() if t["a"][0] != t["b"][0] else None


def live_members(members: DataFrame, classes: DataFrame, percent: int, chunk: int) -> DataFrame:
    """The members (leader, rep, comp) that may be near a member of another component in their block, by bitmaps alone."""

    def run(batches):
        for t in _grouped(batches):
            maps = [np.frombuffer(x, np.uint64) for x in t["bits"].to_pylist()]
            block = Block(t["n"].to_numpy(), maps, None, t["comp"].to_numpy(), percent, side=_side(t)).run()
            live = pa.array(np.sort(block.order[block.live]))
            yield from t.select(["leader", "rep", "comp"]).take(live).to_batches()

    bits = classes.filter("doc_id = rep").select("rep", F.col("n_shingles").alias("n"), "bits")
    units = _chunked(members, 4 * chunk).join(bits, "rep")  # bitmaps are small next to sets
    return _units(units).mapInArrow(run, "leader long, rep long, comp long").distinct()


def verified_links(docs: DataFrame, units: DataFrame, words: int, percent: int, broadcast_bytes: int | None = None) -> DataFrame:
    """(u, v): links of a spanning forest of every unit (leader, a, b), on top of the components the members already have.

    The sets of a unit's members come straight from the representatives' texts, one shuffle for each member of a unit.
    """

    def sets(batches):
        for b in batches:
            items = b.column("items")
            owner = np.repeat(np.arange(b.num_rows), np.diff(items.offsets.to_numpy()))
            tokens = pa.array([s.tobytes() for s in shingle_sets(Texts(b.column("text"), lower=True), words)], pa.binary())
            flat = items.flatten()
            columns = [flat.field(c) for c in ("leader", "a", "b", "side", "comp")]
            for at in range(0, len(owner), 64):  # a text in many units is copied in small batches
                some = pa.array(owner[at : at + 64])
                yield pa.RecordBatch.from_arrays([*[c.slice(at, 64) for c in columns], b.column("doc_id").take(some), tokens.take(some)],
                                                 ["leader", "a", "b", "side", "comp", "rep", "tokens"])

    def run(batches):
        for t in _grouped(batches):
            members = [np.frombuffer(x, np.uint64) for x in t["tokens"].to_pylist()]
            block = Block(np.array([len(s) for s in members]), [bitmap(s) for s in members], members, t["comp"].to_numpy(), percent, side=_side(t)).run()
            if block.links:
                rep, pairs = t["rep"].to_numpy(), np.array(block.links)
                yield pa.RecordBatch.from_arrays([pa.array(rep[pairs[:, 0]]), pa.array(rep[pairs[:, 1]])], ["u", "v"])

    named = units.select(F.col("rep").alias("doc_id"), "leader", "a", "b", "side", "comp")
    listed = with_lists(docs, named, F.struct("leader", "a", "b", "side", "comp"), "inner", broadcast_bytes)
    placed = listed.mapInArrow(sets, "leader long, a int, b int, side int, comp long, rep long, tokens binary")
    return _units(placed).mapInArrow(run, "u long, v long")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK, frequent_size: int = FREQUENT,
                       broadcast_bytes: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    signed = stored(signatures(docs, words), "signatures")
    frequent = stored(signed.select(F.explode("frequent").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
                      .orderBy(F.desc("n"), "shingle").limit(frequent_size).select("shingle"), "frequent")
    reps = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    classes = stored(signed.select("doc_id", "n_shingles", "key", "bits").join(reps, "key", "left")
                     .select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bits")).alias("bits")), "classes")
    hot = np.array([r["shingle"] for r in frequent.collect()], np.int64).view(np.uint64)  # frequent_size rows at most
    prefix = prefixes(docs, hot, words, percent)
    blocks = memberships(prefix, classes.filter("rep is not null"))
    live = stored(live_members(blocks.withColumn("comp", F.col("rep")), classes, percent, chunk), "live")

    # First run: one block per class, the one of its smallest leader, each chunk for itself.
    main = stored(live.groupBy("rep").agg(F.min("leader").alias("leader")).withColumn("comp", F.col("rep")), "main-blocks")
    alone = _chunked(main, chunk).filter("a = b").distinct()
    links = stored(verified_links(docs, alone, words, percent, broadcast_bytes), "links")
    joined = components(links)

    # Second run: what may still link different components, every pair of chunks.
    placed = stored(live.select("leader", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
                    .select("leader", "rep", F.coalesce("component", "rep").alias("comp")), "placed")
    mixed = placed.groupBy("leader").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("leader")
    still = stored(live_members(placed.join(mixed, "leader"), classes, percent, chunk), "still-live")
    more = stored(links.unionByName(verified_links(docs, _chunked(still, chunk), words, percent, broadcast_bytes)), "all-links")
    final = components(more)
    found = (classes.join(final.withColumnRenamed("node", "rep"), "rep", "left")
             .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")))
    return found


def one_of_each_group(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, broadcast_bytes: int | None = None) -> DataFrame:
    """The documents without near copies, and of each group the one with the smallest doc_id.

    Rows that share their doc_id, and rows without one, are told apart by their text: they go by negative numbers made of a hash of
    doc_id and text, which come before the doc_ids of others. Of rows with equal doc_id and text one stays.
    """
    repeated = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select("doc_id"), "repeated-ids")
    if not repeated.count():
        return _without_copies(docs, words, percent, broadcast_bytes)
    docs, moved = renamed_apart(docs, ("_id", "_again", "_hit"))
    again = bounded(repeated.select(F.col("doc_id").alias("_again"), F.lit(True).alias("_hit")), 16, broadcast_bytes)
    rows = docs.join(again, docs["doc_id"].eqNullSafe(again["_again"]), "left").drop("_again")
    number = -F.abs(F.shiftright(F.xxhash64("doc_id", "text"), 1)) - 1
    named = rows.withColumn("_id", F.when(F.col("_hit"), number).otherwise(F.col("doc_id")))
    # Only the rows of repeated ids are shuffled with their texts.
    once = named.filter("_hit").dropDuplicates(["_id"]).unionByName(named.filter("_hit is null")).drop("_hit")
    once = stored(once.withColumnsRenamed({"doc_id": "_again", "_id": "doc_id"}), "numbered")
    left = _without_copies(once, words, percent, broadcast_bytes)
    return renamed_back(left.drop("doc_id").withColumnRenamed("_again", "doc_id").select(*docs.columns), moved)


def _without_copies(docs: DataFrame, words: int, percent: int, broadcast_bytes: int | None) -> DataFrame:
    found = stored(jaccard_components(docs, words, percent, broadcast_bytes=broadcast_bytes), "near")
    gone = stored(found.filter("component_id <> doc_id").select("doc_id").distinct(), "near-gone")
    return docs.join(bounded(gone, 16, broadcast_bytes), "doc_id", "left_anti").select(*docs.columns)
