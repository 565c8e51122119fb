"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import linededup, mixing, packing, quality, recompression, sigtree, simple8b, tokencounts
from millrace.llm.common import Texts, table
from millrace.llm.queries import QUERIES
from millrace.llm.tokens import Encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, `key` int, lines string, tokens int, n int"
LONG = " ".join(f"w{i % 7919}x{i % 31}" for i in range(30_000))
ODD = [None, "", "   \n\t ", "one", "a b c d", "a  b \n\n c", "x   y z  ", "<|endoftext|> Hi <|STARTOFTEXT|>", "é è ê  ß İ ΑΣ ας é e ́", "\x1c\x1d a\x85b c",
       "'s don't DON'T a'b", "a|b | c.. d., !!", LONG, LONG, "same same same same same same", "A B C D E F", "a b c d e f"]


def odd(spark, texts=ODD):
    rows = [(i, t, "en", None if i % 3 else "s", 1, "r", 1, "l", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "a b c d e f", "en", "s", 1, "r", 1, "l", 2, 3)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


# --- n-gram Jaccard join ---------------------------------------------------------------------------------------------------------------


def brute_components(texts, n=5, percent=75):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    parent = {k: k for k in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def near_copies(seed=5, n=160):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.choice([5, 8, 40, 130]))] for _ in range(6)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = str(rng.randrange(1000))
        out.append(" ".join(w + ["tail"] * rng.randrange(3)))
    return out


@pytest.mark.parametrize("chunk, broadcast", [(1024, None), (8, 0)])
def test_jaccard_components_equal_brute_force(spark, chunk, broadcast):
    rows = [(i, t) for i, t in enumerate(near_copies() + ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sigtree.jaccard_components(df, chunk=chunk, broadcast_bytes=broadcast).collect()}
    assert got == brute_components(dict(rows))


def test_jaccard_order_of_frequent_shingles_changes_nothing(spark):
    rows = list(enumerate(near_copies(9, 90)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 50):
        got = {r.doc_id: r.component_id for r in sigtree.jaccard_components(df, frequent_size=size).collect()}
        assert got == {k: v[1] for k, v in brute_components(dict(rows)).items()}


def test_jaccard_edge_cases(spark):
    got = sigtree.jaccard_components(odd(spark))
    assert got.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(ODD) + 1 and rows[None].component_id == 15 and rows[0].n_shingles == 0 and rows[0].component_id == 0
    assert sigtree.jaccard_components(empty(spark)).count() == 0
    left = sigtree.one_of_each_group(odd(spark))
    assert left.columns == odd(spark).columns and {r.doc_id for r in left.collect()} >= {0, 1, 2, 12} and 13 not in {r.doc_id for r in left.collect()}
    twice = spark.createDataFrame([(4, "a b c d e f g"), (4, "a b c d e f g"), (7, "a b c d e f g")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in sigtree.jaccard_components(twice).collect()) == [(4, 4), (4, 4), (7, 4)]


def test_signature_tree_visits_few_pairs_of_a_copy_group():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 2**63, 200, dtype=np.uint64)
    sets = []
    for _ in range(400):
        s = base.copy()
        s[rng.integers(0, 200, 3)] = rng.integers(1, 2**63, 3, dtype=np.uint64)
        sets.append(np.unique(s))
    block = sigtree.Block(np.array([len(s) for s in sets]), [sigtree.bitmap(s) for s in sets], sets, np.arange(400)).run()
    assert len(block.links) == 399 and block.checked < 2000


# --- substring dedup -------------------------------------------------------------------------------------------------------------------


def brute_repeats(texts, w=50):
    first, out = {}, {}
    split = {k: (t or "").encode().split() for k, t in texts.items()}
    for k, ws in split.items():
        for i in range(len(ws) - w + 1):
            g = tuple(ws[i : i + w])
            first[g] = min(first.get(g, k), k)
    for k, ws in split.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - w + 1):
            if first[tuple(ws[i : i + w])] < k:
                gone[i : i + w] = [True] * w
        kept = b" ".join(x for x, y in zip(ws, gone) if not y)
        out[k] = (len(ws), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def repetitive(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab") for _ in range(400)) for _ in range(5)]
    out = []
    for _ in range(120):
        ws = []
        for _ in range(rng.randint(0, 5)):
            b, i = rng.choice(base), rng.randint(0, 300)
            ws += list(b[i : i + rng.randint(1, 140)])
            if rng.random() < 0.4:
                ws += ["a"] * rng.randint(1, 120)
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize("broadcast", [1 << 24, 0])
def test_repeats_equal_brute_force(spark, broadcast):
    texts = dict(enumerate(repetitive() + ODD))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.remove_repeats(df, broadcast_bytes=broadcast).collect()}
    assert got == brute_repeats(texts)


def test_repeats_edge_cases(spark):
    got = recompression.remove_repeats(odd(spark), with_text=True).collect()
    assert len(got) == len(ODD) + 1 and {r.doc_id: r.kept for r in got}[13] == ""
    assert recompression.remove_repeats(empty(spark)).count() == 0
    text = " ".join(map(str, range(60)))
    twice = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in recompression.remove_repeats(twice).collect()) == [(1, 0), (1, 0), (2, 60)]


def test_hot_groups_are_joined_in_parts(spark, tmp_path):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 900).alias("symbol"), F.col("id").alias("doc_id"),
                                    (F.col("id") % 11).cast("int").alias("first_window"))
    groups = recompression.shared_by(rows, ["symbol"])
    got = recompression.joined_in_parts(rows, groups, ["symbol"], 5000, "first_window")
    assert sorted(map(tuple, got.select("symbol", "doc_id", "first_window", "low").collect())) == sorted(
        map(tuple, rows.join(groups, "symbol").select("symbol", "doc_id", "first_window", "low").collect()))
    hot = groups.filter(F.col("n") * recompression.HOT_GROUPS > 5_000_000).count()
    assert hot == 0 and recompression.joined_in_parts(rows, groups, ["symbol"], 5_000_000, "first_window").count() == got.count()


def shuffled_rows(plan):
    """Rows that the exchanges of a plan without adaptive execution wrote when it ran."""
    own, below = plan.metrics().get("shuffleRecordsWritten"), plan.children()
    return (own.get().value() if own.isDefined() else 0) + sum(shuffled_rows(below.apply(i)) for i in range(below.size()))


def test_rows_of_hot_groups_are_not_shuffled(spark, tmp_path):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for hot in (1000, 4000):
            at = str(tmp_path / str(hot))
            spark.range(3000 + hot).select(F.when(F.col("id") >= 3000, F.lit(-1)).otherwise(F.col("id") % 600).alias("symbol"), F.col("id").alias("doc_id"),
                                           F.lit(0).alias("first_window")).write.parquet(f"{at}/rows")
            rows = spark.read.parquet(f"{at}/rows")
            recompression.shared_by(rows, ["symbol"]).write.parquet(f"{at}/groups")
            got = recompression.joined_in_parts(rows, spark.read.parquet(f"{at}/groups"), ["symbol"], 10 * recompression.HOT_GROUPS, "first_window")
            assert sorted((r.doc_id, r.low) for r in got.collect()) == [(i, 3000 if i >= 3000 else i % 600) for i in range(3000 + hot)]
            plan = got._jdf.queryExecution().executedPlan()
            assert shuffled_rows(plan) == 3000 + 600 and "LeftOuter" not in plan.toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_equal_windows_have_equal_anchors(levels):
    rng = random.Random(levels)
    base = [rng.choice("abc") for _ in range(200)] + ["z"] * 70 + [rng.choice("ab") for _ in range(60)]
    left, right = ["l"] * 7 + base + ["m", "n"], ["r", "z"] + base + ["z"] * 3
    import pyarrow as pa

    t = Texts(pa.array([" ".join(left), " ".join(right)]))
    starts, ends, first = t.words()
    doc, key, _, begin, count = recompression.anchors(t.hashes(starts, ends), first, levels=levels)
    named = [{}, {}]
    for d, k, b, c in zip(doc.tolist(), key.tolist(), begin.tolist(), count.tolist()):
        for p in range(b, b + c):
            named[d][p - (7 if d == 0 else 2)] = k
    assert all(named[0][p] == named[1][p] for p in range(len(base) - 50 + 1))


# --- tokens ----------------------------------------------------------------------------------------------------------------------------


def library(name, texts, end=()):
    t = Tokenizer.from_file(tokenizer_path(name))
    return [t.encode(x or "", add_special_tokens=False).ids + list(end) for x in texts]


def mixed_texts(seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab .,'\n\t|1é  <> \xa0") for _ in range(rng.randrange(80))) for _ in range(150)]


@pytest.mark.parametrize("cache", [4, 100_000])
def test_encoder_equals_the_library(cache):
    texts = [t for t in ODD + mixed_texts() if t]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = Encoder(tokenizer_path(name), cache, cache)
        for at in range(0, len(texts), 7):  # small batches, so tables are dropped and filled again
            some = Texts(pa.array([t.encode() for t in texts[at : at + 7]]))
            assert [np.frombuffer(raw, "<u4").tolist() for raw in e.ids_of(some)] == library(name, texts[at : at + 7])
        assert [np.frombuffer(e.ids(t.encode()), "<u4").tolist() for t in texts] == library(name, texts)


def test_token_counts_equal_the_library(spark):
    texts = ODD + mixed_texts()
    df = odd(spark, texts)
    for size in (0, 64, 1 << 16):
        got = {r.doc_id: r for r in tokencounts.count_tokens(df, tokenizer_path("byte_bpe_50k.json"), limit=20, table_pieces=size).collect()}
        for i, (t, ids) in enumerate(zip(texts, library("byte_bpe_50k.json", texts))):
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), len(ids), len(ids) > 20)
    assert tokencounts.count_tokens(empty(spark), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_token_counts_shuffle_nothing_and_survive_a_full_table(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    df = odd(spark, ODD + mixed_texts())
    assert "Exchange" not in tokencounts.count_tokens(df, path)._jdf.queryExecution().executedPlan().toString()
    tier, table = tokencounts.Met(Encoder(path), most=5), tokencounts.build_table(path, 100)
    texts = [t for t in ODD + mixed_texts() if t]
    for at in range(0, len(texts), 7):
        some = texts[at : at + 7]
        got = tokencounts.count_batch(Texts(pa.array([t.encode() for t in some])), tier, table)
        assert got.tolist() == [len(i) for i in library("byte_bpe_50k.json", some)]


def test_token_files_round_trip(spark, tmp_path):
    df = odd(spark, ODD + mixed_texts())
    manifest = simple8b.write_token_files(df, tokenizer_path("word_bpe_49k.json"), 1, str(tmp_path / "ids"), block_ids=500)
    got = sorted(simple8b.read_token_files(manifest).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (doc, _), ids in zip(got, rows, library("word_bpe_49k.json", [t for _, t in rows], [1]), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert QUERIES["op8_token_files"](spark, SF).count() == table(spark, SF, "documents").count()
    assert simple8b.token_files(empty(spark), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_simple8b_words():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 59, 61, 500):
        for shift in (0, 3, 4, 20, 50, 63, 64 - 1):
            v = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) >> np.uint64(shift)
            packed = simple8b.pack(v)
            assert (simple8b.unpack(packed, n) == v).all()
    assert len(simple8b.pack(np.ones(600, np.uint64))) == 10
    big = np.array([2**64 - 1, 0, 2**60, 5], np.uint64)
    assert (simple8b.unpack(simple8b.pack(big), 4) == big).all()


def test_packing_keeps_every_id_once(spark):
    df = odd(spark, ODD + mixed_texts())
    path = tokenizer_path("word_bpe_49k.json")
    got = packing.pack_documents(df, path, 2, capacity=256).toPandas()
    ids = {i: x for i, x in enumerate(library("word_bpe_49k.json", ODD + mixed_texts(), [2]))}
    for r in got[got.doc_id.notna()].itertuples():
        mine = ids[int(r.doc_id)]
        assert r.doc_tokens == len(mine) and r.ids_crc32 == zlib.crc32(np.array(mine[r.start : r.start + r.length], "<u4").tobytes())
    assert got[got.doc_id.notna()].groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in ids.items()}
    order = got.sort_values(["sequence_id", "offset"])
    assert (order.offset == order.groupby("sequence_id").length.cumsum() - order.length).all()
    assert order.groupby("sequence_id").length.sum().max() <= 256
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_packing_of_whole_documents_is_tight(spark):
    got = QUERIES["op5_cutting_stock_packing"](spark, "/root/testdata/sf0.01").toPandas()
    assert got.length.sum() >= 0.98 * 4096 * got.sequence_id.nunique()


@pytest.mark.parametrize("histogram", [{3: 1}, {1: 5, 2: 7, 16: 3}, {9: 100}, {5: 97, 6: 61, 7: 43, 11: 80}])
def test_cutting_plan_places_each_piece_once(histogram):
    rules, n = packing.plan(histogram, 16)
    load, seen = collections.Counter(), collections.Counter()
    for size, first, per, sequence, uses in rules:
        for k in range(per * uses):
            seen[size, first + k] += 1
            load[sequence + k // per] += size
    assert seen == {(s, r): 1 for s, m in histogram.items() for r in range(m)}
    assert max(load.values()) <= 16 and set(load) == set(range(n))
    alone = sum(m for s, m in histogram.items() if s > 8)  # no two of these share a sequence
    assert n <= max(alone, -(-sum(s * m for s, m in histogram.items()) // 16)) * 1.05 + len(histogram)


# --- quality rules ---------------------------------------------------------------------------------------------------------------------


def brute_statistics(t):
    w = words(t)
    often, mark = collections.Counter(zip(w, w[1:], w[2:])), [0] * len(w)
    for i in range(len(w) - 2):
        if often[tuple(w[i : i + 3])] > 1:
            mark[i] = mark[i + 1] = mark[i + 2] = 1
    seen, again = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), again, sum(mark)


def test_quality_statistics_equal_brute_force(spark):
    df = odd(spark, ODD + mixed_texts() + ["a\nb\na\n\n a\na", "x y z x y z\nx y z x y z"])
    texts = texts_of(df)
    for r in quality.document_statistics(df).collect():
        assert tuple(r[c] for c in quality.BASE) == brute_statistics(texts[r.doc_id])


def test_quality_model_is_accurate_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    half = F.col("doc_id") % 2 == 0
    judged = quality.judge(quality.document_statistics(docs), quality.fit_quality(docs, labels.filter(half)))
    held = judged.join(labels.filter(~half), "doc_id").filter("not base_failed").toPandas()
    assert ((held.score >= 0.5) == (held.quality == 1)).mean() > 0.985


def test_quality_scores_fall_with_monotone_features():
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    y = (x[:, 0] + 0.3 * rng.standard_normal(600) > 0.5).astype(float)  # rises in truth
    falling = quality.fit(x, y, np.array([-1, 0]), rounds=15)
    rising = quality.fit(x, y, np.array([1, 0]), rounds=15)
    grid = np.column_stack([np.linspace(0, 1, 50), np.full(50, 0.4)])
    assert (np.diff(falling.score(grid)) <= 1e-12).all() and (np.diff(rising.score(grid)) >= -1e-12).all()
    assert ((rising.score(x) > 0.5) == y).mean() > 0.75


def test_quality_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.quality_rules(odd(spark), none).collect()}
    assert rows[0].base_failed and not rows[0].kept and rows[12].kept and rows[14].base_failed
    assert quality.quality_rules(empty(spark), none).count() == 0
    kept = quality.keep_good(odd(spark), none)
    assert kept.columns == odd(spark).columns and {r.doc_id for r in kept.collect()} == {12, 13}


# --- line dedup and mixing -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_lines_equal_brute_force(spark, broadcast):
    rng = random.Random(4)
    rows = [(i, rng.choice(["h1", "h2", None]), rng.choice(["x", None]) and "\n".join(rng.choice(["menu", " menu\t", "", "  ", f"l{rng.randrange(30)}", "foot"])
                                                                                  for _ in range(rng.randrange(6)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.drop_boilerplate(df, ratio=0.3, min_pages=5, broadcast_bytes=broadcast).collect()}
    pages, on = collections.Counter(), collections.Counter()
    for _, h, t in rows:
        pages[h] += 1
        for line in {x.strip() for x in (t or "").split("\n")} - {""}:
            on[h, line] += 1
    for i, h, t in rows:
        if t is None:
            assert got[i] == (None, 0, 0)
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not (x.strip() and on[h, x.strip()] >= 5 and on[h, x.strip()] > 0.3 * pages[h])]
        assert got[i] == ("\n".join(kept), len(lines), len(lines) - len(kept))


def test_lines_edge_cases(spark):
    out = linededup.drop_boilerplate(odd(spark))
    assert out.count() == len(ODD) + 1 and out.columns == [*odd(spark).columns, "n_lines", "n_dropped"]
    assert linededup.drop_boilerplate(empty(spark)).count() == 0


def test_mixing_meets_budget_and_limits(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randrange(1, 60)), "big" if i % 3 else f"s{i % 21}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    per = collections.Counter()
    for _, t, s in rows:
        per[s] += len(t.split())
    total = sum(per.values())
    for kwargs in ({"broadcast_bytes": 1 << 20}, {"broadcast_bytes": 0}):
        mixed = mixing.mix(df, entropy=0.95, repeats=1.5, block_docs=32, **kwargs).collect()
        got = collections.Counter()
        seen = collections.Counter((r.doc_id, r.mix_epoch) for r in mixed)
        for r in mixed:
            got[r.source] += r.mix_tokens
        assert max(seen.values()) == 1
        assert all(got[s] <= 1.5 * per[s] for s in per) and 0.95 * total <= sum(got.values()) <= total
        assert got["big"] / sum(got.values()) < per["big"] / total


def test_mixing_edge_cases(spark):
    out = mixing.mix(odd(spark))
    assert set(odd(spark).columns) <= set(out.columns) and out.count() > 0
    assert mixing.mix(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert mixing.mix(blank).count() == 0
    one = spark.createDataFrame([(1, "a b", "a"), (2, "c d", "a")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in mixing.mix(one).collect()) == [1, 2]
