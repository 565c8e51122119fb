"""Block matrix join, URL filters, components, the pipeline, and all queries of the package against their SQL."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import blockjoin, linededup, mixing, sigtree, urlfilter
from millrace.llm.common import Texts, stored, table
from millrace.llm.components import components
from millrace.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    query = SimpleNamespace(run=QUERIES[name], oracle=ORACLE[name])
    assert compare(spark, connect(SF), query, SF) is None


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


# --- nearest neighbours ----------------------------------------------------------------------------------------------------------------


def product(x, y):
    """Products rounded, summed from left to right."""
    total = 0.0
    for a, b in zip(x, y):
        total += a * b
    return total


def nearest_rows(vectors, k, step):
    out = []
    for q, x in vectors:
        if q % step == 0:
            best = sorted((-product(x, y), c) for c, y in vectors if c != q and len(y) == len(x))[:k]
            out += [(q, i + 1, c) for i, (_, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("query_rows, candidate_rows", [(1000, 1000), (7, 40)])
def test_nearest_equals_brute_force(spark, query_rows, candidate_rows):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(v) for v in rng.integers(-3, 4, 8)]) for i in range(300)]  # whole numbers: many exact ties
    vectors = [(i, v) for i, v in vectors if any(v)] + [(900 + i, [1e-30, 2e30] + [0.0] * 6) for i in range(4)] + [(950, [1.0, 2.0]), (960, [2.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = blockjoin.nearest(blockjoin.usable(df), F.col("vec_id") % 10 == 0, 5, query_rows, candidate_rows)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == nearest_rows(vectors, 5, 10)


def test_nearest_edge_cases(spark):
    rows = [(0, [1.0, 0.0], 1), (20, None, 1), (40, [0.0, 0.0], 1), (60, [float("nan"), 1.0], 1), (80, [None, 1.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1),
            (100, [float("inf"), 1.0], 1), (120, [], 1), (None, [1.0, 1.0], 1), (2, [1.0, -3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim int")
    got = blockjoin.nearest(blockjoin.usable(df), F.col("vec_id") % 20 == 0)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert blockjoin.nearest(blockjoin.usable(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_few_pairs_are_computed_again():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(4000)
    _, again = blockjoin.search_tile(ids[:50], x[:50], ids, x, 20)
    assert again < 0.06 * 50 * 4000


# --- components and URLs ---------------------------------------------------------------------------------------------------------------


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, *edges[:5]], "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(df.limit(0)).count() == 0


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:cut]


def own_rule(url):
    host, path = parse(url)
    fit = [r for _, r in urlfilter.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fit, key=len, default=None)


def test_rules_of_whole_pages(spark):
    urls = {r.page_id: r.url for r in table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url").collect()}
    verdicts = {r: v for v, r in urlfilter.RULES}
    got = QUERIES["op6_redirect_equivalence"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule) == own_rule(urls[r.page_id])
        assert r.rule is None or r.verdict == verdicts[r.rule]


def test_aliases_share_blocks_and_allow_wins(spark):
    pages = spark.createDataFrame([
        (1, "http://a.example.com/de/x", '<link rel="canonical" href="http://c.com/y">'), (2, "https://www.c.com/y/?utm_a=1", ""),
        (3, "http://d.com/z", '<meta http-equiv=refresh content="0; url=http://m.c.com/y#q">'), (4, "http://e.com/", ""), (5, None, None),
        (6, "nonsense", ""), (7, "http://f.org/fr/1", "<link href='http://b.net/2' rel=canonical>"), (8, "http://b.net/2", None),
        (9, "https://g.com/b2", '<link rel="canonical" href="http://b.net/2">'), (10, "http://h.com/i", ""), (11, "://net/", ""), (12, "x://NET", ""),
        (12, "x://NET", "")], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    moved = spark.createDataFrame([("http://h.com/i", "http://a.example.com/de/x"), (None, "x"), ("http://e.com/", None)], "url string, target string")
    for size in (None, 0):
        got = urlfilter.judge_pages(pages, urlfilter.rule_table(spark, urlfilter.RULES), moved, size, plain_forms=True)
        rows = {r.page_id: (r.rule, r.verdict) for r in got.collect()}
        assert got.count() == 13 and rows == {
            1: ("example.com/de/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"),
            7: ("org/fr/", "allow"), 8: ("net/", "block"), 9: (None, "allow"), 10: (None, "block"), 11: ("net/", "block"), 12: (None, "block")}
    assert urlfilter.judge_pages(pages.limit(0), urlfilter.rule_table(spark, urlfilter.RULES)).count() == 0


def test_targets_that_are_no_pages_decide(spark):
    pages = spark.createDataFrame([
        (1, "http://x.org/a", '<link rel="canonical" href="http://b.net/2">'),  # blocked, never crawled
        (2, "http://y.org/a", '<meta http-equiv=refresh content="0; url=http://c.org/t">'), (3, "http://z.org/a", '<link rel=canonical href="//c.org/t">'),
        (4, "http://p.org/a", '<link rel=canonical href="http://q.org/fr/1">'), (5, "http://r.org/a", ""), (6, "http://s.org/a", ""),
        (7, "http://u.org/a", "<link rel=canonical href='http://v.org/?to=http://b.net/2'>")], "page_id long, url string, html string")
    moved = spark.createDataFrame([
        ("http://c.org/t", "http://d.net/"), ("http://q.org/fr/1", "http://b.net/3"), ("http://r.org/a", "http://w.org/1"), ("http://example.com/de/9", "http://w.org/1"),
        ("http://s.org/a", "nowhere")], "url string, target string")
    rules = urlfilter.rule_table(spark, urlfilter.RULES)
    for size in (None, 0):
        got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_pages(pages, rules, moved, size).collect()}
        assert got == {i: (None, "block" if i in (1, 2, 3, 5) else "allow") for i in range(1, 8)}
    got = {r.page_id: r.verdict for r in urlfilter.judge_pages(pages, rules).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    got = {r.page_id: r.verdict for r in urlfilter.judge_pages(pages.drop("html"), rules, moved).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "allow"}


@pytest.mark.parametrize("seed, size", [(1, None), (2, 0)])
def test_verdicts_equal_a_search_of_the_link_graph(spark, seed, size):
    """Random links between urls with and without rules: a page without a rule is blocked if it can reach a blocked url and no allowed one."""
    rng = random.Random(seed)
    hosts = ["a.net", "example.com", "www.example.net", "b.org", "c.io", "d.io", "e.io", "f.io", "g.io", "h.io"]
    urls = sorted({f"http://{rng.choice(hosts)}/{rng.choice(['de', 'en', 'fr', 'x'])}/{rng.randrange(30)}" for _ in range(400)})
    pages, edges = [], []
    for i, u in enumerate(rng.choices(urls, k=250)):
        to = rng.choice(urls) if rng.random() < 0.5 else None
        pages.append((i if i % 50 else None, u, to and f'<link rel="canonical" href="{to}">'))
        edges += [(u, to)] if to else []
    moved = [(rng.choice(urls), rng.choice(urls)) for _ in range(60)]
    around = {}
    for a, b in edges + moved:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    verdicts = {r: v for v, r in urlfilter.RULES}

    def verdict(url):
        own = own_rule(url)[2]
        if own:
            return verdicts[own]
        seen, todo = {url}, [url]
        while todo:
            todo += (new := around.get(todo.pop(), set()) - seen)
            seen |= new
        found = {verdicts[r] for u in seen if (r := own_rule(u)[2])}
        return "block" if found == {"block"} else "allow"

    got = urlfilter.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), urlfilter.rule_table(spark, urlfilter.RULES),
                                spark.createDataFrame(moved, "url string, target string"), size)
    want = [(i, *own_rule(u), verdict(u)) for i, u, _ in pages]
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str) == sorted(want, key=str)
    assert {"block", "allow"} == {v for *_, rule, v in want if rule is None}


# --- pipeline --------------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), name)
        seen.append((before, docs))
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    quality, lines, near, mixed, packed = seen
    kept = {r.doc_id for r in QUERIES["op10_quality_rules"](spark, SF).filter("kept").collect()}
    assert {r.doc_id for r in quality[1].collect()} == kept
    assert lines[0].count() == lines[1].count()
    assert {r.doc_id for r in near[1].collect()} < {r.doc_id for r in near[0].collect()}
    assert {r.doc_id for r in mixed[1].collect()} <= {r.doc_id for r in mixed[0].collect()}
    assert packed[1].agg(F.sum(F.when(F.col("start") == 0, 1))).first()[0] == packed[0].count()
    assert corpus_pipeline.run(spark, SF).count() == packed[1].count()


def test_lines_of_small_hosts_are_decided_by_the_ratio(spark):
    own = lambda h, i: f"{h} {i}\nfoot\n" + ("pair" if i < 2 else "few" if i < 5 else "")
    rows = [(1000 * len(h) + i, own(h, i), "en", h, 1) for h, n in (("a", 3), ("bb", 9), ("ccc", 40), ("dddd", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, df, SF).collect()}
    assert got[1000] == "a 0\npair" and got[1002] == "a 2\nfew"  # three documents
    assert got[2000] == "bb 0\npair" and got[2003] == "bb 3" and got[2008] == "bb 8\n"  # few: three of nine
    assert got[3000] == "ccc 0\npair" and got[3003] == "ccc 3\nfew"  # three of forty
    assert got[4000] == "dddd 0\nfoot\npair"


@pytest.mark.parametrize("position", range(5))
def test_pipeline_stages_take_no_rows(spark, position):
    docs = table(spark, SF, "documents").limit(0)
    assert corpus_pipeline.STAGES[position][1](spark, docs, SF).count() == 0


ODD_ROWS = [(6, "clean text of its own with many words in it"), (6, "one two three four five six seven"), (5, "one two three four five six seven"),
            (5, "one two three four five six seven"), (None, "null copy of words that stand here twice"), (None, "null copy of words that stand here twice"),
            (None, "another text without a number at all"), (None, None), (8, None), (9, ""), (9, ""), (10, "short")]


def odd_rows(spark):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t in ODD_ROWS for s in (None,)], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicate_stage_tells_rows_of_one_id_apart(spark):
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, odd_rows(spark), SF).collect()]
    assert sorted(left, key=str) == sorted([
        (6, ODD_ROWS[0][1]), next(x for x in left if x[1] == ODD_ROWS[1][1]), ODD_ROWS[4], ODD_ROWS[6], (None, None), (8, None), (9, ""), (10, "short")], key=str)
    assert sum(t == ODD_ROWS[1][1] for _, t in left) == 1


@pytest.mark.parametrize("position", range(1, 5))
def test_pipeline_stages_take_nulls_and_repeated_rows(spark, position):
    docs = odd_rows(spark)
    out = corpus_pipeline.STAGES[position][1](spark, docs, SF)
    if position == 1:
        assert out.count() == len(ODD_ROWS)
    elif position == 3:
        assert {r.text for r in out.collect()} <= {t for _, t in ODD_ROWS} and out.count() > 0
    elif position == 4:
        assert out.filter("start = 0").count() == len(ODD_ROWS)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_internal_names_may_clash_with_columns(spark, broadcast):
    names = ["_host", "_lines", "_salt", "_split", "_gone", "_kept", "_source", "_hash", "_blocks", "_room", "_sum", "_id", "_again", "_hit"]
    rows = [(i % 6, f"foot\nline {i} of many words here", "s", *(str(k) + n for k, n in enumerate(names))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    extra = [tuple(r[3:]) for r in rows]
    for out in (linededup.drop_boilerplate(df, broadcast_bytes=broadcast), mixing.mix(df, broadcast_bytes=broadcast), sigtree.one_of_each_group(df, broadcast_bytes=broadcast)):
        got = out.select(*df.columns).collect()
        assert got and all(tuple(r[3:]) in extra for r in got)
    assert {r.text for r in linededup.drop_boilerplate(df, broadcast_bytes=broadcast).collect()} == {r[1].split("\n")[1] for r in rows}


def test_hashes_tell_regular_words_apart():
    """Complementary sequences of a and b, on which sums of powers collide, and ranges around the sizes of lanes and chunks."""
    word, other = "a", "b"
    while len(word) < 2048:
        word, other = word + other, other + word
    texts = [word, other, *("x" * n for n in range(300)), *("x" * n + "y" for n in range(300)), "z" * 5000, "z" * 4999 + "w"]
    t = Texts(pa.array([s + " " for s in texts]))
    starts, ends = t.offsets[:-1], t.offsets[1:] - 1
    assert len(np.unique(t.hashes(starts, ends))) == len(set(texts))
    shifted = Texts(pa.array(["q" * (i % 11) + s for i, s in enumerate(texts)]))
    begin = shifted.offsets[:-1] + np.arange(len(texts)) % 11
    assert (shifted.hashes(begin, shifted.offsets[1:]) == t.hashes(starts, ends)).all()
