"""License scans, fill-in-the-middle and the Merkle manifest against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import fim, licenses, merkle
from millrace.llm.common import Texts, table
from millrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, digest string, words string, tree string, `at` int, lo int, hi int, n int, "
          "path string, top string, output string, restored string, form string, held int, plain string, found int, base string")
EXTRA = ("x", "y", "z", 1, 2, 3, 4, "p", "t", "o", "r", "f", 5, "q", 6, "b")
LONG = "é<" + " ".join(f"W{i % 7919}x ß{i % 31}" for i in range(40_000))
ODD = [None, "", "  \n\t ", "one", "<P", "a<S>b", "<<P", "ends<", "M>x", "é́İ\U0001F600 KK", "CC BY", "Cc  bY cc-by cc\nby", "x" * 17, LONG, LONG,
       "All rights reserved. ALL RIGHTS RESERVED!", "general public license", "general public license", "<M><S><P>", "ẞ<S> CC by",
       "Licensed under the Apache License, Version 2.0", "license apache the under licensed 2 0 version", "\x00\x1f nul"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd(spark):
    rows = [(i, t, ["en", None][i % 2], [None, "s", "", "ü"][i % 4], None if i % 5 == 0 else i) + EXTRA for i, t in enumerate(ODD)]
    rows += [(None, "Null Id", None, "s", 1) + EXTRA, (None, "Null Id", None, "s", 1) + EXTRA, (7, "other text", "en", "ü", 2) + EXTRA, rows[7], rows[7]]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- license scans ---------------------------------------------------------------------------------------------------------------------


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def scan_row(doc_id, text, templates, phrases, percent):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, base, labels, best = [], set(), set(), 0.0
    for phrase, label in phrases:
        want = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        places += here
        base |= {label} if here else set()
    for label, t in templates:
        want = re.findall("[0-9a-z]+", t.lower())
        half = 8
        while half < len(want):
            half *= 2
        for at in range(0, len(words), half):
            share = len(set(want) & set(words[at : at + 2 * half]))
            if 100 * share >= percent * len(set(want)):
                labels.add(label)
                best = max(best, share / len(set(want)))
    return (doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), 1.0 if places else best)


def scan_rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("percent, size", [(95, None), (60, 0), (100, 0)])
def test_license_scan_equals_brute_force(spark, percent, size):
    rng = random.Random(percent)
    texts = list(ODD)
    for _ in range(60):  # templates with words lost, moved and put in, among other words
        _, t = rng.choice(licenses.TEMPLATES)
        words = t.split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["the", "of", "xyz"])
        if rng.random() < 0.3:
            rng.shuffle(words)
        around = lambda: [rng.choice(["mit", "der", "and", "cc", "by", "license", "q"]) for _ in range(rng.randrange(40))]
        texts.append(" ".join([*around(), *words, *around()]))
    texts += texts[-5:]
    df = spark.createDataFrame([(i, t, "e", "s", 1) + EXTRA for i, t in enumerate(texts)] + [(None, "cc by", None, None, None) + EXTRA], SCHEMA)
    got = licenses.scan(df, percent=percent, broadcast_bytes=size)
    want = [scan_row(i, t, licenses.TEMPLATES, licenses.PHRASES, percent) for i, t in [*enumerate(texts), (None, "cc by")]]
    assert scan_rows(got) == sorted(want, key=str)


def test_license_scan_of_whole_documents(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = {r[0]: r for r in scan_rows(QUERIES["op11_prefix_filter_licenses"](spark, SF))}
    assert got == {i: scan_row(i, t, licenses.TEMPLATES, licenses.PHRASES, licenses.PERCENT) for i, t in texts.items()}
    found = {label for r in got.values() for label in r[6].split(",")}
    assert {"Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0"} <= found


def test_license_scan_edge_cases(spark):
    assert licenses.scan(empty(spark)).count() == 0
    rows = scan_rows(licenses.scan(odd(spark)))
    assert len(rows) == len(ODD) + 5 and all(0 <= r[-1] <= 1 for r in rows)
    assert scan_rows(licenses.scan(odd(spark), templates=[])) == sorted([scan_row(r.doc_id, r.text, [], licenses.PHRASES, 95) for r in odd(spark).collect()], key=str)
    assert licenses.need(20, 95) == 19 and licenses.need(7, 95) == 7 and licenses.half_block(9) == 16
    with pytest.raises(ValueError):
        licenses.scan(odd(spark), templates=[("x", " ".join(f"w{i}" for i in range(20_001)))])


# --- fill-in-the-middle ----------------------------------------------------------------------------------------------------------------


def fim_row(doc_id, text):
    text = text or ""
    g = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(g[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_rearranged_texts_equal_plain_slices(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab<>PSM é\U0001F600") for _ in range(rng.randrange(12))) for _ in range(600)]
    df = spark.createDataFrame([(i, t, "e", "s", 1) + EXTRA for i, t in enumerate(texts)] + [(None, "null id", "e", "s", 1) + EXTRA], SCHEMA)
    got = fim.restore(fim.rearrange(df)).collect()
    want = {i: fim_row(i, t) for i, t in [*enumerate(texts), (None, "null id")]}
    assert len(got) == len(want)
    for r in got:
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want[r.doc_id]
        assert r.restored == ("null id" if r.doc_id is None else texts[r.doc_id] or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_query_over_whole_documents(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in QUERIES["op12_displacement_fim"](spark, SF).collect():
        *want, output = fim_row(r.doc_id, texts[r.doc_id])
        assert [r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars] == want
        assert r.output_sha256 == sha(output) and r.restored_sha256 == sha(texts[r.doc_id] or "")


def test_fim_edge_cases(spark):
    assert fim.restore(fim.rearrange(empty(spark))).count() == 0
    assert fim.restore(fim.rearrange(odd(spark))).count() == len(ODD) + 5
    with pytest.raises(ValueError):  # an output that lost a sentinel
        fim.gather(Texts(pa.array(["<P>a<S>b"])), np.array([1]))


# --- Merkle manifest -------------------------------------------------------------------------------------------------------------------


def leaf_of(row, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)]
    return sha("".join(parts))


def grown(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def steps(levels, k):
    out = []
    for level in levels[:-1]:
        begin = k // 16 * 16
        out.append(("".join(level[begin:k]), "".join(level[k + 1 : begin + 16])))
        k //= 16
    return out


def manifest_rows(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grown([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = grown([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for k, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = steps(trees[s], k) + steps(top, i)
            own = leaf
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                own = leaf_of(r, None if r.text is None else lower(r.text))
            for left, right in path:
                own = sha(left + own + right)
            root = top[-1][0]
            out.append((r.doc_id, leaf, trees[s][-1][0], root, sha("".join(a + b for a, b in path)), own, own == root))
    return sorted(out, key=str)


def verified_rows(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [None, 0])
def test_manifest_equals_plain_trees(spark, size):
    rng = random.Random(9)
    # Sources of 1, 16, 17, 256, 257 and many rows; one with a third of all, one doc_id on many rows.
    counts = [("a", 1), ("b", 16), ("c", 17), (None, 256), ("é", 257), ("", 2), ("hot", 700)] + [(f"s{i}", 1) for i in range(30)]
    rows = [(rng.choice([5, rng.randrange(3000)]) if s == "hot" else i, rng.choice(["Text A", "text", None, f"T{i}"]), "en", s, None)
            for s, n in counts for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = verified_rows(merkle.verify(df, size))
    assert got == manifest_rows(df.collect())
    assert {r[-1] for r in got} == {True, False}


def test_manifest_edge_cases(spark):
    assert merkle.verify(empty(spark)).count() == 0
    assert verified_rows(merkle.verify(odd(spark))) == manifest_rows(odd(spark).collect())
    one = odd(spark).filter("doc_id = 9")
    assert verified_rows(merkle.verify(one)) == manifest_rows(one.collect())
    (row,) = merkle.verify(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("")


def test_manifest_query_over_whole_documents(spark):
    docs = table(spark, SF, "documents").collect()
    assert verified_rows(QUERIES["op13_interval_merkle"](spark, SF)) == manifest_rows(docs)
