"""A Merkle manifest of a data set with nested-interval labels.

Every row is a leaf. Leaves of a source are ranked by doc_id, and every node of the tree carries the interval of leaf ranks it covers:
nodes of level l lie in buckets of 16^l ranks. A join of one level with the next on (source, bucket), checked by containment of the
intervals, attaches each node to its parent; the parent's children whose intervals are left when the node's own is taken out are its
siblings, those below it on the left and those above it on the right. Going down, a node's path is its own pair of siblings and its
parent's path, so what a row joins with is one row per run of sixteen. The roots of the sources are the leaves of one more tree, built
by the same functions.

Ranks come from a range partitioning by (source, doc_id, leaf) and the counts of its parts, so a source, or a doc_id, with a third of all
rows is spread over tasks. Texts are hashed where they are read and never shuffled.

Edge cases: a null field counts as ``-``; null doc_ids come first within their source and are never tampered with; a null source is a
source of its own, before all others; rows of equal doc_id are ordered by their leaf; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, stored

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def _sha(*parts: F.Column) -> F.Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: F.Column) -> F.Column:
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_table(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered, salt): the digest of every row, and where it is tampered with, that of the tampered row."""
    field = {c: F.col(c) for c in FIELDS}
    other = field | {"text": F.translate(field["text"].cast("string"), _UPPER, _LOWER)}
    hit = F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), _sha(*[_field(field[c]) for c in FIELDS]).alias("leaf"),
                       F.when(hit, _sha(*[_field(other[c]) for c in FIELDS])).alias("tampered"), F.rand(11).alias("salt"))


def ranked(rows: DataFrame, order: list[str], broadcast_bytes: int | None = None) -> DataFrame:
    """``rows`` with ``lo``, the rank within ``tree`` by ``order`` (from 0), ``hi`` = ``lo`` + 1, and ``n``, the rows of the tree."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Monotonic ids are the part's number times 2^33 plus the place in the part.
    placed = stored(rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
                    .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "ranked-rows")
    counts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")  # a row per part
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stored(counts.select("tree", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                                  F.sum("rows").over(tree).alias("n")), "part-counts")
    joined = placed.join(bounded(firsts, 128, broadcast_bytes), ["tree", "part"])
    lo = F.col("at") + F.col("shift")
    return joined.withColumn("lo", lo).withColumn("hi", F.col("lo") + 1).drop("at", "part", "shift")


def grow(nodes: DataFrame) -> list[DataFrame]:
    """Levels 1, 2, ... above ``nodes`` (tree, n, lo, hi, digest): (tree, n, lo, hi, digest, children), until every tree has one node."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, width = [], 1
    while width < most:
        child = F.struct("lo", "hi", "digest")
        bucket = F.floor(F.col("lo") / (width * FAN_OUT)).alias("bucket")
        runs = (nodes.filter(F.col("n") > width).groupBy("tree", bucket)
                .agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(child)).alias("children")))
        text = F.array_join(F.transform("children", lambda c: c["digest"]), "")
        nodes = stored(runs.select("tree", "n", "lo", "hi", F.sha2(text, 256).alias("digest"), "children"), "level")
        levels.append(nodes)
        width *= FAN_OUT
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the one node at the top of every tree."""
    out, width = nodes.filter("n = 1").select("tree", "digest"), 1
    for level in levels:
        width *= FAN_OUT
        out = out.unionByName(level.filter((F.col("n") <= width) & (F.col("n") > width // FAN_OUT)).select("tree", "digest"))
    return out


def _attached(nodes: DataFrame, parents: DataFrame, width: int, keep: list[str]) -> DataFrame:
    """Nodes with the path of their parent, their own siblings in front: a containment join inside buckets of ``width`` ranks."""
    bucket = F.floor(F.col("lo") / width)
    p = parents.select("tree", bucket.alias("bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("children").alias("p_children"),
                       F.col("path").alias("p_path"), "top")
    joined = nodes.withColumn("bucket", bucket).join(p, ["tree", "bucket"]).filter("p_lo <= lo and hi <= p_hi")
    digests = lambda keep_child: F.array_join(F.transform(F.filter("p_children", keep_child), lambda c: c["digest"]), "")
    own = F.struct(digests(lambda c: c["hi"] <= F.col("lo")).alias("left"), digests(lambda c: c["lo"] >= F.col("hi")).alias("right"))
    return joined.select(*keep, F.concat(F.array(own), "p_path").cast(_PATH).alias("path"), "top")


def descend(nodes: DataFrame, levels: list[DataFrame], above: DataFrame | str | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``nodes`` with ``path``, from their own siblings up, and the digest ``top`` of their tree.

    ``above`` holds (tree, path, top): what lies over the top of each tree, a row per tree; or it is the digest of the only tree.
    """

    def below(df: DataFrame) -> DataFrame:
        if isinstance(above, DataFrame):
            return df.join(above, "tree")
        return df.withColumns({"path": F.array().cast(_PATH), "top": F.lit(above).cast("string")})

    columns = ["tree", "n", "lo", "hi", "children"]
    parents = None
    for i in range(len(levels) - 1, -1, -1):
        width = FAN_OUT ** (i + 1)
        highest = below(levels[i].filter(F.col("n") <= width).select(*columns))
        if parents is not None:
            lower = levels[i].filter(F.col("n") > width).select(*columns)
            highest = highest.unionByName(_attached(lower, parents, width * FAN_OUT, columns))
        parents = stored(highest, "paths")
    single = below(nodes.filter("n = 1")).select(*keep, "path", "top")
    return single if parents is None else _attached(nodes.filter("n > 1"), parents, FAN_OUT, keep).unionByName(single)


def manifest(docs: DataFrame, broadcast_bytes: int | None = None) -> tuple[DataFrame, str | None]:
    """(doc_id, leaf, tampered, subroot, path) of every row, and the root; None for an empty table."""
    leaves = stored(leaf_table(docs), "leaves")
    placed = stored(ranked(leaves, ["doc_id", "leaf", "salt"], broadcast_bytes).withColumn("digest", F.col("leaf")), "leaf-ranks")
    levels = grow(placed)
    # The roots of the sources are the leaves of one tree more, in the order of the sources.
    subroots = tops(placed, levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    heads = stored(ranked(subroots, ["name"], broadcast_bytes), "subroots")
    upper = grow(heads)
    root = tops(heads, upper).first()
    above = stored(descend(heads, upper, root and root["digest"], ["name", "digest"]).select(F.col("name").alias("tree"), "path", F.col("digest").alias("top")), "above")
    rows = descend(placed, levels, above, ["doc_id", "leaf", "tampered"])
    return rows.withColumnRenamed("top", "subroot"), root and root["digest"]


def fold(own: F.Column, path: F.Column) -> F.Column:
    """The root recomputed from a leaf and its path."""
    return F.aggregate(path, own, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def verify(docs: DataFrame, broadcast_bytes: int | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; some rows are tampered with."""
    rows, root = manifest(docs, broadcast_bytes)
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.sha2(proof, 256).alias("proof_sha256"),
                       fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def merkle_sql(levels: int = 4, upper: int = 3) -> str:
    """The same as SQL over ``documents``, for sources of up to 16^levels rows and up to 16^upper sources.

    A tree that is down to one node keeps it through the levels that are left.
    """
    bits = "[c, 0, 0, 0, 0, 0, 0, 0, 0]"
    crc = (f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))), "
           f"lambda x, y: list_reduce({bits.replace('c', 'xor(x, y)', 1)}, lambda s, t: xor(s >> 1, (s & 1) * 3988292384))), 4294967295)")
    size = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"
    text = f"translate(text, '{_UPPER}', '{_LOWER}')"
    leaf = lambda t: "sha256(concat(" + ", ".join(size(t if c == "text" else c) for c in FIELDS) + "))"
    out = [f"""
d AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(text)} END AS tampered FROM documents),
k0 AS (SELECT coalesce('=' || source, '') AS tree, doc_id, leaf, tampered, leaf AS h,
              row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM d)"""]
    for i in range(levels + upper):
        if i == levels:  # the roots of the sources become one tree
            out.append(f"k{i} AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS k FROM r{i})")
        rows = f"PARTITION BY tree, k // {FAN_OUT} ORDER BY k ROWS BETWEEN"
        out.append(f"""s{i} AS (SELECT *, count(*) OVER (PARTITION BY tree) = 1 AS alone, coalesce(string_agg(h, '') OVER ({rows} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
              coalesce(string_agg(h, '') OVER ({rows} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM k{i})""")
        after = f"k{i + 1}" if i + 1 != levels else f"r{levels}"
        out.append(f"{after} AS (SELECT tree, k // {FAN_OUT} AS k, CASE WHEN any_value(alone) THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY k)) END AS h "
                   f"FROM s{i} GROUP BY tree, k // {FAN_OUT})")
    total = levels + upper
    join = " ".join(f"JOIN s{i} ON s{i}.tree = s0.tree AND s{i}.k = s0.k // {FAN_OUT ** i}" if i < levels
                    else f"JOIN s{i} ON s{i}.name = s0.tree" if i == levels else f"JOIN s{i} ON s{i}.k = s{levels}.k // {FAN_OUT ** (i - levels)}"
                    for i in range(1, total))
    fold_, steps = "coalesce(s0.tampered, s0.leaf)", []
    for i in range(total):
        steps.append(f"f{i} AS (SELECT *, CASE WHEN a{i} THEN f ELSE sha256(l{i} || f || r{i}) END AS g FROM {'j' if i == 0 else f'f{i - 1}x'})")
        steps.append(f"f{i}x AS (SELECT * EXCLUDE (f, g), g AS f FROM f{i})")
    parts = ", ".join(f"s{i}.l AS l{i}, s{i}.r AS r{i}, s{i}.alone AS a{i}" for i in range(total))
    proof = " || ".join(f"l{i} || r{i}" for i in range(total))
    out.append(f"j AS (SELECT s0.doc_id, s0.leaf, {fold_} AS f, s{levels}.h AS subroot, (SELECT h FROM k{total}) AS root, {parts} FROM s0 {join})")
    return ("WITH " + ",\n".join(out + steps) + f"\nSELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f AS folded_root, f = root AS verified "
            f"FROM f{total - 1}x")
