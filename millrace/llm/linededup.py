"""Line dedup by site-relative frequency, in DataFrame functions alone.

Per host, the pages that contain a line are divided by the pages of the host; lines above a boilerplate ratio are dropped from the
host's pages. Counting explodes 64-bit line hashes, each once per page, and sums partial counts, so a line on all pages of a host with
a third of all rows costs one row per task. The lines above the ratio number less than the host's mean lines per page divided by the
ratio, so they go back as one array per host, and pages filter their own lines: texts are not exploded, sorted or regrouped.

Edge cases: lines are compared without white space at their ends; lines without other characters are never counted or dropped; a null
host counts as the host ''; a null text has no lines and stays null; a line on fewer than ``MIN_PAGES`` pages of its host is no
boilerplate, whatever the ratio; repeated rows are pages of their own; an empty table gives no rows; other columns pass through, but
for input columns named ``n_lines`` or ``n_dropped``, which the counts replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, renamed_apart, renamed_back, stored

#: For hosts of every size the ratio alone decides, but for lines that hardly repeat.
RATIO, MIN_PAGES = 0.1, 3
SALTS = 64
_OWN = ("_host", "_lines", "_salt", "_split", "_gone", "_kept")


def _key(line: F.Column) -> F.Column:
    """Null for lines that do not count."""
    bare = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): the hashes of a host's boilerplate lines."""
    named = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    totals = named.groupBy("host").agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), _key), lambda k: k.isNotNull()))
    counts = named.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    common = counts.filter(F.col("n") >= min_pages).join(totals, "host").filter(F.col("n") > ratio * F.col("pages"))
    return common.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
                     broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pages with boilerplate lines taken out of their text, and ``n_lines``, ``n_dropped``."""
    common = stored(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    hosts, lines = common.agg(F.count("*"), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    right = common.select(F.col("host").alias("_host"), F.col("lines").alias("_lines"))
    pages, moved = renamed_apart(pages, _OWN)
    host, text = moved.get(host, host), moved.get(text, text)
    left = pages.withColumn("_host", F.coalesce(F.col(host).cast("string"), F.lit("")))
    if 64 * hosts + 8 * lines <= broadcast_bytes:
        joined = left.join(F.broadcast(right), "_host", "left")
    else:  # a hot host is dealt to as many tasks as there are salts
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        joined = (left.withColumn("_salt", F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)).cast("int"))
                  .join(right.select("_host", "_lines", salts), ["_host", "_salt"], "left").drop("_salt"))
    split = F.split(F.col(text), "\n")
    # What of the page is boilerplate, by a hash set; lines are then compared with those few only.
    gone = F.array_intersect(F.transform("_split", _key), "_lines")
    kept = F.filter("_split", lambda line: ~F.coalesce(F.array_contains("_gone", _key(line)), F.lit(False)))
    out = (joined.withColumn("_split", split).withColumn("_gone", gone)
           .withColumn("_kept", F.when(F.coalesce(F.size("_gone"), F.lit(0)) <= 0, F.col("_split")).otherwise(kept))
           .withColumn(text, F.array_join("_kept", "\n"))
           .withColumns({"n_lines": F.coalesce(F.size("_split"), F.lit(0)), "n_dropped": F.coalesce(F.size("_split") - F.size("_kept"), F.lit(0))})
           .withColumns({c: F.when(F.col(text).isNull(), 0).otherwise(F.col(c)) for c in ("n_lines", "n_dropped")}))
    return renamed_back(out.drop(*_OWN), moved)


def line_sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """The same as SQL over ``documents``, with the text as its md5."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT r, host, i, lines[i] AS line, trim(lines[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare
      FROM d, LATERAL (SELECT unnest(generate_series(1, len(lines))) AS i)),
n AS (SELECT host, bare, count(DISTINCT r) AS n FROM l WHERE bare <> '' GROUP BY ALL),
p AS (SELECT host, count(*) AS pages FROM d GROUP BY ALL),
b AS (SELECT n.host, n.bare FROM n JOIN p USING (host) WHERE n.n >= {min_pages} AND n.n > {ratio} * p.pages),
k AS (SELECT r, count(*) AS n_lines, count(b.bare) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.bare IS NULL), '') AS kept
      FROM l LEFT JOIN b ON l.host = b.host AND l.bare = b.bare GROUP BY r)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN md5(k.kept) END AS kept_md5
FROM d LEFT JOIN k USING (r)"""
