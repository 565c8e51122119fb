"""Mixing sources to target weights by temperature, in DataFrame functions alone.

The weight of a source is its token share to the power of an exponent, normalised. The exponent is bisected: the smallest on a grid
(the most even mix) whose entropy does not exceed a share of the greatest possible one and that repeats no source more than a limit.
Both conditions hold from some exponent on; at 1 the mix is the natural one. Every step is one small aggregate over the sources.

Each source then gets its weight's part of the token budget, as whole epochs and one partial epoch. An epoch is a permutation of
blocks of bounded size, dealt by a hash of doc_id and shuffled by a hash per epoch. In the partial epoch blocks are taken until the
budget is met, and the block it falls into gives its documents in hash order while they fit. So a source with a third of all rows is
cut in its table of blocks, never sorted by document in one task.

Edge cases: tokens are words; null and empty texts have none and ride along with their block; a source without tokens takes part in
whole epochs never and is dropped; a null source counts as ''; a null doc_id hashes like its text; repeated rows are documents of their own;
an empty table gives no rows; other columns pass through, but for input columns named like the four outputs, which are replaced. If not even the natural mix keeps the limit, the budget is cut to what the limit allows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, renamed_apart, renamed_back, stored

#: Steps of the exponent between 0 and 1.
GRID = 4096
ENTROPY, REPEATS = 0.9, 2.0
BLOCK_DOCS = 2048
SEED = "mix"
_OWN = ("_source", "_hash", "_blocks", "_room", "_sum")


def _words(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _dealt(seed: str, *parts: F.Column) -> F.Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def exponent(shares: DataFrame, budget: float, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The bisected exponent for sources (source, tokens, share)."""

    def even_enough(k: int) -> bool:
        weight = F.pow(F.col("share"), F.lit(k / GRID))
        z, a, most, n = shares.agg(F.sum(weight), F.sum(weight * F.log("share")), F.max(weight / F.col("tokens")), F.count("*")).first()
        now = math.log(z) - k / GRID * a / z
        return now <= entropy * math.log(n) + 1e-9 and budget * most / z <= repeats + 1e-9

    low, high = 0, GRID  # ``high`` is good, or the end of the grid
    while low < high:
        middle = (low + high) // 2
        if even_enough(middle):
            high = middle
        else:
            low = middle + 1
    return high / GRID


def block_plan(measured: DataFrame, entropy: float, repeats: float, budget: int | None, block_docs: int, seed: str) -> DataFrame | None:
    """(source, block, epoch, place, room): the blocks each source gives in each epoch; ``room`` is null where all of a block goes."""
    per_source = stored(measured.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).filter("tokens > 0"), "sources")
    total = per_source.agg(F.sum("tokens")).first()[0]
    if not total:
        return None
    shares = per_source.withColumn("share", F.col("tokens") / F.lit(total))
    wanted = total if budget is None else min(budget, int(repeats * total))
    alpha = exponent(shares, wanted, entropy, repeats)
    power = F.pow(F.col("share"), F.lit(alpha))
    z = shares.agg(F.sum(power)).first()[0]
    quota = F.least(F.floor(power / F.lit(z) * wanted + 0.5), F.floor(repeats * F.col("tokens"))).cast("long")
    quotas = (shares.withColumn("quota", quota)
              .select("source", F.col("tokens").alias("all_tokens"), F.floor(F.col("quota") / F.col("tokens")).cast("int").alias("whole"), "quota"))
    blocks = measured.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).join(quotas, "source")
    each = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    order = Window.partitionBy("source", "epoch").orderBy(_dealt(seed, F.col("source"), F.col("block"), F.col("epoch")), "block")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("quota") - F.col("all_tokens") * F.col("whole") - F.col("before")
    placed = each.withColumns({"place": F.row_number().over(order), "before": before})
    partial = F.col("epoch") == F.col("whole")
    return (placed.withColumn("room", F.when(partial & (left < F.col("tokens")), left))
            .filter(~partial | F.col("room").isNull() | (F.col("room") > 0))
            .filter(~(partial & (left <= 0))).select("source", "block", "epoch", "place", "room"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", entropy: float = ENTROPY, repeats: float = REPEATS,
        budget: int | None = None, block_docs: int = BLOCK_DOCS, seed: str = SEED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents of the mix, once per epoch they take part in, with ``mix_tokens``, ``mix_epoch``, ``mix_block`` and ``mix_place``.

    Blocks in the order of (epoch, place) are the permutation; ``budget`` defaults to the tokens of the input.
    """
    docs, moved = renamed_apart(docs, _OWN)
    source, text = moved.get(source, source), moved.get(text, text)
    name = F.coalesce(F.col("doc_id").cast("string"), F.col(text).cast("string"))
    counted = (docs.withColumn("_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
               .withColumn("_hash", _dealt(seed, name)).withColumn("mix_tokens", _words(text)))
    sizes = stored(counted.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("docs")), "source-docs")
    # Sources number far fewer than documents; their size is checked like any other.
    small = sizes.count() * 64 <= broadcast_bytes
    names = sizes.select(F.col("source").alias("_source"), F.ceil(F.col("docs") / block_docs).alias("_blocks"))
    number = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")
    dealt = counted.join(F.broadcast(names) if small else names, "_source").withColumn("mix_block", (number % F.col("_blocks")).cast("int"))
    measured = stored(dealt.select(F.col("_source").alias("source"), F.col("mix_block").alias("block"), F.col("mix_tokens").alias("tokens")), "measured")
    plan = block_plan(measured, entropy, repeats, budget, block_docs, seed)
    if plan is None:
        none = dealt.withColumns({"mix_epoch": F.lit(0), "mix_place": F.lit(0)}).filter(F.lit(False))
        return renamed_back(none.drop("_source", "_hash", "_blocks"), moved)
    plan = stored(plan.select(F.col("source").alias("_source"), F.col("block").alias("mix_block"), F.col("epoch").alias("mix_epoch"),
                              F.col("place").alias("mix_place"), F.col("room").alias("_room")), "mix-plan")
    right = F.broadcast(plan) if plan.count() * 96 <= broadcast_bytes else plan
    chosen = dealt.join(right, ["_source", "mix_block"])
    whole = chosen.filter("_room is null")
    inside = (Window.partitionBy("_source", "mix_block", "mix_epoch").orderBy(_dealt(seed, name, F.col("mix_epoch")), "mix_tokens")
              .rowsBetween(Window.unboundedPreceding, 0))
    cut = chosen.filter("_room is not null").withColumn("_sum", F.sum("mix_tokens").over(inside)).filter("_sum <= _room").drop("_sum")
    return renamed_back(whole.unionByName(cut).drop("_source", "_hash", "_blocks", "_room"), moved)


def mixing_sql(entropy: float = ENTROPY, repeats: float = REPEATS, block_docs: int = BLOCK_DOCS, seed: str = SEED) -> str:
    """The same as SQL over ``documents``: every exponent of the grid is tried instead of bisecting."""
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(concat('{seed}:', coalesce(CAST(doc_id AS VARCHAR), text, ''))) AS h,
         coalesce(CAST(doc_id AS VARCHAR), text, '') AS name,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents),
c AS (SELECT source, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS all_tokens FROM d GROUP BY ALL),
s AS (SELECT source, all_tokens, all_tokens / (SELECT sum(all_tokens) FROM c) AS share, (SELECT sum(all_tokens) FROM c) AS budget FROM c WHERE all_tokens > 0),
g AS (SELECT k, ln(sum(pow(share, k / {GRID}.0))) - k / {GRID}.0 * sum(pow(share, k / {GRID}.0) * ln(share)) / sum(pow(share, k / {GRID}.0)) AS entropy,
             max(budget) * max(pow(share, k / {GRID}.0) / all_tokens) / sum(pow(share, k / {GRID}.0)) AS repetition, count(*) AS n
      FROM s, (SELECT unnest(generate_series(0, {GRID})) AS k) GROUP BY k),
a AS (SELECT coalesce(min(k) FILTER (WHERE entropy <= {entropy} * ln(n) + 1e-9 AND repetition <= {repeats} + 1e-9), {GRID}) / {GRID}.0 AS alpha FROM g),
q AS (SELECT source, all_tokens, CAST(least(floor(pow(share, alpha) / (SELECT sum(pow(share, alpha)) FROM s, a) * budget + 0.5),
             floor({repeats} * all_tokens)) AS BIGINT) AS quota FROM s, a),
m AS (SELECT d.*, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % CAST(ceil(docs / {block_docs}.0) AS BIGINT) AS INTEGER) AS block FROM d JOIN c USING (source)),
b AS (SELECT source, block, CAST(sum(tokens) AS BIGINT) AS tokens FROM m GROUP BY ALL),
e AS (SELECT b.*, q.all_tokens, q.quota, q.quota // q.all_tokens AS whole, epoch
      FROM b JOIN q USING (source), LATERAL (SELECT unnest(generate_series(0, q.quota // q.all_tokens)) AS epoch)),
p AS (SELECT *, row_number() OVER w AS place,
             quota - all_tokens * whole - coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
      FROM e WINDOW w AS (PARTITION BY source, epoch ORDER BY md5(concat('{seed}:', source, ':', block, ':', epoch)), block)),
o AS (SELECT m.doc_id, m.source, m.tokens, p.epoch, m.block, p.place, p.epoch < p.whole OR p.room >= p.tokens AS entire, p.room,
             sum(m.tokens) OVER (PARTITION BY m.source, m.block, p.epoch
                                 ORDER BY md5(concat('{seed}:', m.name, ':', p.epoch)), m.tokens
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sofar
      FROM m JOIN p ON m.source = p.source AND m.block = p.block WHERE p.epoch < p.whole OR p.room > 0)
SELECT doc_id, source, tokens AS mix_tokens, CAST(epoch AS INTEGER) AS mix_epoch, block AS mix_block, CAST(place AS INTEGER) AS mix_place
FROM o WHERE entire OR sofar <= room"""
