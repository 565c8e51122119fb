"""Paragraph-packing chunker with character overlap, one fold per document inside the JVM.

A chunk is always one stretch of the document: its own paragraphs, and before them the overlap, which is the text that ends where
they begin. So the fold carries numbers only, and texts are cut out once at the end; its cost is linear in the paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Chunk size, overlap and paragraph separator.
CHUNK_SIZE, CHUNK_OVERLAP, SEPARATOR = 512, 50, "\n\n"

EDGE_SPACE = r"^[\s\p{Z}\x0b\x1c-\x1f\x85]+|[\s\p{Z}\x0b\x1c-\x1f\x85]+$"

#: Chunks of ``{text}`` as an array. ``a`` is the fold's state: ``i`` paragraphs seen; the open chunk starts at paragraph ``first``, is
#: ``len`` characters long, begins at ``start`` of the packed text, and has the overlap in front if ``tail``. ``done`` holds closed ones.
_CHUNKS = r"""
transform(array(split({text}, concat('\\Q', {separator}, '\\E'), -1)), parts ->
  transform(filter(
    transform(
      aggregate(transform(parts, p -> length(p)),
        named_struct('i', 0, 'first', 1, 'len', 0, 'start', 0, 'tail', false,
                     'done', cast(array() as array<struct<first:int,until:int,len:int,start:int,tail:boolean,last:boolean>>)),
        (a, n) -> CASE
          WHEN a.len = 0 THEN named_struct('i', a.i + 1, 'first', a.i + 1, 'len', n, 'start', a.start, 'tail', false, 'done', a.done)
          WHEN a.len + n + length({separator}) <= {size} THEN
            named_struct('i', a.i + 1, 'first', a.first, 'len', a.len + n + length({separator}), 'start', a.start, 'tail', a.tail, 'done', a.done)
          ELSE named_struct('i', a.i + 1, 'first', a.i + 1,
            'len', n + if(a.len > {overlap} AND {overlap} > 0, {overlap} + length({separator}), 0),
            'start', a.start + a.len - if(a.len > {overlap}, {overlap}, 0), 'tail', a.len > {overlap} AND {overlap} > 0,
            'done', concat(a.done, array(named_struct('first', a.first, 'until', a.i, 'len', a.len, 'start', a.start, 'tail', a.tail, 'last', false))))
        END,
        a -> concat(a.done, array(named_struct('first', a.first, 'until', a.i, 'len', a.len, 'start', a.start, 'tail', a.tail, 'last', true)))),
      c -> named_struct('content', regexp_replace(concat(
             if(c.tail, concat(right(array_join(slice(parts, greatest(1, c.first - {overlap} - 1), c.first - greatest(1, c.first - {overlap} - 1)),
                                                {separator}), {overlap}), {separator}), ''),
             array_join(slice(parts, c.first, c.until - c.first + 1), {separator})), '{edge}', ''),
           'start_idx', c.start, 'end_idx', c.start + c.len, 'last', c.last)),
    c -> NOT c.last OR length(c.content) > 0),
  c -> named_struct('content', c.content, 'start_idx', c.start_idx, 'end_idx', c.end_idx)))[0]"""


def _literal(text: str) -> str:
    """A SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f"'{escaped}'"


def _chunk_sql(text: str, size: str, overlap: str, separator: str) -> str:
    return _CHUNKS.format(text=text, size=size, overlap=overlap, separator=separator, edge=EDGE_SPACE.replace("\\", "\\\\"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def chunk_array(column: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separator: str = SEPARATOR) -> Column:
    """Paragraphs of a column packed up to ``size`` characters.

    A paragraph longer than that stays whole. A new chunk starts with the last ``overlap`` characters of the one before,
    when that one is longer than the overlap. Offsets count the packed text, the content is stripped, and a blank rest is
    dropped.
    """
    return F.expr(_chunk_sql(f"`{column}`", str(size), str(overlap), _literal(separator)))


def chunk_documents(docs: DataFrame, doc_id: str = "doc_id", content: str = "content", size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP, separator: str = SEPARATOR) -> DataFrame:
    """One row per chunk: ``chunk_id, chunk_index, content, start_idx, end_idx`` and the other columns of the document."""
    others = [c for c in docs.columns if c not in (doc_id, content)]
    exploded = docs.filter(F.col(content).isNotNull()).select(
        doc_id, *others, F.posexplode(chunk_array(content, size, overlap, separator)).alias("chunk_index", "_c"))
    return exploded.select(
        F.concat(F.col(doc_id).cast("string"), F.lit("_"), F.col("chunk_index")).alias("chunk_id"), doc_id, "chunk_index",
        "_c.content", "_c.start_idx", "_c.end_idx", *others)


def paragraphs(docs: DataFrame, doc_id: str, content: str, separator: str = SEPARATOR) -> DataFrame:
    """Paragraph ordinals and their offsets in the document: a running sum of the lengths before."""
    parts = docs.select(doc_id, F.xxhash64(doc_id, content).alias("_row"),
                        F.posexplode(F.split(content, r"\Q" + separator + r"\E", -1)).alias("ordinal", "content"))
    before = Window.partitionBy(doc_id, "_row").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("content") + len(separator)).over(before), F.lit(0)).cast("int")
    return parts.select(doc_id, "ordinal", "content", start.alias("start_idx"))


def register_chunk_text(spark: SparkSession) -> None:
    """The same rule as a SQL table function: ``LATERAL chunk_text(text, size, overlap, separator)``."""
    chunks = _chunk_sql("body", "size", "overlap", "separator")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION chunk_text(body STRING, size INT, overlap INT, separator STRING) "
              "RETURNS TABLE (chunk_index INT, content STRING, start_idx INT, end_idx INT) RETURN "
              f"SELECT pos, col.content, col.start_idx, col.end_idx FROM (SELECT posexplode({chunks}))")
