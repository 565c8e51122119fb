"""Fill-in-the-middle by displacement scatter.

A batch of texts is one byte array. The cuts of every text are scanned from its lead bytes; they split it into prefix, middle and
suffix, and each part moves by one displacement. The displacements go into a difference array at the parts' first bytes; its
cumulative sum is the shift of every byte, and one numpy scatter builds all outputs of the batch. Restoring scans the sentinels of the
output, takes the same differences the other way round, and gathers.

The parts never touch each other in an output, a sentinel always stands between them, and no part holds one: so a sentinel found in
an output is one that was put there, and the text is rebuilt from output and form alone.

Edge cases: a null text counts as empty; an empty text is plain; texts with a sentinel are plain; a null doc_id is hashed as the empty
number; repeated rows get equal outputs; an empty table gives no rows; other columns are ignored. Batches are bounded in bytes, so a
worker holds one batch, or one text if that is longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, small_batches

#: Fixed values of the format: the order of parts in the two moved forms, by their sentinels.
FORMS = {"psm": b"PSM", "spm": b"SPM"}
PLAIN_PERCENT, SPM_PERCENT = 10, 20
_MARK = np.zeros(256, bool)
_MARK[list(b"PSM")] = True


def sentinels(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``<P>``, ``<S>`` and ``<M>``, and the text each stands in."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((data[:-2] == 60) & _MARK[data[1:-1]] & (data[2:] == 62))
    owner = np.searchsorted(offsets, at, side="right") - 1
    whole = at + 3 <= offsets[owner + 1]
    return at[whole], owner[whole]


def shifts(size: int, begins: np.ndarray, ends: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """For parts ``begins[i]:ends[i]`` that move by ``moves[i]``, the move of every byte: a difference array, summed up."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, begins, moves)
    np.subtract.at(steps, ends, moves)
    return np.cumsum(steps[:-1])


def cut_places(texts: Texts, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, form, the two cuts in code points, and the two cuts as bytes; ``draws`` holds four numbers per text."""
    lead = (texts.data & 0xC0) != 0x80
    n = texts.counts(lead)
    a, b = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    first, second = np.minimum(a, b), np.maximum(a, b)
    form = np.where(draws[:, 3] % 100 < SPM_PERCENT, 2, 1)
    _, marked = sentinels(texts.data, texts.offsets)
    form[marked] = 0
    form[(n == 0) | (draws[:, 2] % 100 >= 100 - PLAIN_PERCENT)] = 0
    leads = np.append(np.flatnonzero(lead), len(texts.data))
    before = np.cumsum(n) - n

    def byte_of(cut):
        place = leads[np.minimum(before + cut, len(leads) - 1)]
        return np.where(cut == n, texts.offsets[1:], np.where(cut == 0, texts.offsets[:-1], place))

    return n, form, first, second, byte_of(first), byte_of(second)


def scatter(texts: Texts, form: np.ndarray, cut1: np.ndarray, cut2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs as bytes and offsets."""
    begin, end = texts.offsets[:-1], texts.offsets[1:]
    moved = form > 0
    out_offsets = np.zeros(texts.n + 1, np.int64)
    np.cumsum(np.where(moved, end - begin + 9, end - begin), out=out_offsets[1:])
    start = out_offsets[:-1]
    prefix, suffix = cut1 - begin, end - cut2
    spm = form == 2
    head = np.where(spm, suffix, prefix)
    new_prefix = np.where(spm, start + 6 + suffix, start + 3)
    new_suffix = np.where(spm, start + 3, start + 6 + prefix)
    new_middle = start + 9 + prefix + suffix
    # A plain text is one part.
    begins = np.concatenate([begin, cut1[moved], cut2[moved]])
    ends = np.concatenate([np.where(moved, cut1, end), cut2[moved], end[moved]])
    moves = np.concatenate([np.where(moved, new_prefix, start) - begin, (new_middle - cut1)[moved], (new_suffix - cut2)[moved]])
    out = np.empty(int(out_offsets[-1]), np.uint8)
    out[np.arange(len(texts.data)) + shifts(len(texts.data), begins, ends, moves)] = texts.data
    for kind, order in enumerate(FORMS.values(), 1):
        mine = form == kind
        for letter, place in zip(order, (start, start + 3 + head, start + 6 + prefix + suffix)):
            for i, byte in enumerate((60, letter, 62)):
                out[place[mine] + i] = byte
    return out, out_offsets


def gather(texts: Texts, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that outputs were made from, as bytes and offsets."""
    begin, end = texts.offsets[:-1], texts.offsets[1:]
    moved = form > 0
    at, owner = sentinels(texts.data, texts.offsets)
    at, owner = at[moved[owner]], owner[moved[owner]]
    if len(at) != 3 * moved.sum() or not (np.bincount(owner, minlength=texts.n)[moved] == 3).all():
        raise ValueError("an output does not hold its three sentinels")
    first, second, third = at[0::3], at[1::3], at[2::3]
    spm = form[moved] == 2
    p_begin, p_end = np.where(spm, second, first) + 3, np.where(spm, third, second)
    s_begin, s_end = np.where(spm, first, second) + 3, np.where(spm, second, third)
    m_begin, m_end = third + 3, end[moved]
    offsets = np.zeros(texts.n + 1, np.int64)
    np.cumsum(np.where(moved, end - begin - 9, end - begin), out=offsets[1:])
    to = offsets[:-1][moved]
    to_middle = to + p_end - p_begin
    to_suffix = to_middle + m_end - m_begin
    size = int(offsets[-1])
    begins = np.concatenate([offsets[:-1][~moved], to, to_middle, to_suffix])
    ends = np.concatenate([offsets[1:][~moved], to_middle, to_suffix, to_suffix + s_end - s_begin])
    moves = np.concatenate([(begin - offsets[:-1])[~moved], p_begin - to, m_begin - to_middle, s_begin - to_suffix])
    return texts.data[np.arange(size) + shifts(size, begins, ends, moves)], offsets


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


_NAMES = np.array(["plain", *FORMS], object)


def rearrange(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and ``output`` of every document."""
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *draws)

    def run(batches):
        for b in batches:
            texts = Texts(b.column("text"))
            drawn = np.stack([b.column(f"h{i}").to_numpy() for i in range(1, 5)], axis=1) if b.num_rows else np.zeros((0, 4), np.int64)
            n, form, first, second, cut1, cut2 = cut_places(texts, drawn)
            plain = form == 0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(_NAMES[form].tolist(), pa.string()), pa.array(first, pa.int64(), mask=plain),
                 pa.array(second - first, pa.int64(), mask=plain), _strings(*scatter(texts, form, cut1, cut2))],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """The rows of ``rearrange`` with ``restored``: the text rebuilt from ``output`` and ``form``."""
    small_batches(outputs.sparkSession)

    def run(batches):
        for b in batches:
            names = b.column("form").to_pylist()
            form = np.array([0 if f == "plain" else 1 + list(FORMS).index(f) for f in names], np.int64)
            restored = _strings(*gather(Texts(b.column("output")), form))
            yield pa.RecordBatch.from_arrays([*b.columns, restored], [*b.schema.names, "restored"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema.fields)
    return outputs.mapInArrow(run, f"{kind}, restored string")


def fim_sql() -> str:
    """Forms and digests as SQL over ``documents``."""
    draw = lambda i: f"CAST('0x' || substr(g, {1 + 8 * i}, 8) AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, {draw(0)} AS h1, {draw(1)} AS h2, {draw(2)} AS h3, {draw(3)} AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
