"""Fill-in-the-middle transformation by displacement scatter, and its exact inverse.

A text is cut into lines; two seeded cuts between lines give prefix, middle and suffix, which are put out as
``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm). All texts of a batch are one run of
bytes. The line ends of the batch and the seeded cuts give the places where a segment begins; a difference array takes at
each of them the change of its segment's output shift, its cumulative sum is the shift of every byte, and one
numpy scatter writes all outputs, another their sentinels. Restoring reads the sentinels' places from an output and its
form, builds the shifts in the same way, and gathers the text through them.

Rows are transformed where they are, without a shuffle, in parts of bounded bytes; a longer text is a part of its own.

The seeds of a row are 8-digit groups of the sha256 of a fixed prefix and its doc_id, so a text's form does not depend on
its neighbours; a null doc_id counts as the empty string. Null texts count as empty; empty texts, and those that hold a
sentinel themselves, stay plain. A text without line feed is one line; its cuts are at its ends. Rows may repeat;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from geoquarry.llm.common import table

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, RATE, SPM_RATE = "7", 100, 50
PART_BYTES = 4 << 20
PLAIN, PSM, SPM = "plain", "psm", "spm"
_FORMS = np.array([PLAIN, PSM, SPM])
#: Segments (0 prefix, 1 middle, 2 suffix) in the order of the output.
_ORDER = {1: (0, 2, 1), 2: (2, 0, 1)}
_MARKS = (PREFIX, MIDDLE, SUFFIX)


def seeds(key: Column, seed: str = SEED) -> Column:
    """Four unsigned 32-bit numbers from the sha256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def parts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of bounded bytes, with the bytes of a text column and where each text begins (and the last ends)."""
    texts = batch.column(column)
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + PART_BYTES, "right")) - 1)
        yield batch.slice(begin, end - begin), raw[at[begin] : at[end]], at[begin : end + 1] - at[begin]
        begin = end


def _strings(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw.tobytes())).cast(pa.string())


def find(raw: np.ndarray, at: np.ndarray, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``mark`` stands whole inside one text, and the texts."""
    hit = np.ones(max(len(raw) - len(mark) + 1, 0), bool)
    for k, byte in enumerate(mark):
        hit &= raw[k : k + len(hit)] == byte
    place = np.flatnonzero(hit)
    text = np.searchsorted(at, place, "right") - 1
    inside = place + len(mark) <= at[text + 1]
    return place[inside], text[inside]


def shifts(size: int, start: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The shift of each of ``size`` bytes: segment k holds bytes from start[k] to the next start and moves by shift[k]. Ascending; empty segments may share a start."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, start, np.diff(shift, prepend=0))
    return np.cumsum(steps[:size])


def cuts(raw: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text, and the two cuts as places in the batch (texts x 2)."""
    feed = np.flatnonzero(raw == 10)
    begin, end = at[:-1], at[1:]
    first, past = np.searchsorted(feed, begin), np.searchsorted(feed, end)
    feeds = past - first
    whole = end > begin
    open_ = whole & (raw[np.maximum(end - 1, 0)] != 10) if len(raw) else whole
    n = feeds + open_
    units = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)], 1), 1)
    # after u lines: behind the u-th line feed, at the text's end where the last line has none
    line = np.clip(first[:, None] + units - 1, 0, max(len(feed) - 1, 0))
    behind = feed[line] + 1 if len(feed) else np.broadcast_to(end[:, None], units.shape)
    return n, np.where(units == 0, begin[:, None], np.where(units > feeds[:, None], end[:, None], behind))


def _layout(sizes: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where outputs begin, where their segments (prefix, middle, suffix) begin, and where the sentinels stand (-1: none)."""
    marked = form > 0
    marks = sum(map(len, _MARKS))
    at = np.concatenate([[0], np.cumsum(sizes.sum(1) + marks * marked)])
    seat, mark = np.empty_like(sizes), np.full_like(sizes, -1)
    for code in (0, 1, 2):
        rows = form == code
        here = at[:-1][rows]
        for segment in _ORDER.get(code, (0, 1, 2)):
            if code:
                mark[rows, segment] = here
                here = here + len(_MARKS[segment])
            seat[rows, segment] = here
            here = here + sizes[rows, segment]
    return at, seat, mark


def scatter(raw: np.ndarray, at: np.ndarray, cut: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all outputs and where each begins."""
    start = np.column_stack([at[:-1], cut])
    sizes = np.column_stack([cut[:, 0] - at[:-1], cut[:, 1] - cut[:, 0], at[1:] - cut[:, 1]])
    out_at, seat, mark = _layout(sizes, form)
    out = np.empty(out_at[-1], np.uint8)
    out[np.arange(len(raw)) + shifts(len(raw), start.ravel(), (seat - start).ravel())] = raw
    for segment, sentinel in enumerate(_MARKS):
        place = mark[:, segment][form > 0]
        out[place[:, None] + np.arange(len(sentinel))] = np.frombuffer(sentinel, np.uint8)
    return out, out_at


def gather(out: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``scatter`` from outputs and forms alone: bytes of all texts and where each begins."""
    begin, end, marked = at[:-1], at[1:], form > 0
    seat = np.column_stack([begin, end, end])
    mark = np.column_stack([end, end, end])
    for segment, sentinel in enumerate(_MARKS):
        place, text = find(out, at, sentinel)
        of_form = marked[text]
        place, text = place[of_form], text[of_form]
        mark[text, segment] = place
        seat[text, segment] = place + len(sentinel)
        if (np.bincount(text, minlength=len(form))[marked] != 1).any():
            raise ValueError("an output of this form has each sentinel once")
    # a segment ends where the next sentinel, or the output, does
    stop = seat.copy()
    stop[~marked, 0] = end[~marked]
    for code, order in _ORDER.items():
        rows = form == code
        for segment, later in zip(order, [*order[1:], None], strict=True):
            stop[rows, segment] = mark[rows, later] if later is not None else end[rows]
    sizes = stop - seat
    if (sizes < 0).any():
        raise ValueError("the sentinels of an output do not stand in the order of its form")
    text_at = np.concatenate([[0], np.cumsum(sizes.sum(1))])
    start = text_at[:-1, None] + np.cumsum(sizes, 1) - sizes
    size = int(text_at[-1])
    return out[np.arange(size) + shifts(size, start.ravel(), (seat - start).ravel())], text_at


def _lengths(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points between places."""
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return heads[end] - heads[start]


def transform(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars (code points; null if plain), output of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in parts(batch, "text"):
                h = part.column("seeds").flatten().to_numpy().reshape(-1, 4)
                n, cut = cuts(raw, at, h[:, 0], h[:, 1])
                plain = (at[1:] == at[:-1]) | (h[:, 2] % 100 >= rate)
                for sentinel in _MARKS:
                    plain[find(raw, at, sentinel)[1]] = True
                form = np.where(plain, 0, np.where(h[:, 3] % 100 < spm_rate, 2, 1))
                out, out_at = scatter(raw, at, cut, form)
                chars = [pa.array(_lengths(raw, a, b), pa.int64(), mask=plain) for a, b in ((at[:-1], cut[:, 0]), (cut[:, 0], cut[:, 1]))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(_FORMS[form].tolist(), pa.string()), *chars, _strings(out, out_at)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), "text", seeds(doc_id, seed).alias("seeds"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """The columns of ``outputs`` (form, output and others) and restored: the text of each output."""
    if "restored" in [c.lower() for c in outputs.columns]:
        raise ValueError("outputs have a column named restored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in parts(batch, "output"):
                form = np.array([{PSM: 1, SPM: 2}.get(f, 0) for f in part.column("form").to_pylist()])
                yield part.append_column("restored", _strings(*gather(raw, at, form)))

    return outputs.mapInArrow(run, StructType([*outputs.schema, StructField("restored", StringType())]))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(transform(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
h AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2, ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM h),
s AS (SELECT doc_id, n, text, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM s
"""
