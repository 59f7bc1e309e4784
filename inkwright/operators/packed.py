"""Several values packed in one field: one row per value, with its position.

The text of a whole Arrow batch is one array of code points. Separators, quotes and blanks are masks over it; pieces are
the runs between separators that lie outside quotes. Rows are never visited one by one: the only loop runs over the n-th
quote of all rows at once, and over the few values that hold escapes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ",;|\n\r\t\v\f，；、｜"
BLANKS = " \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
QUOTES = [('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("«", "»"), ("「", "」")]
#: Code points split at once; a longer batch is cut between rows.
BLOCK = 4_000_000


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _unescape(value: str, quote: str) -> str:
    if quote in "\"'":
        value = value.replace(quote * 2, quote)
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else m[1], value, flags=re.S)


def split_codes(codes: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """codes: the code points of all rows; row_at: where each row starts, and the end. Returns the row, start and end of
    each value in order, and (number of the value, quote) for values whose text may hold escapes."""
    n, rows = len(codes), len(row_at) - 1
    at = np.arange(n)
    row = np.repeat(np.arange(rows), np.diff(row_at))
    blank = np.isin(codes, _codes(BLANKS))
    sep = np.isin(codes, _codes(SEPARATORS))

    # a bracket pair around the whole row counts as blank
    solid = ~blank & ~sep
    first = np.full(rows, n)
    np.minimum.at(first, row[solid], at[solid])
    last = np.full(rows, -1)
    np.maximum.at(last, row[solid], at[solid])
    whole = np.flatnonzero((first < last) & (codes[np.minimum(first, max(n - 1, 0))] == ord("[")) & (codes[np.maximum(last, 0)] == ord("]"))) if n else np.array([], int)
    if len(whole):  # the opening one must pair with the last: no other outside of quotes
        brackets = np.bincount(row[(codes == ord("[")) | (codes == ord("]"))], minlength=rows)
        follows = np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1][first[whole] + 1]
        whole = whole[(brackets[whole] == 2) | np.isin(codes[follows], _codes("\"'“‘"))]
    blank[first[whole]] = True
    blank[last[whole]] = True

    # a slash separates only between blanks (or at an end of the row)
    edge_l, edge_r = row_at[:-1][row], row_at[1:][row] - 1
    white = blank | np.isin(codes, _codes("\n\r\t\v\f"))
    slash = np.flatnonzero(codes == ord("/"))
    before = (slash == edge_l[slash]) | white[np.maximum(slash - 1, 0)]
    after = (slash == edge_r[slash]) | white[np.minimum(slash + 1, n - 1)] if n else before
    sep[slash[before & after]] = True

    # the nearest character that isn't blank, to either side
    full = ~blank
    seen = np.maximum.accumulate(np.where(full, at, -1)) if n else at
    prev = np.concatenate([[-1], seen[:-1]]) if n else at
    coming = np.minimum.accumulate(np.where(full, at, n)[::-1])[::-1] if n else at
    after_it = np.concatenate([coming[1:], [n]]) if n else at
    begins = (prev < edge_l) | sep[np.maximum(prev, 0)]
    ends = (after_it > edge_r) | sep[np.minimum(after_it, max(n - 1, 0))]

    # a quote behind an odd number of backslashes is text
    text = np.zeros(n, bool)
    if (codes == 92).any():
        other = np.maximum.accumulate(np.where(codes != 92, at, -1))
        start = np.maximum(np.concatenate([[-1], other[:-1]]), edge_l - 1)
        text = (at - 1 - start) % 2 == 1
    opens, closes = np.zeros(n, np.int8), np.zeros(n, np.int8)
    for k, (a, b) in enumerate(QUOTES, 1):
        shut = (codes == ord(b)) & ends & ~text
        final = np.full(rows, -1)
        np.maximum.at(final, row[shut], at[shut])
        closes[shut] = k
        opens[(codes == ord(a)) & begins & ~text & (at < final[row])] = k  # else nothing would close it

    # parity of quotes: the n-th event of every row in one step
    event = np.flatnonzero(opens | closes)
    inside = np.zeros(n + 1, np.int32)
    close_of = np.full(n, -1)
    if len(event):
        r, where, count = np.unique(row[event], return_index=True, return_counts=True)
        state, since = np.zeros(len(r), np.int8), np.zeros(len(r), np.int64)
        for step in range(count.max()):
            live = np.flatnonzero(count > step)
            e = event[where[live] + step]
            shut = (state[live] > 0) & (closes[e] == state[live])
            done = live[shut]
            close_of[since[done]] = e[shut]
            op = (state[live] == 0) & (opens[e] > 0)
            state[done] = 0
            state[live[op]], since[live[op]] = opens[e[op]], e[op]
        o = np.flatnonzero(close_of >= 0)
        np.add.at(inside, o, 1)
        np.add.at(inside, close_of[o] + 1, -1)
    cut = np.flatnonzero(sep & (np.cumsum(inside[:n]) == 0))

    # pieces between cuts, without blanks and separators around them
    lo = np.sort(np.concatenate([row_at[:-1], cut + 1]), kind="stable")
    hi = np.sort(np.concatenate([row_at[1:], cut]), kind="stable")
    of = np.searchsorted(row_at, lo, side="right") - 1
    empty_rows = lo >= hi
    lo, hi, of = lo[~empty_rows], hi[~empty_rows], of[~empty_rows]
    if not len(lo):
        return of, lo, hi, []
    lo = coming[lo]
    keep = lo < hi
    lo, hi, of = lo[keep], hi[keep], of[keep]
    hi = seen[hi - 1] + 1
    quoted = (close_of[lo] == hi - 1) & (close_of[lo] >= 0)
    kind = np.where(quoted, opens[lo], 0)
    lo, hi = np.where(quoted, lo + 1, lo), np.where(quoted, hi - 1, hi)
    full2 = ~(blank | white)
    seen2 = np.maximum.accumulate(np.where(full2, at, -1))
    coming2 = np.append(np.minimum.accumulate(np.where(full2, at, n)[::-1])[::-1], n)
    lo = np.where(quoted, np.minimum(coming2[lo], hi), lo)
    hi = np.where(quoted & (lo < hi), seen2[np.maximum(hi - 1, 0)] + 1, hi)
    keep = lo < hi
    lo, hi, of, kind = lo[keep], hi[keep], of[keep], kind[keep]
    odd = np.zeros(n + 1, np.int64)
    np.cumsum((codes == 92) | np.isin(codes, _codes("\"'")), out=odd[1:])
    return of, lo, hi, [(int(i), QUOTES[kind[i] - 1][0]) for i in np.flatnonzero((kind > 0) & (odd[hi] > odd[lo]))]


def split_array(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Values packed in an Arrow string array: the row, the position from 1 and the text of each."""
    texts = texts.cast(pa.large_string())
    valid = np.flatnonzero(~np.asarray(texts.is_null()))
    texts = texts.drop_null()
    if not len(texts):
        return np.array([], np.int64), np.array([], np.int32), pa.array([], pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.array([], np.uint8)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    row_at = chars[at - at[0]]
    codes = _codes(raw.tobytes().decode("utf-8"))
    of, lo, hi, escaped = split_codes(codes, row_at)
    size = hi - lo
    begin = np.concatenate([[0], np.cumsum(size)])
    picked = codes[np.repeat(lo - begin[:-1], size) + np.arange(begin[-1])]
    width = np.concatenate([[0], np.cumsum(1 + (picked > 0x7F) + (picked > 0x7FF) + (picked > 0xFFFF))])
    body = picked.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    # list array: the children's offsets by parent, flattened with the parents' ordinals
    values = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.ascontiguousarray(width[begin], np.int64)), pa.py_buffer(body))
    per_row = np.bincount(of, minlength=len(texts))
    child = np.concatenate([[0], np.cumsum(per_row)])
    values = pa.LargeListArray.from_arrays(pa.array(child, pa.int64()), values).flatten().cast(pa.string())
    if escaped:  # only these values are touched
        escaped = sorted(escaped)
        mask = np.zeros(len(values), bool)
        mask[[i for i, _ in escaped]] = True
        fixed = [_unescape(v, quote) for v, (_, quote) in zip(values.filter(pa.array(mask)).to_pylist(), escaped)]
        values = pc.replace_with_mask(values, pa.array(mask), pa.array(fixed, pa.string()))
    return valid[of], (np.arange(len(of)) - child[of] + 1).astype(np.int32), values


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    block = np.cumsum(size, dtype=np.int64) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def explode_packed(df: DataFrame, column: str, pos: str = "pos", value: str = "tag") -> DataFrame:
    """One row for each value packed in `column`, which gives way to `pos` (from 1) and `value`; other columns are kept.

    Separators: comma, semicolon, bar, line break, tab and their wide and ideographic forms, in any mixture, and a slash
    with blanks around it. A separator inside quotes belongs to the value. Blanks, quotes and escapes inside the quotes are
    removed, as are square brackets around the whole field. A quote counts only at the edge of a value and only if it is
    closed; an apostrophe within a word is text. Null, empty and blank fields give no row; empty pieces take no position;
    repeated values stay. Texts of any length are split whole. Columns named like `pos` or `value` are replaced.
    """
    others = [c for c in df.columns if c not in (column, pos, value)]
    src = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{column}`").cast("string").alias("__packed"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__packed"), f"`{pos}` int", f"`{value}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _blocks(whole, "__packed"):
                parent, place, values = split_array(batch.column("__packed"))
                ids = pa.array(parent, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(ids) for c in others), pa.array(place, pa.int32()), values], names=[*others, pos, value])

    return src.where(F.length(F.trim("__packed")) > 0).mapInArrow(run, schema)


def tag_rows(papers: DataFrame, uploads: DataFrame) -> DataFrame:
    """The tags of papers and uploads: (rec_kind, rec_id, pos, tag)."""
    src = papers.select(F.lit("paper").alias("rec_kind"), F.col("id").alias("rec_id"), "tags").unionByName(
        uploads.select(F.lit("upload").alias("rec_kind"), F.col("id").alias("rec_id"), "tags")
    )
    return explode_packed(src, "tags", "pos", "tag")
