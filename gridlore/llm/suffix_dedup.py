"""Removal of repeated byte strings, keeping the first: longest previous factors in suffix order, within anchored contexts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_of, worker, written
from .exact_dedup import flagged

LENGTH = 100
GRAM = 32
#: An anchor with more distinct surroundings than this is compared window by window under the windows' own hashes.
HOT_CONTEXTS = 2_000
_SEGMENT = 1 << 23
_P = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram bytes from each position; gram is a power of two, reached by doubling."""
    h, width, power = b.astype(np.uint64) + np.uint64(1), 1, _P
    while width < gram:
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power & _M64
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w values in a row, from running minima within blocks of w."""
    n = len(v) - w + 1
    pad = -len(v) % w
    x = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(x, 1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window of length bytes belongs to the smallest gram in it (the first of equals): gram hash, first and last window of each anchor.

    Which gram that is depends on the window's bytes alone, so equal windows belong to equal grams, in any document.
    """
    found = []
    windows = len(data) - length + 1
    w = length - gram + 1
    b = np.frombuffer(data, np.uint8)
    for at in range(0, max(windows, 0), _SEGMENT):
        h = _gram_hashes(b[at : at + _SEGMENT + length - 1], gram)
        low = _sliding_min((h & np.uint64(_M64 ^ 0xFFFFFF)) | np.arange(len(h), dtype=np.uint64), w)
        p = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        cut = np.nonzero(np.concatenate(([True], p[1:] != p[:-1])))[0]
        found.append((h[p[cut]], cut + at, np.concatenate((cut[1:], [len(p)])) - 1 + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _nearest_earlier(at: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each suffix in suffix order its longest common prefix with the nearest one to its left that starts earlier (0 if none does).

    at: where each suffix starts; common: its common prefix with its left neighbour. The candidates jump to their own candidates, all at once: between a suffix
    and its candidate everything starts later than the candidate, so nothing is passed over; common prefixes are minima over what is jumped.
    """
    to, low = np.arange(len(at)) - 1, common.copy()
    open_ = np.nonzero((to >= 0) & (at[to] > at))[0]
    while len(open_):
        c = to[open_]
        low[open_] = np.minimum(low[open_], low[c])
        to[open_] = to[c]
        open_ = open_[(to[open_] >= 0) & (at[to[open_]] > at[open_])]
    low[to < 0] = 0
    return low


def previous_factors(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For contexts in order of position, the longest previous factor of each window, up to length: how many of its bytes, from its start, also start earlier.

    Suffixes that have length bytes are sorted by these bytes, ties in order of position, with the common prefixes of neighbours. The longest previous
    factor of a suffix is then the larger of its common prefixes with its previous and its next smaller position in suffix order.
    """
    views = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(c, np.uint8), length) for c in contexts]
    flat = np.ascontiguousarray(np.concatenate(views))
    order = np.argsort(flat.view(f"S{length}").ravel(), kind="stable")
    rows = flat[order]
    differ = rows[1:] != rows[:-1]
    common = np.concatenate(([0], np.where(differ.any(1), differ.argmax(1), length))).astype(np.int32)
    left = _nearest_earlier(order, common)
    right = _nearest_earlier(order[::-1], np.concatenate(([0], common[:0:-1])))[::-1]
    out = np.zeros(len(flat), np.int32)
    out[order] = np.maximum(left, right)
    return np.split(out, np.cumsum([len(v) for v in views])[:-1])


def _merged(doc: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Spans of each document joined where they touch."""
    order = np.lexsort((start, h, doc))
    doc, h, start, end = doc[order], h[order], start[order], end[order]
    other = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (start[1:] > end[:-1])))
    head = np.nonzero(other)[0]
    return [doc[head], h[head], start[head], np.maximum.reduceat(end, head) if len(head) else end]


_ROW = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()), ("lo", pa.int32()), ("span", pa.int32()), ("hot", pa.bool_())])
_ROW_SQL = "a long, c long, doc long, h long, lo int, span int, hot boolean"


def _rows(a, c, doc, h, lo, span, hot=None) -> pa.RecordBatch:
    """Rows of anchors; of finished spans (a null): lo to lo + span in bytes."""
    n = len(doc)
    return pa.RecordBatch.from_arrays([
        pa.nulls(n, pa.int64()) if a is None else pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()), pa.array(doc, pa.int64()), pa.array(h, pa.int64()),
        pa.array(lo, pa.int32()), pa.array(span, pa.int32()), pa.array(np.zeros(n, bool) if hot is None else hot),
    ], schema=_ROW)


def _later(head: np.ndarray, doc: np.ndarray, h: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Rows at another position than the first of their context; a row that is given twice stands at one position."""
    first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    return (doc != doc[first]) | (h != h[first]) | (lo != lo[first])


def _spans(doc, h, start, end) -> pa.RecordBatch:
    doc, h, start, end = _merged(doc, h, start, end)
    return _rows(None, None, doc, h, start, end - start)


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """docs (doc, h, text) to the spans of bytes to remove: doc, h, spans (array of struct start, end; unsorted, may overlap).

    1. Every window of length bytes belongs to an anchor, and the bytes that an anchor's windows span are its context. Each
       task folds equal contexts of its own to the earliest, and sends anchors on.
    2. Anchors meet by gram hash. Of equal contexts all but the earliest are removed whole. Where a gram has several different contexts,
       the earliest of each are asked for.
    3. Only documents that were asked give the contexts' bytes. Their suffixes are sorted, and a longest previous factor of length or more, from the
       previous and next smaller positions in suffix order, removes a window.
       Grams with more than hot_contexts contexts send single windows under their own hashes instead, folded by task,
       so no group grows with the corpus.
    """

    @worker("suffix")
    def mark(batches):
        held, size = [], 0

        def fold():
            a, c, doc, h, lo, span = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((lo, h, doc, c))
            a, c, doc, h, lo, span = (x[order] for x in (a, c, doc, h, lo, span))
            head = np.concatenate(([True], c[1:] != c[:-1]))
            again = _later(head, doc, h, lo)
            if again.any():
                yield _spans(doc[again], h[again], lo[again], lo[again] + span[again] + length)
            yield _rows(a[head], c[head], doc[head], h[head], lo[head], span[head])

        for b in batches:
            for i, hh, t in zip(b.column("doc").to_pylist(), b.column("h").to_pylist(), b.column("text"), strict=True):
                data = t.as_buffer().to_pybytes()
                a, lo, hi = anchors(data, length, gram)
                if not len(a):
                    continue
                of = xxhash.xxh3_64_intdigest
                c = np.array([of(data[x : y + length]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64)
                held.append((a.view(np.int64), c.view(np.int64), np.full(len(a), i, np.int64), np.full(len(a), hh, np.int64), lo, hi - lo))
                size += len(a)
                if size > 400_000:
                    yield from fold()
                    size = 0
        if held:
            yield from fold()

    def meet(batches):
        """Rows sorted by a, c, doc, h, lo. Whole grams are settled together; one that outgrows a batch many times is hot."""
        carry, hot_gram = None, None

        def settle(cols):
            a, c, doc, h, lo, span = cols
            head = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
            again = _later(head, doc, h, lo)
            if again.any():
                yield _spans(doc[again], h[again], lo[again], lo[again] + span[again] + length)
            a, c, doc, h, lo, span = (x[head] for x in cols)
            cut = np.nonzero(np.concatenate(([True], a[1:] != a[:-1])))[0]
            many = np.repeat(np.diff(np.concatenate((cut, [len(a)]))), np.diff(np.concatenate((cut, [len(a)]))))
            hot = many > hot_contexts
            if hot_gram is not None:
                hot |= a == hot_gram
            ask = (many > 1) | hot
            if ask.any():
                yield _rows(a[ask], c[ask], doc[ask], h[ask], lo[ask], span[ask], hot[ask])

        for b in batches:
            done = b.filter(b.column("a").is_null())
            if len(done):
                yield done.select(_ROW.names)
            b = b.filter(b.column("a").is_valid())
            if not len(b):
                continue
            cols = [np.asarray(b.column(n)) for n in ("a", "c", "doc", "h", "lo", "span")]
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            at = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if at == 0 and len(cols[0]) > 50 * hot_contexts:
                # one gram fills it all: settle whole contexts, keep the last one's earliest row
                same = np.nonzero(cols[1] != cols[1][-1])[0]
                at = int(same[-1]) + 1 if len(same) else 0
                hot_gram = cols[0][-1]
            if at:
                yield from settle([x[:at] for x in cols])
            carry = [x[at:] for x in cols]
            if hot_gram is not None and carry[0][0] != hot_gram:
                hot_gram = None
        if carry is not None:
            yield from settle(carry)

    anchored = docs.select("doc", "h", "text").mapInArrow(mark, _ROW_SQL)
    anchored = anchored.repartition(F.coalesce("a", F.xxhash64("doc", "lo"))).sortWithinPartitions("a", "c", "doc", "h", "lo")
    met = written(anchored.mapInArrow(meet, _ROW_SQL), "anchors")
    asked = met.where("a is not null").groupBy("doc", "h").agg(F.collect_list(F.struct("a", "lo", "span", "hot")).alias("asked"))
    asked = written(asked, "asked")
    given = flagged(docs, asked.select(F.col("doc").alias("digest")), "doc", "may").where("may").join(asked, ["doc", "h"]).select("doc", "h", "text", "asked")

    def quote(batches):
        """The bytes asked for; hot ones as single windows under their own hash, the later ones of this task settled here."""
        seen: dict[bytes, tuple] = {}
        names, kinds = ["a", "doc", "h", "lo", "end", "bytes"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def flush():
            rows = [(xxhash.xxh3_64_intdigest(w) - (1 << 63), *at, None, w) for w, at in seen.items()]
            seen.clear()
            return batch(rows)

        for b in batches:
            rows: list[tuple] = []
            size = 0
            for doc, h, t, asked_ in zip(b.column("doc").to_pylist(), b.column("h").to_pylist(), b.column("text"), b.column("asked").to_pylist(), strict=True):
                data = t.as_buffer().to_pybytes()
                for q in asked_:
                    lo, last = q["lo"], q["lo"] + q["span"]
                    if not q["hot"]:
                        rows.append((q["a"], doc, h, lo, None, data[lo : last + length]))
                        size += last - lo + length
                        continue
                    for s in range(lo, last + 1):
                        w, own = data[s : s + length], (doc, h, s)
                        had = seen.setdefault(w, own)
                        if had != own:
                            first, later = (had, own) if had < own else (own, had)
                            seen[w] = first
                            rows.append((None, *later, later[2] + length, None))
                if size > 8_000_000:
                    yield batch(rows)
                    rows, size = [], 0
                if len(seen) > 100_000:
                    yield flush()
            if rows:
                yield batch(rows)
        if seen:
            yield flush()

    def solve(batches):
        """Rows sorted by a, doc, h, lo; whole grams gather until there is enough to sort at once."""
        held: list[tuple] = []
        size, last = 0, None

        def settle():
            held[:] = sorted({r[:3]: r for r in held}.values(), key=lambda r: r[:3])
            marks = [f >= length for f in previous_factors([r[3] for r in held], length)]
            n = np.array([int(m.sum()) for m in marks])
            if n.sum():
                doc, h, lo = (np.repeat(np.array([r[k] for r in held]), n) for k in range(3))
                start = lo + np.concatenate([np.nonzero(m)[0] for m in marks])
                yield _spans(doc, h, start, start + length)
            held.clear()

        for b in batches:
            for a, doc, h, lo, end, bytes_ in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if a is None:
                    yield _rows(None, None, [doc], [h], [lo], [end - lo])
                    continue
                if a != last and size > 30_000:
                    yield from settle()
                    size = 0
                held.append((doc, h, lo, bytes_))
                size += len(bytes_) - length + 1
                last = a
        if held:
            yield from settle()

    quoted = given.mapInArrow(quote, "a long, doc long, h long, lo int, end int, bytes binary")
    quoted = quoted.repartition(F.coalesce("a", F.xxhash64("doc", "lo"))).sortWithinPartitions("a", "doc", "h", "lo")
    solved = quoted.mapInArrow(solve, _ROW_SQL)
    spans = met.where("a is null").unionByName(solved)
    return spans.groupBy("doc", "h").agg(F.collect_list(F.struct(F.col("lo").alias("start"), (F.col("lo") + F.col("span")).alias("end"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) for each row of docs.

    A byte goes if a string of length bytes that covers it also starts earlier: in a row with a smaller id, or before in the same text.
    Matches stay within texts, may overlap, and are judged on the texts as given. Null text: empty. Rows that repeat id and text are
    one document given twice, both with the same result; rows that share only the id are separate, in order of a hash of the text.
    Null ids come after all others. An empty table gives an empty result; other columns are left out.
    """
    last = (1 << 63) - 1
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = rows.withColumns({"doc": F.coalesce("id", F.lit(last)), "h": F.xxhash64("text")})
    spans = written(removed_spans(rows, length, gram, hot_contexts), "spans")
    marked = flagged(rows, spans.select(F.col("doc").alias("digest")), "doc", "may")

    def strip(batches):
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            out: list[tuple] = []
            size = 0
            for i, t, spans in zip(b.column("id").to_pylist(), b.column("text"), b.column("spans").to_pylist(), strict=True):
                data = t.as_buffer().to_pybytes()
                kept, at, runs, end = [], 0, 0, -1
                for s, e in sorted((x["start"], x["end"]) for x in spans or []):
                    if s > end:
                        runs += 1
                        kept.append(data[at:s])
                    end = at = max(end, e)
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((i, len(data), len(data) - len(rest), runs, rest))
                size += len(rest)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    touched = marked.where("may").join(spans, ["doc", "h"], "left").select("id", "text", "spans").mapInArrow(strip, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    nothing = F.lit(0).cast("long")
    whole = marked.where("not may").select("id", F.octet_length("text").cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return whole.unionByName(touched).withColumnRenamed("id", id_col)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
b as (select doc_id, unnest(list_transform(range(0, length(x) // 2), lambda p: substr(x, 2 * p + 1, 2))) as y, unnest(range(0, length(x) // 2)) as p from h),
t as (select doc_id, unnest(list_transform(range(0, greatest(length(x) // 2 - 99, 0)), lambda p: md5_number(substr(x, 2 * p + 1, 200)))) as w, unnest(range(0, greatest(length(x) // 2 - 99, 0))) as p from h),
g as (select doc_id, p, row_number() over (partition by w order by doc_id, p) > 1 as again from t),
m as (select doc_id, p, y, coalesce(max(case when again then 1 else 0 end) over (partition by doc_id order by p rows between 99 preceding and current row), 0) = 1 as gone from b left join g using (doc_id, p)),
v as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as head from m),
a as (select doc_id, count(*) as n_bytes, count_if(gone)::bigint as n_removed, count_if(head)::bigint as n_spans, coalesce(string_agg(y, '' order by p) filter (not gone), '') as kept from v group by 1)
select doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from documents left join a using (doc_id)"""
