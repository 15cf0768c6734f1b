"""Texts and table rows cut into chunks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.functions.cells import row_text
from gridlore.functions.texts import page_text
from gridlore.operators.tables import number_in_blocks, with_offsets
from gridlore.shared import freeing, written

TEXT_SIZE, ROW_BUDGET, ROWS = 2000, 3500, 50
#: Row numbers of a sheet whose lengths one task holds, and blocks whose passages it goes through in order.
BLOCK_ROWS, FAN = 65_536, 512
#: Chunks of fixed rows that one task numbers.
BLOCK_CHUNKS = 4096


def pack_words(text: str, size: int) -> list[str]:
    """Words in order, as many to a chunk as fit; each counts its length and one. A text within size stays as it is.

    A chunk ends at the last space that leaves it shorter than size, so the work is by chunk, not by word.
    """
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start >= size:
        end = text.rfind(" ", start, start + size)
        end = text.find(" ", start) if end < 0 else end  # a word that is too long is a chunk by itself
        if end < 0:
            break
        out.append(text[start:end])
        start = end + 1
    out.append(text[start:])
    return out


def chunk_texts(pages: DataFrame, size: int = TEXT_SIZE) -> DataFrame:
    """pages (document_id, page, content; a page once) to document_id, page, chunk_index, content, chunk_id.

    White space is collapsed first and empty pages are dropped. Packing is sequential, so it runs on Arrow batches, in time linear
    in a text of any length; its chunks are written once, page by page. chunk_index runs over a document's pages: the chunks of the pages before
    are summed from counts alone (see page_offsets), and only pages after a document's first have any, so where documents have one page no
    content moves. Pages of a null document are left out.
    """

    @freeing
    def cut(batches):
        for b in batches:
            made = [pack_words(t, size) for t in b.column(2).to_pylist()]
            if made:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(m) for m in made], pa.int32()), pa.array(made, pa.list_(pa.string()))], ["document_id", "page", "n", "contents"])

    clean = pages.select(F.col("document_id").cast("string"), F.col("page").cast("int"), page_text(F.col("content")).alias("content")).where("content is not null and document_id is not null")
    cut_pages = written(clean.mapInArrow(cut, "document_id string, page int, n int, contents array<string>"), "pages")
    before = written(page_offsets(cut_pages), "offsets")
    placed = cut_pages.join(before.withColumnsRenamed({"document_id": "d", "page": "p"}), (F.col("document_id") == F.col("d")) & F.col("page").eqNullSafe(F.col("p")), "left")
    each = placed.select("document_id", "page", F.coalesce("before", F.lit(0)).alias("before"), F.posexplode("contents").alias("pos", "content"))
    return with_chunk_ids(each.select("document_id", "page", "content", (F.col("before") + F.col("pos")).cast("int").alias("chunk_index")))


def page_offsets(counts: DataFrame, block_pages: int = BLOCK_CHUNKS) -> DataFrame:
    """counts (document_id, page, n) to document_id, page, before: the chunks of the document's pages before, where there are any.

    Sums go from block to block of block_pages pages, so that no task sorts a document; a null page comes first.
    """
    block = F.floor(F.coalesce("page", F.lit(0)) / block_pages)
    rows = counts.select("document_id", "page", "n", block.alias("__block"))
    order = Window.partitionBy("document_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("document_id", "__block").agg(F.sum("n").alias("m"))
    sums = sums.select("document_id", "__block", F.coalesce(F.sum("m").over(order), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("document_id", "__block").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    placed = with_offsets(rows.withColumn("__inside", F.coalesce(F.sum("n").over(inside), F.lit(0))), sums, ["document_id"])
    return placed.select("document_id", "page", (F.col("__before") + F.col("__inside")).alias("before")).where("before > 0")


def number_chunks(chunks: DataFrame, order: Sequence[str], key: str = "document_id", block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """chunk_index from 0 within each document, in order; the first of order is a number. Rows that repeat a key and an order share a number.

    Keys alone are numbered, in blocks of block_chunks of the first of order; contents meet their numbers in one join and are in no window.
    """
    keys = chunks.select(key, *order).distinct()
    numbered = number_in_blocks(keys, [key], list(order), F.floor(F.coalesce(F.col(order[0]), F.lit(-(1 << 40))) / block_chunks), "chunk_index")
    names = {c: f"__n{i}" for i, c in enumerate([key, *order])}
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    rows = chunks if "chunk_index" in order else chunks.drop("chunk_index")
    return rows.join(numbered.withColumnRenamed("chunk_index", "__at").withColumnsRenamed(names), reduce(lambda x, y: x & y, on)).withColumn("chunk_index", F.col("__at").cast("int")).drop("__at", *names.values())


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", F.md5(F.concat_ws(":", "document_id", F.col("chunk_index").cast("string"))))


def row_lines_of(df: DataFrame, columns: Sequence[str], row_number: str, keep: Sequence[str] = (), headers: Sequence[str | None] | None = None) -> DataFrame:
    """keep, row_start (the header counts as row 1), line: 'Row n: Header=value, ...'; blank rows are left out."""
    n = (F.col(row_number) + 1).cast("bigint")
    lines = df.select(*keep, n.alias("row_no"), row_text(df, columns, headers).alias("body")).where("body <> ''")
    return lines.select(*keep, "row_no", F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(": "), F.col("body")).alias("line"))


@dataclass
class Passage:
    """What packing does with a block of lines: from the characters used in the chunk that is open at its start to those used at its end, and the chunks closed between.

    The first line that doesn't fit decides, and all after it follows from that alone. So a block is a list of at most budget + 1 cases: ends[i] is the length of
    its lines up to line i; a chunk that line i opens leaves exits[i] characters in the block's last chunk, after breaks[i] more breaks. total: the
    length of all its lines. Two passages in a row make one passage again.
    """

    ends: np.ndarray
    exits: np.ndarray
    breaks: np.ndarray
    total: int

    @classmethod
    def of(cls, sizes: np.ndarray, budget: int) -> Passage:
        ends = np.cumsum(sizes)
        starts = ends - sizes
        # where the chunk that a line opens ends: the first later line that doesn't fit
        stop = np.maximum(np.searchsorted(ends, starts + budget, "right"), np.arange(1, len(sizes) + 1)).tolist()
        n, total = len(sizes), int(ends[-1])
        exits, breaks = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            j = stop[i]
            if j < n:
                exits[i], breaks[i] = exits[j], breaks[j] + 1
            else:
                exits[i] = total - int(starts[i])
        m = min(n, int(np.searchsorted(ends, budget - 1, "right")) + 1)
        return cls(ends[:m], np.array(exits[:m], np.int64), np.array(breaks[:m], np.int64), total)

    def through(self, used: int, budget: int) -> tuple[int, int]:
        """The characters used at the end and the breaks on the way; used 0 is the start of a sheet, where the first line opens a chunk without a break."""
        if not used:
            return int(self.exits[0]), int(self.breaks[0])
        i = int(np.searchsorted(self.ends, budget - used, "right"))
        return (int(self.exits[i]), int(self.breaks[i]) + 1) if i < len(self.ends) else (used + self.total, 0)

    def then(self, other: Passage, budget: int) -> Passage:
        after = [other.through(int(u), budget) for u in self.exits]
        exits, breaks = np.array([a for a, _ in after], np.int64), self.breaks + np.array([b for _, b in after], np.int64)
        ends = self.ends
        if self.total < budget:  # a chunk can stay open all through the first
            ends, exits, breaks = np.concatenate([ends, self.total + other.ends]), np.concatenate([exits, other.exits]), np.concatenate([breaks, other.breaks])
            m = min(len(ends), int(np.searchsorted(ends, budget - 1, "right")) + 1)
            ends, exits, breaks = ends[:m], exits[:m], breaks[:m]
        return Passage(ends, exits, breaks, self.total + other.total)


_KEYS = ("document_id", "sheet_name")
_PASSAGE = "document_id string, sheet_name string, block bigint, ends array<bigint>, exits array<bigint>, breaks array<bigint>, total bigint"
_ENTRY = "document_id string, sheet_name string, block bigint, used bigint, part bigint"


def _by_block(batches, columns: Sequence[str]):
    """Sorted batches as (document, sheet, block), then the columns' arrays of all its rows; holds one block."""
    at, held = None, []
    for b in batches:
        start = 0
        for key, run in groupby(zip(*(b.column(c).to_pylist() for c in (*_KEYS, "block")), strict=True)):
            n = sum(1 for _ in run)
            if key != at:
                if at:
                    yield at, [pa.concat_arrays(c) for c in zip(*held, strict=True)]
                at, held = key, []
            held.append([b.column(c).slice(start, n) for c in columns])
            start += n
    if at:
        yield at, [pa.concat_arrays(c) for c in zip(*held, strict=True)]


def _passage_rows(found, names: Sequence[str]):
    kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
    for key, p in found:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*key, p.ends, p.exits, p.breaks, p.total), kinds, strict=True)], list(names))


_PASSAGE_NAMES = tuple(c.split()[0] for c in _PASSAGE.replace("array<bigint>", "array").split(", "))


def _read_passages(batches):
    for b in batches:
        for doc, sheet, block, group, ends, exits, breaks, total in zip(*(b.column(c) for c in (*_KEYS, "block", "group", "ends", "exits", "breaks", "total")), strict=True):
            yield (doc.as_py(), sheet.as_py()), block.as_py(), group.as_py(), Passage(*(x.values.to_numpy() for x in (ends, exits, breaks)), total.as_py())


def _composed(passages: DataFrame, fan: int, budget: int) -> DataFrame:
    """The passage of each fan blocks in a row, numbered anew."""

    @freeing
    def compose(batches):
        def groups():
            at, held = None, None
            for key, _, group, p in _read_passages(batches):
                if (*key, group) != at:
                    if at:
                        yield at, held
                    at, held = (*key, group), p
                else:
                    held = held.then(p, budget)
            if at:
                yield at, held

        yield from _passage_rows(groups(), _PASSAGE_NAMES)

    return _grouped(passages, fan).mapInArrow(compose, _PASSAGE)


def _grouped(passages: DataFrame, fan: int) -> DataFrame:
    rows = passages.withColumn("group", F.floor(F.col("block") / fan))
    return rows.repartition(*_KEYS, "group").sortWithinPartitions(*_KEYS, "group", "block")


def _entries(passages: DataFrame, above: DataFrame | None, fan: int, budget: int) -> DataFrame:
    """The state in which packing enters each block: characters used in the open chunk (0 at a sheet's start), and its number.

    above: the states in which it enters each fan of them; without it, a sheet's blocks are one group.
    """
    start = [F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("part")]
    if above is None:
        rows = passages.select("*", F.lit(0).cast("bigint").alias("group"), *start)
    else:
        rows = passages.withColumn("group", F.floor(F.col("block") / fan)).join(above.withColumnRenamed("block", "group"), [*_KEYS, "group"])
    rows = rows.repartition(*_KEYS, "group").sortWithinPartitions(*_KEYS, "group", "block")

    @freeing
    def enter(batches):
        at, used, part = None, 0, 0
        for b in batches:
            out = []
            for (key, block, group, p), u, n in zip(_read_passages([b]), b.column("used").to_pylist(), b.column("part").to_pylist(), strict=True):
                if (*key, group) != at:
                    at, used, part = (*key, group), u, n
                out.append((*key, block, used, part))
                used, more = p.through(used, budget)
                part += more
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["document_id", "sheet_name", "block", "used", "part"])

    return rows.mapInArrow(enter, _ENTRY)


def _parts(lines: DataFrame, budget: int, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """document_id, sheet_name, row_no, part: which chunk of its sheet each line falls in.

    Where a chunk ends depends on all lines before it. So blocks of block_rows row numbers become passages, in parallel; passages are composed fan by fan
    until a sheet has at most fan of them; states are handed down again, and each block is packed from its own state. A task holds one block's lengths or
    one passage.
    """
    sizes = lines.select(*[F.col(k).cast("string") for k in _KEYS], F.col("row_no").cast("bigint"), F.floor(F.col("row_no") / block_rows).alias("block"), (F.length("line") + 1).cast("bigint").alias("size"))

    @freeing
    def measure(batches):
        yield from _passage_rows(((key, Passage.of(size.to_numpy(), budget)) for key, (size,) in _by_block(batches, ["size"])), _PASSAGE_NAMES)

    blocks = sizes.repartition(*_KEYS, "block").sortWithinPartitions(*_KEYS, "block", "row_no")
    levels = [written(blocks.mapInArrow(measure, _PASSAGE), "passages")]
    while levels[-1].groupBy(*_KEYS).count().where(F.col("count") > fan).limit(1).count():
        levels.append(written(_composed(levels[-1], fan, budget), "passages"))
    entries = None
    for level in reversed(levels):
        entries = _entries(level, entries, fan, budget)
    entries = written(entries, "entries")

    @freeing
    def cut(batches):
        for key, (rows, size, used, part) in _by_block(batches, ["row_no", "size", "used", "part"]):
            out, u, n = [], used[0].as_py(), part[0].as_py()
            for s in size.to_pylist():
                if u and u + s > budget:
                    u, n = 0, n + 1
                u += s
                out.append(n)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(out), pa.string()) for k in key[:2]] + [rows, pa.array(out, pa.int32())], ["document_id", "sheet_name", "row_no", "part"])

    placed = sizes.join(entries, [*_KEYS, "block"]).repartition(*_KEYS, "block").sortWithinPartitions(*_KEYS, "block", "row_no")
    return written(placed.mapInArrow(cut, "document_id string, sheet_name string, row_no bigint, part int"), "parts")


def chunk_rows_by_budget(lines: DataFrame, budget: int = ROW_BUDGET, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """lines (document_id, sheet_name, row_no, line; one a row number) packed up to budget characters, each line counting its length and one.

    Only lengths are packed in order, and those block by block in parallel (see _parts); the lines themselves are gathered chunk by chunk. Lines of a
    null document or sheet are left out.
    """
    keys = ["document_id", "sheet_name"]
    parts = _parts(lines.where(F.col("document_id").isNotNull() & F.col("sheet_name").isNotNull()), budget, block_rows, fan)
    one = F.array_sort(F.collect_list(F.struct("row_no", "line")))
    packed = lines.join(parts, [*keys, "row_no"]).groupBy(*keys, "part").agg(one.alias("l"))
    packed = packed.select(*keys, "part", F.col("l")[0]["row_no"].alias("row_start"), F.element_at("l", -1)["row_no"].alias("row_end"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))
    # chunks of the sheets before, from counts alone
    before = Window.partitionBy("document_id").orderBy("sheet_name").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(*keys).agg((F.max("part") + 1).alias("n"))
    offsets = counts.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return with_chunk_ids(packed.join(offsets, keys).withColumn("chunk_index", (F.col("part") + F.col("before")).cast("int")).drop("part", "before"))


def chunk_rows_fixed(lines: DataFrame, rows: int = ROWS, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """lines in chunks of rows row numbers, numbered over a document's sheets in blocks."""
    part = F.floor((F.col("row_no") - 2) / rows)
    one = F.struct("row_no", "line")
    grouped = lines.groupBy("document_id", "sheet_name", part.alias("part")).agg(F.array_sort(F.collect_list(one)).alias("l"))
    block = F.struct("sheet_name", F.floor(F.col("part") / block_chunks))
    grouped = number_in_blocks(grouped, ["document_id"], ["part"], block, "chunk_index").withColumn("chunk_index", F.col("chunk_index").cast("int"))
    made = grouped.select("document_id", "sheet_name", (F.col("part") * rows + 2).cast("bigint").alias("row_start"), F.array_max(F.transform("l", lambda x: x["row_no"])).alias("row_end"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"), "chunk_index")
    return with_chunk_ids(made)


def chunk_documents(texts: DataFrame, lines: DataFrame, size: int = TEXT_SIZE, budget: int = ROW_BUDGET) -> DataFrame:
    """Text documents by words and tables by rows, as one table of chunks with a struct of where each is from."""
    none = lambda kind: F.lit(None).cast(kind)
    meta = lambda page, sheet, a, b: F.struct(page.alias("page"), sheet.alias("sheet"), a.alias("row_start"), b.alias("row_end")).alias("meta")
    a = chunk_texts(texts, size).select("chunk_id", "document_id", "chunk_index", "content", meta(F.col("page"), none("string"), none("bigint"), none("bigint")))
    b = chunk_rows_by_budget(lines, budget).select("chunk_id", "document_id", "chunk_index", "content", meta(none("int"), F.col("sheet_name"), F.col("row_start"), F.col("row_end")))
    return a.unionByName(b)
