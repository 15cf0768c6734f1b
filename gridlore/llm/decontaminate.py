"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import re
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, table, text_of, worker, written

WORDS = re.compile(r"\w+")
SHINGLE = 5
CONTAINMENT = Fraction(4, 5)
#: Bytes of an index (texts of its items and sketches) that one map pass holds; larger benchmarks take several passes over the documents.
BLOCK_BYTES = 16 << 20


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def shingles_of(found: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    """Runs of width words; a shorter text is one run of all its words; none without a word."""
    if not found:
        return set()
    if len(found) < width:
        return {tuple(found)}
    return set(zip(*(found[i:] for i in range(width)), strict=False))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _runs(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of width ids none of which is 0."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        ok &= ids[k : k + n] != 0
    return _mix(h[ok])


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) | 1


def sketch_size(n: int, containment: Fraction) -> int:
    """How many of the smallest hashes of an item of n shingles are kept: what a document may lack of the largest item of its size class, and one."""
    largest = (1 << n.bit_length()) - 1
    return largest - -(-largest * containment.numerator // containment.denominator) + 1


def sketches(items: DataFrame, containment: Fraction, width: int) -> DataFrame:
    """i, t of each row of items that has a word, with its number of distinct shingles n, their width w, and its sketch of smallest hashes."""

    @worker("decontaminate")
    def make(batches):
        for b in batches:
            rows = []
            for k, t in enumerate(b.column("t").to_pylist()):
                own = shingles_of(words(t), width)
                if own:
                    ids = np.array([[_hash(w) for w in run] for run in own], np.uint64)
                    h = np.unique(np.concatenate([_runs(row, len(row)) for row in ids]))[: sketch_size(len(own), containment)]
                    rows.append((k, len(own), ids.shape[1], h.tobytes()))
            if rows:
                k, n, w, h = zip(*rows, strict=True)
                at = pa.array(k, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("i").take(at), b.column("t").take(at), pa.array(n, pa.int64()), pa.array(w, pa.int32()), pa.array(h, pa.binary())], ["i", "t", "n", "w", "h"])

    return items.mapInArrow(make, f"i {items.schema['i'].dataType.simpleString()}, t string, n long, w int, h binary")


class ContainmentIndex:
    """MinHash sketches of short items, by size class: shingle counts from a power of two up to less than the next.

    A document that holds at least c of an item's q shingles lacks at most q - ceil(c q) of them. So of the item's s smallest
    hashes, s one more than that for the class's largest q, the document's shingles must hit one: no
    item is missed, whatever the document's length. What is hit is verified on the words themselves.
    """

    def __init__(self, items: list[tuple], containment: Fraction = CONTAINMENT, width: int = SHINGLE):
        """items: id, text, shingles, width of a shingle and sketch of each, as sketches() gives them."""
        self.width, self.containment = width, containment
        self.ids, self.texts = [i for i, *_ in items], [t for _, t, *_ in items]
        self.sizes, self.runs = np.array([n for _, _, n, _, _ in items], np.int64), np.array([w for _, _, _, w, _ in items], np.int64)
        self.widths = sorted(set(self.runs.tolist()))
        by_class: dict[int, list[int]] = {}
        for k, n in enumerate(self.sizes.tolist()):
            by_class.setdefault(n.bit_length() - 1, []).append(k)
        self.classes: list[tuple[int, np.ndarray, np.ndarray]] = []
        for c, members in sorted(by_class.items()):
            parts = [np.frombuffer(items[k][4], np.uint64) for k in members]
            flat, who = np.concatenate(parts), np.repeat(members, [len(x) for x in parts])
            order = np.argsort(flat, kind="stable")
            self.classes.append((1 << c, flat[order], who[order]))
        self._vocab: dict[str, int] = {}
        self._sets: dict[int, set] = {}

    def __getstate__(self):
        return self.__dict__ | {"_vocab": {}, "_sets": {}}

    def _set(self, k: int) -> set:
        """The shingles of item k, kept for those that are hit."""
        if k not in self._sets:
            self._sets[k] = shingles_of(words(self.texts[k]), self.width)
        return self._sets[k]

    def find(self, text: str) -> list[tuple]:
        """(item id, shared shingles, item's shingles) for each item that the text contains."""
        if not self._vocab:
            self._vocab.update((w, _hash(w)) for t in self.texts for w in words(t))
        found = words(text)
        ids = np.fromiter(map(self._vocab.get, found, repeat(0)), np.uint64, len(found))
        hits = np.unique(np.concatenate([_runs(ids, w) for w in self.widths])) if self.widths else ids[:0]
        if not len(hits):
            return []
        near: set[int] = set()
        for low, sketch, owner in self.classes:
            if len(hits) * self.containment.denominator < low * self.containment.numerator:
                continue  # fewer shingles than any item of this class needs
            a, b = np.searchsorted(sketch, hits, "left"), np.searchsorted(sketch, hits, "right")
            for i in np.nonzero(b > a)[0]:
                near.update(owner[a[i] : b[i]].tolist())
        out = []
        own: dict[int, set] = {}
        for k in sorted(near):
            width = int(self.runs[k])
            if width not in own:
                own[width] = set(zip(*(found[i:] for i in range(width)), strict=False))
            shared = len(self._set(k) & own[width])
            if shared * self.containment.denominator >= int(self.sizes[k]) * self.containment.numerator:
                out.append((self.ids[k], shared, int(self.sizes[k])))
        return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", containment: Fraction = CONTAINMENT, width: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id_col, item_id, shared, item_shingles, containment for each document and each item that it contains.

    An item is contained if at least containment of its distinct shingles (width lower-cased words in a row, words being runs of
    letters, digits and underscores) occur in the whole document; an item of fewer words is one shingle. Sketches are made in tasks. Items
    travel in blocks of whole items with texts and sketches of at most block_bytes together (an item beyond that makes a block of its own), each
    broadcast for one map pass over the documents, so no broadcast grows with the benchmark and nothing of the documents is shuffled.

    Null or empty texts contain nothing and are contained nowhere. Repeated documents and items give a row each; ids of any type and null ids
    are carried. Other columns are left out. Empty tables give an empty result.
    """
    spark = bounded_batches(docs.sparkSession)
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    chosen = sketches(items.select(F.col(item_id).alias("i"), text_of(item_text).alias("t")), containment, width)
    chosen = chosen.withColumns({"size": F.octet_length("t") + F.octet_length("h") + 64, "k": F.monotonically_increasing_id()})
    chosen = written(chosen.withColumn("file", F.spark_partition_id()), "sketches")
    names, item_type = ["id", "item_id", "shared", "item_shingles"], to_arrow_type(items.schema[item_id].dataType)
    out = None
    for part in _blocks(chosen, block_bytes):
        sent = spark.sparkContext.broadcast(ContainmentIndex([(r["i"], r["t"], r["n"], r["w"], bytes(r["h"])) for r in part.select("i", "t", "n", "w", "h").collect()], containment, width))

        @worker("decontaminate")
        def search(batches, sent=sent):
            index = sent.value
            for b in batches:
                got = [(row, *hit) for row, t in enumerate(b.column(1)) for hit in index.find(t.as_py())]
                if got:
                    row, item, shared, n = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(item, item_type), pa.array(shared, pa.int64()), pa.array(n, pa.int64())], names)

        found = rows.mapInArrow(search, f"id {kinds[0]}, item_id {kinds[1]}, shared long, item_shingles long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"id {kinds[0]}, item_id {kinds[1]}, shared long, item_shingles long")
    return out.select(F.col("id").alias(id_col), "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def _blocks(chosen: DataFrame, most: int):
    """The rows of chosen (k, size, file) in blocks of at most most bytes, cut in order of k, which rises with file: only sums by file and sizes of the files that are cut reach the driver."""
    files = chosen.groupBy("file").agg(F.sum("size").alias("size"), F.min("k").alias("low"), F.max("k").alias("high")).orderBy("file").collect()
    begin, held, last = None, 0, None
    for f in files:
        whole = held + f["size"] <= most
        steps = [(f["low"], f["high"], f["size"])] if whole else [(r["k"], r["k"], r["size"]) for r in chosen.where(F.col("file") == f["file"]).select("k", "size").orderBy("k").toLocalIterator()]
        for low, high, size in steps:
            if held and held + size > most:
                yield chosen.where(F.col("k").between(begin, last))
                begin, held = None, 0
            begin, last, held = low if begin is None else begin, high, held + size
    if held:
        yield chosen.where(F.col("k").between(begin, last))


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
with dw as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from documents),
iw as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from benchmark),
i as (select distinct item_id, least(len(w), 5) as k, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') as s from (select item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as p from iw where len(w) > 0)),
d as (select distinct doc_id, k, array_to_string(w[p : p + k - 1], ' ') as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from dw, (select distinct k from i) where len(w) >= k)),
n as (select item_id, count(*) as item_shingles from i group by 1),
h as (select doc_id, item_id, count(*) as shared from d join i using (k, s) group by 1, 2)
select doc_id, item_id, shared, item_shingles, shared / item_shingles as containment from h join n using (item_id) where shared * 5 >= item_shingles * 4"""
