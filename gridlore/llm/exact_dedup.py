"""Exact deduplication over a log-structured merge index of digests."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_of, worker, written

#: Entries of a memtable (one per distinct digest) before it is flushed.
MEMTABLE_ENTRIES = 200_000
#: Bits of a filter for each digest, and the most that a task is sent; with more digests, filters are made for the files that they meet (see flagged).
BITS_PER_DIGEST, MAX_BITS = 12, 1 << 26
FILTER_HASHES = 4


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def flush(rows: DataFrame, keep: str = "largest", entries: int = MEMTABLE_ENTRIES) -> DataFrame:
    """rows (digest binary, id long) through memtables: runs of (run, digest, keep_id, n), each sorted by digest.

    Each task fills its own memtable, which folds copies as they come, and flushes it when it is full: a hot digest leaves a
    task once a run, however many copies the task meets.
    """
    best = max if keep == "largest" else min

    @worker("exact")
    def fill(batches):
        mem: dict[bytes, list[int]] = {}

        def run():
            order = sorted(mem)
            name = [uuid.uuid4().hex] * len(order)
            return pa.RecordBatch.from_arrays([pa.array(name), pa.array(order, pa.binary()), pa.array([mem[d][0] for d in order], pa.int64()), pa.array([mem[d][1] for d in order], pa.int64())], ["run", "digest", "keep_id", "n"])

        for b in batches:
            for d, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                slot = mem.get(d)
                if slot is None:
                    if len(mem) >= entries:
                        yield run()
                        mem.clear()
                    mem[d] = [i, 1]
                else:
                    slot[1] += 1
                    if i is not None:
                        slot[0] = i if slot[0] is None else best(slot[0], i)
        if mem:
            yield run()

    return rows.select("digest", "id").mapInArrow(fill, "run string, digest binary, keep_id long, n long")


def _hashes(digest: Column) -> tuple[Column, Column]:
    """Two hashes of 40 bits, so that their sums stay within a long."""
    return tuple(F.xxhash64(digest, F.lit(k)).bitwiseAND(F.lit((1 << 40) - 1)) for k in range(2))


def _power(n: int, most: int) -> int:
    """Bits of a filter for n digests: a power of two."""
    return min(most, 1 << max(6, (BITS_PER_DIGEST * n - 1).bit_length()))


def _words(hashed: DataFrame, bits: int, *by: str) -> DataFrame:
    """by, w, b: the words of 32 bits of the filter of the hashes h1, h2, one filter for each value of by."""
    at = F.explode(F.array(*[F.col("h1") + F.lit(k) * F.col("h2") for k in range(FILTER_HASHES)]))
    at = hashed.select(*by, at.alias("p")).select(*by, F.col("p").bitwiseAND(F.lit(bits - 1)).alias("p"))
    on = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(32)).cast("int"))
    return at.groupBy(*by, (F.col("p") / 32).cast("int").alias("w")).agg(F.bit_or(on).alias("b"))


class DigestFilter:
    """Bloom filters of digests, one for each run; a filter never loses a digest. words: those of all filters in a row; starts, bits: by run."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, bits: np.ndarray):
        self.words, self.starts, self.bits = words, starts, bits

    @staticmethod
    def positions(h1: np.ndarray, h2: np.ndarray, bits):
        for k in range(FILTER_HASHES):
            yield (h1 + k * h2) & (bits - 1)

    @classmethod
    def made(cls, h1: np.ndarray, h2: np.ndarray, bits: int) -> bytes:
        """The filter of one run, from the two hashes of its digests."""
        on = np.zeros(bits, bool)
        for at in cls.positions(h1, h2, bits):
            on[at] = True
        return np.packbits(on, bitorder="little").tobytes()

    @classmethod
    def joined(cls, filters: dict[int, bytes], runs: int) -> DigestFilter:
        """Filters by run; runs without one hold nothing."""
        sizes = np.array([len(filters.get(r, b"\0" * 8)) for r in range(runs)], np.int64)
        words = np.frombuffer(b"".join(filters.get(r, b"\0" * 8) for r in range(runs)), np.uint8)
        return cls(words, np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes * 8)

    @classmethod
    def build(cls, digests: DataFrame, bits: int | None = None) -> DigestFilter:
        """One filter over a written table of one column, digest, by or-ing words in Spark: at most bits / 8 bytes reach the driver."""
        bits = bits or _power(digests.count(), MAX_BITS)
        h1, h2 = _hashes(F.col("digest"))
        return cls.read(_words(digests.select(h1.alias("h1"), h2.alias("h2")), bits), bits)

    @classmethod
    def read(cls, words: DataFrame, bits: int) -> DigestFilter:
        """One filter from its words (w, b)."""
        got = words.select("w", "b").toPandas()
        out = np.zeros(bits // 32, "<u4")
        out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).astype("<u4")
        return cls.joined({0: out.tobytes()}, 1)

    def might_hold(self, docs: DataFrame, digest: str = "digest") -> DataFrame:
        """The rows of docs whose digest may be in the filter."""
        return docs.where(self.test(docs.sparkSession, digest))

    def test(self, spark, digest: Column | str) -> Column:
        """Whether the digest may be in the filter of its run (see run_of)."""
        sent = spark.sparkContext.broadcast((self.words, self.starts, self.bits))
        digest = F.col(digest) if isinstance(digest, str) else digest

        @F.pandas_udf("boolean")
        def test(run, h1, h2):
            import pandas as pd

            words, starts, bits = sent.value
            run, ok = run.to_numpy(np.int64), np.ones(len(run), bool)
            for p in DigestFilter.positions(h1.to_numpy(np.int64), h2.to_numpy(np.int64), bits[run]):
                ok &= (words[starts[run] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1
            return pd.Series(ok)

        return test(run_of(digest, len(self.starts)), *_hashes(digest))


def run_of(digest: Column, runs: int) -> Column:
    """The merged run that holds a digest."""
    return F.pmod(F.xxhash64(digest, F.lit(2)), F.lit(runs)).cast("int")


def flagged(rows: DataFrame, digests: DataFrame, key: str | Column, name: str, max_bits: int = MAX_BITS) -> DataFrame:
    """rows with a column name, which is false only where key is not among digests (a written table of one column, digest, of key's type).

    While BITS_PER_DIGEST bits for each digest fit in max_bits, one filter goes to all tasks. Beyond that filters follow the rows: the digests
    that meet a row of a file are found by their hashes, so no other column moves; files are dealt into blocks whose digests fit in max_bits;
    and each block's files are read by themselves, each file once, and tested with the block's filter. So neither what a task is
    sent nor the share of rows that pass without cause grows with the table. A file that alone meets more digests has a filter that is
    fuller; rows that don't come straight from files are tested with one filter of max_bits, which lets more through but loses none.
    """
    key = F.col(key) if isinstance(key, str) else key
    n = digests.count()
    dealt = _by_file(rows, digests, key, max_bits) if BITS_PER_DIGEST * n > max_bits else []
    if not dealt:
        return rows.withColumn(name, DigestFilter.build(digests, _power(n, max_bits)).test(rows.sparkSession, key))
    parts = [rows.where(F.col(_PATH).isin(paths)).withColumn(name, may.test(rows.sparkSession, key) if may else F.lit(False)) for paths, may in dealt]
    return reduce(DataFrame.unionAll, parts)


_PATH = "_metadata.file_path"


def _by_file(rows: DataFrame, digests: DataFrame, key: Column, max_bits: int) -> list[tuple[list[str], DigestFilter | None]]:
    """Blocks of the files of rows, each with the filter of the digests that its rows meet (None: no digest meets one); none where rows have no files."""
    h1, h2 = _hashes(key)
    try:
        places = rows.select(F.xxhash64(_PATH).alias("file"), h1.alias("h1"), h2.alias("h2"))
        files = {r["file"]: r["path"] for r in rows.select(F.col(_PATH).alias("path")).distinct().select("path", F.xxhash64("path").alias("file")).collect()}
    except AnalysisException:  # rows of a join, or made by hand
        return []
    wanted = digests.select(*[h.alias(c) for h, c in zip(_hashes(F.col("digest")), ("h1", "h2"), strict=True)]).distinct()
    met = written(places.distinct().join(wanted, ["h1", "h2"], "left_semi"), "met")
    counts = {r["file"]: r["n"] for r in met.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks: list[list[int]] = []
    room = 0
    for f in sorted(counts, key=files.__getitem__):
        if not blocks or counts[f] > room:
            blocks.append([])
            room = max_bits // BITS_PER_DIGEST
        blocks[-1].append(f)
        room -= counts[f]
    out: list[tuple[list[str], DigestFilter | None]] = [([p for f, p in files.items() if f not in counts], None)]
    if blocks:
        bits = max(64, 1 << (max_bits.bit_length() - 1))
        block_of = rows.sparkSession.createDataFrame([(f, k) for k, b in enumerate(blocks) for f in b], "file long, block int")
        words = _words(met.join(F.broadcast(block_of), "file"), bits, "block")  # block_of: as many rows as files, which the driver lists anyway
        words = written(words.repartitionByRange("block").sortWithinPartitions("block"), "words")
        out += [([files[f] for f in b], DigestFilter.read(words.where(F.col("block") == k), bits)) for k, b in enumerate(blocks)]
    return [x for x in out if x[0]]


def compact(runs: DataFrame, keep: str = "largest", entries: int = MEMTABLE_ENTRIES, max_bits: int = MAX_BITS) -> tuple[DataFrame, DigestFilter]:
    """A written table of runs merged into one level: (digest, keep_id, n), and the filters of its repeated digests.

    The level is itself a list of runs, each with the digests of one value of run_of. Sorted rows of the same digest follow each other, whichever
    run they come from, and are folded as they pass; the task that ends a merged run makes its filter.
    """
    best = max if keep == "largest" else min
    count = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // entries))
    most = 1 << ((max_bits // count).bit_length() - 1)
    names = ["run", "digest", "keep_id", "n", "filter"]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    @worker("exact")
    def merge(batches):
        out: list[tuple] = []
        repeated: list[tuple[int, int]] = []
        at = None  # run, digest, smallest or largest id, count, hashes

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return made

        def close():
            out.append((at[0], at[1], at[2], at[3], None))
            if at[3] > 1:
                repeated.append((at[4], at[5]))

        def close_run():
            if repeated:
                h = np.array(repeated, np.int64)
                out.append((at[0], None, None, None, DigestFilter.made(h[:, 0], h[:, 1], _power(len(h), max(64, most)))))
                repeated.clear()

        for b in batches:
            for run, digest, i, n, h1, h2 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at and at[1] == digest and at[0] == run:
                    at[2] = i if at[2] is None else at[2] if i is None else best(at[2], i)
                    at[3] += n
                    continue
                if at:
                    close()
                    if at[0] != run:
                        close_run()
                at = [run, digest, i, n, h1, h2]
            if out:
                yield batch()
        if at:
            close()
            close_run()
            yield batch()

    h1, h2 = _hashes(F.col("digest"))
    rows = runs.select(run_of(F.col("digest"), count).alias("run"), "digest", "keep_id", "n").repartition(count, "run").sortWithinPartitions("run", "digest")
    level = written(rows.select("run", "digest", "keep_id", "n", h1.alias("h1"), h2.alias("h2")).mapInArrow(merge, "run int, digest binary, keep_id long, n long, filter binary"), "level")
    filters = {r["run"]: bytes(r["filter"]) for r in level.where("filter is not null").select("run", "filter").collect()}
    return level.where("filter is null").select("digest", "keep_id", "n"), DigestFilter.joined(filters, count)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest_of: Callable[[Column], Column] = sha256_of, entries: int = MEMTABLE_ENTRIES, max_bits: int = MAX_BITS) -> DataFrame:
    """id_col, keep_id, group_size, kept, digest for each row of docs.

    Memtables flush sorted runs, compaction merges them, and each merged run has a filter of its repeated digests. Rows that pass it have
    their bytes verified: within a digest the smallest and the largest text must be the same, a grouped minimum and maximum
    that each task folds before the shuffle, so that a hot group of copies sends one row a task. Digests that fail (texts that
    collide) are grouped by text instead.

    Texts are equal when their bytes are; null counts as empty. keep: 'largest' or 'smallest' id of equal texts. Rows that repeat an id
    each count and share its fate; a null id never wins over another. An empty table gives an empty result; other columns
    are left out, so their names can't clash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("digest", digest_of(F.col("text")))
    level, filters = compact(written(flush(rows, keep, entries), "runs"), keep, entries, max_bits)
    repeated = level.where("n > 1").select("digest")
    many = BITS_PER_DIGEST * repeated.count() > max_bits  # then the runs' filters are too full
    hits = flagged(rows, repeated, "digest", "may", max_bits).where("may") if many else filters.might_hold(rows)
    verified = hits.groupBy("digest").agg((F.min("text") == F.max("text")).alias("same"))
    collided = written(verified.where("not same").select("digest"), "collided")
    out = rows.select("id", "digest").join(level, "digest").select("id", "keep_id", F.col("n").alias("group_size"), "digest")
    if collided.limit(1).count():
        apart = rows.join(collided, "digest", "left_semi")
        best = F.max if keep == "largest" else F.min
        whole = apart.groupBy("digest", "text").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        mixed = apart.join(whole, ["digest", "text"]).select("id", "keep_id", "group_size", "digest")
        out = out.join(collided, "digest", "left_anti").select("id", "keep_id", "group_size", "digest").unionByName(mixed)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id, count(*) over (partition by coalesce(text, '')) as group_size,
  doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept, sha256(coalesce(text, '')) as text_sha256
from documents"""
