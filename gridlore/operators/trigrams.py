"""Substring search through stored trigram postings, verified on the texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.shared import bounded_batches, freeing

GRAM = 3
#: Of a text that is looked for, so many of its rarest trigrams choose the rows.
RAREST = 3
#: Rows that share a list of postings, as bits of their number; a gap between two of them takes two bytes at most.
SEGMENT_BITS = 14
#: Folders that grams are dealt into.
PARTS = 64
#: So many rows found at most go to all tasks; more are met by a shuffle.
SENT_ROWS = 1_000_000


def grams_of(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def part_of(gram: str) -> int:
    """The folder of a gram's postings; Spark's crc32 gives the same."""
    return zlib.crc32(gram.encode()) % PARTS


def packed_gaps(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gaps below 2 ** 14 as bytes of seven bits, the upper ones first and marked, and how many bytes each takes."""
    sizes = 1 + (gaps > 127)
    last = np.cumsum(sizes) - 1
    out = np.zeros(int(last[-1]) + 1, np.uint8)
    out[last] = gaps & 127
    two = sizes == 2
    out[last[two] - 1] = gaps[two] >> 7 | 128
    return out, sizes


def places_of(packed: bytes) -> np.ndarray:
    """The places in a segment that a list of packed gaps names."""
    b = np.frombuffer(packed, np.uint8).astype(np.int64)
    marked = b > 127
    first = ~np.concatenate([[False], marked[:-1]])
    return np.cumsum(np.where(marked, (b & 127) << 7 | np.append(b[1:], 0), b)[first])


def postings_of(rows: np.ndarray, texts: Sequence[pa.Array]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For rows (their numbers, ascending, of one segment) and their texts: base, grams (code points, a gram a row), how many rows hold each, and the gaps between those rows (the first row's place, then the steps to the next).

    A gram and its row are one number, so that one sort finds all lists; where alphabet and rows are too many for that, halves are taken by themselves.
    """
    points, owners = [], []
    for t in texts:
        t = t.fill_null("")
        points.append(np.frombuffer("".join(t.to_pylist()).encode("utf-32-le"), np.uint32))
        owners.append(np.repeat(np.arange(len(rows)), pc.utf8_length(t).to_numpy()))
        points.append(np.zeros(GRAM, np.uint32))  # texts of two columns make no gram together
        owners.append(np.full(GRAM, -1))
    point, owner = np.concatenate(points), np.concatenate(owners)
    seen = np.unique(point)
    if len(rows) > 1 and len(seen) ** GRAM * len(rows) >= 2**63:
        half = len(rows) // 2
        for part in (slice(0, half), slice(half, None)):
            yield from postings_of(rows[part], [t[part] for t in texts])
        return
    letter = np.zeros(int(seen[-1]) + 1, np.int64)
    letter[seen] = np.arange(len(seen))
    letters, n = letter[point], len(seen)
    whole = (owner[:-2] == owner[2:]) & (owner[:-2] >= 0)
    held = (((letters[:-2] * n + letters[1:-1]) * n + letters[2:]) * len(rows) + owner[:-2])[whole]
    if not len(held):
        return
    held.sort()
    held = held[np.concatenate([[True], held[1:] != held[:-1]])]
    gram, row = np.divmod(held, len(rows))
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    place = rows[row] - rows[0]
    gaps = np.diff(place, prepend=0)
    gaps[first] = place[first]
    gram = gram[first]
    yield int(rows[0]), seen[np.stack([gram // (n * n), gram // n % n, gram % n], axis=1)], np.diff(first, append=len(held)), gaps


@dataclass(frozen=True)
class TextIndex:
    """Under path: the rows, numbered (one folder a bucket of the tasks that wrote them), and postings (gram, bucket, base, n, gaps) dealt into folders by gram.

    A list of postings names the rows of one segment that hold a gram: base is the number of the segment's first row, gaps tell the others (see packed_gaps). So a row costs a byte or two
    for each of its grams, whatever its key, and texts are written where they are read. A search reads the folders of its grams alone; files are sorted by gram, so Parquet's statistics
    leave out the row groups of others. A gram of a third of all rows has as many postings, but rare ones are looked up first, and a text of
    common grams alone reads what it must.
    """

    path: str
    key: str
    texts: tuple[str, ...]
    buckets: int = 64

    def build(self, rows: DataFrame) -> TextIndex:
        """The index of rows, whatever was there before. Keys must not be null and name a row each; null texts hold nothing."""
        spark = bounded_batches(rows.sparkSession)
        numbered = rows.withColumns({"__bucket": F.pmod(F.spark_partition_id(), F.lit(self.buckets)), "__row": F.monotonically_increasing_id()}).sortWithinPartitions("__bucket", "__row")
        numbered.write.mode("overwrite").option("compression", "zstd").partitionBy("__bucket").parquet(f"{self.path}/rows")
        stored = spark.read.parquet(f"{self.path}/rows")

        @freeing
        def post(batches):
            for b in batches:
                bucket, row = b.column(0).to_numpy(), b.column(1).to_numpy()
                # a batch can go on from one file to the next, where numbers start anew
                ends = np.flatnonzero((np.diff(row >> SEGMENT_BITS) != 0) | (np.diff(row) <= 0) | (np.diff(bucket) != 0)) + 1
                for start, stop in zip([0, *ends], [*ends, len(row)], strict=True):
                    if start == stop:
                        continue
                    for base, grams, counts, gaps in postings_of(row[start:stop], [b.column(c)[start:stop] for c in range(2, b.num_columns)]):
                        made = grams.astype("<u4").tobytes().decode("utf-32-le")
                        packed, sizes = packed_gaps(gaps)
                        offsets = np.concatenate([[0], np.cumsum(sizes)[np.cumsum(counts) - 1]]).astype(np.int32)
                        lists = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])
                        k = len(counts)
                        names = pa.array([made[i : i + GRAM] for i in range(0, len(made), GRAM)], pa.string())
                        yield pa.RecordBatch.from_arrays([names, pa.array(np.full(k, bucket[start], np.int32)), pa.array(np.full(k, base, np.int64)), pa.array(counts.astype(np.int32)), lists], ["gram", "bucket", "base", "n", "gaps"])

        lists = stored.select("__bucket", "__row", *[F.lower(c).alias(f"t{i}") for i, c in enumerate(self.texts)]).mapInArrow(post, "gram string, bucket int, base bigint, n int, gaps binary")
        dealt = lists.withColumn("__part", (F.crc32("gram") % PARTS).cast("int")).repartition("__part")
        dealt.sortWithinPartitions("__part", "gram").write.mode("overwrite").option("compression", "zstd").partitionBy("__part").parquet(f"{self.path}/postings")
        return self

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._shown(spark.read.parquet(f"{self.path}/rows"))

    def _shown(self, stored: DataFrame) -> DataFrame:
        return stored.drop("__bucket", "__row")

    def _postings(self, spark: SparkSession, grams: Sequence[str]) -> DataFrame:
        read = spark.read.schema("gram string, bucket int, base bigint, n int, gaps binary, __part int").parquet(f"{self.path}/postings")
        return read.where(F.col("__part").isin(sorted({part_of(g) for g in grams})) & F.col("gram").isin(list(grams)))

    def _rarest(self, spark: SparkSession, text: str) -> dict[str, int] | None:
        """The rarest grams of text and how many rows hold each. None if it has no gram.

        % and _ in text stand for anything, as in LIKE, so grams come from between them.
        """
        asked = sorted(set().union(*(grams_of(part) for part in re.split("[%_]", text.lower()))))
        if not asked:
            return None
        seen = {r["gram"]: r["n"] for r in self._postings(spark, asked).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        return {g: seen.get(g, 0) for g in sorted(asked, key=lambda g: (seen.get(g, 0), g))[:RAREST]}

    def _holding(self, spark: SparkSession, grams: Sequence[str]) -> DataFrame:
        lists = self._postings(spark, grams).groupBy("bucket", "base").agg(F.collect_list("gaps").alias("lists")).where(F.size("lists") == len(grams))

        def meet(batches):
            for b in batches:
                for bucket, base, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    rows = reduce(np.intersect1d, [places_of(x) for x in found]) + base
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), bucket, np.int32)), pa.array(rows)], ["bucket", "row"])

        return lists.mapInArrow(meet, "bucket int, row bigint")

    def holding(self, spark: SparkSession, text: str) -> DataFrame | None:
        """bucket, row of the rows that may hold text, whatever its case: those with its rarest grams. None if no gram can choose: every row may."""
        rarest = self._rarest(spark, text)
        return None if rarest is None else self._holding(spark, list(rarest))

    def candidates(self, spark: SparkSession, texts: Sequence[str]) -> DataFrame:
        """The rows that may hold one of texts. Only buckets with such a row are read; all are, if one of texts is too short to choose."""
        stored = spark.read.parquet(f"{self.path}/rows")
        found, most = None, 0
        for text in texts:
            rarest = self._rarest(spark, text)
            if rarest is None:
                return self._shown(stored)
            one, most = self._holding(spark, list(rarest)), most + min(rarest.values())
            found = one if found is None else found.unionByName(one)
        if found is None:
            return self._shown(stored.where(F.lit(False)))
        buckets = [r["bucket"] for r in found.select("bucket").distinct().collect()]  # no more than there are buckets
        chosen = stored.where(F.col("__bucket").isin(buckets)) if len(buckets) < self.buckets else stored
        keys = found.select(F.col("row").alias("__row"))
        return self._shown(chosen.join(F.broadcast(keys) if most <= SENT_ROWS else keys, "__row", "left_semi"))
