"""Best-fit-decreasing packing of token sequences, certified by lower bounds from dual feasible functions."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table, text_of, worker, written
from .pretokens import Spec, encoder


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing of lengths takes fewer bins (see bound_of)."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity) if len(lengths) else 0


def bound_of(hist: np.ndarray, capacity: int) -> int:
    """The fewest bins for hist[n] items of length n: the best of the total, a threshold family and a rounding family of dual feasible functions."""
    size = np.arange(capacity + 1)
    best = -(-int(hist @ size) // capacity)
    # items above capacity - t count whole, items below t count nothing
    below = np.concatenate(([0], np.cumsum(hist * size)))
    above = np.concatenate(([0], np.cumsum(hist)))
    t = np.arange(1, capacity // 2 + 1)
    whole = above[-1] - above[capacity - t + 1]
    best = max(best, int((whole + -(-(below[capacity - t + 1] - below[t]) // capacity)).max()))
    for k in range(1, 12):
        # x counts floor((k + 1) x) / k, or itself where (k + 1) x is whole
        exact = (k + 1) * size % capacity == 0
        worth = np.where(exact, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int(hist @ worth) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; open bins are kept by free space, and a bit set finds the tightest that fits."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = spaces >> need
        if fits:
            space = need + ((fits & -fits).bit_length() - 1)
            b = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
        else:
            b, n, space = n, n + 1, capacity
        bins[i], offsets[i] = b, capacity - space
        left = space - need
        if left:
            by_space[left].append(b)
            spaces |= 1 << left
    return bins, offsets


def _placer(capacity: int, turn: int, last: bool, length: str):
    """Packs one group, with its number of bins and lower bound; marks as open the bins that go into the next exchange."""

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf[length].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        group = int(pdf["pack_group"].iloc[0])
        used = np.bincount(bins, weights=lengths).astype(np.int64)
        gap = len(used) - lower_bound(lengths, capacity)
        loose = np.argsort(used, kind="stable")[: 0 if last else 1 + 3 * gap]
        open_ = np.isin(bins, loose[used[loose] < capacity])
        pdf["sequence_id"] = (turn << 54) + (group << 24) + bins
        pdf["offset"] = offsets
        pdf["open"] = open_
        pdf["pack_group"] = (turn << 30) + group
        pdf["group_bins"] = len(np.unique(bins[~open_]))
        pdf["group_bound"] = lower_bound(lengths[~open_], capacity)
        return pdf

    return place


_PLACE = ["sequence_id", "offset", "pack_group", "group_bins", "group_bound"]


def pack(pieces: DataFrame, capacity: int = 1024, items_per_group: int = 40_000, rounds: int = 6) -> DataFrame:
    """pieces (with a column length from 1 to capacity, and any others) plus sequence_id, offset, pack_group, group_bins and group_bound.

    Pieces as long as a sequence make one each. The rest is dealt at random into groups of about items_per_group, each packed
    best-fit-decreasing in one task and compared with its lower bound. Every group gives up its emptiest bin, and a group above its
    bound also as many bins again as the gap, twice over; what these held is exchanged: dealt anew into fewer groups and packed
    again, until one group holds it all, which has none to exchange with, or a round leaves nothing open. After rounds exchanges groups keep the gap
    they have. Every piece is placed exactly once.

    group_bins and group_bound certify what a group keeps: its pieces take group_bins sequences, and no packing of them takes fewer than group_bound
    (pieces that fill a sequence: group -1, each with 1 and 1). certificate() compares the whole.

    Ties: equal lengths are interchangeable. Repeated rows are placed one by one. Columns of pieces that have a name of these five are replaced;
    other names can't clash. An empty table gives an empty result.
    """
    given = [c for c in pieces.columns if c not in _PLACE]
    inner = [f"c{k}" for k in range(len(given))]
    length = inner[given.index("length")]
    pieces = pieces.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(given, inner, strict=True)])
    one = F.lit(1).cast("long")
    done = [pieces.where(F.col(length) >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(-1).cast("long").alias("pack_group"), one.alias("group_bins"), one.alias("group_bound"))]
    pool = pieces.where(F.col(length) < capacity)
    n = pool.count()
    turn = 0
    while n:
        groups = max(1, math.ceil(n / items_per_group))
        last = groups == 1 or turn == rounds

        dealt = pool.withColumn("pack_group", F.lit(0).cast("long") if groups == 1 else F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups)))
        long = [T.StructField(c, T.LongType()) for c in _PLACE if c != "pack_group"]
        schema = T.StructType([*pieces.schema.fields, T.StructField("pack_group", T.LongType()), *long, T.StructField("open", T.BooleanType())])
        placed = written(dealt.groupBy("pack_group").applyInPandas(_placer(capacity, turn, last, length), schema), "packed")
        done.append(placed.where("not open").select(*inner, *_PLACE))
        pool = placed.where("open").select(*inner)
        n = 0 if last else pool.count()
        turn += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*[F.col(i).alias(c) for c, i in zip(given, inner, strict=True)], *_PLACE)


def certificate(packed: DataFrame, capacity: int = 1024) -> tuple[int, int]:
    """How many sequences a packing takes, and a lower bound for any packing of the same pieces; at most capacity rows reach the driver."""
    counts = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("offset") == 0).alias("bins")).collect()
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts:
        hist[r["length"]] = r["n"]
    return sum(r["bins"] for r in counts), bound_of(hist, capacity) if counts else 0


def _packed_ids(ids) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return struct.pack(f"<{len(ids)}I", *ids)


def token_pieces(docs: DataFrame, tokenizer_path: str, eos: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """id_col, piece, start, length, ids (binary: little-endian unsigned 32-bit; with digest their CRC-32 as ids_crc32 instead) of each document's ids and eos.

    Documents of more than capacity ids are cut into pieces of capacity; what is over goes in the first, so only that may be
    shorter. Null text counts as empty: one piece that is eos alone. Rows that repeat an id give their pieces again.
    """
    spec = bounded_batches(docs.sparkSession).sparkContext.broadcast(Spec.of(tokenizer_path))
    end = np.array([eos], "<u4").tobytes()
    names = ["id", "piece", "start", "length", "ids_crc32" if digest else "ids"]
    last = zlib.crc32 if digest else bytes

    @worker("pretokens")
    def cut(batches):
        enc = encoder(spec.value, "bytes", _packed_ids)
        kinds = None
        for b in batches:
            kinds = kinds or [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()]
            out: list[tuple] = []
            size = 0
            for i, ids in zip(b.column(0).to_pylist(), enc.each((t.as_py() for t in b.column(1)), b"".join), strict=True):
                ids += end
                n = len(ids) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n, capacity), n] if n > capacity else [0, n]
                for k in range(len(cuts) - 1):
                    out.append((i, k, cuts[k], cuts[k + 1] - cuts[k], last(ids[4 * cuts[k] : 4 * cuts[k + 1]])))
                size += 100 if digest else len(ids)
                if size > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    made = rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, {names[-1]} {'long' if digest else 'binary'}")
    return made.withColumnRenamed("id", id_col) if id_col != "id" else made


def packed_documents(docs: DataFrame, tokenizer_path: str, eos: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the columns that pack adds: the ids themselves stay in the map pass that makes them.

    Null ids and texts, repeated rows, long texts and empty tables: as in token_pieces and pack. Other columns of docs are left out.
    """
    return pack(written(token_pieces(docs, tokenizer_path, eos, capacity, digest=True), "pieces"), capacity)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
