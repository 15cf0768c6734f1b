"""N-gram Jaccard self-join on count vectors: exact links, classes of equal sets, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, table, text_of, worker, worker_cache, written
from .exact_dedup import flagged

#: Shingles for each coordinate of a count vector, and its fewest and most coordinates; fan-out of the R-tree.
PER_COORDINATE, COORDINATES = 8, (64, 1 << 16)
FAN_OUT = 16
#: A group of candidates with more shingles than this is dealt into chunks of about so many, and what is compared with all chunks into blocks of so many.
CHUNK_SHINGLES = 1_500_000
#: A key with more classes than this is dealt into blocks of about so many; no more than the second number are compared at once, as one box without a tree.
BUCKET, LOCAL_BUCKET = 512, 32
#: Counters of shingles; how many of the largest a task reports, and how many of all are told to the tasks.
COUNTERS, TASK_HOT, HOT = 1 << 20, 4_096, 16_384
#: Rows of a batch whose sets are held at once; keys held before they are folded.
ROWS_HELD, KEYS_HELD = 128, 300_000
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64 and len(self) < 150_000:
            self[word] = h
        return h


def _hash_of():
    """The worker's hash of a word."""
    return worker_cache("jaccard", "words", _Hashes).__getitem__


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct shingles: A-Z lower-cased, words between U+0020 and U+0009 to U+000D."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hash_of(), words), np.uint64, len(words))
    if len(w) < width:
        seed = np.uint64(len(w))
        return _mixed(np.array([xxhash.xxh3_64_intdigest(w.tobytes())], np.uint64) + seed)
    n = len(w) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h += w[k : k + n] * _PRIMES[k % len(_PRIMES)] ^ np.uint64(k // len(_PRIMES))
        h = (h << np.uint64(7)) | (h >> np.uint64(57))
    return np.unique(_mixed(h))


def set_name(h: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of the set as two longs; equal sets have equal names."""
    d = xxhash.xxh3_128_intdigest(h.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def counter_of(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(24)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def prefix(h: np.ndarray, num: int, den: int, often: np.ndarray | None = None) -> np.ndarray:
    """The shingles of a set under which it meets all that it may link with.

    Sets that link share at least ceil(num n / den) shingles of each one's n. So, in any order of all shingles, their first
    n - ceil(num n / den) + 1 have one in common. The order is by how often the shingle's counter was hit (often; counters
    outside the most frequent ones count 0), then by hash: what many documents share comes last and is seldom a key.
    """
    keep = len(h) - -(-num * len(h) // den) + 1
    if often is not None:
        rank = often[counter_of(h)]
        if rank.any():
            h = h[np.argsort(rank, kind="stable")]
    return h[:keep]


def coordinates_of(n: int) -> int:
    """How many coordinates the count vector of n shingles has: a power of two, so that about PER_COORDINATE shingles share one."""
    low, high = COORDINATES
    return min(high, max(low, 1 << (max(n - 1, 0) // PER_COORDINATE).bit_length()))


def count_vector(h: np.ndarray) -> np.ndarray:
    c = coordinates_of(len(h))
    return np.bincount((h >> np.uint64(8)).astype(np.int64) & (c - 1), minlength=c).astype(np.int32)


def packed_counts(v: np.ndarray) -> bytes:
    """One byte a count while they fit, else two or four."""
    most = int(v.max(initial=0))
    return v.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def unpacked_counts(v: bytes, n: int) -> np.ndarray:
    return np.frombuffer(v, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(v) // coordinates_of(n)]).astype(np.int32)


def folded(v: np.ndarray, coordinates: int) -> np.ndarray:
    """The count vector with fewer coordinates: those that agree in the low bits are summed."""
    return v.reshape(-1, coordinates).sum(0)


class CountVectorTree:
    """An R-tree over count vectors: boxes of FAN_OUT neighbours, each with its largest counts and its range of sizes, level on level.

    Two sets share at most the sum over coordinates of the smaller count; a set and a box, at most the sum with the box's largest.
    Boxes are packed by size, then by distance from the vector that lies farthest from the middle.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        band = (np.log(sizes) / np.log(max(den / num, 1.01))).astype(np.int64)
        far = vectors[np.abs(vectors - vectors.mean(0)).sum(1).argmax()]
        self.order = np.lexsort((np.abs(vectors - far).sum(1), band))
        self.levels = [(vectors[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels) < 2 or len(self.levels[-1][0]) > FAN_OUT:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(top), FAN_OUT)
            self.levels.append((np.maximum.reduceat(top, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def query(self, v: np.ndarray, n: int, wanted: np.ndarray) -> np.ndarray:
        """Positions among wanted (a mask) that may link with a set of n shingles and the counts v."""
        least = -(-n * self.num // self.den)
        at = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[level]
            if level < len(self.levels) - 1:
                at = (at[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                at = at[at < len(top)]
            if level == 0:
                at = at[wanted[self.order[at]]]
            at = at[(high[at] >= least) & (low[at] * self.num <= n * self.den)]
            need = -(-self.num * (n + np.maximum(low[at], least)) // (self.num + self.den))
            at = at[np.minimum(top[at], v).sum(1) >= need]
        return self.order[at]


def one_box(vectors: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of a few sets may link with which, by the bound of the tree: a mask of pairs, without those of a set with itself."""
    need = -(-num * (sizes[:, None] + sizes) // (num + den))
    near = (sizes * den >= sizes[:, None] * num) & (sizes[:, None] * den >= sizes * num)
    near &= np.stack([np.minimum(vectors, v).sum(1) for v in vectors]) >= need
    np.fill_diagonal(near, False)
    return near


def spanning(ids: np.ndarray, sizes: np.ndarray, vectors: list[np.ndarray], num: int, den: int, verify=None, label: np.ndarray | None = None, may=None) -> list[tuple[int, int]]:
    """Pairs that span the components of those which the bound leaves and verify (positions x, y) accepts.

    Vectors of several sizes are compared with the coordinates of the shorter one. label: components known already; may(x, positions):
    a mask of the partners that matter. Of two components that meet the smaller one is relabelled, so all relabelling takes n log n steps; a set
    whose component holds all is asked nothing more.
    """
    label = np.arange(len(ids)) if label is None else np.unique(label, return_inverse=True)[1]
    members: list[list[int]] = [[] for _ in range(int(label.max(initial=-1)) + 1)]
    for k, of in enumerate(label.tolist()):
        members[of].append(k)
    width = np.array([len(v) for v in vectors])
    reach = 1 << (-(-den // num) - 1).bit_length()
    out = []
    for c in np.unique(width):
        at = np.nonzero((width >= c) & (width <= c * reach))[0]
        own = width[at] == c
        if len(at) < 2:
            continue
        flat = np.stack([folded(vectors[k], c) for k in at])
        near = one_box(flat, sizes[at], num, den) if len(at) <= LOCAL_BUCKET else None
        if near is not None and not near[own].any():
            continue
        tree = CountVectorTree(flat, sizes[at], num, den) if near is None else None
        later = np.arange(len(at))
        for i in np.nonzero(own)[0]:
            x = at[i]
            if len(members[label[x]]) == len(ids):
                return out
            wanted = (label[at] != label[x]) & (~own | (later > i))
            if near is not None:
                wanted &= near[i]
            if may is not None:
                wanted &= may(x, at)
            if not wanted.any():
                continue
            for j in np.nonzero(wanted)[0] if tree is None else tree.query(flat[i], int(sizes[x]), wanted):
                y = at[j]
                if label[x] != label[y] and (verify is None or verify(x, y)):
                    out.append((int(ids[x]), int(ids[y])))
                    large, small = sorted((label[x], label[y]), key=lambda k: -len(members[k]))
                    label[members[small]] = large
                    members[large] += members[small]
                    members[small] = []
    return out


def linked(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int, label: np.ndarray | None = None, may=None) -> list[tuple[int, int]]:
    """Links that span the components among sets: every pair is ruled out by the tree's bound, verified on its shingles, or joined already."""
    sizes = np.array([len(s) for s in sets])

    def verify(x: int, y: int) -> bool:
        shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return shared * den >= num * (sizes[x] + sizes[y] - shared)

    return spanning(ids, sizes, [count_vector(s) for s in sets], num, den, verify, label, may)


def _sets(rows: DataFrame, width: int, make, schema: str) -> DataFrame:
    """rows (id, text, more columns) through make(batch's other columns, iterator of sets)."""

    @worker("jaccard")
    def run(batches):
        for b in batches:
            for at in range(0, len(b), ROWS_HELD):
                part = b.slice(at, ROWS_HELD)
                yield from make(part, [shingle_set(t.as_py(), width) for t in part.column("text")])

    return rows.mapInArrow(run, schema)


def _longs(columns: list, names: list[str]) -> pa.RecordBatch:
    n = next(len(c) for c in columns if c is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], names)


_KEYS = ["a", "c1", "c2"]
_KEYS_SQL = "a long, c1 long, c2 long"


def _named(rows: DataFrame, width: int) -> DataFrame:
    """id, n, c1, c2, vec of each row; rows of counter, hits (the others null) with the largest counters of each task."""
    names, kinds = ["id", "n", "c1", "c2", "vec", "counter", "hits"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    @worker("jaccard")
    def run(batches):
        hits, held, size = np.zeros(COUNTERS, np.int64), [], 0
        for b in batches:
            for at in range(0, len(b), ROWS_HELD):
                part = b.slice(at, ROWS_HELD)
                sets = [shingle_set(t.as_py(), width) for t in part.column("text")]
                called = [set_name(s) if len(s) else (None, None) for s in sets]
                vec = [packed_counts(count_vector(s)) if len(s) else None for s in sets]
                held += map(counter_of, sets)
                size += sum(map(len, sets))
                if size > 1_000_000:
                    hits += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size = [], 0
                cols = [part.column("id"), [len(s) for s in sets], [x for x, _ in called], [y for _, y in called], vec, [None] * len(sets), [None] * len(sets)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        if held:
            hits += np.bincount(np.concatenate(held), minlength=COUNTERS)
        most = np.argpartition(hits, -TASK_HOT)[-TASK_HOT:]
        most = most[hits[most] > 1]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(most), k) for k in kinds[:5]), pa.array(most, pa.int64()), pa.array(hits[most], pa.int64())], names)

    return rows.mapInArrow(run, "id long, n long, c1 long, c2 long, vec binary, counter long, hits long")


def _fold(keys: list[np.ndarray], owner: list[np.ndarray], called: list[tuple[int, int]]):
    """Keys and the classes that have them, in order of keys."""
    k, o = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(k, kind="stable")
    k, o = k[order], o[order]
    c = np.array(called, np.int64).reshape(-1, 2)
    return _longs([k.view(np.int64), c[o, 0], c[o, 1]], _KEYS)


def _buckets(batches, bucket: int):
    """Rows sorted by key and class: buckets of two classes or more, named by their members, so that keys with the same members are one.
    Rows of a key with more than bucket classes are wide and keep the key."""
    carry, hot = None, None

    def apart(a, c, d):
        one = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])))
        return a[one], c[one], d[one]

    def rows(a, c, d, wide):
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (a, c, d)), pa.array(np.full(len(a), wide))], [*_KEYS, "wide"])

    def settle(a, c, d):
        a, c, d = apart(a, c, d)
        start = np.nonzero(np.concatenate(([True], a[1:] != a[:-1])))[0]
        size = np.diff(np.concatenate((start, [len(a)])))
        wide = np.repeat((size > bucket) | (a[start] == hot if hot is not None else False), size)
        name = np.repeat(np.add.reduceat(_mixed(c.view(np.uint64) ^ _mixed(d.view(np.uint64))), start).view(np.int64), size)
        keep = (np.repeat(size, size) > 1) & ~wide
        yield rows(name[keep], c[keep], d[keep], False)
        yield rows(a[wide], c[wide], d[wide], True)

    for b in batches:
        a, c, d = (np.asarray(b.column(x)).astype(np.int64) for x in _KEYS)
        if not len(a):
            continue
        if carry is not None:
            a, c, d = (np.concatenate(x) for x in zip(carry, (a, c, d), strict=True))
        at = int(np.searchsorted(a, a[-1], "left"))
        if at:
            yield from settle(a[:at], c[:at], d[:at])
        a, c, d = a[at:], c[at:], d[at:]
        if len(a) > 16 * bucket:
            a, c, d = apart(a, c, d)
        if len(a) > 16 * bucket:  # more classes of one key than are held: they go as they come
            hot = a[0]
            yield rows(a, c, d, True)
            a, c, d = a[-1:], c[-1:], d[-1:]
        carry = (a, c, d)
    if carry is not None:
        yield from settle(*carry)


def _blocks(wide: DataFrame, num: int, den: int, bucket: int, chunk_shingles: int) -> DataFrame:
    """a, cls: buckets of bounded size in which all classes of a key that may link by size meet; wide: a (the key), cls, n.

    Sizes fall into bands so wide that sets which link are of one band or of two neighbours: a window is a band and the next. The classes of a window are dealt
    into blocks, and each two blocks are a bucket (one block: that block). So a bucket holds no more than two blocks, however many classes have the key.
    """
    width = math.log(max(den / num, 1.01)) * (1 + 1e-9)
    wide = wide.select("a", "cls", "n", F.floor(F.log("n") / width).alias("band"))
    bands = written(wide.groupBy("a", "band").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s")), "bands")
    after = bands.select("a", (F.col("band") - 1).alias("band"), F.col("k").alias("k2"), F.col("s").alias("s2"))
    windows = bands.join(after, ["a", "band"], "left").select("a", "band", (F.col("k") + F.coalesce("k2", F.lit(0))).alias("k"), (F.col("s") + F.coalesce("s2", F.lit(0))).alias("s"))
    windows = written(windows.where("k > 1").select("a", "band", F.greatest(F.ceil(F.col("k") / bucket), F.ceil(F.col("s") / chunk_shingles)).cast("int").alias("blocks")), "windows")
    rows = wide.select("a", "cls", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band")).join(windows, ["a", "band"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: (F.col("blocks") == 1) | (k != F.col("own")))
    rows = rows.select("a", "cls", "band", "own", F.explode(others).alias("other"))
    return rows.select(F.xxhash64("a", "band", F.least("own", "other"), F.greatest("own", "other")).alias("a"), "cls")


def _grouped(batches, key: list[str], finish):
    """Batches sorted by key: finish(key, rows as tuples) for one group at a time, which gives batches."""
    at, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[: len(key)] != at:
                if held:
                    yield from finish(at, held)
                at, held = row[: len(key)], []
            held.append(row[len(key) :])
    if held:
        yield from finish(at, held)


def _pairs(pairs: list[tuple[int, int]]):
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """id_col, n_shingles, component_id for each row of docs; component_id is the smallest id reachable over links.

    Two documents link when den * |intersection| >= num * |union| of their sets of shingles of width words; no link between
    different sets is lost. The steps:

    1. Equal sets make one class, so copies are not paired. The pass that names them also counts shingles, and the largest counters are
       told to all tasks (at most HOT of them).
    2. Classes meet under the shingles of their prefix, rare ones first (see prefix). The classes of a key are a bucket; in it an R-tree
       over count vectors rules out pairs by the summed smaller counts, and what is left is tied. A key with more than BUCKET classes is dealt
       into buckets of bounded size by size and block (see _blocks), so no pair is tied without the bound and no task holds a hot key.
    3. Components of these ties are groups of candidates. In each, an R-tree over count vectors bounds the overlap by the summed smaller
       counts, and what survives is verified on whole sets until every pair is joined or ruled out. A group of more than
       chunk_shingles shingles is dealt into chunks, each with the group's first set, and solved chunk by chunk; then only the sets that
       were not joined to the group's largest component are compared with the other chunks, in blocks of chunk_shingles shingles too: a task
       holds one chunk and one block.
    4. Links that span are turned into components, and components carried back to the rows.

    Sets are of 64-bit shingle hashes, classes named by 128 bits. Null text, or text without words: an empty set, its own component. Fewer words
    than width: the whole sequence is the one shingle. Rows that repeat an id share its component; a row with a null id keeps component
    null unless its class has an id, and joins no others. Empty tables give an empty result; other columns are left out.
    """
    spark, bucket = bounded_batches(docs.sparkSession), BUCKET
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    sets = written(_named(rows, width), "sets")
    named = sets.where("counter is null").select("id", "n", "c1", "c2", "vec")
    hot = sets.where("counter is not null").groupBy("counter").agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "counter").limit(HOT).toPandas()
    told = spark.sparkContext.broadcast((hot["counter"].to_numpy(np.int64), hot["hits"].to_numpy(np.int64)))
    classes = named.where("c1 is not null").groupBy("c1", "c2").agg(F.min("id").alias("first_id"), F.max("n").alias("n"), F.first("vec").alias("vec"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    @worker("jaccard")
    def meet(batches):
        often = np.zeros(COUNTERS, np.int64)
        often[told.value[0]] = told.value[1]
        keys, owner, called, size = [], [], {}, 0
        for b in batches:
            for t in b.column("text"):
                s = shingle_set(t.as_py(), width)
                c = set_name(s)
                if not len(s) or c in called:
                    continue
                k = prefix(s, num, den, often)
                keys.append(k)
                owner.append(np.full(len(k), len(called)))
                called[c] = None
                size += len(k)
                if size > KEYS_HELD:
                    yield _fold(keys, owner, list(called))
                    keys, owner, called, size = [], [], {}, 0
        if keys:
            yield _fold(keys, owner, list(called))

    met = rows.select("text").mapInArrow(meet, _KEYS_SQL)
    met = met.repartition("a").sortWithinPartitions("a", "c1", "c2")
    met = written(met.mapInArrow(worker("jaccard")(lambda batches: _buckets(batches, bucket)), f"{_KEYS_SQL}, wide boolean").distinct(), "buckets")
    members = met.where("not wide").join(classes, ["c1", "c2"]).select("a", "cls", "n", "vec")
    wide = met.where("wide")
    if wide.limit(1).count():
        wide = written(wide.join(classes.select("c1", "c2", "cls", "n"), ["c1", "c2"]).select("a", "cls", "n"), "wide")
        members = members.unionByName(_blocks(wide, num, den, bucket, chunk_shingles).join(classes, "cls").select("a", "cls", "n", "vec"))

    @worker("jaccard")
    def bound(batches):

        def finish(_, held):
            sizes = np.array([n for _, n, _ in held])
            yield from _pairs(spanning(np.array([c for c, _, _ in held]), sizes, [unpacked_counts(v, n) for _, n, v in held], num, den))

        return _grouped(batches, ["a"], finish)

    ties = members.repartition("a").sortWithinPartitions("a", "cls").mapInArrow(bound, "a long, b long")
    groups = written(components(written(ties.distinct(), "ties")).withColumnsRenamed({"node": "cls", "component": "grp"}), "groups")
    sized = groups.join(classes.select("cls", "c1", "c2", "n", "first_id"), "cls")
    whole = sized.groupBy("grp").agg(F.ceil(F.sum("n") / chunk_shingles).cast("int").alias("chunks")).withColumns({"blocks": F.lit(1), "block": F.lit(0)})
    sized = sized.join(whole, "grp").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    sized = written(sized.withColumns({"everywhere": F.col("cls") == F.col("grp"), "label": F.col("cls")}), "members")

    def links(some: DataFrame, strays: bool) -> DataFrame:
        """Links within the chunks of the members some. What is everywhere comes to all chunks, block by block: each chunk meets one block at a time.
        strays: only those between a set that is everywhere and one of another label."""
        may = flagged(rows, some.select(F.col("first_id").alias("digest")), "id", "may").where("may").drop("may")
        chosen = may.join(some, F.col("id") == F.col("first_id")).select("c1", "c2", "grp", "cls", "everywhere", "label", "own", "block", "chunks", "blocks", "text")

        def named(b, sets):
            called = zip(b.column("c1").to_pylist(), b.column("c2").to_pylist(), strict=True)
            same = pa.array([len(s) > 0 and set_name(s) == c for s, c in zip(sets, called, strict=True)], pa.bool_())  # else another row of the same id
            whole = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(2, 10)), whole], [*b.schema.names[2:10], "s"]).filter(same)

        @worker("jaccard")
        def solve(batches):

            def finish(at, held):
                held = list({h[0]: h for h in held}.values())
                ids, everywhere, label, own, block = (np.array([h[k] for h in held]) for k in range(5))
                sets = [np.frombuffer(h[5], np.uint64) for h in held]
                stray, here = everywhere & (block == at[2]), own == at[1]
                may = (lambda x, y: (stray[x] & here[y]) | (stray[y] & here[x])) if strays else None
                yield from _pairs(linked(ids, sets, num, den, label, may))

            return _grouped(batches, ["grp", "chunk", "block"], finish)

        place = "struct({} as chunk, {} as block)"
        all_ = F.expr(f"if(everywhere, transform(sequence(0, chunks - 1), k -> {place.format('k', 'block')}), array())")
        dealt = _sets(chosen, width, named, "grp long, cls long, everywhere boolean, label long, own int, block int, chunks int, blocks int, s binary")
        dealt = dealt.withColumn("to", F.explode(F.array_union(all_, F.expr(f"transform(sequence(0, blocks - 1), k -> {place.format('own', 'k')})"))))
        dealt = dealt.select("grp", "to.chunk", F.col("to.block").alias("to_block"), "cls", "everywhere", "label", "own", "block", "s")
        return dealt.repartition("grp", "chunk", "to_block").sortWithinPartitions("grp", "chunk", "to_block").mapInArrow(solve, "a long, b long")

    pairs = written(links(sized, False), "links")
    large = sized.where("chunks > 1")
    if large.limit(1).count():
        joined = components(pairs).withColumnsRenamed({"node": "cls", "component": "to"})
        large = large.drop("label").join(joined, "cls", "left").withColumn("label", F.coalesce("to", "cls")).drop("to")
        most = large.groupBy("grp", "label").count().groupBy("grp").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
        large = large.join(most.where("labels > 1"), "grp").withColumn("everywhere", F.col("label") != F.col("main"))
        blocks = large.where("everywhere").groupBy("grp").agg(F.ceil(F.sum("n") / chunk_shingles).cast("int").alias("blocks"))
        large = large.drop("blocks").join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int"))
        pairs = pairs.unionByName(links(written(large.select(sized.columns), "strays"), True))
    linked_classes = components(written(pairs, "links"))
    linked_classes = linked_classes.withColumnsRenamed({"node": "cls", "component": "grp"}).join(classes.select("cls", "first_id"), "cls")
    low = linked_classes.groupBy("grp").agg(F.min("first_id").alias("component_id"))
    label = linked_classes.join(low, "grp").select("cls", "component_id")
    all_ = classes.select("cls", "c1", "c2", "first_id").join(label, "cls", "left").select("c1", "c2", F.coalesce("component_id", "first_id").alias("component_id"))
    all_ = written(all_, "labels")  # so that the join with a hot class's rows is one that Spark can split
    out = named.where("c1 is not null").drop("vec").join(all_, ["c1", "c2"]).select("id", "n", "component_id")
    out = out.unionByName(named.where("c1 is null").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with recursive w as (select doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' '), ' ') as w from documents),
k as (select doc_id, case when len(w) = 1 and w[1] = '' then [] else w end as w from w),
s as (select distinct doc_id, array_to_string(w[p : p + 2], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as p from k where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
l as materialized (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2) t join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 90 * (p.n + q.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as x, doc_id as m from documents union select e.b, r.m from r join e on e.a = r.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m as component_id from documents d left join n using (doc_id) join (select x, min(m) as m from r group by 1) on x = d.doc_id"""
