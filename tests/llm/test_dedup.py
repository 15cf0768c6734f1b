"""Exact, near and repeated-string deduplication and decontamination against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlore.llm.common import components, written
from gridlore.llm.decontaminate import contaminated, shingles_of, words
from gridlore.llm.exact_dedup import DigestFilter, compact, exact_groups, flagged, flush
from gridlore.llm.jaccard_join import COUNTERS, CountVectorTree, count_vector, folded, jaccard_components, linked, packed_counts, prefix, set_name, shingle_set, unpacked_counts
from gridlore.llm.suffix_dedup import anchors, previous_factors, remove_repeats


def groups(pairs, nodes):
    up = {n: n for n in [*nodes, *(x for p in pairs for x in p)]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
@settings(max_examples=5, deadline=None)
def test_components(spark, pairs):
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == groups(pairs, nodes)


def test_components_of_a_path(spark):
    got = components(spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {r["component"] for r in got.collect()} == {0} and got.count() == 201


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(docs, no_docs, corpus, keep):
    by = defaultdict(list)
    for i, t in corpus:
        by[t or ""].append(i)
    pick = max if keep == "largest" else min
    want = {i: (pick(ids), len(ids), i == pick(ids)) for ids in by.values() for i in ids}
    for how in ({}, {"digest_of": lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 1)}, {"max_bits": 64}, {"entries": 7}):
        rows = exact_groups(docs, keep=keep, **how).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows} == want and len(rows) == len(corpus)
    assert exact_groups(no_docs).count() == 0


def test_exact_with_repeated_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "b")]
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in got) == [("1", 1, 3, True), ("1", 1, 3, True), ("2", 2, 2, True), ("None", 1, 3, False), ("None", 2, 2, False)]


def test_filter_loses_nothing(spark):
    some = spark.range(500).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    other = spark.range(500, 1500).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    for f in (DigestFilter.build(some), DigestFilter.build(some, 1 << 14)):
        assert f.might_hold(some).count() == 500 and f.might_hold(other).count() < 100
    assert DigestFilter.build(some.where("false")).might_hold(other).count() == 0


@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    """12,000 texts in 24 files; those of ids below 6,000 whose id is odd stand twice, in files far apart."""
    path = str(tmp_path_factory.mktemp("filed") / "table")
    ids = spark.range(12000).withColumnRenamed("id", "doc_id")
    twin = F.when((F.col("doc_id") >= 6000) & (F.col("doc_id") % 2 == 1), F.col("doc_id") - 6000).otherwise(F.col("doc_id"))
    ids.select("doc_id", F.concat(F.lit("text "), twin.cast("string")).alias("text")).repartitionByRange(24, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def test_filters_follow_the_files(spark, filed):
    rows = filed.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    for n in (300, 3000):  # ten times the digests: as few rows pass
        wanted = written(spark.range(n).select(F.unhex(F.sha2(F.concat(F.lit("text "), (2 * F.col("id") + 1).cast("string")), 256)).alias("digest")), "wanted")
        one = flagged(rows, wanted, "digest", "may")  # fits: one filter
        many = flagged(rows, wanted, "digest", "may", 2048)
        assert many.columns == ["doc_id", "digest", "may"] and many.count() == 12000 == many.select("doc_id").distinct().count()
        assert one.where("may").count() < 2 * n + 200
        held = many.join(wanted, "digest", "left_semi")
        assert held.count() == 2 * n and held.where("not may").count() == 0
        assert many.where("may").count() < 2 * n + 600
    crowded = rows.withColumn("may", DigestFilter.build(wanted, 2048).test(spark, "digest"))
    assert crowded.where("may").count() > 11000  # what one filter of that size lets through
    # each file is read once, by the branch of its own block
    assert many._jdf.queryExecution().executedPlan().toString().count("file_path") > 4
    by_hand = spark.createDataFrame(filed.limit(50).collect(), filed.schema).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    assert flagged(by_hand, wanted, "digest", "may", 64).count() == 50
    assert flagged(rows.where("doc_id < 0"), wanted, "digest", "may", 64).count() == 0


def test_filters_follow_null_keys_and_odd_types(spark, filed):
    rows = filed.select(F.when(F.col("doc_id") % 10 > 0, F.col("doc_id")).alias("key"))
    wanted = written(spark.range(11, 2000).select(F.when(F.col("id") > 11, F.col("id")).alias("digest")), "wanted")
    got = flagged(rows, wanted, "key", "may", 512)
    assert got.where("key is null").count() == 1200 == got.where("key is null and may").count()
    assert got.where("key between 12 and 1999 and not may").count() == 0 and got.where("may and key >= 2000").count() < 1000
    assert flagged(rows.where("key = -1"), wanted, "key", "may", 64).count() == 0


def test_exact_with_filters_by_file(filed):
    rows = exact_groups(filed, max_bits=2048).collect()
    want = {i: (i + 6000 if i < 6000 and i % 2 else i, 2 if i % 2 else 1) for i in range(12000)}
    assert len(rows) == 12000 and {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows} == want
    odd = exact_groups(filed, max_bits=2048, digest_of=lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 2)).collect()  # digests collide
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in odd} == want


def test_operators_with_filters_by_file(spark, filed, monkeypatch):
    """Every operator that asks flagged gives the same rows when filters follow the files."""
    import gridlore.llm.jaccard_join as j
    import gridlore.llm.suffix_dedup as s
    import gridlore.llm.warc as w

    docs = filed.where("doc_id % 4 < 2").withColumn("text", F.concat_ws(" ", *[F.concat(F.md5("text"), F.lit(str(k))) for k in range(5)], F.when(F.col("doc_id") % 3 == 0, F.lit("x"))))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    asked = []

    def small(rows, digests, key, name):
        out = flagged(rows, digests, key, name, 2048)
        asked.append(out._jdf.queryExecution().analyzed().toString().count("file_path"))
        return out

    def results():
        return [sorted(map(str, d.collect())) for d in (j.jaccard_components(docs, 2, 60, 100), s.remove_repeats(docs).select("doc_id", "n_removed", "kept"), w.page_records(pages))]

    before = results()
    for module in (j, s, w):
        monkeypatch.setattr(module, "flagged", small)
    assert results() == before and sum(n > 0 for n in asked) >= 3


def test_compaction_merges_runs_and_filters_repeats(spark):
    n = 400
    rows = spark.range(3 * n).select(F.unhex(F.sha2((F.col("id") % n).cast("string"), 256)).alias("digest"), "id").where(f"id < 2 * {n} or id % 4 = 0").repartition(5)
    runs = written(flush(rows, "smallest", 30), "test_runs")
    assert runs.select("run").distinct().count() > 20
    level, filters = compact(runs, "smallest", 30)
    assert len(filters.starts) >= 30
    got = {bytes(r["digest"]): (r["keep_id"], r["n"]) for r in level.collect()}
    assert got == {hashlib.sha256(str(i).encode()).digest(): (i, 2 + (i % 4 == 0)) for i in range(n)}
    once, more = spark.range(n, 2 * n).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id"), rows.select("digest", "id").where(f"id < {n}")
    level, filters = compact(written(flush(once.unionByName(more.limit(50)), "smallest", 30), "test_runs"), "smallest", 30)
    assert level.count() == n + 50 and filters.might_hold(once).count() == 0


def sets_of(corpus, width):
    out = {}
    for i, t in corpus:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return out


@pytest.mark.parametrize(("width", "num", "chunk"), [(3, 90, 3_000_000), (5, 80, 3_000_000), (2, 60, 3_000_000), (3, 80, 150), (3, 80, 40)])
def test_jaccard(docs, corpus, width, num, chunk):
    sets = sets_of(corpus, width)
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) > 0]
    want = groups(pairs, sets)
    rows = jaccard_components(docs, width, num, 100, chunk_shingles=chunk).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(s), want[i]) for i, s in sets.items()} and len(rows) == len(corpus)


def test_jaccard_with_hot_keys(docs, corpus, monkeypatch):
    import gridlore.llm.jaccard_join as j

    monkeypatch.setattr(j, "BUCKET", 1)
    monkeypatch.setattr(j, "LOCAL_BUCKET", 1)
    sets = sets_of(corpus, 3)
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    assert {r["doc_id"]: r["component_id"] for r in jaccard_components(docs, 3, 80, 100).collect()} == groups(pairs, sets)


def test_jaccard_of_nothing(no_docs):
    assert jaccard_components(no_docs).count() == 0


@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([(90, 100), (80, 100), (60, 100)]), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_linked_sets_meet_under_a_key(both, left, right, threshold, seed):
    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 1 << 63, both + left + right, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, both + left + right, dtype=np.uint64))
    rng.shuffle(h)
    x, y = np.sort(h[: both + left]), np.sort(np.concatenate((h[:both], h[both + left :])))
    often = rng.integers(0, 3, COUNTERS)
    if 100 * both >= threshold[0] * len(h):
        for order in (None, often):
            assert set(prefix(x, *threshold, order)) & set(prefix(y, *threshold, order))
    assert bool(linked(np.array([1, 2]), [x, y], *threshold)) == (100 * both >= threshold[0] * len(h))


def test_tree_bound_keeps_every_link():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(200, 1500)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(150)]
    flat, sizes = np.stack([folded(count_vector(s), 16) for s in sets]), np.array([len(s) for s in sets])
    tree = CountVectorTree(flat, sizes, 30, 100)
    for i in range(150):
        wanted = np.arange(150) % 7 > 0
        near = set(tree.query(flat[i], len(sets[i]), wanted).tolist())
        for j in range(150):
            shared = len(np.intersect1d(sets[i], sets[j]))
            assert j in near or not wanted[j] or 100 * shared < 30 * (len(sets[i]) + len(sets[j]) - shared)


@pytest.mark.parametrize("threshold", [(30, 100), (60, 100), (80, 100)])
def test_links_among_sets_of_many_sizes(threshold):
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 1 << 62, int(n)).astype(np.uint64)) for n in np.geomspace(1, 3000, 40)]
    sets = base + [np.sort(rng.choice(b, max(1, int(len(b) * rng.uniform(0.3, 1))), replace=False)) for b in base * 2]
    ids = np.arange(len(sets)) * 3
    want = []
    for a in range(len(sets)):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 100 * shared >= threshold[0] * (len(sets[a]) + len(sets[b]) - shared):
                want.append((int(ids[a]), int(ids[b])))
    assert groups(linked(ids, sets, *threshold), ids.tolist()) == groups(want, ids.tolist()) and want


@pytest.mark.parametrize("most", [3, 300, 70_000])
def test_counts_come_back(most):
    s = (np.arange(most, dtype=np.uint64) << np.uint64(40)) | np.uint64(1)
    v = count_vector(s)
    assert (unpacked_counts(packed_counts(v), len(s)) == v).all() and v.max() == most


def test_set_names():
    a, b = shingle_set("A b c d", 3), shingle_set("a B  c\td", 3)
    assert set_name(a) == set_name(b) and len(a) == 2 and set_name(shingle_set("a b", 3)) != set_name(shingle_set("a b c", 3)) and len(shingle_set(" \n", 3)) == 0


def brute_removed(rows, length):
    """Of each text the bytes that an earlier string of length covers."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeats(docs, corpus, hot):
    rows = remove_repeats(docs, hot_contexts=hot).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in rows} == brute_removed(corpus, 100)
    assert len(rows) == len(corpus)


def test_repeats_of_nothing(no_docs):
    assert remove_repeats(no_docs).count() == 0


def test_repeated_row_is_one_document(spark):
    t = "the same text of more than one hundred bytes that is given twice under one id and once under another id, as it happens"
    got = remove_repeats(spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("1", 0), ("1", 0), ("2", len(t)), ("None", len(t))]


@given(st.binary(min_size=0, max_size=400), st.integers(0, 50))
@settings(max_examples=100, deadline=None)
def test_each_window_has_one_anchor(data, cut):
    data = data + data[cut:] + data
    a, lo, hi = anchors(data, 100, 32)
    assert [w for x, y in zip(lo, hi, strict=True) for w in range(x, y + 1)] == list(range(max(0, len(data) - 99)))
    by = {}
    for h, x, y in zip(a.tolist(), lo.tolist(), hi.tolist(), strict=True):
        for w in range(x, y + 1):
            assert by.setdefault(data[w : w + 100], h) == h


@given(st.lists(st.text("ab", min_size=3, max_size=30), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_previous_factors(contexts):
    contexts = [c.encode() for c in contexts]
    got = previous_factors(contexts, 3)
    starts = [(k, s) for k, c in enumerate(contexts) for s in range(len(c) - 2)]
    for k, s in starts:
        best = 0
        for j, r in starts:
            if (j, r) < (k, s):
                n = 0
                while n < 3 and contexts[j][r + n] == contexts[k][s + n]:
                    n += 1
                best = max(best, n)
        assert got[k][s] == best


def test_previous_factors_in_any_order_of_positions():
    assert [f.tolist() for f in previous_factors([b"abcd", b"xbcdy", b"bcd"], 3)] == [[0, 0], [0, 3, 0], [3]]
    rng = np.random.default_rng(2)
    data = [bytes(rng.integers(97, 99, 2000, dtype=np.uint8)) + b"q" * 300, b"q" * 400]
    got = previous_factors(data, 8)
    seen = set()
    for c, f in zip(data, got, strict=True):
        for s in range(len(c) - 7):
            assert (f[s] == 8) == (c[s : s + 8] in seen)
            seen.add(c[s : s + 8])


def test_decontamination(spark, docs, corpus):
    rng = np.random.default_rng(1)
    texts = dict(corpus)
    items = [(k, " ".join(texts[int(i)].split()[a : a + 40])) for k, (i, a) in enumerate(zip(rng.integers(0, 60, 25), rng.integers(0, 20, 25), strict=True))]
    items += [(50, "nothing of the sort is anywhere here at all"), (51, ""), (52, None), (53, "one"), (54, " ".join(texts[145].split()[20_000:20_050])), (55, " ".join(texts[7].split()[:10] + ["zz"] + texts[7].split()[10:40])), (53, "one")]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    want = Counter()
    for k, t in items:
        q = shingles_of(words(t or ""))
        for i, d in corpus:
            width = len(next(iter(q))) if q else 5
            shared = len(q & shingles_of(words(d or ""), width)) if q and len(words(d or "")) >= width else 0
            if q and 5 * shared >= 4 * len(q):
                want[i, k, shared, len(q)] += 1
    for block in (32 << 20, 300):
        got = Counter((r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in contaminated(docs, bench, block_bytes=block).collect())
        assert got == want and any(k == 54 for _, k, _, _ in got)
    named = contaminated(docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"), bench.withColumn("item_id", F.concat(F.lit("i"), "item_id")), block_bytes=300)
    assert {(r["doc_id"], r["item_id"]) for r in named.collect()} == {(f"d{i}", f"i{k}") for i, k, _, _ in want}
    assert contaminated(docs.where("false"), bench).count() == 0 and contaminated(docs, bench.where("false")).count() == 0
