"""What the findings of round 4 asked for."""

import random

from tests.llm.test_dedup import groups, sets_of

import gridlore.llm.jaccard_join as j


def _watched(monkeypatch):
    """The tables that a run writes, by name."""
    seen, write = {}, j.written

    def kept(df, name):
        seen[name] = write(df, name)
        return seen[name]

    monkeypatch.setattr(j, "written", kept)
    return seen


def _linked(rows, num):
    sets = sets_of(rows, 3)
    return groups([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) > 0], sets)


def test_a_hot_key_ties_nothing_without_the_bound(spark, monkeypatch):
    """800 texts are made of 10 of 40 passages, so that hot keys are in every prefix; only twins link."""
    rng = random.Random(3)
    passages = [" ".join(f"p{k}w{i}" for i in range(10)) for k in range(40)]
    rows = []
    for i in range(0, 800, 2):
        text = " ".join(rng.sample(passages, 10))
        rows += [(i, text), (i + 1, text + f" v{i}")]
    monkeypatch.setattr(j, "BUCKET", 64)
    seen = _watched(monkeypatch)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in j.jaccard_components(docs, 3, 75, 100).collect()}
    assert got == _linked(rows, 75) and len(set(got.values())) == 400
    assert seen["members"].groupBy("grp").count().agg({"count": "max"}).first()[0] < 50  # one group of 800 before
    assert seen["wide"].groupBy("a").count().agg({"count": "max"}).first()[0] > 128


def test_strays_come_to_chunks_in_blocks(spark, monkeypatch):
    """A chain of 120 texts, each linked to the next: one group, in many chunks. No task gets more than a chunk and a block."""
    words = [f"w{k}" for k in range(500)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = _watched(monkeypatch)
    got = {r["doc_id"]: r["component_id"] for r in j.jaccard_components(docs, 3, 80, 100, chunk_shingles=400).collect()}
    assert got == _linked(rows, 80) and set(got.values()) == {0}
    strays = seen["strays"]
    assert strays.where("everywhere").agg({"n": "sum"}).first()[0] > 4 * 400
    assert strays.where("everywhere").groupBy("grp", "block").agg({"n": "sum"}).agg({"sum(n)": "max"}).first()[0] < 4 * 400  # all of them with each chunk before


def test_the_near_stage_ties_nothing_without_the_bound(spark, monkeypatch):
    """The pipeline's shingles and threshold: 400 texts of 10 of 40 passages and their twins, one of each two stays."""
    import corpus_pipeline

    rng = random.Random(4)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(40)]
    texts = [" ".join(rng.sample(passages, 10)) for _ in range(400)]
    rows = [(2 * i + odd, t + odd * f" v{i}") for i, t in enumerate(texts) for odd in range(2)]
    seen = _watched(monkeypatch)
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "")
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(0, 800, 2))
    assert seen["members"].groupBy("grp").count().agg({"count": "max"}).first()[0] < 50  # one group of all before
