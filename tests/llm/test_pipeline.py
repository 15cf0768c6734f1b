"""The pipeline and each of its stages against brute force."""

import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from gridlore.llm.decontaminate import shingles_of, words
from gridlore.llm.language_id import KernelParams
from gridlore.llm.packing import packed_documents

from .test_dedup import groups, sets_of
from .test_language import LABELLED, ridge_scores

BENCHMARK = [(0, None), (1, ""), (2, "nothing of the sort is anywhere here at all")]


CLASHES = ["score", "lang_pred", "found", "best", "kept_id", "bad_id", "bad", "row", "maybe", "open", "offset", "pack_group", "length", "component_id"]


def language(rows, lang="en"):
    """Texts with a letter and a score of a dense kernel ridge above the threshold; without labels, texts with a letter."""
    letters = [(i, t) for i, t in rows if any(unicodedata.category(c).startswith("L") for c in t or "")]
    if not lang:
        return letters
    scores = ridge_scores([(t, lang) for _, t in letters], [t for _, t in letters])
    return [r for r, s in zip(letters, scores.max(1), strict=True) if s >= KernelParams().reject_below]


def exact(rows):
    """One row of equal texts, with the smallest id; a null id comes after all others, and null is an empty text."""
    first = {}
    for i, t in rows:
        if (t or "") not in first or i is not None and (first[t or ""][0] is None or i < first[t or ""][0]):
            first[t or ""] = (i, t)
    return list(first.values())


def near(rows):
    sets = sets_of(rows, p.SHINGLE_WORDS)
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and p.DEN * len(sets[a] & sets[b]) >= p.NUM * len(sets[a] | sets[b]) > 0]
    stays = {i for i, c in groups(pairs, sets).items() if i == c}
    return [(i, t) for i, t in rows if i in stays]


def decontaminate(rows, items):
    def hit(d):
        for _, t in items:
            q = shingles_of(words(t or ""))
            width = len(next(iter(q))) if q else 5
            if q and len(words(d or "")) >= width and 5 * len(q & shingles_of(words(d or ""), width)) >= 4 * len(q):
                return True
        return False

    return [(i, t) for i, t in rows if not hit(t)]


def counted(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.fixture(scope="module")
def items(corpus):
    texts = dict(corpus)
    return BENCHMARK + [(10 + i, " ".join(texts[i].split()[:30])) for i in (2, 9, 121) if len(texts[i].split()) >= 30]


@pytest.fixture(scope="module")
def sf(spark, docs, items, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, docs, no_docs, corpus, items, sf):
    more = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    for stage, want in ((p.language, language(corpus)), (p.exact, exact(corpus)), (p.near, near(corpus)), (p.decontaminate, decontaminate(corpus, items))):
        got = stage(spark, more, sf)
        assert got.columns == more.columns
        assert counted(got) == Counter(want) and len(want) < len(corpus), stage
        assert got.where(" or ".join(f"{c} <> 'own {c}'" for c in CLASHES)).count() == 0
        assert stage(spark, no_docs, sf).count() == 0, stage
    packed = p.pack(spark, more, sf)
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in corpus} and p.pack(spark, no_docs, sf).count() == 0


def test_language_rejects_what_no_language_scores(spark, sf):
    rows = [(k, t, lang) for k, (t, lang) in enumerate(LABELLED * 3)] + [(900, "Привет, как дела? Это простой текст", None), (901, "你好世界这是一个中文句子", None), (902, "the dog runs in the garden", None), (903, "12 !", "en"), (904, None, "en")]
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert {r["doc_id"] for r in p.language(spark, some, sf).collect()} == {i for i, _, _ in rows} - {900, 901, 903, 904}
    unlabelled = some.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in p.language(spark, unlabelled, sf).collect()} == {i for i, _, _ in rows} - {903, 904}


def test_null_and_repeated_ids(spark, docs, items, sf):
    rows = [(1, "same text here"), (1, "same text here"), (None, "same text here"), (None, "alone with no id"), (2, "same text here"), (3, "other text"), (3, "another text"), (None, items[3][1]), (4, items[3][1])]
    some = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    assert counted(p.language(spark, some, sf)) == Counter(language(rows)) == Counter(rows)
    assert counted(p.exact(spark, some, sf)) == Counter(exact(rows))
    assert counted(p.decontaminate(spark, some, sf)) == Counter((i, t) for i, t in rows if i not in (None, 4))
    assert counted(p._without(some, some.where("doc_id is null or doc_id = 3").select("doc_id"))) == Counter((i, t) for i, t in rows if i in (1, 2, 4))


def test_run(spark, docs, corpus, items, sf):
    kept = decontaminate(near(exact(language(corpus))), items)
    import public_tokenizers

    want = packed_documents(spark.createDataFrame(kept, "doc_id long, text string"), public_tokenizers.path(p.TOKENIZER), p.EOS, p.CAPACITY)
    pieces = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    got = p.run(spark, sf)
    assert pieces(got) == pieces(want) and {r["doc_id"] for r in got.collect()} == {i for i, _ in kept}
    used = Counter()
    for r in got.collect():
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= p.CAPACITY
