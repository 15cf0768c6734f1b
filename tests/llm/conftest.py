"""Documents with every awkward row: null, empty and very long texts, ties, repeats, extra columns with clashing names."""

import random

import pytest


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    rng = random.Random(7)
    rows, base = [], [words(rng, rng.randrange(1, 150)) for _ in range(60)]
    for i, t in enumerate(base):
        rows.append((i, t))
    for i in range(60, 120):  # near copies: a few words changed
        w = base[i - 60].split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    passage = words(rng, 60)
    for i in range(120, 135):  # a passage that many share
        rows.append((i, words(rng, 20) + " " + passage + " " + words(rng, 15)))
    rows += [(135, None), (136, ""), (137, "   \n\t"), (138, "one"), (139, "One"), (140, "Üñí 你好 123"), (141, "12345 !!"), (142, base[3]), (143, base[3]), (144, base[3].upper()), (145, words(rng, 30_000, 5000)), (146, "ab" * 3000), (147, "<|endoftext|> a <|endoftext|>"), (148, "x\x00y\x1cz " * 40)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", b"clash", 1) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long, id string, digest binary, n int").repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
