import hashlib
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridlore.llm.packing import best_fit_decreasing, certificate, lower_bound, pack, packed_documents, token_pieces
from gridlore.llm.pretokens import PieceEncoder, Spec, is_odd
from gridlore.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def enc():
    return PieceEncoder(Spec.of(PATH, 2000), tuple)


@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdtlrev.,!0123456789éß\x1c\x85\xa0")), max_size=60), max_size=6))
@settings(max_examples=400, deadline=None)
def test_pieces_equal_the_library(tok, enc, texts):
    got = list(enc.each(texts, lambda parts: [i for p in parts for i in p]))
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


STRANGE = ["It’s a “quoted” word – and more…", "emoji 😀😀 here 👩‍👩‍👧 end", "日本語 と 한국어 русский язык", "a <|endoftext|> b<|endoftext|>c  <|endoftext|>", "tab\x1c\x1d x \x1f", "\U0001d400\U0001d401 math 𝟏𝟐 ok", "x\u0378y \u0378 \u0378\u0378  z", "  lead 😀  two  spaces ", "it's we'll I’ve", "à\u0300\u0301 é", "\u00a0nbsp\u2003em\u3000wide", "<|endoftext|>"]


def test_strange_texts_equal_the_library(tok, enc):
    texts = [*STRANGE, " ".join(STRANGE), "\n".join(STRANGE * 20), "".join(STRANGE)]
    assert list(enc.each(texts, lambda parts: [i for p in parts for i in p])) == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_only_odd_stretches_leave_the_tiers(enc, monkeypatch):
    seen = []
    monkeypatch.setattr(PieceEncoder, "whole", lambda self, text: seen.append(text) or ())
    list(enc.each(["It’s “plain” – dashes and русский 日本 😀", "one \U0001d400 odd", "a <|endoftext|> b"], list))
    assert seen == [" \U0001d400", " <|endoftext|>"]


def test_every_character_that_is_not_odd_splits_like_the_library(tok, enc):
    chars = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and not is_odd(c)]
    chars = [c for c in chars if ord(c) < 0x3400 or ord(c) > 0xD7A3 and not 0xE000 <= ord(c) < 0xF900 and ord(c) < 0x20000 or ord(c) % 97 == 0]
    texts = ["".join(f"a{c}b1{c}2 {c}.{c} " for c in chars[k : k + 50]) for k in range(0, len(chars), 50)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert list(enc.each(texts, lambda parts: [i for p in parts for i in p])) == want and len(chars) > 18_000


def test_one_run_after_another(tok, enc):
    texts = ["long text of many words, 2024! " * 50_000, "short", "é" * 1_200_000 + " end"]
    assert list(enc.each(texts, lambda parts: sum(map(len, parts)))) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_small_cache_changes_nothing(tok, monkeypatch):
    import gridlore.llm.pretokens as p

    monkeypatch.setattr(p, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(p, "CACHE_KEY_CHARS", 4)
    enc = PieceEncoder(Spec.of(PATH, 0), tuple)
    texts = [f"alpha beta{i} gamma delta {i}" for i in range(50)]
    for t in texts:
        assert list(enc.each([t], lambda parts: [i for p in parts for i in p])) == [tok.encode(t, add_special_tokens=False).ids]


def test_other_tokenizers_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), PieceEncoder(Spec.of(path), tuple)
    texts = ["Hello  World", "", "it's 2024"]
    assert list(enc.each(texts, lambda parts: [i for p in parts for i in p])) == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_frequent_pieces(docs, corpus, tok):
    """The table holds the corpus's own pre-tokens, whatever their length; a small one, an empty one and one of other texts count alike."""
    from collections import Counter

    from gridlore.llm.pretokens import split
    from gridlore.llm.token_counts import frequent_pieces

    spec = frequent_pieces(docs, Spec.of(PATH, 0))
    seen = Counter(p for _, t in corpus if t and not is_odd(t) and "<|endoftext|>" not in t for p in split(t))
    words = spec.frequent.to_pylist()
    assert {w for w, _ in seen.most_common(100)} <= set(words) and (spec.lengths > 1).any()
    assert spec.lengths.tolist() == [len(tok.encode(w, add_special_tokens=False).ids) for w in words]
    few = frequent_pieces(docs, Spec.of(PATH, 0), entries=5, rows=20)
    assert len(few.frequent) <= 5 and len(frequent_pieces(docs.where("false"), Spec.of(PATH, 0)).frequent) == 0
    texts = [t or "" for _, t in corpus]
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    for s in (spec, few, Spec.of(PATH, 0)):
        assert list(PieceEncoder(s, len).each(texts, sum)) == want


def test_counts(docs, no_docs, corpus, tok):
    got = {r["doc_id"]: r for r in token_counts(docs, PATH).collect()}
    for i, t in corpus:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 512)
    assert len(got) == len(corpus) and token_counts(no_docs, PATH).count() == 0


def _exact_bins(lengths, capacity):
    """The fewest bins, by trying all."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        bins.append(lengths[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_bound_never_passes_the_optimum(lengths):
    x = np.array(lengths)
    bins, offsets = best_fit_decreasing(x, 20)
    assert lower_bound(x, 20) <= _exact_bins(sorted(lengths, reverse=True), 20) <= bins.max() + 1
    for b in set(bins.tolist()):
        at = sorted((offsets[i], x[i]) for i in np.nonzero(bins == b)[0])
        assert [o for o, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))] and sum(n for _, n in at) <= 20


def test_bound_sees_large_items():
    assert lower_bound(np.array([11] * 7), 20) == 7 and lower_bound(np.array([7] * 9), 20) == 5 and lower_bound(np.zeros(0, int), 20) == 0


@pytest.mark.parametrize("per_group", [40, 100_000])
def test_exchange_places_every_piece_once(spark, per_group):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 1500)
    names = ["open", "c0", "c3", "bins"]
    pieces = spark.createDataFrame([(i, int(n), *names, "mine") for i, n in enumerate(lengths)], "id long, length long, open string, c0 string, c3 string, bins string, pack_group string")
    packed = pack(pieces, 100, per_group)
    got = packed.toPandas()
    assert sorted(got["id"]) == list(range(1500)) and set(got.columns) == {"id", "length", *names, "sequence_id", "offset", "pack_group", "group_bins", "group_bound"}
    assert all((got[c] == c).all() for c in names)
    assert certificate(packed, 100) == (got["sequence_id"].nunique(), lower_bound(lengths, 100))
    for group, g in got.groupby("pack_group"):
        bins = 1 if group == -1 else g["sequence_id"].nunique()
        assert (g["group_bins"] == bins).all() and (g["group_bound"] == (1 if group == -1 else lower_bound(g["length"].to_numpy(), 100))).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == list(g["length"].cumsum() - g["length"]) and g["length"].sum() <= 100
    assert got["sequence_id"].nunique() <= lower_bound(lengths, 100) * (1.08 if per_group == 40 else 1.01) + 2
    none = pack(pieces.where("false"), 100)
    assert none.count() == 0 and certificate(none, 100) == (0, 0)


def test_packed_documents(spark, docs, corpus, tok):
    got = packed_documents(docs, PATH, 2, 64).toPandas().sort_values(["doc_id", "piece"])
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in corpus}
    for i, g in got.groupby("doc_id"):
        n = len(ids[i])
        assert list(g["piece"]) == list(range(len(g))) and list(g["start"]) == list(g["length"].cumsum() - g["length"]) and g["length"].sum() == n
        assert len(g) == max(1, -(-n // 64)) and (g["length"].iloc[1:] == 64).all()
        assert [zlib.crc32(ids[i][s : s + k].tobytes()) for s, k in zip(g["start"], g["length"], strict=True)] == list(g["ids_crc32"])
    assert set(got["doc_id"]) == set(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == list(g["length"].cumsum() - g["length"]) and g["length"].sum() <= 64
    raw = token_pieces(docs.where("doc_id = 145"), PATH, 2, 64).orderBy("piece").collect()
    assert hashlib.sha256(b"".join(r["ids"] for r in raw)).digest() == hashlib.sha256(ids[145].tobytes()).digest()
    assert isinstance(got, pd.DataFrame)
