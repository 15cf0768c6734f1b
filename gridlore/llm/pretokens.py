"""Tokens of whole texts through two tiers: a broadcast table of frequent pre-tokens, then a bounded cache in each worker."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from .common import worker_cache

CACHE_ENTRIES = 250_000
CACHE_KEY_CHARS = 128


def _visible() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others take the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


def _ranges(points: Iterable[int]) -> str:
    """Code points in rising order as ranges of a character class."""
    runs: list[list[int]] = []
    for c in points:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


_CLASSES: list[tuple[re.Pattern, re.Pattern]] = []
#: A class of the basic plane alone is looked up in a table; with others it would be a list that is tried one by one.
_BEYOND = re.compile("[\U00010000-\U0010ffff]+")


def classes() -> tuple[re.Pattern, re.Pattern]:
    """The byte-level pre-tokenizer's split rule, and the odd characters of the basic plane, for which it can't be told here (see is_odd).

    Whether a character is a letter or a number depends on the Unicode version. Those that Unicode 3.2 has as such in the basic plane are so in
    every later version; characters that are assigned and neither now never become one. The rest is odd: unassigned
    ones, later letters and numbers and those of other planes, and U+001C to U+001F, which are spaces to this engine alone.
    """
    if not _CLASSES:
        old = unicodedata.ucd_3_2_0.category
        letters, numbers, odd = [], [], [*range(0x1C, 0x20)]
        for c in range(1 << 16):
            now = unicodedata.category(chr(c))
            if now[0] in "LN" and old(chr(c))[0] == now[0]:
                (letters if now[0] == "L" else numbers).append(c)
            elif now[0] in "LN" or now == "Cn":
                odd.append(c)
        _CLASSES.append((_rule(_ranges(letters), _ranges(numbers)), re.compile(f"[{_ranges(odd)}]")))
    return _CLASSES[0]


def _rule(letters: str, numbers: str) -> re.Pattern:
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+")


#: The same rule for ASCII texts, with short classes.
_ASCII_RULE = _rule("A-Za-z", "0-9")


def split(text: str) -> list[str]:
    """The pre-tokens of a text that is not odd."""
    return (_ASCII_RULE if text.isascii() else classes()[0]).findall(text)


def is_odd(text: str) -> bool:
    if text.isascii():
        return bool(_ODD_ASCII.search(text))
    if classes()[1].search(text):
        return True
    return any(unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Cn" for run in _BEYOND.findall(text) for c in run)


#: A pre-token always ends between a character that is no space and a single space that such a character follows.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_ODD_ASCII = re.compile("[\x1c-\x1f]")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _back() -> dict[str, int]:
    return {chr(c): b for b, c in _visible().items()}


@dataclass
class Spec:
    """What workers need of a tokenizer file. frequent: its frequent pre-tokens, ids: theirs in a row, lengths: how many each has.

    alike: the file splits by the plain byte-level rule, so that pre-tokens can be encoded one by one. ranks: the vocabulary's pieces in order
    of rank for a faster encoder, if each merge makes the next id and single bytes come first. special: strings that the
    library takes out of texts; None among them stands for one that can't be confined to a stretch of text.
    """

    path: str
    alike: bool
    ranks: list[tuple[bytes, int]] | None = None
    special: list[str | None] = field(default_factory=list)
    frequent: list[str] | pa.StringArray = field(default_factory=list)
    ids: np.ndarray | None = None
    lengths: np.ndarray | None = None

    @classmethod
    def of(cls, path: str, entries: int = 50_000) -> Spec:
        """Frequent pre-tokens are the vocabulary's first entries that stand alone as one: a vocabulary is ordered by how often its entries were
        met in training. Their number is bounded by the vocabulary, whatever the corpus; the library itself gives the ids."""
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        pre, model = parts.get("pre_tokenizer") or {}, parts["model"]
        alike = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space") and not parts.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
        if not alike:
            return cls(path, False)
        added = parts.get("added_tokens") or []
        special = [None if re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") else t["content"] for t in added if t["content"]]
        back = _back()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = None
        if all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            ranks = [(bytes(back.get(c, ord(c)) for c in piece), i) for piece, i in model["vocab"].items() if i < 256 + len(merges)]
        contents = {t["content"] for t in added}
        words = []
        for piece, _ in sorted(model["vocab"].items(), key=lambda kv: kv[1])[:entries]:
            word = bytes(back.get(c, ord(c)) for c in piece if ord(c) < 512).decode("utf-8", "replace")
            if word and piece not in contents and "�" not in word and not is_odd(word) and split(word) == [word]:
                words.append(word)
        words = list(dict.fromkeys(words))
        ids = [e.ids for e in load(path).encode_batch(words, add_special_tokens=False)]
        return cls(path, True, ranks, special, words, np.array([i for e in ids for i in e], np.uint32), np.array([len(e) for e in ids], np.uint8))


class _Pieces(dict):
    """A worker's cache of one generation; what it lacks comes from the generation before, or is made."""

    def __init__(self, base: dict, older: dict, make: Callable):
        super().__init__(base)
        self.older, self.make = older, make

    def __missing__(self, piece: str):
        found = self.older.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= CACHE_KEY_CHARS:
            self[piece] = found
        return found


class PieceEncoder:
    """Encodes whole texts piece by piece; value makes what is stored for a piece from its ids (of frequent ones without ids: the length itself)."""

    def __init__(self, spec: Spec, value: Callable):
        self.path, self.value, self.alike = spec.path, value, spec.alike and None not in spec.special
        self._tok = None
        self.special = re.compile("|".join(map(re.escape, spec.special))) if self.alike and spec.special else None
        self.base, at = {}, 0
        words = spec.frequent if isinstance(spec.frequent, list) else spec.frequent.to_pylist()
        for word, n in zip(words, spec.lengths.tolist() if spec.lengths is not None else [], strict=True):
            self.base[word] = n if spec.ids is None else value(spec.ids[at : at + n].tolist())
            at += n
        self.visible = _visible()
        self.ranked = self._ranked(spec.ranks) if self.alike else None
        self.known = _Pieces(self.base, {}, lambda p: value(self.piece(p)))

    @staticmethod
    def _ranked(ranks):
        try:
            import tiktoken
        except ImportError:
            return None
        # the split leaves a pre-token whole, as it matches anything
        return tiktoken.Encoding("ranks", pat_str=r"(?s:.)+", mergeable_ranks=dict(ranks), special_tokens={}) if ranks else None

    @property
    def tok(self):
        if self._tok is None:
            self._tok = load(self.path)
        return self._tok

    def whole(self, text: str):
        return self.value(self.tok.encode(text, add_special_tokens=False).ids)

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-token: by ranks where the file's merges are ranks, else by the library's merge model."""
        if self.ranked:
            return self.ranked.encode_ordinary(text)
        return [t.id for t in self.tok.model.tokenize(text.encode().decode("latin-1").translate(self.visible))]

    def strange(self, text: str) -> bool:
        """Whether the library itself must see the text."""
        return is_odd(text) or bool(self.special and self.special.search(text))

    def each(self, texts: Iterable[str], join: Callable):
        """join(stored values) for each text. The cache is looked after between runs of about 1 MB of text."""
        run: list[str] = []
        size = 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size > 1_000_000:
                yield from self._run(run, join)
                run, size = [], 0
        yield from self._run(run, join)

    def _run(self, texts: list[str], join: Callable):
        if len(self.known) > len(self.base) + CACHE_ENTRIES:
            # what was met lately stays within reach for another generation
            before = dict(self.known)
            self.known = _Pieces(self.base, before, self.known.make)
        for text in texts:
            yield join(self._values(text))

    def _values(self, text: str):
        """What is stored for each piece; of stretches with odd characters or special strings, for the stretch as a whole."""
        if not self.alike:
            return [self.whole(text)]
        if not self.strange(text):
            return map(self.known.__getitem__, split(text))
        out: list = []
        plain: list[str] = []
        for stretch in [*_CUT.split(text), None]:
            if stretch is not None and not self.strange(stretch):
                plain.append(stretch)
                continue
            out += map(self.known.__getitem__, split("".join(plain)))
            plain.clear()
            if stretch is not None:
                out.append(self.whole(stretch))
        return out


def encoder(spec: Spec, kind: str, value: Callable) -> PieceEncoder:
    """The worker's encoder; kept between tasks, as Spark reuses Python workers."""
    return worker_cache("pretokens", (spec.path, kind), lambda: PieceEncoder(spec, value))
