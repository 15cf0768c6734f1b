"""Spelling variants: words one edit apart, found by scanning a sorted vocabulary with rows of a banded edit matrix."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_of, worker, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
NO_RUN = re.compile("[^A-Za-zÀ-ÿ]")
LOWER = {c: c + 32 for c in range(65, 91)}
#: A run is damaged where this divides the checksum of its document and itself.
DAMAGE = 199
MIN_LENGTH, MIN_COUNT, DOMINANCE = 6, 5, 5
#: Characters of a text that are cut into runs at once; distinct words that a task counts before it hands them on.
PIECE, ENTRIES = 1 << 20, 200_000
#: Words that one block lists at most; larger blocks are cut by one more character.
BLOCK = 20_000
FAR = 9


def runs_of(text: str, piece: int = PIECE) -> Iterator[Counter]:
    """The letter runs of a text, counted piece by piece; a piece ends where a run ends."""
    at = 0
    while at < len(text):
        end = at + piece
        if end < len(text):
            gap = NO_RUN.search(text, end)
            end = gap.start() if gap else len(text)
        yield Counter(RUN.findall(text[at:end]))
        at = end


def observed(prefix: int, run: str, damage: int = DAMAGE) -> str:
    """run in lower case (A-Z alone), less one letter where damage divides its checksum; prefix: the checksum of what stands before it."""
    run = run.lower() if run.isascii() else run.translate(LOWER)
    h = zlib.crc32(run.encode(), prefix)
    if h % damage:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """word, n: the words of at least min_length letters that occur min_count times or more in docs.

    Each task counts what it reads and sends a word once for ENTRIES distinct ones, so a frequent word is a few rows.
    """

    @worker("spelling")
    def count(batches):
        seen: Counter = Counter()

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                prefix = zlib.crc32(f"{i.as_py()}:".encode())
                for part in runs_of(text.as_py()):
                    for run, n in part.items():
                        if len(run) >= min_length:
                            word = observed(prefix, run, damage)
                            if len(word) >= min_length:
                                seen[word] += n
                    if len(seen) >= ENTRIES:
                        yield made()
        if seen:
            yield made()

    rows = docs.select(text_of(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def lcps(words: list[str]) -> list[int]:
    """Of each word of a sorted list with the one before it."""
    return [0, *(shared(a, b) for a, b in zip(words, words[1:], strict=False))]


def near(words: list[str], common: list[int], query: str) -> Iterator[int]:
    """Places in the sorted list words (common: its lcps) of those exactly one edit from query.

    Row j of the edit matrix holds the distances of a word's first j letters to query's first j - 1, j and j + 1, which is all of the
    band of one edit. A word starts from the rows of the prefix it shares with the word before. Where no entry of a row is under two,
    all words with that prefix are passed over at once.
    """
    rows, i, length = [(FAR, 0, 1)], 0, len(query)
    keep = 0
    while i < len(words):
        word = words[i]
        del rows[keep + 1 :]
        a, b, c = rows[-1]
        for j in range(keep, len(word)):
            ch = word[j]
            a = min(b + 1, a + (ch != query[j - 1]) if 0 < j <= length else FAR)
            b = min(b + (ch != query[j]) if j < length else FAR, a + 1, c + 1)
            c = min(c + (ch != query[j + 1]) if j + 1 < length else FAR, b + 1) if j + 2 <= length else FAR
            rows.append((a, b, c))
            if a > 1 and b > 1 and c > 1:
                after = bisect_left(words, word[: j + 1] + "\U0010ffff", i + 1)
                if after < len(words):
                    keep = common[after] if after == i + 1 else shared(word, words[after])
                i = after
                break
        else:
            if -1 <= length - len(word) <= 1 and rows[-1][1 + length - len(word)] == 1:
                yield i
            i += 1
            if i < len(words):
                keep = common[i]


def _reach(word: Column, prefix: Column) -> Column:
    """Whether a text that starts with prefix can be within one edit of word."""
    n = F.length(prefix)
    return F.greatest(*[(F.levenshtein(prefix, F.substring(word, F.lit(1), n + k), 1) >= 0).cast("int") for k in (-1, 0, 1)]) == 1


def blocks(vocab: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, salt, kind (0 listed, 1 asked), word, n: the words that each asked word must be compared with, in lists of at most block words.

    Of two words one edit apart, the first half of one (length div 2 letters) begins the other, or its last half ends it. So words meet
    by their first letters, and reversed by their last. A larger block is cut by one more letter, round by round; a word is
    asked in those parts only whose shared prefix is within one edit of it. Where many words are asked of one part, they are dealt out
    and its list goes with each share. A block's name is its way, the number of letters that it began with, and its prefix.
    """
    word, m = F.col("word"), F.length("word")
    halves = F.explode(F.array_distinct(F.array(F.floor((m - 1) / 2).cast("int"), F.floor(m / 2).cast("int"), F.floor((m + 1) / 2).cast("int"))))
    rows = vocab.select(F.explode(F.array(F.struct(F.lit("<").alias("way"), word.alias("word"), "n"), F.struct(F.lit(">").alias("way"), F.reverse(word).alias("word"), "n"))).alias("r")).select("r.*")
    rows = rows.select("way", "word", "n", halves.alias("h")).where("h <= length(word)")
    rows = rows.select(F.concat("way", F.col("h").cast("string"), F.lit(":"), F.substring("word", F.lit(1), F.col("h"))).alias("block"), "word", "n", (F.col("h") == F.floor(m / 2)).alias("asks"))
    large = written(rows.groupBy("block").count().where(F.col("count") > block).select("block"), "large")
    plain = rows if not large.limit(1).count() else rows.join(large, "block", "left_anti")
    out = plain.select("block", F.lit(0).alias("salt"), F.lit(0).alias("kind"), "word", "n").unionByName(plain.where("asks").select("block", F.lit(0).alias("salt"), F.lit(1).alias("kind"), "word", "n"))
    if plain is rows:
        return out
    hot = rows.join(large, "block", "left_semi")
    listed, asked = hot.select("block", "word", "n"), hot.where("asks").select("block", "word", "n")
    start, prefix = F.expr("substring(block, 1, instr(block, ':'))"), lambda c: F.expr(f"substring({c}, instr({c}, ':') + 1)")
    depth = F.length(prefix("block")) + 1
    part = F.concat(start, F.substring("word", F.lit(1), depth), F.when(F.length("word") < depth, "\n").otherwise(""))
    while True:
        listed = written(listed.select("block", part.alias("part"), "word", "n"), "listed")
        parts = listed.groupBy("block", "part").count()
        asked = asked.join(parts, "block").where(_reach(F.col("word"), F.rtrim(prefix("part"), F.lit("\n")))).select(F.col("part").alias("block"), "word", "n", F.col("count").alias("size"))
        asked = written(asked, "asked")
        ready = asked.where(F.col("size") <= block)
        salts = ready.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("salts"))
        lists = listed.drop("block").withColumnRenamed("part", "block").join(salts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "word", "n")
        dealt = ready.join(salts, "block").select("block", F.pmod(F.xxhash64("word"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "word", "n")
        out = out.unionByName(lists).unionByName(dealt)
        asked = asked.where(F.col("size") > block).select("block", "word", "n")
        if not asked.limit(1).count():
            return out
        listed = listed.drop("block").withColumnRenamed("part", "block").join(asked.select("block").distinct(), "block", "left_semi")


def near_words(vocab: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, near_n, near_word for each word of vocab (word, n; no word twice) with a word exactly one edit away: how many, and the most frequent (ties: the smallest)."""

    @worker("spelling")
    def scan(batches):
        at, words, counts, common, out = None, [], [], None, []

        def made():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["word", "n_near", "near_n", "near_word"])
            out.clear()
            return batch

        for b in batches:
            for block_, salt, kind, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (block_, salt) != at:
                    at, words, counts, common = (block_, salt), [], [], None
                if kind == 0:
                    words.append(word)
                    counts.append(n)
                    continue
                if common is None:
                    common = lcps(words)
                back = block_[0] == ">"
                own = word[::-1] if back else word
                found, best = 0, None
                for i in near(words, common, word):
                    other = words[i][::-1] if back else words[i]
                    if back and shared(own, other) >= len(own) // 2:
                        continue  # found forwards
                    found += 1
                    if best is None or (-counts[i], other) < best:
                        best = (-counts[i], other)
                if best:
                    out.append((own, found, -best[0], best[1]))
            if out:
                yield made()

    rows = blocks(vocab, block).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind", "word")
    found = rows.mapInArrow(scan, "word string, n_near long, near_n long, near_word string").groupBy("word")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near_word").alias("w")))
    return found.agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("near_n"), F.col("b.w").alias("near_word"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for each of forms (word, form): the last word that forms lead to. Each round doubles the steps that are jumped; forms grow in count, so there are no rings."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = written(jumped, "roots")
        at = jumped.select("word", "root")
        if not jumped.where("moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, dominance: int = DOMINANCE, damage: int = DAMAGE, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary of docs.

    A word's form is the most frequent word one edit away (ties: the smallest in code-point order), if that is dominance times as frequent;
    its root is the end of the forms that follow, itself if there are none.

    Null and empty texts have no words; a null id counts as an empty one; rows that repeat count each. An empty table, or one without
    frequent words, gives an empty result. Other columns are left out, so their names can't clash.
    """
    vocab = written(vocabulary(docs, id_col, text_col, min_length, min_count, damage), "vocabulary")
    has = F.col("near_n") >= dominance * F.col("n")
    every = vocab.join(near_words(vocab, block), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("near_word")).alias("form"), F.when(has, F.col("near_n")).alias("form_n"))
    every = written(every, "forms")
    return every.join(roots(every.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: The checksum is folded byte by byte over its table; words one edit apart share what is left when a letter goes.
OP11_SQL = r"""
with recursive t as (select list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
r as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) as run from documents),
g as (select doc_id, run, count(*) as n, hex(coalesce(doc_id::varchar, '') || ':' || run) as bytes from r where length(run) >= 6 group by 1, 2),
h as (select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(bytes) // 2), lambda i: ('0x' || bytes[2 * i + 1:2 * i + 2])::bigint)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) as h from g, t),
o as (select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from h),
v as (select word, sum(n)::bigint as n from o where length(word) >= 6 group by 1 having sum(n) >= 5),
d as (select word, n, unnest(range(1, length(word) + 1)) as i from v),
e as (select word, n, i, left(word, i::int - 1) || substr(word, i::int + 1) as less from d),
p as (select a.word, b.word as other, b.n from e a join e b on a.i = b.i and a.less = b.less and a.word <> b.word
  union select e.word, v.word, v.n from e join v on v.word = e.less union select v.word, e.word, e.n from e join v on v.word = e.less),
m as (select word, count(*) as n_near, max(n) as best, arg_min(other, (-n, other)) as other from p group by 1),
f as (select v.word, v.n, coalesce(m.n_near, 0) as n_near, case when best >= 5 * v.n then other end as form, case when best >= 5 * v.n then best end as form_n from v left join m using (word)),
w as (select word, word as at from f union all select w.word, f.form from w join f on f.word = w.at where f.form is not null),
z as (select w.word, w.at as root from w join f on f.word = w.at where f.form is null)
select word, form, root, n, n_near, form_n from f join z using (word)"""
