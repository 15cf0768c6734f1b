"""Keyword, file, row, vector and hybrid retrieval of chunks for one question or a batch, within a budget of characters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridlore.functions.filters import contains_any
from gridlore.functions.intents import intent
from gridlore.functions.texts import BETWEEN_SOURCES, DOC_PREFIX, FALLBACK_TEXT, FALLBACK_URL, MAX_TERMS, holding_lines, last_row_line, location, query_terms, row_lines, source_text
from gridlore.shared import written

from .tables import in_scope

KEYWORD_TOP_K, SEMANTIC_TOP_K, TARGETED = 20, 12, 5
TOTAL_BUDGET, WEB_SHARE, WEB_CHARS, MIN_USEFUL = 14_000, 0.4, 2000, 200
#: Questions that one pass over the chunks takes; batches of more take several passes, so a broadcast never grows.
QUESTIONS_PER_PASS = 4_096
#: Positions whose lengths are summed as one when documents are fitted to a budget.
BLOCK_ITEMS = 1_024


def with_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunks with their documents' filename and status; Spark broadcasts documents only while they are small."""
    return chunks.join(documents.select("document_id", "filename", "status"), "document_id")


def _first(df: DataFrame, k: int, last: bool = False) -> DataFrame:
    return df.orderBy(F.desc("chunk_index") if last else F.asc("chunk_index"), "chunk_id").limit(k)


def keyword_search(chunks: DataFrame, documents: DataFrame, question: str, k: int = KEYWORD_TOP_K, ids: Sequence[str] | None = None) -> DataFrame:
    """Chunks in scope that hold any of the question's terms, in order of chunk."""
    terms = query_terms(F.lit(question))
    return _first(in_scope(with_documents(chunks, documents), ids).where(F.exists(terms, lambda t: F.contains(F.lower("content"), t))), k)


def term_search(chunks: DataFrame, documents: DataFrame, terms: Sequence[str], k: int = TARGETED, ids: Sequence[str] | None = None) -> DataFrame:
    return _first(in_scope(with_documents(chunks, documents), ids).where(contains_any(F.col("content"), terms)), k)


def files_named(documents: DataFrame, name: str) -> DataFrame:
    """Documents, or chunks with their documents, whose file name holds the text, whatever its case."""
    return documents.where(F.lower("filename").contains(name.lower()))


def first_chunks(chunks: DataFrame, k: int) -> DataFrame:
    return _first(chunks, k)


def file_search(chunks: DataFrame, documents: DataFrame, name: str, k: int = KEYWORD_TOP_K, ids: Sequence[str] | None = None, last: bool = False) -> DataFrame:
    """Chunks of files whose name holds the text, the first or the last ones."""
    return _first(files_named(in_scope(with_documents(chunks, documents), ids), name), k, last)


def _passes(questions: DataFrame, per_pass: int) -> list[DataFrame]:
    """questions in parts of about per_pass rows, small enough to be broadcast."""
    n = max(1, math.ceil(questions.count() / per_pass))
    return [questions] if n == 1 else [questions.where(F.pmod(F.xxhash64(*questions.columns[:1]), F.lit(n)) == i) for i in range(n)]


def first_holding(chunks: DataFrame, text: Column, wanted: DataFrame, k: int) -> DataFrame:
    """question_id, chunk_id, chunk_index: for each of wanted (question_id, pattern) chunks whose text holds the pattern, the first k of each pattern among them.

    All patterns are looked for at once: a task runs through its texts with one automaton (Aho-Corasick) and keeps k chunks a pattern, so the
    chunks never move and what is shuffled is patterns times k rows a task. wanted is one pass's part of the questions, so the patterns are few.
    """
    spark, kind = chunks.sparkSession, chunks.schema["chunk_index"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(sorted(r["pattern"] for r in wanted.where("pattern is not null").select("pattern").distinct().collect()))

    def find(batches):
        patterns = sent.value
        automaton = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            if p:
                automaton.add_word(p, i)
        automaton.make_automaton()
        always = [i for i, p in enumerate(patterns) if not p]
        best: list[list[tuple]] = [[] for _ in patterns]
        for b in batches:
            for chunk, at, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if not t.is_valid:
                    continue
                for i in {i for _, i in automaton.iter(t.as_py())}.union(always) if len(automaton) else always:
                    best[i].append((at, chunk))
                    if len(best[i]) >= 2 * k + 8:
                        best[i] = sorted(best[i])[:k]
        rows = [(patterns[i], chunk, at) for i, found in enumerate(best) for at, chunk in sorted(found)[:k]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32() if kind == "int" else pa.int64()), strict=True)], ["pattern", "chunk_id", "chunk_index"])

    hits = chunks.select(F.col("chunk_id").cast("string"), "chunk_index", text.alias("text")).mapInArrow(find, f"pattern string, chunk_id string, chunk_index {kind}")
    return wanted.join(hits, "pattern").select("question_id", "chunk_id", "chunk_index").distinct()


def keyword_search_batch(chunks: DataFrame, questions: DataFrame, k: int = KEYWORD_TOP_K, per_pass: int = QUESTIONS_PER_PASS) -> DataFrame:
    """question_id, chunk_id, rank: for each of questions (question_id, query) its first k chunks with one of its terms.

    The chunks are read once for each part of the questions and never moved (see first_holding).
    """
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("chunk_index", "chunk_id"))
    out = None
    for part in _passes(questions.select("question_id", F.explode(query_terms(F.col("query"))).alias("pattern")), per_pass * MAX_TERMS):
        found = first_holding(chunks, F.lower("content"), part, k)
        found = found.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "chunk_id", "rank")
        out = found if out is None else out.unionByName(found)
    return out


#: Vectors that a task multiplies with all questions of a pass at once.
VECTOR_BLOCK = 4_096
#: Block products may differ from exact dot products by this much at most (unit vectors): what they leave is scored again.
SLACK = 1e-9


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column as rows of length one (zeros stay), and the places of those that are there and have no null entry."""
    whole = not column.null_count and not column.flatten().null_count
    ok = np.ones(len(column), bool) if whole else np.array([v.is_valid and not v.values.null_count for v in column], bool)
    kept = column if whole else column.filter(pa.array(ok))
    sizes = pc.min_max(pc.list_value_length(kept)).as_py()
    if sizes["min"] != sizes["max"]:
        raise ValueError(f"vectors of {sizes['min']} to {sizes['max']} entries")
    m = kept.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(kept), -1)
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(norms > 0, norms, 1)[:, None], np.flatnonzero(ok)


class Best:
    """For each of n questions the k best vectors so far by (score, id): arrays of question, score and id that hold n * k entries after each block."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.q, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)

    def add(self, rows: np.ndarray, ids: np.ndarray, questions: np.ndarray) -> None:
        """Block products choose; what may be among the best is scored by itself, so that equal vectors score alike wherever they stand."""
        near = rows @ questions.T
        if len(rows) > self.k:
            self.least = np.maximum(self.least, np.partition(near, len(rows) - self.k, axis=0)[len(rows) - self.k])
        at, q = np.nonzero(near >= self.least - SLACK)
        score = np.einsum("ij,ij->i", rows[at], questions[q])
        q, score, ids = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids[at].astype(object)])
        place = np.unique(ids, return_inverse=True)[1] if len(ids) else np.zeros(0, np.int64)
        order = np.lexsort((place, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        starts = np.searchsorted(q, q)  # where each one's question begins
        kept = np.arange(len(q)) - starts < self.k
        self.q, self.score, self.ids = q[kept], score[kept], ids[kept]
        full = np.flatnonzero(np.arange(len(self.q)) - np.searchsorted(self.q, self.q) == self.k - 1)
        self.least[self.q[full]] = np.maximum(self.least[self.q[full]], self.score[full])


def semantic_search(vectors: DataFrame, questions: DataFrame, k: int, scope: Column | None = None, per_pass: int = 256, key: str = "vec_id", whole: bool = False) -> DataFrame:
    """question_id, key, score, rank: the k vectors of highest cosine for each of questions (question_id, vector).

    scope filters vectors before anything is ranked, so a search never leaves it. Exact: vectors stay in place, the questions of a pass (per_pass
    of them, whatever their number in all) go to all tasks, and a task multiplies blocks of vectors with them and keeps k rows a question. Ranked
    by the whole score, shown with six places unless whole asks for all of it; ties follow key. A zero vector scores 0. Vectors and questions that are null or hold a null
    find nothing and are not found; unlike lengths are an error.
    """
    rows = (vectors if scope is None else vectors.where(scope)).select(key, "embedding")
    id_type, q_type = rows.schema[key].dataType, questions.schema["question_id"].dataType
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), key))
    out = None
    for part in _passes(questions.select("question_id", "vector"), per_pass):
        asked = part.toArrow().combine_chunks()
        column = asked.column("vector").combine_chunks()
        unit, at = unit_rows(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column) if asked.num_rows else (np.zeros((0, 0)), np.zeros(0, np.int64))
        sent = rows.sparkSession.sparkContext.broadcast((unit, asked.column("question_id").take(pa.array(at)).to_pylist()))
        kinds = [to_arrow_type(q_type), to_arrow_type(id_type), pa.float64()]

        def find(batches, sent=sent, kinds=kinds):
            questions_, names = sent.value
            best = Best(len(names), k)
            for b in batches:
                for start in range(0, b.num_rows if names else 0, VECTOR_BLOCK):
                    block = b.slice(start, VECTOR_BLOCK)
                    m, ok = unit_rows(block.column(1))
                    if len(ok):
                        best.add(m, block.column(0).take(pa.array(ok)).to_numpy(zero_copy_only=False), questions_)
            if len(best.q):
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in best.q], kinds[0]), pa.array(best.ids.tolist(), kinds[1]), pa.array(best.score)], ["question_id", key, "score"])

        scored = rows.mapInArrow(find, f"question_id {q_type.simpleString()}, {key} {id_type.simpleString()}, score double")
        found = scored.withColumn("rank", rank).where(F.col("rank") <= k)
        found = found if whole else found.withColumn("score", F.round("score", 6))
        out = found if out is None else out.unionByName(found)
    return out


def merged(branches: Sequence[DataFrame], key: str = "chunk_id", by: Sequence[str] = (), order: Sequence[str] = ("pos",)) -> DataFrame:
    """Branches in order as one list: of rows with the same key the first branch's stays."""
    parts = [b.withColumn("branch", F.lit(i)) for i, b in enumerate(branches)]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    w = Window.partitionBy(*by, key).orderBy("branch", *order)
    return all_.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def hybrid_search(chunks: DataFrame, documents: DataFrame, questions: DataFrame, semantic: DataFrame | None = None, keyword_k: int = KEYWORD_TOP_K, exact: bool = False, per_pass: int = QUESTIONS_PER_PASS, vectors: DataFrame | None = None, semantic_k: int = SEMANTIC_TOP_K, with_branch: bool = False) -> DataFrame:
    """question_id, pos, chunk_id, url, text (with_branch: and the branch that found it) for each of questions (question_id, query), best first.

    Branches in order: column=value (at most 5), file name (1 when the last is asked for, else keyword_k), row number (at most 5),
    semantic, keywords. The semantic branch is the semantic_k chunks of ready documents whose vectors (chunk_id, embedding) are nearest to a question's own
    (column vector of questions, null for none), or is given as semantic (question_id, chunk_id, rank). A hit by column=value or row, or a question for the last of a
    file, switches the last two off. With such a hit only chunks that hold the marker stay, cut to their matching lines.
    A chunk is listed once, under its first branch. exact: a value ends at ', ' or the line's end, so Index=1 is not Index=10.
    """
    base = with_documents(chunks.select("chunk_id", "document_id", "chunk_index", "content", "meta"), documents).where("status = 'ready'")
    outs = []
    if vectors is not None:
        found = vectors.join(base.select("chunk_id"), "chunk_id", "left_semi")
        semantic = semantic_search(found, questions.where("vector is not null").select("question_id", "vector"), semantic_k, key="chunk_id")
    for part in _passes(questions.select("question_id", "query"), per_pass):
        asked = part.withColumn("i", intent(F.col("query"))).select("question_id", query_terms(F.col("query")).alias("terms"), "i.row_intent", "i.column_value", F.col("i.filename").alias("asked_file"), "i.wants_last")
        marker = F.concat(F.col("column_value.column_name"), F.lit("="), F.col("column_value.value"))
        asked = asked.withColumns({"marker": marker, "row_no": F.col("row_intent.row_number")})
        q = F.broadcast(asked)
        content, low = F.col("content"), F.lower("content")
        value_hit = F.contains(low, F.lower("marker"))
        if exact:
            value_hit = value_hit & F.exists(F.split(low, r", |\n|: "), lambda x: x == F.lower("marker"))

        def ranked(found: DataFrame, k: Column | int, last: Column | None = None) -> DataFrame:
            order = [F.asc("chunk_index")] if last is None else [F.when(last, -F.col("chunk_index")).otherwise(F.col("chunk_index"))]
            r = F.row_number().over(Window.partitionBy("question_id").orderBy(*order, "chunk_id"))
            return found.withColumn("pos", r).where(F.col("pos") <= k).select("question_id", "chunk_id", "pos")

        wanted = lambda c: asked.select("question_id", c.alias("pattern"))
        by_value = ranked(base.join(q, value_hit) if exact else first_holding(base, low, wanted(F.lower("marker")), TARGETED), TARGETED)
        files = documents.where("status = 'ready'").select("document_id", "filename").join(q, F.contains(F.lower("filename"), F.lower("asked_file"))).select("question_id", "wants_last", "document_id")
        by_file = ranked(files.join(chunks.select("document_id", "chunk_id", "chunk_index"), "document_id"), F.when(F.col("wants_last"), 1).otherwise(keyword_k), F.col("wants_last"))
        by_row = ranked(first_holding(base, content, wanted(F.concat(F.lit("Row "), F.col("row_no").cast("string"))), TARGETED), TARGETED)
        by_word = ranked(first_holding(base, low, wanted(F.explode("terms")), keyword_k), keyword_k)
        # a semantic list belongs to all passes: only this part's questions are taken from it
        near = semantic.join(part.select("question_id"), "question_id", "left_semi").select("question_id", "chunk_id", F.col("rank").alias("pos")) if semantic is not None else None
        branches = [by_value, by_file, by_row, *([near] if near is not None else []), by_word]
        names = ["value", "file", "row", *(["semantic"] if near is not None else []), "keyword"]
        listed = merged(branches, by=["question_id"]).join(q, "question_id")
        w = Window.partitionBy("question_id")
        hits = F.max(F.col("branch").isin(0, 2).cast("int")).over(w) == 1
        precise = (hits & (F.col("column_value").isNotNull() | F.col("row_intent").isNotNull())) | (F.col("wants_last") & F.col("asked_file").isNotNull())
        listed = listed.withColumns({"hits": hits, "precise": precise}).where(~F.col("precise") | (F.col("branch") <= 2))
        full = listed.join(base, "chunk_id")
        of_value, of_row = F.col("column_value").isNotNull(), F.col("row_intent").isNotNull()
        row_text = F.concat(F.lit("Row "), F.col("row_no").cast("string"))
        held = F.when(of_value, F.coalesce(F.contains(low, F.lower("marker")), F.lit(False))).when(of_row, F.contains(content, row_text)).otherwise(True)
        strict = F.when(of_value, F.coalesce(F.contains(low, F.lower("marker")), F.lit(False))).when(of_row, F.contains(content, F.concat(row_text, F.lit(":")))).otherwise(True)
        full = full.where(~F.col("hits") | strict)
        shown = (
            F.when(F.col("hits") & of_value, holding_lines(content, F.col("marker"))).when(F.col("hits") & ~of_value & of_row, row_lines(content, F.col("row_no")))
            .when(F.col("wants_last") & F.col("asked_file").isNotNull() & ~of_value & ~of_row, last_row_line(content)).otherwise(content)
        )
        place = location(F.col("meta.page"), F.col("meta.sheet"), F.col("meta.row_start"), F.col("meta.row_end"))
        at = F.row_number().over(w.orderBy((F.col("branch") > 2).cast("int"), (~held).cast("int"), "branch", F.col("pos"), "chunk_id"))
        outs.append(full.select(
            "question_id", at.alias("pos"), "chunk_id", F.concat(F.lit(DOC_PREFIX), "document_id").alias("url"),
            F.concat(F.lit("["), F.coalesce("filename", F.lit("")), F.lit("] "), place, F.lit("\n"), shown).alias("text"),
            *([F.element_at(F.array(*[F.lit(n) for n in names]), F.col("branch") + 1).alias("branch")] if with_branch else []),
        ))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def merged_top(lists: Sequence[DataFrame], k: int, key: str = "vec_id") -> DataFrame:
    """Ranked lists (question_id, key, score, rank) of several scopes as one: of a key the best score stays, and the k best of a question.

    Scores must be whole ones (see semantic_search), as rounded ones tie where the vectors don't; they are shown with six places.
    """
    all_ = lists[0]
    for one in lists[1:]:
        all_ = all_.unionByName(one)
    best = all_.groupBy("question_id", key).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), key))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", F.round("score", 6))


def fit_documents(items: DataFrame, budget: Column, keys: Sequence[str] = ("question_id",), doc_chars: int = 0, most: int = TOTAL_BUDGET, block: int = BLOCK_ITEMS) -> DataFrame:
    """items (keys, pos, text) in order up to budget characters: the crossing one is cut, and under 200 left nothing more is taken.

    budget is the same for all items of a key and at most most. Lengths are summed by blocks of block positions; a key's blocks are summed up in order until the budget is
    used, of which each task keeps no more than could matter (most blocks that hold a character); the items of those blocks alone go on, with
    the characters before their block. Keys must not be null.
    """
    text = F.substring("text", 1, doc_chars) if doc_chars else F.col("text")
    cut = items.withColumns({"text": text, "__budget": budget, "__block": F.floor(F.col("pos") / block)})
    sums = cut.groupBy(*keys, "__block").agg(F.sum(F.length("text")).alias("n"), F.max("__budget").alias("__most")).where("n > 0")
    order = Window.partitionBy(*keys).orderBy("__block")
    sums = sums.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most).withColumn("__after", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.where(F.col("__after") - F.col("n") <= F.col("__most") - MIN_USEFUL)
    last = sums.groupBy(*keys).agg(F.min(F.when(F.col("__after") > F.col("__most") - MIN_USEFUL, F.col("__block"))).alias("__last"), F.array_sort(F.collect_list(F.struct("__block", "n"))).alias("__sums"))
    last = written(last, "last")  # a row a key: where that is small, Spark knows it and sends it to the texts, which stay where they are
    within = cut.join(last, list(keys), "left").where("__last is null or __block <= __last")
    before = F.aggregate(F.filter(F.coalesce("__sums", F.array().cast("array<struct<__block:bigint,n:bigint>>")), lambda x: x["__block"] < F.col("__block")), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    inside = F.sum(F.length("text")).over(Window.partitionBy(*keys, "__block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    left = within.withColumn("__before", before).withColumn("left", F.col("__budget") - F.col("__before") - F.coalesce(inside, F.lit(0))).where(F.col("left") >= MIN_USEFUL)
    return left.withColumn("text", F.substring(F.col("text"), F.lit(1), F.least(F.length("text"), F.col("left").cast("int")))).select(*items.columns)


def fit_web(items: DataFrame, budget: int, keys: Sequence[str] = ("question_id",), web_chars: int = WEB_CHARS) -> DataFrame:
    """items (keys, pos, url, text; a pos once): each cut to web_chars and taken if it still fits, else left out; the items taken, with used, the characters of all of them.

    Taking one depends on all before it, but room only shrinks: of items of one length those taken come first, and no more of them than fit. So a key has at most
    budget / 1 + budget / 2 + ... candidates, whatever its items; these are folded in order as pairs of position and length, and texts
    stay where they are. Empty items are always taken. Keys must not be null.
    """
    cut = items.withColumn("text", F.substring("text", 1, web_chars)) if web_chars else items
    size = F.length("text")
    rank = F.row_number().over(Window.partitionBy(*keys, "size").orderBy("pos"))
    some = cut.where(size.between(1, budget)).select(*keys, "pos", size.alias("size")).withColumn("__rank", rank).where(F.col("__rank") <= F.floor(F.lit(budget) / F.col("size")))
    pos = items.schema["pos"].dataType.simpleString()
    empty = F.struct(F.array().cast(f"array<{pos}>").alias("taken"), F.lit(0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(acc["used"] + x["size"] <= budget, F.struct(F.concat(acc["taken"], F.array(x["pos"])).alias("taken"), (acc["used"] + x["size"]).cast("int").alias("used"))).otherwise(acc)

    folded = some.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("pos", "size"))), empty, step).alias("f"))
    joined = cut.join(folded, list(keys), "left").where((size == 0) | F.array_contains("f.taken", F.col("pos")))
    return joined.select(*items.columns, F.coalesce("f.used", F.lit(0)).alias("used"))


def allocate_budget(web: DataFrame, docs: DataFrame, total: int = TOTAL_BUDGET, share: float = WEB_SHARE, web_chars: int = WEB_CHARS) -> DataFrame:
    """question_id, source (0 web, 1 document), pos, url, text: web items within their share, then documents within the rest."""
    taken = fit_web(web, int(total * share), web_chars=web_chars)
    used = taken.groupBy("question_id").agg(F.max("used").alias("used"))
    rest = docs.join(used, "question_id", "left").withColumn("budget", F.lit(total) - F.coalesce("used", F.lit(0)))
    fitted = fit_documents(rest, F.col("budget"), most=total).select("question_id", F.lit(1).alias("source"), F.col("pos").cast("int"), "url", "text")
    return taken.select("question_id", F.lit(0).alias("source"), F.col("pos").cast("int"), "url", "text").unionByName(fitted)


def context_digests(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, context_md5: MD5 of the context text of all items (keys, pos, url, text) of a key, null if none has a url and a text.

    MD5 goes through a text from its first byte to its last, so one task reads a key's rows, but as a sorted stream: it holds a batch of
    rows and one running digest, never the context.
    """
    rows = items.select(*[F.col(k).cast("string").alias(k) for k in keys], "pos", "text", source_text(F.col("url"), F.col("text")).alias("source_text"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "pos", "text").select(*keys, "source_text")
    names = [*keys, "context_md5"]

    def digest(batches):
        key, md5, out = None, None, []

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names)

        def close():
            if key is not None:
                out.append((*key, md5 and md5.hexdigest()))

        for b in batches:
            for *at, text in zip(*(b.column(c) for c in (*keys, "source_text")), strict=True):
                at = [x.as_py() for x in at]
                if at != key:
                    close()
                    key, md5 = at, None
                if text.is_valid:
                    if md5 is None:
                        md5 = hashlib.md5(usedforsecurity=False)
                    else:
                        md5.update(BETWEEN_SOURCES.encode())
                    md5.update(text.as_buffer())
            if out:
                yield made()
                out.clear()
        close()
        if out:
            yield made()

    return rows.mapInArrow(digest, ", ".join(f"{c} string" for c in names))


def answer_mode(prefer: Column, include_web: Column, online: Column, archived: Column, documents: Column) -> Column:
    """ONLINE, OFFLINE_ARCHIVE or LOCAL_WEIGHTS from a preference and the numbers of sources found."""
    offline = F.coalesce(prefer == "OFFLINE", F.lit(False))
    web = (
        F.when(offline, F.when(archived > 0, "OFFLINE_ARCHIVE")).when(include_web & (online > 0), "ONLINE")
        .when(include_web & ~F.coalesce(prefer == "ONLINE", F.lit(False)) & (archived > 0), "OFFLINE_ARCHIVE")
    )
    found = F.coalesce(web, F.lit("LOCAL_WEIGHTS"))
    with_docs = F.when((documents > 0) & (~include_web | (found == "LOCAL_WEIGHTS")), "OFFLINE_ARCHIVE").otherwise(found)
    nothing = web.isNull() & (documents == 0)
    return F.when(nothing, F.when(offline, "OFFLINE_ARCHIVE").otherwise("LOCAL_WEIGHTS")).otherwise(with_docs)


def with_fallback(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Contexts of every question; one without any gets the fallback row."""
    joined = questions.select("question_id").join(contexts, "question_id", "left")
    return joined.withColumns({"url": F.coalesce("url", F.lit(FALLBACK_URL)), "text": F.coalesce("text", F.lit(FALLBACK_TEXT))})
