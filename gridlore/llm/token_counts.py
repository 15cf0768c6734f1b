"""Token counts without a pre-token shuffle."""

from __future__ import annotations

from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table, text_of, worker
from .pretokens import CACHE_KEY_CHARS, Spec, encoder, is_odd, load, split


#: Entries of the table of frequent pre-tokens, and about how many rows they are counted in.
FREQUENT, SAMPLE_ROWS = 50_000, 2_000


def frequent_pieces(docs: DataFrame, spec: Spec, text_col: str = "text", entries: int = FREQUENT, rows: int = SAMPLE_ROWS) -> Spec:
    """spec with the entries most frequent pre-tokens of docs, counted in a sample of about rows rows, and their lengths in tokens as the library gives them.

    The table decides how fast a text is counted, never what comes out, so a sample does. Each task counts its own rows and hands on no more than entries
    pre-tokens: nothing of the corpus beyond the sample is shuffled. The table is sent as two arrays.
    """
    if not spec.alike:
        return spec
    n = docs.count()
    some = docs.select(text_of(text_col).alias("text"))
    some = some.sample(fraction=rows / n, seed=7) if n > rows else some

    @worker("pretokens")
    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                text = t.as_py()
                if not is_odd(text):
                    seen.update(p for p in split(text) if len(p) <= CACHE_KEY_CHARS)
                if len(seen) > 4 * entries:
                    seen = Counter(dict(seen.most_common(entries)))
        best = seen.most_common(entries)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best]), pa.array([k for _, k in best], pa.int64())], ["piece", "n"])

    best = some.mapInArrow(count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(entries).toArrow()
    words = [w for w in best.column("piece").to_pylist() if not any(x and x in w for x in spec.special)]
    lengths = np.array([len(e.ids) for e in load(spec.path).encode_batch(words, add_special_tokens=False)], np.uint16)
    return replace(spec, frequent=pa.array(words, pa.string()), ids=None, lengths=lengths)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit for each row of docs; one map pass, no shuffle.

    The lengths of the corpus's frequent pre-tokens are looked up in a broadcast table of FREQUENT entries (see frequent_pieces); other pre-tokens are encoded once per
    worker and their lengths kept in a cache of bounded size. Only stretches between spaces that hold a character whose class depends on the
    library's Unicode tables, or a special token's string, go to the library as they are.

    Null or empty text: 0 bytes, 0 tokens. Null ids and repeated rows: one result each. An empty table gives an empty
    result. Other columns are not carried over, so their names can't clash.
    """
    spec = bounded_batches(docs.sparkSession).sparkContext.broadcast(frequent_pieces(docs, Spec.of(tokenizer_path, 0), text_col))

    @worker("pretokens")
    def count(batches):
        enc = encoder(spec.value, "length", len)
        for b in batches:
            n = list(enc.each((t.as_py() for t in b.column(2)), sum))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
