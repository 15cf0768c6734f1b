"""What the operators of this folder share: the shared folder, written tables, components, Bloom filters."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.shared import bounded_batches, release, shared_dir

_OWNER: list[str] = []
_CACHES: dict[str, dict] = {}


def worker_cache(owner: str, key, make):
    """What a Python worker keeps between tasks for one operator. Spark reuses workers, so when another operator's task
    comes, the one before gives its memory back, to the system too where the C library can."""
    claim(owner)
    held = _CACHES.setdefault(owner, {})
    if key not in held:
        held[key] = make()
    return held[key]


def claim(owner: str) -> None:
    """This worker now works for owner: caches of others go."""
    if _OWNER == [owner]:
        return
    for other in [o for o in _CACHES if o != owner]:
        del _CACHES[other]
    gc.collect()
    release()
    _OWNER[:] = [owner]


def worker(owner: str):
    """For functions over Arrow batches: the worker is owner's while it runs and gives free memory back when it ends."""

    def wrap(f):
        def run(batches):
            claim(owner)
            try:
                yield from f(batches)
            finally:
                release()

        return run

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Tables written there live as long as the caller keeps the folder; each run takes new names.
    """
    return f"{shared_dir(spark)}/gridlore/{name}-{uuid.uuid4().hex}"


def fresh(taken: list[str], name: str) -> str:
    """name, or name with underscores before it until no column of taken has it (Spark's names ignore case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later jobs read it and no lost executor makes them redo what lies before."""
    path = shared_path(bounded_batches(df.sparkSession), name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): node, component (its smallest node id).

    Alternating large-star and small-star rounds: each round is two grouped minima and two joins, the number of
    edges never grows, and hubs shrink because every neighbour is relinked to the minimum. Each round is written to
    the shared folder, so the plan stays short and a lost executor costs one round; so are the minima, as Spark can then split
    the join of a hub's edges with them. Self-loops and repeats are harmless;
    an empty input gives an empty result.
    """
    star = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc"
    )
    for _ in range(max_rounds):
        both = star.select("u", "v").unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc_low")
        large = star.unionAll(star.select(F.col("v"), F.col("u"))).join(low, "u").where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        following = written(small.select("e.u", "e.v").where("u <> v").distinct(), "cc")
        # done when every node hangs on a root: no node is both a child and a parent, and no child has two parents
        roots = following.select(F.col("v").alias("u")).distinct()
        open_ = following.join(roots, "u", "left_semi").limit(1).count()
        star = following
        if not open_ and not following.groupBy("u").count().where("count > 1").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
