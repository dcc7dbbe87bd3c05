"""What the operators of this package share: tables, the shared folder, digests, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that separates words of letters and digits, after A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_local_folder: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only where none is named."""
    global _local_folder
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if named := spark.sparkContext.getCheckpointDir():
        return named.rstrip("/")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="quern-")
    return f"file://{_local_folder}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/quern/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that stored() made and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; lower() would also change other letters."""
    return F.translate(text, UPPER, LOWER)


def plain_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, as an array; null gives none.

    split() is one linear pass. Empty strings occur only before the first and after the last separator.
    """
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def text_key(text: Column) -> Column:
    """A 128-bit digest of a text, to tell rows with one doc_id apart; null has its own."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), F.length(text), text).alias("b"))


#: Edges that a task reduces to a forest at a time, or labels if there are no more.
FOREST_EDGES = 200_000


def _forest(batches):
    """Of the edges that a task reads, a block at a time, those that connect something."""
    import pyarrow as pa

    parent: dict[int, int] = {}
    seen = 0

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for batch in batches:
        a, b = [], []
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (seen := seen + 1) % (4 * FOREST_EDGES) == 0:
                parent.clear()  # a full block: the next one is reduced on its own
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _labels(batches):
    """Components of all edges that a task reads: (node, component)."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
    nodes = sorted(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) longs: (node, component) with the smallest node reachable.

    Alternating large-star and small-star steps, each two aggregations and a join over edges; a
    star's centre is never gathered into one list, so a hot node costs rows, not memory. Every round
    is written to the shared folder. Rounds grow with the logarithm of the longest path; the limit
    only guards against an endless loop and raises. First, tasks drop the edges within what their
    block of about FOREST_EDGES connects already: of many links in a dense group about one a node stays.
    Edges that are one block are labelled by one task.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    blocks = -(-current.count() // FOREST_EDGES)
    if blocks <= 1:  # one block is one task's work: its labels are final
        return stored(current.coalesce(1).mapInArrow(_labels, "node long, component long"), "labels")
    current = stored(current.repartition(blocks).mapInArrow(_forest, "a long, b long"), "forest")
    state = None
    for _ in range(rounds):
        around = both(current)
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: every node points to the smallest of its smaller neighbours, and so do those neighbours
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        following = stored(small.where("a <> b").distinct(), "edges")
        now = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(current) if current.inputFiles() else None
        current = following
        if now == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now
    raise RuntimeError("components did not settle")
