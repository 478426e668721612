"""What the operators share: scratch tables, sizes, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z to a-z, other bytes as they are.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: White space of the word rules: space and \x09-\x0D.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    if root := context.getConf().get("spark.checkpoint.dir"):
        return root.rstrip("/")
    if root := context.getCheckpointDir():
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quintet-"))
    return context.getCheckpointDir().rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors.

    With ``release`` the shuffles that led to ``df`` are deleted now rather than some time later: Spark does so when the driver has
    collected their plan, which it holds until another query has run.
    """
    spark, path = df.sparkSession, new_dir(df.sparkSession, tag)
    df.write.parquet(path)
    if release:
        spark.range(1).write.format("noop").mode("overwrite").save()
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def by_bytes(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many bytes, or of one row, as views of those that Spark sends (which it bounds itself, to 64 MB or a row)."""
    for b in batches:
        if b.nbytes <= most or b.num_rows <= 1:
            yield b
        else:
            half = b.num_rows // 2
            yield from by_bytes(iter((b.slice(0, half), b.slice(half))), most)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, for a file scan the size of the files; where it has none, the bytes of the texts."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 60:
        return size
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return int(df.agg(F.sum(sum(texts, F.lit(0)))).first()[0] or 0)


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """A number of partitions that grows with the input, at least the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1_000_000, -(-input_bytes(df) // bytes_each)))


def drop_dir(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; component is the smallest node reachable.

    Alternating large-star and small-star rounds. A node's smallest neighbour
    is an aggregate with a map-side part; it is written out, so the join that
    hands it to the node's edges has a shuffle of its own, whose hot keys
    Spark can split, or none: a hub's edges are never gathered. Each round is
    written to the shared folder; rounds are about the logarithm of the
    longest path. Null ends and self loops are ignored.
    """
    spark = edges.sparkSession
    kind = edges.schema["u"].dataType
    path = new_dir(spark, "cc")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(T.StructType([T.StructField(c, kind) for c in df.columns])).parquet(f"{path}/{name}")

    def put(df: DataFrame, k: int) -> tuple[DataFrame, tuple]:
        back = kept(df, str(k))
        mark = back.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return back, tuple(mark)

    start = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = put(start, 0)
    for k in range(1, max_rounds + 1):
        if not mark[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{k}-around")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = kept(large, f"{k}-large")
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), f"{k}-below")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, said = put(small.union(least.select("u", F.col("m").alias("v"))).distinct(), k)
        for old in (f"{k - 1}", f"{k}-around", f"{k}-large", f"{k}-below"):
            drop_dir(spark, f"{path}/{old}")
        now, done, mark = after, said == mark, said
        if done:
            break
    else:
        raise RuntimeError("connected components did not converge")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def store(uri: str):
    """``(filesystem, path)`` of pyarrow for a folder or file of the shared store, on driver or executor."""
    import re

    from pyarrow import fs

    uri = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def put_file(folder: str, name: str, content: bytes) -> str:
    """Write a file whole: under a name of this attempt, then renamed, so a retried task only replaces it."""
    system, path = store(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own, compression=None) as f:
        f.write(content)
    system.move(own, f"{path}/{name}")
    return f"{folder}/{name}"
