"""Tables in the folder that all executors share, and graph components on them."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and every copy survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leadspark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(path: str) -> None:
    spark = _written.pop(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads: everything made from them has been written."""
    for t in tables:
        _delete(t.stored_at)


def _clean() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is the cluster's scratch space
            return


def meet(many: DataFrame, one: DataFrame, keys: list[str], count: str, spread: list[str]) -> DataFrame:
    """many joined with one on keys, which are not null; one has a row for each and in `count` how many rows of many have it.

    Hot keys are dealt to several tasks: rows of many by the hash of `spread`, the row of one in as many copies. A key is
    hot from `limit` rows on, which grows so that at most a million keys can be hot: the broadcast table of hot keys is bounded.
    """
    top = one.agg(F.max(count).alias("top"), F.sum(count).alias("rows")).first()
    limit = max(1000, (top.rows or 0) // 1_000_000)
    if (top.top or 0) <= limit:
        return many.join(one.drop(count), keys)
    parts = F.ceil(F.col(count) / limit).cast("int")
    hot = one.where(F.col(count) > limit).select(*keys, parts.alias("_parts"))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    copies = one.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(count)
    return dealt.join(copies, [*keys, "_part"]).drop("_part")


def sift(many: DataFrame, one: DataFrame, key: str, most: int = 1 << 28) -> DataFrame:
    """many without most of the rows whose key is not in one: put before a join, so that few rows which meet nothing are shuffled.

    One bit for each hash of a key; the bitmap is broadcast and has 16 bits for each row of one, up to `most` (32 MB). It
    never drops a row that meets; more rows of one only let more rows pass. one is a table of materialize().
    """
    bits = min(most, 1 << max(20, (16 * one.count()).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    marks = one.select(at.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, 1)), 16, 10).cast("int")
    near = many.join(F.broadcast(marks), F.bitmap_bucket_number(at) == F.col("_bucket"))
    return near.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*many.columns)


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """df with `name`: 1, 2, ... in each group by order, which tells all rows of a group apart; null is a group like any other.

    Rows are dealt by ranges of group and order and written once, so a large group takes many tasks: a row's rank is the
    one inside its range plus the rows of its group in the ranges before, of which each range and group gives one number.
    """
    dealt = materialize(df.repartitionByRange(*groups, *order).withColumn("_in", F.struct(*groups, F.spark_partition_id().alias("_range"))), "ranges")
    sizes = dealt.groupBy("_in").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(F.col(f"_in.{g}") for g in groups)).orderBy("_in._range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("_in").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_in").orderBy(*order)))
    return rows.join(sizes, F.col("_in") == F.col("_at")).select(*df.columns, (F.col(name) + F.col("_before")).alias(name))


def components(edges: DataFrame, name: str = "components", few: int = 10_000) -> DataFrame:
    """(node, component) of an undirected graph with edges (a, b): component is the smallest node that can be reached.

    The graph is contracted: each node points to its smallest neighbour if that is smaller, the nodes pointed to are
    followed to the end of their pointers by doubling, and edges between the ends make the next graph, of half the nodes
    at most; stars are gone after one round, so only that one is as large as the input. Then labels go back through the
    rounds. Nodes and labels stay in Spark; the driver gets some counts per round. Minima combine before each shuffle, and
    a hub's edges and nodes meet their label in several tasks (graphs of at most `few` nodes need no such care). Tables of
    a round are deleted as soon as the next one is written.
    """
    graph = materialize(edges.where("a <> b").select("a", "b"), name)
    kept, empty = [], graph.select(F.col("a").alias("node"), F.col("a").alias("component")).where(F.lit(False))
    while graph.limit(1).count():
        sides = graph.union(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        held = materialize(sides.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to"), F.count("*").alias("degree")), name)
        large = held.count() > few
        join = meet if large else lambda many, one, keys, count, spread: many.join(one.drop(count), keys)
        hubs = materialize(held.groupBy("to").agg(F.count("*").alias("_n")).join(held.select(F.col("node").alias("to"), F.col("to").alias("up")), "to"), name)
        while True:
            above = hubs.select(F.col("to").alias("up"), F.col("up").alias("_up"))
            sizes = materialize(hubs.groupBy("up").agg(F.count("*").alias("_of")).join(above, "up"), name)
            new = materialize(join(hubs, sizes, ["up"], "_of", ["to"]).select("to", "_n", F.col("_up").alias("up"), (F.col("up") != F.col("_up")).alias("_moved")), name)
            discard(hubs, sizes)
            hubs = new
            if not hubs.where("_moved").limit(1).count():
                break
        root = materialize(join(held, hubs.select("to", "up", "_n"), ["to"], "_n", ["node"]).select("node", F.col("up").alias("root"), "degree"), name)
        discard(held, hubs)
        ends = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"), "degree")
        moved = join(join(graph, ends("a"), ["a"], "degree", ["b"]), ends("b"), ["b"], "degree", ["a"]).where("_a <> _b")
        new = materialize(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), name)
        discard(graph)
        graph = new
        kept.append(root)
    discard(graph)
    if not kept:
        return empty
    done = [*kept]
    out = kept.pop().select("node", F.col("root").alias("component"))
    while kept:
        root = kept.pop()
        sizes = root.groupBy("root").agg(F.count("*").alias("_n")).join(out.withColumnRenamed("node", "root"), "root", "left")
        sizes = materialize(sizes.select("root", "_n", F.coalesce("component", "root").alias("component")), name)
        done.append(sizes)
        out = meet(root, sizes, ["root"], "_n", ["node"]).select("node", "component")
    out = materialize(out, name)
    discard(*done)
    return out
