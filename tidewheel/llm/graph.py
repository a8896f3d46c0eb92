"""Connected components as DataFrame operations, and grouped batch processing."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Where the session names none, a temporary one
    serves a single machine, and a cluster is an error: its disks aren't shared."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not there:
        has = sc._jsc.sc().getCheckpointDir()
        if not has.isDefined() and not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = has.get() if has.isDefined() else tempfile.mkdtemp(prefix="tidewheel-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: later reads
    survive lost executors and never recompute it."""
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    # df holds its executed plan, and with it the shuffle files and tables that led here. Unless the
    # caller names it, it is unreachable now, and a collection on both sides lets them go.
    del df
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Gives back what the driver no longer needs: unreachable objects on both sides, and
    the memory that its JVM freed outside the heap, which the C library keeps for itself
    otherwise, and the driver grows from stage to stage.
    A JVM without that command (before 17.0.9, or not on Linux with glibc) keeps it."""
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    # By reflection, as the server's own class isn't open to callers.
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = spark.sparkContext._gateway.new_array(jvm.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        pass


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of an edge.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each is
    one partial aggregation and one equi-join, so a hub of any degree is split
    by adaptive skew joins and nothing is gathered in one place. Stars that no
    other edge touches are final; only the rest goes through another round.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    final = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # A centre is open if it is a leaf itself, or if one of its leaves is a centre or has another one.
        leaves = e.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        if (more := leaves.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first())[0] == more[1] and e.select(F.col("v").alias("u")).distinct().join(leaves, "u", "left_semi").isEmpty():
            final = e if final is None else final.unionAll(e)
            break
        shared = e.join(leaves.where("n > 1").select("u"), "u", "left_semi").select("v")
        both = e.join(e.select(F.col("v").alias("u")), "u", "left_semi").selectExpr("explode(array(u, v)) AS v")
        open_ = shared.unionAll(both).distinct().withColumn("open", F.lit(True))
        marked = cut(e.join(open_, "v", "left").select("u", "v", "open"))
        done = marked.where("open IS NULL").select("u", "v")
        final = done if final is None else final.unionAll(done)
        e = marked.where("open").select("u", "v")
    return final.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        final.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


class Forest:
    """Union-find over 0..n-1; the root of a tree is its smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                self.up = up
                return up
            up = nxt


def by_table(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over the rows of each distinct key, for few large groups: rows are dealt
    and sorted by key in the JVM, and a task holds one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        done: list[pa.RecordBatch] = []
        rows = 0

        def close() -> None:
            nonlocal rows
            out = fn(pa.Table.from_batches(held))
            if out is not None and out.num_rows:
                done.append(out)
                rows += out.num_rows

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            at = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for i, (x, y) in enumerate(zip(at, at[1:], strict=False)):
                key = tuple(c[x] for c in cols)
                if key != last:
                    if held:
                        close()
                    held = []
                    last = key
                held.append(batch.slice(x, y - x))
            if rows >= 4096:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done, rows = [], 0
        if held:
            close()
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of batches sorted by keys, dealt anew so that no group is split."""
    held: list[pa.RecordBatch] = []

    def last_of(batch: pa.RecordBatch) -> tuple:
        return tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        tail = last_of(batch)
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, tail, strict=True):
            same &= batch.column(k).to_numpy(zero_copy_only=False) == v
        cut = int(np.argmax(same))  # where the last group begins
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and last_of(held[-1]) != tail:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, keys: list[str], columns: list[str], fn: Callable[..., tuple | None], least: int = 1, parts: int | None = None) -> DataFrame:
    """(a, b): what fn(*columns) gives for the rows of each distinct key, for very
    many small groups: a batch's columns are converted once, groups are slices
    of them. Integers come as numpy arrays, others as lists. Groups of fewer
    than `least` rows are passed over. parts: how many tasks, else their bytes decide."""

    def values(batch: pa.RecordBatch, c: str):
        x = batch.column(c)
        return x.to_numpy(zero_copy_only=False) if pa.types.is_integer(x.type) else x.to_pylist()

    def join(parts: list):
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if isinstance(parts[0], np.ndarray) else [x for p in parts for x in p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        last, rows = None, 0
        done: list[tuple] = []

        def close(parts: list[list]) -> None:
            nonlocal rows
            if sum(len(p[0]) for p in parts) >= least:
                out = fn(*(join([p[i] for p in parts]) for i in range(len(columns))))
                if out is not None and len(out[0]):
                    done.append(out)
                    rows += len(out[0])

        def flush() -> pa.RecordBatch:
            nonlocal done, rows
            a, b = (pa.array(np.concatenate([np.asarray(d[i], np.int64) for d in done])) for i in (0, 1))
            done, rows = [], 0
            return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            vals = [values(batch, c) for c in columns]
            new = np.zeros(batch.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            first = tuple(c[0] for c in cols)
            if held and first != last:
                close(held)
                held = []
            at = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for x, y in zip(at[:-2], at[1:-1], strict=True):
                if held:
                    close([*held, [v[x:y] for v in vals]])
                    held = []
                elif y - x >= least:
                    close([[v[x:y] for v in vals]])
            held.append([v[at[-2] :] for v in vals])
            last = tuple(c[-1] for c in cols)
            if rows >= 8192:
                yield flush()
        if held:
            close(held)
        if done:
            yield flush()

    dealt = df.select(*keys, *[c for c in columns if c not in keys]).repartition(*([parts] if parts else []), *keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def block_pairs(df: DataFrame, id_col: str, weight: str, cap: int, own: str | None = None) -> DataFrame:
    """Adds bi, bj: groups whose `weight` column exceeds cap are dealt into
    ceil(weight / cap) blocks, and a row goes to every pair of blocks with its
    own, so every two rows of a group still meet and no task holds more than
    two blocks. Other groups keep one block. own: a column for the row's block in
    its group, -1 if the group has one."""
    g = F.greatest(F.lit(1), F.ceil(F.col(weight) / F.lit(cap))).cast("int")
    b = F.pmod(F.xxhash64(F.col(id_col)), g).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda x: F.struct(F.least(x, F.col("_b")).alias("bi"), F.greatest(x, F.col("_b")).alias("bj")))
    return df.withColumns({"_g": g, "_b": b}).withColumn("_p", F.explode(pairs)).select(*df.columns, *([F.expr("if(_g > 1, _b, -1)").cast("long").alias(own)] if own else []), F.col("_p.bi").alias("bi"), F.col("_p.bj").alias("bj"))


def run_dir(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tidewheel-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path that run_dir() gave out, in whatever store it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


class Bloom:
    """A filter of 64-bit hash ids, built on the executors: ten bits or more for
    each id, up to MOST (16 MB, what reaches the driver and is broadcast at the
    most). Beyond that it only lets more rows through to the join that follows."""

    MOST = 1 << 27
    SHIFTS = (0, 18, 37)

    def __init__(self, ids: DataFrame, column: str):
        self.bits = min(self.MOST, max(1 << 16, 1 << (10 * ids.count()).bit_length()))
        # The ids are hashes: their own bits serve as the filter's.
        spots = F.array(*[F.shiftrightunsigned(F.col(column), s).bitwiseAND(F.lit(self.bits - 1)) for s in self.SHIFTS])
        bit = ids.select(F.explode(spots).alias("b"))
        words = bit.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("x")).toArrow()
        table = np.zeros(self.bits >> 6, np.uint64)
        table[words.column("w").to_numpy()] = words.column("x").to_numpy().view(np.uint64)
        self.table = ids.sparkSession.sparkContext.broadcast(table)

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        table, h = self.table.value, ids.view(np.uint64)
        ok = np.ones(len(h), bool)
        for s in self.SHIFTS:
            b = (h >> np.uint64(s)) & np.uint64(self.bits - 1)
            ok &= (table[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) > 0
        return ok
