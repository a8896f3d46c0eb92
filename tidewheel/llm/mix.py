"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target number of words: all words of the corpus are shared
out by weight, no source above CAP times its own size (the excess goes to the
others by weight). A source is taken whole as often as its target allows; what
remains is fitted exactly: documents are counted by exact length, whole shares
of each length are taken in proportion, and a bounded-knapsack dynamic program
over the last few thousand words picks how many of each length close the gap.
Which documents of a length are taken follows a seeded hash.

Skew: a source is only ever seen as counts by (length, hash bucket), summed
before the shuffle; hashes are ranked only inside the one bucket of a length that
the count cuts, so a source or length with a third of all rows is never ordered
in one task. The texts themselves are read once more and meet one small row for
each (source, length): the hash up to which its documents are taken.

Edge cases: a null or empty text has size 0 and takes 0; a null source is a
source of its own, last in order; a source without words has target 0; rows that
repeat an id are ranked apart by their text; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
SEED = 17
#: Highest bits of a hash that say its bucket.
BITS = 8
#: Words left to the dynamic program; its table has this many bits.
FIT = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"


def size(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) with target: water-filling in closed form.
    With cap / weight in ascending order, the first sources are full; the level
    is where the words left, over the weights left, fits under the next cap.
    One row per source: the windows are over that small table."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    one = sources.withColumn("k", F.row_number().over(by_name)).withColumn("w", w)
    full = Window.orderBy(F.col("top") / F.col("w"), "k")
    one = one.withColumn("top", (F.col("source_size") * cap).cast("double"))
    one = one.withColumns(
        {
            "n": F.row_number().over(full),
            "used": F.coalesce(F.sum("top").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "w_left": F.sum("w").over(full.rowsBetween(0, Window.unboundedFollowing)),
            "all": F.sum("source_size").over(Window.partitionBy(F.lit(0))),
        }
    )
    level = F.min(F.when((F.col("all") - F.col("used")) / F.col("w_left") <= F.col("top") / F.col("w"), F.struct("n", ((F.col("all") - F.col("used")) / F.col("w_left")).alias("level")))).over(Window.partitionBy(F.lit(0)))
    one = one.withColumn("l", level)
    return one.select("source", "source_size", F.when(F.col("l.n").isNull() | (F.col("n") < F.col("l.n")), F.col("top")).otherwise(F.least("top", F.col("w") * F.col("l.level"))).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum comes nearest below or
    at budget; exact where some choice of the documents left open is exact."""
    keep = lengths > 0
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if not keep.any() or budget <= 0:
        return take
    if budget >= total:
        return np.where(keep, counts, 0)
    share = max(0, budget - FIT // 2) / total
    take = np.where(keep, np.floor(counts * share).astype(np.int64), 0)
    left = budget - int((take * lengths).sum())
    # Long lengths first, until the rest is small enough for the table.
    for i in np.argsort(-lengths):
        if left <= FIT:
            break
        if lengths[i] > 0:
            n = min(int(counts[i] - take[i]), (left - FIT // 2) // int(lengths[i]))
            take[i] += n
            left -= n * int(lengths[i])
    goal, reach, steps = min(left, FIT), 1, []
    mask = (1 << (goal + 1)) - 1
    for i in np.argsort(-lengths):
        n = min(int(counts[i] - take[i]), goal // int(lengths[i])) if 0 < lengths[i] <= goal else 0
        part = 1
        while n > 0 and not reach >> goal & 1:
            part = min(part, n)
            steps.append((i, part, reach))
            reach |= (reach << part * int(lengths[i])) & mask
            n -= part
            part *= 2
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            take[i] += part
            at -= part * int(lengths[i])
    return take


def _fit_sources(t: pa.Table) -> pa.RecordBatch:
    """Rows (key, size, n, source_size, target): adds full (times each is taken) and extra."""
    lengths = t.column("size").to_numpy()
    counts = t.column("n").to_numpy()
    whole, target = t.column("source_size")[0].as_py(), t.column("target")[0].as_py()
    goal = round(target)
    full = min(CAP, goal // whole) if whole else 0
    extra = fit(lengths, counts, goal - full * whole) if full < CAP else np.zeros(len(lengths), np.int64)
    return pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), t.column("size").combine_chunks(), pa.array(np.full(len(lengths), full), pa.int64()), pa.array(extra)], ["key", "size", "full", "extra"])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """docs' columns in a struct `row` with size, source_size, target, copies and taken."""
    order = F.xxhash64(F.lit(seed), "row.doc_id", "row.text")
    d = docs.select(F.struct("*").alias("row")).select(
        "row",
        F.coalesce(F.concat(F.lit("="), F.col("row.source")), F.lit("")).alias("key"),
        size(F.col("row.text")).alias("size"),
        order.alias("h"),
    )
    # Hashes in order, by their highest bits.
    narrow = graph.cut(d.select("key", "size", "h", (F.shiftright("h", 64 - BITS) + (1 << BITS - 1)).cast("int").alias("bucket")))
    hist = graph.cut(narrow.groupBy("key", "size", "bucket").agg(F.count("*").alias("n")))
    lengths = hist.groupBy("key", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = graph.cut(targets(sources.select(F.expr("if(key = '', null, substring(key, 2))").alias("source"), "source_size"), weights).select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "source_size", "target"))
    plan = graph.cut(graph.by_table(lengths.join(goal, "key"), ["key"], _fit_sources, "key string, size long, full long, extra long"))
    # The bucket in which the count ends, and in it the hash; `some` of the `ties` rows with that hash are taken.
    upto = Window.partitionBy("key", "size").orderBy("bucket")
    cut = hist.join(plan.where("extra > 0"), ["key", "size"]).withColumn("before", F.sum("n").over(upto) - F.col("n"))
    cut = cut.where("before < extra AND extra <= before + n").select("key", "size", "bucket", (F.col("extra") - F.col("before")).alias("left"))
    inside = narrow.join(cut, ["key", "size", "bucket"]).groupBy("key", "size", "left", "h").agg(F.count("*").alias("ties"))
    inside = inside.withColumn("before", F.sum("ties").over(Window.partitionBy("key", "size").orderBy("h")) - F.col("ties"))
    last = inside.where("before < left AND left <= before + ties").select("key", "size", F.col("h").alias("last"), (F.col("left") - F.col("before")).alias("some"), "ties")
    rule = graph.cut(plan.drop("extra").join(goal, "key").join(last, ["key", "size"], "left"))
    out = d.join(rule, ["key", "size"])
    more = F.when(F.col("h") < F.col("last"), 1).when((F.col("h") == F.col("last")) & (F.col("some") == F.col("ties")), 1).otherwise(0)
    split = (F.col("h") == F.col("last")) & (F.col("some") < F.col("ties"))
    if not rule.where("some < ties").isEmpty():
        # Rows that repeat id and text, of which only some are taken.
        rank = F.row_number().over(Window.partitionBy("key", "size", "h").orderBy("h"))
        tied = out.where(split).withColumn("more", F.when(rank <= F.col("some"), 1).otherwise(0))
        out = out.where(F.coalesce(~split, F.lit(True))).withColumn("more", more).unionByName(tied)
    else:
        out = out.withColumn("more", more)
    copies = F.col("full") + F.col("more")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def digest(docs: DataFrame) -> DataFrame:
    m = mix(docs.select("doc_id", "text", "source"))
    return m.select("row.doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents the mix takes, with their columns and `copies` (1 to 3)."""
    m = mix(docs).where("copies > 0 AND size > 0")
    extra = [F.col(c).alias(c if c not in docs.columns else f"mix_{c}") for c in ("size", "source_size", "target", "copies", "taken")]
    return m.select("row.*", *extra)
