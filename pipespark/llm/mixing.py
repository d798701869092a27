"""Mixing sources to target weights by entropy balancing.

Each document i of source s gets a rate r_i, the copies wanted of it.  Of all rates with
sum(r_i * size_i) = target_s and 0 <= r_i <= 2, those nearest to 1 in relative entropy are
r_i = min(2, exp(lambda_s * size_i / scale_s)): documents are tilted exponentially by their size.  The convex dual
has one unknown per source; Newton's method on it, kept inside a bracket, solves all sources at once, with one
aggregate for each iteration.

Rates depend on source and size only, so the aggregates run over the table of distinct (source, size) with counts,
never over documents.  Rates become copies by rounding their running sum in order of size, which leaves an error of
at most about one document in each source; single documents are then added or dropped to bring the rest down.
Inside a cell of equal size the documents with a further copy are the first in the order of a hash of the id.

Edge cases: a null source is a source of its own, weighted last; a null or wordless text has size 0 and takes no
words; a source without words has target 0; an empty table gives an empty result; over MAX_SOURCES sources are an error.  Equal ids in one cell are ordered
arbitrarily between themselves, which changes no sum.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace

#: Sources are a list on the driver: a million names is the most that is taken.
MAX_SOURCES = 1_000_000

#: Documents of one (source, size) that one task ranks.
CELL = 1_000


def word_count(text: str | Column) -> Column:
    """The number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null.  The count builds no array of the words."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit("[^ \\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words wanted of each source: ``share`` of all, dealt by weight, none above ``most`` times its own size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), set(order)
    while open_:
        all_ = sum(weight[s] for s in open_)
        over = [s for s in order if s in open_ and left * weight[s] / all_ > most * sizes[s]]
        if not over:
            got |= {s: left * weight[s] / all_ for s in open_}
            break
        for s in over:
            got[s] = most * sizes[s]
            open_.discard(s)
        left -= sum(got[s] for s in over)
    return got


def _solve(cells: DataFrame, sources: DataFrame, want: dict[int, float], most: float, rounds: int = 60, close: float = 1e-9) -> dict[int, float]:
    """lambda for each source number; each round sums all sources' gradient and curvature over the cells."""
    spark = cells.sparkSession
    low, high, now = {s: -64.0 for s in want}, {s: 64.0 for s in want}, {s: 0.0 for s in want}
    open_ = set(want)
    schema = T.StructType([T.StructField("s", T.LongType()), T.StructField("lam", T.DoubleType())])
    for _ in range(rounds):
        if not open_:
            break
        lam = F.broadcast(spark.createDataFrame([(s, now[s]) for s in sorted(open_)], schema))  # at most MAX_SOURCES rows
        x = F.col("size") / F.col("scale")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        rate = F.least(raw, F.lit(most))
        bend = F.when(raw < most, raw * x * F.col("size")).otherwise(0.0)
        got = cells.join(lam, "s").groupBy("s").agg(F.sum(rate * F.col("size") * F.col("n")).alias("words"), F.sum(bend * F.col("n")).alias("bend"))
        for s, have, slope in got.collect():
            miss = have - want[s]
            if abs(miss) <= close * max(1.0, want[s]):
                open_.discard(s)
                continue
            if miss > 0:
                high[s] = now[s]
            else:
                low[s] = now[s]
            if high[s] - low[s] < 1e-13 * max(1.0, abs(now[s])):  # no nearer number is left
                open_.discard(s)
                continue
            step = now[s] - miss / slope if slope > 0 else math.inf
            now[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    if open_:
        warnings.warn(f"the rates of {len(open_)} sources did not settle; the nearest found are taken", stacklevel=3)
    return now


def mix(df: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, mark: str | None = None) -> DataFrame:
    """(key, source, size, source_size, target, rate, copies, taken): how often the mix takes each row, and the words it takes of it.

    mark: the column whose hash says which documents of equal source and size get a further copy; else the key.
    """
    spark = df.sparkSession
    docs = work.keep(df.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(9), F.col(mark or key)).alias("mark")), "sizes")
    found = docs.groupBy("source", "size").agg(F.count("*").alias("n"))
    per = docs.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    rows = per.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    order = sorted((r for r in rows if r["source"] is not None), key=lambda r: [ord(c) for c in r["source"]]) + [r for r in rows if r["source"] is None]
    want = targets({r["source"]: r["words"] for r in order}, weights, share, most)
    schema = "source string, s bigint, words bigint, scale double, target double"
    named = [(r["source"], i, r["words"], float(max(1.0, r["words"] / r["docs"])), float(want[r["source"]])) for i, r in enumerate(order)]
    sources = F.broadcast(spark.createDataFrame(named, schema))  # at most MAX_SOURCES rows
    cells = work.keep(found.join(sources, found["source"].eqNullSafe(sources["source"])).select("s", "size", "n", "scale"), "cells")
    # A target at the limit itself needs every document twice; one of no words needs none.
    full = {i for i, (_, _, words, _, target) in enumerate(named) if target >= most * words * (1 - 1e-12)}
    lam = _solve(cells, sources, {i: row[4] for i, row in enumerate(named) if i not in full}, most)
    known = F.broadcast(spark.createDataFrame([(i, lam.get(i, math.inf), row[4]) for i, row in enumerate(named)], "s bigint, lam double, target double"))
    tilt = F.when(F.col("lam") == math.inf, F.lit(float(most))).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))), F.lit(float(most))))
    rated = cells.join(known, "s").withColumn("rate", tilt)
    # The running sum is over distinct sizes of a source, whose number is bounded by the longest text, not by the rows.
    upto = W.partitionBy("s").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    total = F.round(F.sum(F.col("rate") * F.col("n")).over(upto), 6)
    marked = rated.withColumn("total", F.floor(total + 0.5).cast("bigint"))
    before = F.lag("total", 1, 0).over(W.partitionBy("s").orderBy("size"))
    copies = F.least(F.col("total") - before, F.col("n") * most)
    now = work.keep(marked.select("s", "size", "n", "rate", "target", F.greatest(copies, F.lit(0)).cast("bigint").alias("copies")), "rounded")
    now = _repair(now, work, most)
    return _deal(docs, now, sources, work, key, source)


def _repair(cells: DataFrame, work: Workspace, most: int, rounds: int = 4) -> DataFrame:
    """Adds or drops one document in each source and round, the one that brings its words nearest to the target."""
    for k in range(rounds):
        off = cells.groupBy("s").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("off"))
        able = F.when(F.col("off") > 0, F.col("copies") < F.col("n") * most).otherwise(F.col("copies") > 0)
        gap = F.abs(F.abs("off") - F.col("size"))
        pick = cells.join(F.broadcast(off), "s").filter(able & (gap < F.abs("off"))).groupBy("s").agg(F.min_by("size", F.struct(gap, "size")).alias("pick"), F.first(F.signum("off")).cast("bigint").alias("step"))
        cells = cells.join(F.broadcast(pick), "s", "left").withColumn("copies", F.col("copies") + F.when(F.col("size") == F.col("pick"), F.col("step")).otherwise(0)).drop("pick", "step")
        cells = work.keep(cells, f"repaired-{k}")
    return cells


def _deal(docs: DataFrame, cells: DataFrame, sources: DataFrame, work: Workspace, key: str, source: str) -> DataFrame:
    """Gives each document its cell's copies: the same to all, one more to the first by hash; large cells are ranked in salted parts."""
    docs = docs.join(sources, docs["source"].eqNullSafe(sources["source"])).select("id", "mark", docs["source"], "s", "size", "words")
    salted = docs.join(cells, ["s", "size"]).withColumn("salt", F.pmod("mark", F.ceil(F.col("n") / F.lit(CELL))))
    large = salted.filter(F.col("n") > CELL).groupBy("s", "size", "salt").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("copies").alias("copies"))
    # Of the cell's extra copies, each salted part takes a share in proportion to its rows, rounded by running sums.
    w = W.partitionBy("s", "size").orderBy("salt")
    upto = F.sum("m").over(w.rowsBetween(W.unboundedPreceding, 0))
    extra = F.pmod("copies", "n")
    share = F.floor(upto * extra / F.col("n")) - F.floor((upto - F.col("m")) * extra / F.col("n"))
    parts = large.select("s", "size", "salt", share.cast("bigint").alias("share"))
    salted = salted.join(parts, ["s", "size", "salt"], "left").withColumn("share", F.coalesce("share", extra))
    nth = F.row_number().over(W.partitionBy("s", "size", "salt").orderBy("mark", "id"))
    copies = (F.floor(F.col("copies") / F.col("n")) + F.when(nth <= F.col("share"), 1).otherwise(0)).cast("bigint")
    return salted.select(F.col("id").alias(key), F.col("source").alias(source), "size", F.col("words").alias("source_size"), "target", "rate", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
