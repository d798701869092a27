"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint has bit i set if more than half of the text's shingle hashes have it set.  To find all
pairs within ``radius`` differing bits, each bit position i gets a vector phi(i) of radius+1 bits, and there is
one table per non-zero vector v, keyed by the fingerprint's bits at the positions with <phi(i), v> odd (Pagh,
"Locality-sensitive hashing without false negatives", 2016).  The phi of at most ``radius`` differing positions
span a space of at most that dimension, so some v is orthogonal to all of them: in its table the pair agrees.
No pair within the radius is missed, and each table still compares half of the bits.

Rows are first reduced to distinct fingerprints, so a group of copies of any size is one row.  A bucket's
members reach one task in blocks of bounded size (a larger bucket becomes a grid of block pairs), which returns
the bucket's spanning forest of links, never its pairs.

Edge cases: a null, empty or wordless text has fingerprint zero and links like any other.  A text with fewer
words than a shingle is one shingle.  Ties in the vote (exactly half) give 0.  A null id takes part, but can
only name a component if all its rows have null ids.  Other columns play no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, batch, chunks, map_batches, regrouped, utf8, words
from .components import components, roots

#: Rows of a bucket that a task compares at once (twice this, for a pair of blocks).
BLOCK = 2048

#: Of so many fingerprints, one is looked at to tell which buckets are large; and the large buckets that are sent to every task.
SAMPLE, BROADCAST_BUCKETS = 16, 1_000_000

#: Shingle hashes whose bits are counted at once.
_VOTES = 1 << 14


def masks(radius: int, bits: int = 64) -> list[int]:
    """The tables' bit masks as signed 64-bit numbers: 2^(radius+1)-1 of them, each with about half of the bits.

    phi deals the non-zero vectors out evenly in an odd stride, so all masks have nearly the same number of bits.
    """
    n = (1 << (radius + 1)) - 1
    phi = [1 + (i * 7) % n for i in range(bits)]
    out = [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def vote(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 for none."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _VOTES):
        part = hashes[i : i + _VOTES]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every ``size`` words in a row, joined by one space; of all words if there are fewer; repeats included."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    n = len(w) - size + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return np.fromiter([h(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64, n)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.zeros(b.num_rows, np.uint64)
            for i, _, data, at in chunks(b.column(1)):
                raw, at = data.tobytes(), at.tolist()
                for k in range(len(at) - 1):
                    fp[i + k] = vote(shingle_hashes(raw[at[k] : at[k + 1]], size))
            yield batch(**{key: b.column(0), "fp": fp.view(np.int64)})

    return map_batches(df.select(key, utf8(text)), run, f"`{key}` {df.schema[key].dataType.simpleString()}, fp bigint")


def _linked(ids: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among a block's rows: positions of the ends of real links, the closest first (Prim)."""
    n = len(fps)
    if n == 2:
        near = int(fps[0] ^ fps[1]).bit_count() <= radius
        return (np.array([0]), np.array([1])) if near else (np.zeros(0, int), np.zeros(0, int))
    best, src, free = np.full(n, 99, np.uint8), np.zeros(n, np.int64), np.ones(n, bool)
    a, b, at = [], [], 0
    for _ in range(n):
        free[at] = False
        d = np.bitwise_count(fps ^ fps[at])
        closer = free & (d < best)
        best[closer], src[closer] = d[closer], at
        at = int(np.argmin(np.where(free, best, 100)))
        if free[at] and best[at] <= radius:
            a.append(src[at])
            b.append(at)
        elif not free.any():
            break
    return np.array(a, np.int64), np.array(b, np.int64)


def _forest_of_buckets(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Reads rows (k, id, fp) sorted by k; yields links (a, b)."""
    held: list[np.ndarray] = []

    def links(block: list[np.ndarray], new: np.ndarray) -> pa.RecordBatch:
        ids, fps = block[1], block[2].view(np.uint64)
        ends = np.append(np.flatnonzero(new[1:]) + 1, len(ids))
        starts = np.append(0, ends[:-1])
        a, b = [], []
        two = starts[ends - starts == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
        a.append(ids[near])
        b.append(ids[near + 1])
        for s, e in zip(*(x[ends - starts > 2].tolist() for x in (starts, ends)), strict=True):
            x, y = _linked(ids[s:e], fps[s:e], radius)
            a.append(ids[s:e][x])
            b.append(ids[s:e][y])
        return batch(a=np.concatenate(a), b=np.concatenate(b))

    for x in regrouped(batches, 20_000):
        if not x.num_rows:
            continue
        now = [x.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if held:
            now = [np.concatenate([p, q]) for p, q in zip(held, now, strict=True)]
        new = np.append(True, now[0][1:] != now[0][:-1])
        last = int(np.flatnonzero(new)[-1])  # its bucket may go on in the next batch
        held = [c[last:] for c in now]
        if last:
            yield links([c[:last] for c in now], new[:last])
    if held:
        yield links(held, np.arange(len(held[0])) == 0)


def near_links(points: DataFrame, work: Workspace, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): of each bucket of each covering table, a spanning forest of the pairs of points within the radius.

    points: columns id, fp of bigint, with distinct fp; with a column p, there is a set of tables for each p, and fp is
    distinct in each.  The forests' union has the same components as all links.

    A bucket is known by a hash of its table and its bits, so that a row is three numbers; buckets that share a hash are only
    compared in vain.  Which buckets are large is told from every SAMPLE-th fingerprint; the result doesn't depend on it.
    """
    of = masks(radius)
    which = F.col("p") * len(of) if "p" in points.columns else F.lit(0)
    tables = F.array(*[F.xxhash64(which + i, F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(of)])
    deal = lambda df: df.select(F.explode(tables).alias("k"), "id", "fp")
    rows = deal(points)
    some = deal(points.filter(F.pmod(F.xxhash64(F.lit("sample"), "fp"), F.lit(SAMPLE)) == 0))
    large = work.keep(some.groupBy("k").agg((F.count("*") * SAMPLE).alias("n")).filter(F.col("n") > block / 2), "large-buckets")
    if many := large.count():
        # Block i of a large bucket meets every block j: its rows go to the pairs (min(i, j), max(i, j)).
        rows = rows.join(F.broadcast(large) if many <= BROADCAST_BUCKETS else large, "k", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / F.lit(block)), F.lit(0)).cast("int"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.greatest("blocks", F.lit(1))).cast("int"))
        rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0)))))
        pair = F.xxhash64("k", F.least("own", "j"), F.greatest("own", "j"))
        rows = rows.select(F.when(F.col("blocks") > 1, pair).otherwise(F.col("k")).alias("k"), "id", "fp")
    parts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "k").sortWithinPartitions("k")
    return map_batches(dealt, functools.partial(_forest_of_buckets, radius=radius), "a bigint, b bigint")


def near_duplicates(df: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """(key, fp, component_id): rows whose fingerprints are tied by links of at most ``radius`` bits share the smallest key reachable."""
    marks = work.keep(fingerprints(df, key, text, size), "fingerprints")
    points = work.keep(marks.groupBy("fp").agg(F.min(key).cast("bigint").alias("id")), "distinct")
    edges = near_links(points.filter("id is not null"), work, radius)
    joined = components(edges, work)
    classes = points.join(joined, points["id"] == joined["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return marks.join(classes, "fp").select(key, "fp", "component_id")
