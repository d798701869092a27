"""Exact near-duplicate embeddings: a metric range join with pivots.

On the unit sphere angles are a metric, and a cosine of at least c is an angle of at most arccos(c), the range.  Pivots
are vectors of the table; every vector goes to the cell of its nearest pivot, and a cell is a ball about its pivot that
reaches as far as its farthest vector.  By the triangle inequality a vector can only be within range of one in cell i if its
angle to pivot i is at most the cell's reach plus the range, and at most the angle to its own pivot plus twice the range.

Whole cells are packed into blocks of a bounded number of bytes (a larger cell is cut by a hash), neighbours together.  Of
two blocks one visits the other, so each pair of vectors is compared at most once: a vector is copied to those of the
blocks it has to visit that hold a cell it reaches, and inside a block it is compared with the cells it reaches only.
Blocks join alone.  Visitors stream past a block, and many visitors are dealt to several copies of it, so no task's
memory grows with the data.  A block returns counts and a spanning forest of its links, never pairs.

Equal vectors are one row with a count, so a group of copies of any size costs one vector.  The choice of pivots
changes the cost and never the result.  Where vectors form groups, cells are narrow and few vectors visit; for vectors spread
evenly over many dimensions all angles are alike, and no metric rule can spare a block: then each vector is copied to half
of the blocks, and only the rule inside blocks saves work.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and keep
themselves; all others count, however small or large (they are scaled before they are squared).  Vectors of different lengths
never link.  Cosines are taken in double precision; single precision decides only where it is sure.  Rows with null ids link with
nothing.  Rows that repeat an id are vectors of their own: each has its own links, and a component is named by the smallest id
in it.  An empty table gives an empty result.  Extra columns, labels included, play no part.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, batch, map_batches, regrouped
from .components import components, roots

#: Pivots of all vector lengths together, in number and in bytes; vectors aimed at for a cell.
MAX_PIVOTS, PIVOT_BYTES, CELL = 1024, 32 << 20, 128

#: Vector lengths that have pivots from the data, the most frequent ones; each other length is one cell.
MOST_LENGTHS = 16

#: Vectors of a block, at most and at least, and the bytes of a block in double precision.
ROWS, FEW_ROWS, BLOCK_BYTES = 8192, 256, 32 << 20

#: Blocks that a small table is cut into, so that there is work for several tasks.
BLOCKS = 8

#: Visitors of one copy of a block.
VISITORS = 32_768

#: Visitors, and own vectors, whose products are held at once.
_AT_ONCE, _OWN_AT_ONCE = 4096, 128

#: Rounding may only add copies and comparisons.
SLACK = 1e-6


def _matrix(rows: pa.Array, dim: int, size: int) -> np.ndarray:
    """The vectors of blobs of ``size``-byte floats, in double precision and of length one; scaled first, so that no square over- or underflows."""
    kind = np.float32 if size == 4 else np.float64
    v = np.frombuffer(b"".join(rows.to_pylist()), kind).reshape(-1, dim).astype(np.float64) if len(rows) else np.zeros((0, dim))
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _clean(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, array) to (id, vec, dim): vec is the blob of a usable vector and else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32 if size == 4 else np.float64) + 0.0  # no negative zeros
            ends = np.cumsum(many)
            parts = [flat[e - n : e] for e, n in zip(ends.tolist(), many.tolist(), strict=True)]
            blobs = [v.tobytes() if len(v) and np.isfinite(v).all() and v.any() else None for v in parts]
            yield batch(id=b.column(0), vec=pa.array(blobs, pa.binary()), dim=pa.array([None if x is None else len(x) // size for x in blobs], pa.int32()))

    return run


@dataclasses.dataclass
class Length:
    """The pivots of one vector length, how far their cells reach, and where the cells' vectors go."""

    pivots: np.ndarray
    reach: np.ndarray | None = None
    rows: np.ndarray | None = None
    first: np.ndarray | None = None  # each cell's first block
    cuts: np.ndarray | None = None  # blocks that a cell larger than a block is cut into

    def pack(self, at: int) -> int:
        """Places the cells in blocks numbered from ``at``; gives the next free number."""
        n, dim = int(self.rows.sum()), self.pivots.shape[1]
        size = max(1, min(max(FEW_ROWS, math.ceil(n / BLOCKS)), ROWS, BLOCK_BYTES // (8 * dim)))
        k = len(self.pivots)
        near = (self.pivots @ self.pivots[: max(1, math.ceil(n / size))].T).argmax(1)
        self.first, self.cuts, held = np.zeros(k, np.int64), np.maximum(1, -(-self.rows // size)), 0
        for c in np.lexsort((np.arange(k), near)).tolist():
            m = int(self.rows[c])
            if held and held + m > size:
                at, held = at + 1, 0
            self.first[c] = at
            if self.cuts[c] > 1:
                at, held = at + int(self.cuts[c]), 0
            else:
                held += m
        return at + (held > 0)


def _salt(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))).astype(np.int64) & 0x7FFFFFFF


def _by_length(batches: Iterator[pa.RecordBatch], lengths: dict[int, Length], size: int) -> Iterator[tuple[int, Length, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(dim, its Length, rows, cosines to the pivots, own cells) of batches (pid, vec, dim, m)."""
    for b in regrouped(batches, _AT_ONCE):
        dims = b.column(2).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            part = b.take(pa.array(np.flatnonzero(dims == dim)))
            s = _matrix(part.column(1), dim, size) @ lengths[dim].pivots.T
            yield dim, lengths[dim], part, s, s.argmax(1)


def _homes(lengths: dict[int, Length], size: int):
    """(dim, cell, d, n): of each cell, the largest angle and the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, of, part, s, own in _by_length(batches, lengths, size):
            d, n = np.zeros(len(of.pivots)), np.bincount(own, minlength=len(of.pivots))
            np.maximum.at(d, own, np.arccos(np.clip(s[np.arange(len(s)), own], -1, 1)))
            cell = np.flatnonzero(n)
            yield batch(dim=np.full(len(cell), dim, np.int32), cell=cell.astype(np.int32), d=d[cell], n=n[cell])

    return run


def _least(angle: np.ndarray) -> np.ndarray:
    """The cosine that an angle up to this one has at least, rounding allowed for."""
    return np.cos(np.minimum(math.pi, angle + SLACK)) - SLACK


def _visits(of: Length, s: np.ndarray, own: np.ndarray, ids: np.ndarray, angle: float, blocks: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each row's own block; rows and the blocks that they visit).  blocks: the numbers (first, after the last) of this length's."""
    home = of.first[own] + _salt(ids) % of.cuts[own]
    near = np.arccos(np.clip(s[np.arange(len(s)), own], -1, 1))
    reached = (s >= _least(of.reach + angle)[None, :]) & (s >= _least(near + 2 * angle)[:, None])
    # Cells that share a block count together; a cell larger than a block has its blocks alone.
    order = np.argsort(of.first, kind="stable")
    starts = np.unique(of.first[order], return_index=True)[1]
    row, group = np.nonzero(np.logical_or.reduceat(reached[:, order], starts, axis=1))
    cell = order[starts][group]
    many = of.cuts[cell]
    row, to = np.repeat(row, many), np.repeat(of.first[cell], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    # Round a circle of blocks, each visits the half that lies before it.
    n = blocks[1] - blocks[0]
    back = (home[row] - to) % n
    goes = (back > 0) & ((2 * back < n) | ((2 * back == n) & (home[row] > to)))
    seen = np.unique(row[goes] * n + to[goes] - blocks[0])
    return home, seen // n, seen % n + blocks[0]


def _count(lengths, size: int, angle: float, spans):
    """(block, n): visitors of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, of, part, s, own in _by_length(batches, lengths, size):
            _, _, to = _visits(of, s, own, part.column(0).to_numpy(), angle, spans[dim])
            block, n = np.unique(to, return_counts=True)
            yield batch(block=block, n=n)

    return run


def _deal(lengths, size: int, angle: float, spans, copies: dict[int, int]):
    """(block, part, role, pid, m, cell, dim, vec): own rows (role 0) to every copy of their block, visitors (role 1) to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, of, part, s, own in _by_length(batches, lengths, size):
            ids = part.column(0).to_numpy()
            home, row, to = _visits(of, s, own, ids, angle, spans[dim])
            many = np.array([copies.get(h, 1) for h in home.tolist()], np.int64)
            at = np.repeat(np.arange(len(ids)), many)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            visit = _salt(ids[row] * 7 + 1) % np.array([copies[t] for t in to.tolist()], np.int64) if len(row) else np.zeros(0, np.int64)
            rows, block, nth = np.concatenate([at, row]), np.concatenate([home[at], to]), np.concatenate([nth, visit])
            role = np.concatenate([np.zeros(len(at), np.int32), np.ones(len(row), np.int32)])
            for i in range(0, len(rows), 16_384):
                j = slice(i, i + 16_384)
                x = part.take(pa.array(rows[j]))
                yield batch(block=block[j], part=nth[j].astype(np.int32), role=role[j], pid=x.column(0), m=x.column(3), cell=own[rows[j]].astype(np.int32), dim=x.column(2), vec=x.column(1))

    return run


class _Block:
    """The own vectors of a block, their counts of links, and the components that links tie."""

    def __init__(self, rows: pa.Table, lengths: dict[int, Length], size: int, cosine: float):
        self.dim, self.size, self.cosine = rows.column("dim")[0].as_py(), size, cosine
        order = np.argsort(rows.column("cell").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        self.ids, self.m = rows.column("pid").to_numpy(), rows.column("m").to_numpy()
        self.v = _matrix(rows.column("vec").combine_chunks(), self.dim, size)
        self.single = self.v.astype(np.float32)
        cells, self.start = np.unique(rows.column("cell").to_numpy(), return_index=True)
        self.end = np.append(self.start[1:], len(order))
        of = lengths[self.dim]
        self.pivots = of.pivots[cells]
        self.least = _least(of.reach[cells] + math.acos(cosine))
        self.unsure = max(2e-5, self.dim * 1.2e-7)
        self.n, self.root, self.pairs = np.zeros(len(order), np.int64), np.arange(len(order)), 0

    def _near(self, s: np.ndarray, a: np.ndarray, b: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links among own rows a and rows b of ``other``, of which s holds the products in single precision."""
        some = np.flatnonzero(s.max(1) >= self.cosine - self.unsure)  # most rows have no link
        if not len(some):
            return some, some
        s, a = s[some], a[some]
        x, y = np.nonzero(s >= self.cosine - self.unsure)
        sure = s[x, y] >= self.cosine + self.unsure
        a, b = a[x], b[y]
        doubt = np.flatnonzero(~sure)
        sure[doubt] = np.einsum("ij,ij->i", self.v[a[doubt]], other[b[doubt]]) >= self.cosine
        return a[sure], b[sure]

    def meet(self, v: np.ndarray, single: np.ndarray, after: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links (own row, row of v).  after: v are the own rows from a place on, and only pairs (i, j > i) count."""
        reached = v @ self.pivots.T >= self.least
        for c, (s, e) in enumerate(zip(self.start.tolist(), self.end.tolist(), strict=True)):
            use = np.flatnonzero(reached[:, c])
            if after:
                use = use[use >= s]
            if not len(use):
                continue
            right = single if len(use) == len(single) else single[use]
            for i in range(s, e, _OWN_AT_ONCE):
                own = np.arange(i, min(e, i + _OWN_AT_ONCE))
                a, b = self._near(self.single[own] @ right.T, own, use, v)
                self.pairs += len(own) * len(use)
                if after:
                    a, b = a[b > a], b[b > a]
                if len(a):
                    yield a, b

    def inside(self) -> None:
        for a, b in self.meet(self.v, self.single, True):
            self.n += np.bincount(a, self.m[b], len(self.n)).astype(np.int64) + np.bincount(b, self.m[a], len(self.n)).astype(np.int64)
            self.root = roots(len(self.n), self.root[a], self.root[b])[self.root]

    def visited(self, rows: pa.Table) -> pa.RecordBatch | None:
        """(id, n, root, pairs) of the visitors that have links; own rows remember theirs."""
        ids, m = rows.column("pid").to_numpy(), rows.column("m").to_numpy()
        v = _matrix(rows.column("vec").combine_chunks(), self.dim, self.size)
        k, n = len(self.n), np.zeros(len(ids), np.int64)
        root = np.concatenate([self.root, k + np.arange(len(ids))])
        for a, b in self.meet(v, v.astype(np.float32)):
            self.n += np.bincount(a, m[b], k).astype(np.int64)
            n += np.bincount(b, self.m[a], len(ids)).astype(np.int64)
            root = roots(len(root), root[a], root[k + b])[root]
        self.root, tied = root[:k], np.flatnonzero(n)
        # A component with an own row has one as its root: they come first.
        return batch(id=ids[tied], n=n[tied], root=self.ids[root[k + tied]], pairs=np.zeros(len(tied), np.int64)) if len(tied) else None

    def result(self) -> pa.RecordBatch:
        """(id, n, root, pairs) of own rows with links, and one row of id -1 with the number of pairs that were compared."""
        tied = np.flatnonzero((self.n > 0) | (self.root != np.arange(len(self.n))))
        return batch(id=np.append(self.ids[tied], -1), n=np.append(self.n[tied], 0), root=np.append(self.ids[self.root[tied]], -1), pairs=np.append(np.zeros(len(tied), np.int64), self.pairs))


def _join(lengths, size: int, cosine: float):
    """Reads rows as _deal makes them, sorted by (block, part, role); yields (id, n, root, pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for b in regrouped(batches, _AT_ONCE):
            k = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.append(np.flatnonzero(np.append(True, (k[1:] != k[:-1]).any(1))), len(k)).tolist()
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                part = pa.Table.from_batches([b.slice(i, j - i)])
                if (at := (k[i, 0], k[i, 1])) != now:
                    if held:  # a block without visitors
                        block = _Block(pa.concat_tables(held), lengths, size, cosine)
                        if now[1] == 0:
                            block.inside()
                    if block:
                        yield block.result()
                    now, held, block = at, [], None
                if k[i, 2] == 0:
                    held.append(part)
                    continue
                if held:
                    block, held = _Block(pa.concat_tables(held), lengths, size, cosine), []
                    if now[1] == 0:
                        block.inside()
                found = block.visited(part)
                if found is not None:
                    yield found
        if held:
            block = _Block(pa.concat_tables(held), lengths, size, cosine)
            if now[1] == 0:
                block.inside()
        if block:
            yield block.result()

    return run


def _pivots(points: DataFrame, counts: dict[int, int], size: int) -> dict[int, Length]:
    """Pivots of each length; of those without any from the data, one that is a unit vector."""
    total, out = sum(counts.values()), {}
    for dim, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:MOST_LENGTHS]:
        share = n / total
        want = max(1, min(math.ceil(n / CELL), int(MAX_PIVOTS * share), int(PIVOT_BYTES * share) // (8 * dim)))
        if want > 1:
            rows = points.filter(F.col("dim") == dim).select("vec").orderBy(F.xxhash64("vec"), "vec").limit(want).collect()  # bounded in number and bytes
            out[dim] = Length(_matrix(pa.array([bytes(x["vec"]) for x in rows], pa.binary()), dim, size))
    return out | {dim: Length(np.eye(1, dim)) for dim in counts if dim not in out}


def near_duplicates(df: DataFrame, work: Workspace, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, stats: dict | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.  stats: is told the pairs of distinct vectors that were compared, and all there are."""
    spark, angle = df.sparkSession, math.acos(cosine)
    size = 4 if df.schema[vector].dataType.simpleString() == "array<float>" else 8
    given = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>" if size == 4 else "array<double>"))
    clean = work.keep(map_batches(given, _clean(size), "id bigint, vec binary, dim int"), "vectors")
    distinct = clean.filter("vec is not null and id is not null").groupBy("vec", "dim").agg(F.min("id").alias("id"), F.count("*").alias("m"))
    points = work.keep(distinct.withColumn("pid", F.monotonically_increasing_id()), "distinct")  # numbered once, by writing
    counts = {x["dim"]: x["count"] for x in points.groupBy("dim").count().collect()}  # lengths are few: of n bytes of vectors at most sqrt(n)
    if not counts:
        none = df.select(F.col(key).cast("bigint").alias(key))
        return none.select(key, F.lit(0).cast("bigint").alias("n_links"), F.col(key).alias("component_id"), F.lit(True).alias("kept"))
    rows, lengths = points.select("pid", "vec", "dim", "m"), _pivots(points, counts, size)
    share = lambda x: spark.sparkContext.broadcast(x)  # noqa: E731  # bounded by MAX_PIVOTS and PIVOT_BYTES, a row per cell and per block
    bare = share(lengths)
    sizes = map_batches(rows, lambda it: _homes(bare.value, size)(it), "dim int, cell int, d double, n bigint").groupBy("dim", "cell").agg(F.max("d").alias("d"), F.sum("n").alias("n")).collect()  # one row for each cell
    for of in lengths.values():
        of.reach, of.rows = np.zeros(len(of.pivots)), np.zeros(len(of.pivots), np.int64)
    for x in sizes:
        lengths[x["dim"]].reach[x["cell"]], lengths[x["dim"]].rows[x["cell"]] = x["d"], x["n"]
    spans, at = {}, 0
    for dim, of in sorted(lengths.items()):
        spans[dim] = (at, at := of.pack(at))
    full = share((lengths, spans))
    visitors = map_batches(rows, lambda it: _count(full.value[0], size, angle, full.value[1])(it), "block bigint, n bigint").groupBy("block").agg(F.sum("n").alias("n")).collect()  # one row for each block
    copies = {x["block"]: math.ceil(x["n"] / VISITORS) for x in visitors}
    dealt = share(copies)
    wide = map_batches(rows, lambda it: _deal(full.value[0], size, angle, full.value[1], dealt.value)(it), "block bigint, part int, role int, pid bigint, m bigint, cell int, dim int, vec binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = at + sum(copies.values()) - len(copies)
    wide = wide.repartition(max(parts, min(4 * parts, 3 * groups)), "block", "part").sortWithinPartitions("block", "part", "role")
    found = work.keep(map_batches(wide, lambda it: _join(full.value[0], size, cosine)(it), "id bigint, n bigint, root bigint, pairs bigint"), "links")
    if stats is not None:
        n = sum(counts.values())
        stats |= {"compared": found.agg(F.sum("pairs")).first()[0] or 0, "pairs": n * (n - 1) // 2, "blocks": at, "copied": sum(x["n"] for x in visitors), "vectors": n}
    found = found.filter("id >= 0")
    links = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "pid")
    tied = work.keep(components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), work).select(F.col("node").alias("pid"), "component"), "tied")
    names = points.select("pid", "id").join(tied, "pid").groupBy("component").agg(F.min("id").alias("name"))
    named = tied.join(names, "component").select("pid", "name")
    classes = points.select("vec", "dim", "id", "m", "pid").join(links, "pid", "left").join(named, "pid", "left")
    classes = classes.select("vec", "dim", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("name", "id").alias("component_id"))
    out = clean.withColumn("vec", F.when(F.col("id").isNotNull(), F.col("vec"))).join(classes, ["vec", "dim"], "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
