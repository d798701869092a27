"""Groups of near copies: candidates by SimHash and by sketches of word shingles, compared exactly.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is at least 0.8, or if that of their
words, each counted as often as it occurs, is, and a tenth of their shingles is common.  One changed word takes five shingles
with it, so short texts fall short of the first rule with few changes; the second sees those.

Every text is read once for its signature: 128 bits of hash of its words in order, PRINTS fingerprints of its distinct words,
and the LOW smallest hashes of its shingles.  Texts of one hash are one text from there on.  Then:

1. Covering tables (``simhash.near_links``) tie texts whose fingerprints are within the radius; inside such a group all texts
   are compared.  A large group is first compared with a few of its texts, its hubs, which ties most of it; only what is
   left is compared with everything, in blocks.
2. Texts of different groups that share shingles of their sketches (the first KEYS in order of a hash that aren't in many
   texts) are paired and compared.  A pair of similarity s shares SHARED of KEYS = 16 but for a chance of 2e-9 at s = 0.8 and 0.002
   at 0.5, since each place of the union's sketch is common with chance s; short texts, and those with many shingles
   of many texts, are paired by any one.  Texts that consist of shingles of many texts for the most part are grouped by
   these, and such groups are compared like those of the first step.

Edge cases: rows with null keys are left out.  Null, empty and wordless texts are copies of each other.  A text with fewer words
than a shingle is one shingle.  Several rows may carry one key: what is tied to any of their texts is tied to the key.
Repeated rows, ties and extra columns don't matter; an empty table gives an empty result.  Texts of any length are done whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Workspace, batch, chunks, map_batches, regrouped, utf8, words
from .components import components, roots
from .simhash import near_links

PRINTS = 2

#: Smallest shingle hashes that a signature keeps; those that pair texts; and how many of these a pair must share.
LOW, KEYS, SHARED = 32, 16, 3

#: Common shingles that the second rule asks for, as a similarity.
LOOSE = 0.1

#: Texts of a group of candidates that a task compares at once (twice this, for a pair of blocks), and the bytes of their hashes.
SET_BLOCK, SET_BYTES = 256, 2 << 20

#: Texts of a large group that all others are compared with first, and texts that meet one copy of them.
HUBS, STAR = 8, 1000

#: Ids that are sent to every task; with more of them, the texts are shuffled to meet them.
BROADCAST_ROWS = 500_000

#: Texts whose signatures hold a shingle before it is common; the share of common ones from which on a text is grouped, and by how many.
COMMON, MOSTLY, GROUPS = 64, 0.7, 4

#: Bytes of text that are hashed together, and words whose bits are counted together.
CHUNK, _BITS = 1 << 20, 1 << 16

_LOWER = np.frombuffer(LOWER, np.uint8)
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _remixed(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th of a family of hashes of a hash (splitmix64's steps)."""
    h = h + np.uint64(0x9E3779B97F4A7C15 * n % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word of the texts data[at[i]:at[i+1]], in order; A-Z are lower-cased."""
    word = _WORD[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    edge = at[:-1][at[:-1] < len(data)]
    start[edge] = word[edge]
    cut = np.flatnonzero(start)
    if not len(cut):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.arange(cut[0], len(data)) - np.repeat(cut, np.diff(np.append(cut, len(data))))
    rest = data[cut[0] :]
    value = np.where(word[cut[0] :], _LOWER[rest].astype(np.uint64) + np.uint64(1), np.uint64(0)) * _POWERS[place & (len(_POWERS) - 1)]
    return np.searchsorted(at, cut, "right") - 1, _remixed(np.add.reduceat(value, cut - cut[0]), 0)


def _sorted(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, upper 48 bits of the hash), sorted by both: one sort of numbers that hold the text's place above the hash."""
    out, most = [], 1 << 16
    for i in range(0, int(text.max()) + 1 if len(text) else 0, most):
        use = (text >= i) & (text < i + most) if len(text) and text.max() >= most else slice(None)
        both = np.sort(((text[use] - i).astype(np.uint64) << np.uint64(48)) | (h[use] >> np.uint64(16)))
        out.append(((both >> np.uint64(48)).astype(np.int64) + i, both & np.uint64((1 << 48) - 1)))
    return (np.concatenate([t for t, _ in out]), np.concatenate([x for _, x in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def shingles_of(text: np.ndarray, h: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of n texts, sorted, and where each text's begin; of the words that ``word_hashes`` gives."""
    many = np.bincount(text, minlength=n)
    odd = _POWERS[1 : size + 1]
    m = max(0, len(h) - size + 1)
    total = np.zeros(m, np.uint64)
    for j in range(size):
        total += h[j : j + m] * odd[j]
    whole = np.flatnonzero(text[:m] == text[size - 1 :]) if m else np.zeros(0, np.int64)
    short = np.flatnonzero((many > 0) & (many < size))
    first = np.cumsum(many) - many
    few = np.array([(h[f : f + k] * odd[:k]).sum(dtype=np.uint64) + np.uint64(k) for f, k in zip(first[short].tolist(), many[short].tolist(), strict=True)], np.uint64)
    t, x = _sorted(np.concatenate([text[whole], short]), _remixed(np.concatenate([total[whole], few]), 3))
    new = np.append(True, (t[1:] != t[:-1]) | (x[1:] != x[:-1]))[: len(t)]
    t, x = t[new], x[new]
    return t, x, np.searchsorted(t, np.arange(n + 1))


def votes(text: np.ndarray, h: np.ndarray, n: int, prints: int) -> np.ndarray:
    """(n, prints): fingerprints of the texts' distinct words, each under a hash of its own: the bits that over half of them have."""
    t, x = _sorted(text, h)
    new = np.append(True, (t[1:] != t[:-1]) | (x[1:] != x[:-1]))[: len(t)]
    t, x = t[new], x[new]
    size, out = np.bincount(t, minlength=n), np.zeros((n, prints), np.uint64)
    for p in range(prints):
        total = np.zeros((n, 64), np.int64)
        for i in range(0, len(t), _BITS):
            own, first = np.unique(t[i : i + _BITS], return_index=True)
            bits = np.unpackbits(_remixed(x[i : i + _BITS], p + 4).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            # Eight counters of a byte are added at once, 255 words at most.
            many = np.diff(np.append(first, len(bits)))
            start = np.flatnonzero((np.arange(len(bits)) - np.repeat(first, many)) % 255 == 0)
            part = np.add.reduceat(bits.view(np.uint64), start, axis=0).view(np.uint8)
            total[own] += np.add.reduceat(part, np.searchsorted(start, first), axis=0, dtype=np.int64)
        out[:, p] = np.packbits(total * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def signatures(df: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(id, h, g, fps, low, n, w): hash of the words in order, fingerprints, smallest shingle hashes, numbers of distinct shingles and of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in chunks(b.column(1), CHUNK):
                raw, ends, n = data.tobytes(), at.tolist(), j - i
                wide = np.frombuffer(b"".join([xxhash.xxh3_128_digest(b" ".join(words(raw[ends[k] : ends[k + 1]]))) for k in range(n)]), np.int64).reshape(-1, 2)
                t, h = word_hashes(data, at)
                fps = votes(t, h, n, PRINTS)
                _, x, first = shingles_of(t, h, size, n)
                low = np.minimum(np.diff(first), LOW)
                edge = np.append(0, np.cumsum(low))
                keep = np.repeat(first[:-1] - edge[:-1], low) + np.arange(edge[-1])
                lists = lambda flat, e: pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield batch(id=b.column(0).slice(i, n), h=wide[:, 0].copy(), g=wide[:, 1].copy(), fps=lists(fps.ravel(), np.arange(n + 1) * PRINTS), low=lists(x[keep], edge), n=np.diff(first).astype(np.int32), w=np.bincount(t, minlength=n).astype(np.int32))

    return map_batches(df.select(F.col(key).cast("bigint"), utf8(text)), run, "id bigint, h bigint, g bigint, fps array<bigint>, low array<bigint>, n int, w int")


def occurrences(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of (word, how often it has occurred so far) of n texts, sorted in each, where each text's begin): sets of them overlap as the texts' bags of words do."""
    t, x = _sorted(text, h)
    new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (x[1:] != x[:-1]))[: len(t)])
    nth = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x))))
    x = _remixed(x + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), 1)
    return _sorted(t, x)[1], np.searchsorted(t, np.arange(n + 1))


def bags_of(df: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(id, bag, own): the sorted distinct shingle hashes of a text, and its ``occurrences``, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in chunks(b.column(1), CHUNK):
                t, h = word_hashes(data, at)
                _, x, first = shingles_of(t, h, size, j - i)
                y, begin = occurrences(t, h, j - i)
                blobs = lambda v, e: pa.array([v[p:q].tobytes() for p, q in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)], pa.binary())
                yield batch(id=b.column(0).slice(i, j - i), bag=blobs(x, first), own=blobs(y, begin))

    return map_batches(df.select(F.col(key).cast("bigint"), utf8(text)), run, "id bigint, bag binary, own binary")


def jaccard(bags: list[np.ndarray]) -> np.ndarray:
    """Similarities of all pairs of sets; two empty sets are equal.  Common elements are counted as products of 0/1 matrices, over the elements that two sets or more have."""
    n = len(bags)
    size = np.array([len(x) for x in bags])
    item, at = np.unique(np.concatenate(bags), return_inverse=True) if size.sum() else (np.zeros(0), np.zeros(0, int))
    row = np.repeat(np.arange(n), size)
    shared = np.bincount(at, minlength=len(item)) > 1
    use = shared[at]
    column, row = (np.cumsum(shared) - 1)[at[use]], row[use]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((n, n), np.float32)
    width = 4096
    for c in range(0, int(shared.sum()), width):
        s, e = np.searchsorted(column, (c, c + width))
        m = np.zeros((n, width), np.float32)
        m[row[s:e], column[s:e] - c] = 1
        common += m @ m.T
    either = size[:, None] + size[None, :] - common.astype(np.float64)
    return np.where(either > 0, common, 1) / np.maximum(either, 1)


def alike(bags: list[np.ndarray], own: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of near copies among texts of these shingles and words."""
    s, w = jaccard(bags), jaccard(own)
    return np.nonzero(np.triu((s >= similarity - 1e-9) | ((w >= similarity - 1e-9) & (s >= LOOSE)), 1))


def near(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], similarity: float) -> bool:
    """Whether two texts, each given by its shingles and its words, are near copies."""

    def share(a: np.ndarray, b: np.ndarray) -> float:
        if not (len(a) and len(b)):
            return float(len(a) == len(b))
        common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return common / (len(a) + len(b) - common)

    s = share(x[0], y[0])
    return s >= similarity - 1e-9 or (s >= LOOSE and share(x[1], y[1]) >= similarity - 1e-9)


def _sets(b: pa.RecordBatch, *columns: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The sets of hashes of each row, of these columns of bytes."""
    return zip(*[[np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(c)] for c in columns], strict=True)


def _alike_in_groups(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Reads rows (c, g, id, bag, own) sorted by (c, g); yields links (a, b) that make each group's components."""
    now, ids, sets = None, [], []

    def links() -> pa.RecordBatch:
        a, b = alike([x for x, _ in sets], [y for _, y in sets], similarity)
        root = roots(len(ids), a, b)
        at, own = np.array(ids), np.flatnonzero(root != np.arange(len(ids)))
        return batch(a=at[own], b=at[root[own]])

    for x in batches:
        for c, g, i, both in zip(*[x.column(k).to_pylist() for k in range(3)], _sets(x, 3, 4), strict=True):
            if (c, g) != now:
                if len(ids) > 1:
                    yield links()
                now, ids, sets = (c, g), [], []
            ids.append(i)
            sets.append(both)
    if len(ids) > 1:
        yield links()


def _star(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Reads rows (c, salt, role, id, bag, own) sorted by the first three, hubs (role 0) first; yields links (member, hub): a member's first, and all of a hub's."""
    now, hubs = None, {}
    for x in batches:
        a, b = [], []
        for c, salt, role, i, both in zip(*[x.column(k).to_pylist() for k in range(4)], _sets(x, 4, 5), strict=True):
            if (c, salt) != now:
                now, hubs = (c, salt), {}
            if not role:
                hubs[i] = both
                continue
            for k, hub in hubs.items():
                if k != i and near(both, hub, similarity):
                    a.append(i)
                    b.append(k)
                    if i not in hubs:
                        break
        yield batch(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))


def _grouped(members: DataFrame, work: Workspace, similarity: float, block: int, known: DataFrame | None = None) -> DataFrame:
    """(a, b): links that make the components of near copies inside each group.  members: a written table c, id, bag, own; known: links (a, b) found before."""
    parts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = members.groupBy("c").agg(F.count("*").alias("n"))
    big = work.keep(sizes.filter(F.col("n") > block), "big-groups")
    edges, main = None, None
    if big.limit(1).count():
        crowd = members.join(big, "c").withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / STAR)).cast("int"))
        hubs = work.keep(members.join(big, "c").groupBy("c", F.pmod(F.xxhash64(F.lit("hub"), "id"), F.lit(HUBS)).alias("h"), "n").agg(F.min("id").alias("id")).select("c", "n", "id").distinct(), "hubs")
        spread = members.join(hubs, ["c", "id"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / STAR).cast("int") - 1)))
        wide = lambda df, role: df.select("c", "salt", F.lit(role).alias("role"), "id", "bag", "own")
        rows = wide(spread, 0).union(wide(crowd, 1)).repartition(parts, "c", "salt").sortWithinPartitions("c", "salt", "role")
        edges = work.keep(map_batches(rows, functools.partial(_star, similarity=similarity), "a bigint, b bigint"), "star")
        tied = work.keep(components(edges if known is None else edges.union(known), work), "star-tied")
        # The part of a group that most of its texts are in needs no comparison of its own.
        held = members.select("c", "id").join(big, "c").join(tied, F.col("id") == F.col("node")).groupBy("c", "component").agg(F.count("*").alias("m"))
        main = held.groupBy("c").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
        main = work.keep(tied.join(main, F.col("component") == F.col("main")).select("c", F.col("node").alias("id"), F.lit(True).alias("in_main")), "main")
    placed = members if main is None else members.join(main, ["c", "id"], "left")
    placed = placed.withColumn("in_main", F.lit(False) if main is None else F.coalesce("in_main", F.lit(False)))
    weight = F.octet_length("bag") + F.octet_length("own")
    count = lambda which: F.greatest(F.ceil(F.count(F.when(which, 1)) / block), F.ceil(F.coalesce(F.sum(F.when(which, weight)), F.lit(0)) / SET_BYTES)).cast("int")
    blocks = work.keep(placed.groupBy("c").agg(count(F.col("in_main")).alias("tied"), count(~F.col("in_main")).alias("rest"), F.count("*").alias("n")).filter("rest > 0 and n > 1").drop("n"), "blocks")
    placed = placed.join(blocks, "c")
    place = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.col(n), F.lit(1))).cast("int")
    # Blocks of the rest meet each other and the blocks of the tied part, which don't meet each other.
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest, most = placed.filter("not in_main").withColumn("at", place("rest")), placed.filter("in_main").withColumn("at", place("tied"))
    out = lambda df, g: df.select("c", g.cast("bigint").alias("g"), "id", "bag", "own")
    rows = out(rest.withColumn("j", over("rest")), F.least("at", "j") * F.col("rest") + F.greatest("at", "j"))
    if main is not None:
        rows = rows.union(out(rest.filter("tied > 0").withColumn("j", over("tied")), -1 - (F.col("j") * F.col("rest") + F.col("at"))))
        rows = rows.union(out(most.withColumn("j", over("rest")), -1 - (F.col("at") * F.col("rest") + F.col("j"))))
    dealt = rows.repartition(parts, "c", "g").sortWithinPartitions("c", "g")
    more = work.keep(map_batches(dealt, functools.partial(_alike_in_groups, similarity=similarity), "a bigint, b bigint"), "near")
    return more if edges is None else edges.union(more)


# Pairs by sketches


def _postings(sigs: DataFrame) -> DataFrame:
    """(s, id, c, n, w, need) of what pairs a text: KEYS shingles of its sketch that are not common, and how many of them a pair must
    share; and with need 0, for a text whose sketch is common for the most part, the GROUPS common shingles that it is grouped by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, size = b.column(4).flatten().to_numpy(), b.column(4).value_lengths().to_numpy()
            first = np.cumsum(size) - size
            row = np.repeat(np.arange(b.num_rows), size)
            place = np.arange(len(low)) - first[row]
            common = np.zeros(len(low), bool)
            moved = pc.fill_null(pc.list_value_length(b.column(5)), 0).to_numpy(zero_copy_only=False)
            at = b.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            common[first[np.repeat(np.arange(b.num_rows), moved)] + at] = True
            share = np.bincount(row[common], minlength=b.num_rows) / np.maximum(size, 1)
            rank = lambda which: np.cumsum(which) - np.repeat((np.cumsum(which) - which)[np.minimum(first, max(0, len(which) - 1))], size) - 1  # noqa: E731  # place among those of the text
            rare, often = (rank(~common), rank(common)) if len(low) else (place, place)
            by, group = ~common & (rare < KEYS), common & (often < GROUPS) & (share[row] >= MOSTLY)
            full = np.bincount(row[by], minlength=b.num_rows) >= KEYS
            need = np.where(full & (share < 0.25), SHARED, 1)
            for use, of in ((by, need), (group, np.zeros(b.num_rows, np.int64))):
                own = row[use]
                yield pa.RecordBatch.from_arrays([pa.array(low[use]), *[b.column(i).take(pa.array(own)) for i in range(4)], pa.array(of[own].astype(np.int32))], names=["s", "id", "c", "n", "w", "need"])

    return map_batches(sigs.select("id", "c", "n", "w", "low", "moved"), run, "s bigint, id bigint, c bigint, n int, w int, need int")


def sketch_pairs(sigs: DataFrame, work: Workspace, similarity: float, common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """What the sketches say may be near copies: pairs (a, b), a < b, and groups (c, id).

    sigs: a written table id, c (component), n, w, low.  A shingle that more than ``common`` sketches hold pairs nobody, so a
    shingle gives at most a bounded number of pairs for each text that holds it, however many quote a passage.  Texts that consist
    of such shingles for the most part are grouped by them instead, to be compared without their pairs ever being listed.
    Texts of one component are tied already and aren't paired; nor are those whose sizes don't allow the similarity.
    """
    each = sigs.select("id", F.posexplode("low").alias("pos", "s"))
    often = work.keep(each.groupBy("s").agg(F.count("*").alias("count")).filter(F.col("count") > common).select("s"), "common")
    flags = work.keep(each.join(often, "s", "left_semi").groupBy("id").agg(F.collect_set("pos").alias("moved")), "flags")  # at most LOW for each text
    rows = work.keep(_postings(sigs.join(flags, "id", "left")), "postings")
    parts = int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.filter("need > 0").select("s", "id", "c", "n", "w", "need").repartition(parts, "s").sortWithinPartitions("s")
    met = work.keep(map_batches(dealt, functools.partial(_met, similarity=similarity), "a bigint, b bigint, need int"), "met")
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("k"), F.min("need").alias("need")).filter("k >= need").select("a", "b")
    groups = rows.filter("need = 0").select(F.col("s").alias("g"), "id", "c")
    mixed = work.keep(groups.groupBy("g").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("g"), "mixed")
    return pairs, near_some(groups, mixed, "g").select(F.col("g").alias("c"), "id").distinct()


def _met(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Reads rows (s, id, c, n, w, need) sorted by s; yields the pairs of each s that aren't of one component, if their sizes allow the similarity."""
    held: list[np.ndarray] = []

    def pairs(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s, ids, c, n, w, need = x
        new = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        ends = np.append(new[1:], len(s))
        mixed = np.minimum.reduceat(c, new) != np.maximum.reduceat(c, new)
        end = np.repeat(ends, ends - new)
        live = np.flatnonzero(np.repeat(mixed, ends - new))
        close = lambda v, i, j: np.minimum(v[i], v[j]) >= similarity * np.maximum(v[i], v[j]) - 1e-6
        lag = 1
        while True:
            live = live[live + lag < end[live]]
            if not len(live):
                return
            i, j = live, live + lag
            ok = (c[i] != c[j]) & (ids[i] != ids[j]) & (close(n, i, j) | close(w, i, j))
            i, j = i[ok], j[ok]
            if len(i):
                yield batch(a=np.minimum(ids[i], ids[j]), b=np.maximum(ids[i], ids[j]), need=np.minimum(need[i], need[j]))
            lag += 1

    for x in regrouped(batches, 100_000):
        if not x.num_rows:
            continue
        now = [x.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        if held:
            now = [np.concatenate([p, q]) for p, q in zip(held, now, strict=True)]
        last = int(np.flatnonzero(np.append(True, now[0][1:] != now[0][:-1]))[-1])  # its group may go on in the next batch
        held = [c[last:] for c in now]
        if last:
            yield from pairs([c[:last] for c in now])
    if held:
        yield from pairs(held)


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Reads rows (a, b, bag, own, bag, own) of pairs; yields the pairs that are near copies."""
    for t in batches:
        keep = [near((p, q), (r, s), similarity) for p, q, r, s in _sets(t, 2, 3, 4, 5)]
        yield t.select(["a", "b"]).take(pa.array(np.flatnonzero(keep)))


def near_some(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """df's rows whose key is (left_semi) or isn't (left_anti) among ids, a written table with a column of that name; few ids are sent to every task."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, how)


def similar_groups(df: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, radius: int = 4, block: int = SET_BLOCK) -> DataFrame:
    """(key, component_id) of the rows whose key isn't null: texts tied by near copies share the smallest key reachable."""
    given = df.filter(F.col(key).isNotNull())
    marks = work.keep(signatures(given, size, key, text), "signatures")
    points = work.keep(marks.groupBy("h", "g").agg(F.min("id").alias("id")), "distinct")
    sigs = work.keep(marks.join(points, ["id", "h", "g"], "left_semi").select("id", "fps", "low", "n", "w"), "distinct-signatures")
    each = sigs.select("id", F.posexplode("fps").alias("p", "fp"))
    # Different texts of one fingerprint are tied to its first; the others don't need to be looked up.
    firsts = work.keep(each.groupBy("p", "fp").agg(F.min("id").alias("id")), "firsts")
    same = each.join(firsts.withColumnRenamed("id", "first"), ["p", "fp"]).filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    maybe = work.keep(components(near_links(firsts, work, radius).union(same), work), "candidates")
    texts = lambda ids: bags_of(near_some(given, ids, key).select(key, text), size, key, text)
    bags = work.keep(texts(work.keep(maybe.select(F.col("node").alias(key)), "members")), "bags")
    members = work.keep(bags.join(maybe, F.col("id") == F.col("node")).select(F.col("component").alias("c"), "id", "bag", "own"), "group-bags")
    work.drop(bags)
    edges = _grouped(members, work, similarity, block)
    tied = components(edges, work).select(F.col("node").alias("id"), "component")
    firm = work.keep(sigs.drop("fps").join(tied, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"), "firm")
    pairs, groups = (work.keep(x, name) for x, name in zip(sketch_pairs(firm, work, similarity), ("pairs", "groups"), strict=True))
    if groups.limit(1).count():
        bags = work.keep(texts(work.keep(groups.select(F.col("id").alias(key)).distinct(), "grouped")), "bags")
        members = work.keep(groups.join(bags, "id").select("c", "id", "bag", "own"), "group-bags")
        edges = edges.union(_grouped(members, work, similarity, block, edges))
    ends = work.keep(pairs.select(F.col("a").alias(key)).union(pairs.select("b")).distinct(), "ends")
    bags = work.keep(texts(ends), "pair-bags")
    side = lambda end: bags.select(F.col("id").alias(end), F.col("bag").alias(f"bag_{end}"), F.col("own").alias(f"own_{end}"))
    held = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "bag_a", "own_a", "bag_b", "own_b")
    more = work.keep(map_batches(held, functools.partial(_similar, similarity=similarity), "a bigint, b bigint"), "more")
    tied = components(edges.union(more), work)
    classes = points.join(tied, points["id"] == tied["node"], "left").select("h", "g", F.coalesce("component", "id").alias("component_id"))
    return marks.select("id", "h", "g").join(classes, ["h", "g"]).select(F.col("id").alias(key), "component_id")
