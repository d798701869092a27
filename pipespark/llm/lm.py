"""Language-model scoring with a hidden Markov model over words.

A text is its words, A-Z lower-cased, and one end.  The model has STATES latent states; each emits a symbol and then moves.
Symbols are the most frequent words (at most WORDS of them), one class for each of CLASSES endings for all other words,
and the end.  A word of a class is drawn from the class by its add-one share, so every word has a probability.  A class
keeps the share of one unseen word, and every unseen word gets it: over all conceivable words the shares add up to more than
one, as those of the add-one base do.  The scaled forward recursion gives the exact log probability of a whole text.

Training is Baum-Welch.  Word counts of all training texts are made first; then each iteration runs forward-backward over
every training text, and the tasks' expected counts are added up in the cluster before one table of fixed size
(symbols x states) comes to the driver.  Starting values come from a bounded sample, START_DOCS texts of at most START_TOKENS
tokens; every iteration after that covers all.  What grows with the corpus are the counts, which are of all words; the
states tell only the WORDS most frequent words apart, however large it is.  Texts of one batch run side by side, longest first, so that a step is one small matrix product for all of
them; alphas are kept for STEPS steps at a time and made again from the last kept one on the way back, so memory doesn't
grow with the length of a text.

Counts of words that are too rare to send to every task (below the LOOKUP most frequent) are joined to the texts' words
by a shuffle.  They are rare, so that join has no heavy key.

Edge cases: a null, empty or wordless text is just its end.  Without training texts every count is zero, the base is 0
for all, and the model is what its priors say.  Repeated rows count each time; null ids are allowed and train as their remainder
says.  Texts of any length are done whole.  Extra columns play no part.
"""

from __future__ import annotations

import dataclasses
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, batch, chunks, map_batches, regrouped, utf8, words

STATES = 8
WORDS = 65_000
CLASSES = 256
LOOKUP = 400_000
ITERATIONS = 3

#: Texts and tokens of the sample that gives the starting values, and its iterations.
START_DOCS, START_TOKENS, START_ITERATIONS = 1500, 20_000, 14

#: Tokens (with padding) that run side by side, and steps whose alphas are kept.
_SIDE_BY_SIDE, STEPS = 1 << 19, 1 << 15

#: Texts that are sorted by length together.
TEXTS = 4096

#: Distinct words that a counting task holds before it passes them on.
_HELD_WORDS = 500_000

#: Symbols of a row of expected counts on its way to be added up.
_ROW = 64


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def _ending_column(word: str) -> Column:
    return F.pmod(F.crc32(F.when(F.octet_length(word) <= 3, F.col(word)).otherwise(F.substring(word, -3, 3))), F.lit(CLASSES)).cast("int")


# Forward and backward


def _side_by_side(seqs: list[np.ndarray], fill: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of the sequences, longest first; their lengths; (steps, sequences) symbols padded with fill), in batches of bounded size."""
    size = np.array([len(s) for s in seqs])
    order = np.argsort(-size, kind="stable")
    i = 0
    while i < len(order):
        n = max(1, _SIDE_BY_SIDE // max(1, size[order[i]]))
        part = order[i : i + n]
        x = np.full((size[part[0]], len(part)), fill, np.uint16)
        for j, k in enumerate(part):
            x[: size[k], j] = seqs[k]
        yield part, size[part], x
        i += n


def _forward(x, active, start, move, emit, t0, t1, last, keep):
    """Steps t0..t1 from the alphas ``last`` (states x sequences); their log scales, and with ``keep`` alphas, scales and emissions of each step.

    Arrays have the sequences last, so that every operation runs along memory.
    """
    e = emit[x[t0:t1]]
    total, onward = np.zeros(x.shape[1]), np.ascontiguousarray(move.T)
    alphas = np.empty((t1 - t0, len(start), x.shape[1])) if keep else None
    scales = np.empty((t1 - t0, x.shape[1])) if keep else None
    for t in range(t0, t1):
        m = active[t]
        a = onward @ last[:, :m] if t else np.repeat(start[:, None], m, 1)
        a *= e[t - t0, :m].T
        s = a.sum(0)
        a /= s
        last[:, :m] = a
        total[:m] += np.log(s)
        if keep:
            alphas[t - t0, :, :m], scales[t - t0, :m] = a, s
    return total, alphas, scales, e


def log_likelihoods(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log of each sequence's probability."""
    out = np.zeros(len(seqs))
    for part, size, x in _side_by_side(seqs):
        active = np.searchsorted(-size, -np.arange(len(x)), "left")
        last = np.zeros((len(start), len(part)))
        for t0 in range(0, len(x), STEPS):
            out[part] += _forward(x, active, start, move, emit, t0, min(len(x), t0 + STEPS), last, False)[0]
    return out


def expected_counts(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(first states, moves, emissions, log likelihood) expected over the sequences."""
    k, n_symbols = emit.shape[1], len(emit)
    c_start, c_move, c_emit, loglik = np.zeros(k), np.zeros((k, k)), np.zeros((k, n_symbols + 1)), 0.0
    padded = np.vstack([emit, np.zeros((1, k))])  # padding is one more symbol, whose counts are dropped
    for part, size, x in _side_by_side(seqs, n_symbols):
        active = np.searchsorted(-size, -np.arange(len(x) + 1), "left")
        last = np.zeros((k, len(part)))
        cuts = list(range(0, len(x), STEPS))
        at_cut = []
        for t0 in cuts[:-1]:
            at_cut.append(last.copy())
            loglik += _forward(x, active, start, move, padded, t0, t0 + STEPS, last, False)[0].sum()
        at_cut.append(last)
        beta, after = np.ones((k, len(part))), None  # after: (emissions, scales) of the step that follows
        for t0, last in zip(reversed(cuts), reversed(at_cut), strict=True):
            t1 = min(len(x), t0 + STEPS)
            total, alphas, scales, e = _forward(x, active, start, move, padded, t0, t1, last.copy(), True)
            if t0 == cuts[-1]:
                loglik += total.sum()
            xi = np.zeros((k, k))
            for t in range(t1 - 1, t0 - 1, -1):
                m, n = active[t], active[t + 1]
                if n:
                    e1, s1 = (e[t + 1 - t0, :n], scales[t + 1 - t0, :n]) if t + 1 < t1 else after
                    u = beta[:, :n] * e1.T
                    u /= s1
                    xi += alphas[t - t0, :, :n] @ u.T
                    beta[:, :n] = move @ u
                alphas[t - t0, :, :m] *= beta[:, :m]  # now the posterior
                alphas[t - t0, :, m:] = 0
            after = (e[0, : active[t0]], scales[0, : active[t0]])
            c_move += xi * move
            if t0 == 0:
                c_start += alphas[0].sum(1)
            symbols = x[t0:t1].ravel()
            for j in range(k):
                c_emit[j] += np.bincount(symbols, weights=alphas[:, j].ravel(), minlength=n_symbols + 1)
    return c_start, c_move, c_emit[:, :-1].T, loglik


def maximised(c_start: np.ndarray, c_move: np.ndarray, c_emit: np.ndarray, prior: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model of expected counts; ``weight`` pseudo-counts are spread as ``prior`` over each state's symbols."""
    start, move, emit = c_start + 0.1, c_move + 0.1, c_emit + weight * prior[:, None]
    return start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0, keepdims=True)


def starting_model(seqs: list[np.ndarray], prior: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A model fitted to a small sample, from random emissions and states that tend to stay."""
    rng = np.random.default_rng(seed)
    emit = prior[:, None] * np.exp(rng.normal(0, 1, (len(prior), STATES)))
    emit /= emit.sum(0)
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    model = np.full(STATES, 1 / STATES), move, emit
    for _ in range(START_ITERATIONS if seqs else 0):
        model = maximised(*expected_counts(seqs, *model)[:3], prior, 200.0)
    return model


# Counts and encoding


@dataclasses.dataclass
class Vocabulary:
    """What every task needs to encode texts: the LOOKUP most frequent words, the first n_own of them symbols of their own."""

    entries: list[bytes]
    counts: np.ndarray
    n_own: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    texts: int
    tokens: int
    distinct: int

    @property
    def symbols(self) -> int:
        return self.n_own + CLASSES + 1

    def class_log(self) -> np.ndarray:
        """log10 of the share of a word of count zero in each class."""
        return -np.log10(self.class_tokens + self.class_words + 1.0)

    def prior(self) -> np.ndarray:
        """Each symbol's share of the training tokens, none zero."""
        n = np.concatenate([self.counts[: self.n_own], self.class_tokens, [self.texts]]).astype(np.float64) + 0.01
        return n / n.sum()


def count_words(texts: DataFrame) -> DataFrame:
    """(w, n) of a frame of one binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for b in batches:
            for _, _, data, _ in _joined_texts(b.column(0)):
                held.update(data)
                if len(held) > _HELD_WORDS:
                    yield batch(w=pa.array(list(held), pa.binary()), n=np.fromiter(held.values(), np.int64, len(held)))
                    held = Counter()
        if held:
            yield batch(w=pa.array(list(held), pa.binary()), n=np.fromiter(held.values(), np.int64, len(held)))

    return map_batches(texts, run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def _joined_texts(column: pa.Array) -> Iterator[tuple[int, int, list[bytes], np.ndarray]]:
    """(first row, row after the last, all their words, the number of each row's words)."""
    for i, j, data, at in chunks(column):
        raw, ends = data.tobytes(), at.tolist()
        every, sizes = [], []
        for k in range(j - i):
            w = words(raw[ends[k] : ends[k + 1]])
            every += w
            sizes.append(len(w))
        yield i, j, every, np.array(sizes, np.int64)


def _cut(hist: list[tuple[int, int]], limit: int) -> int:
    """The least count such that at most ``limit`` words have it or more.  hist: (least count of a range of counts, words in it)."""
    total, cut = 0, 1 + max((n for n, _ in hist), default=0)
    for n, m in sorted(hist, reverse=True):
        total += m
        if total > limit:
            break
        cut = n
    return cut


def vocabulary(counts: DataFrame, texts: int) -> tuple[Vocabulary, int]:
    """The vocabulary of a written table of counts, and the least count that is in it."""
    big = F.lit(4096) + F.floor(F.log2(F.col("n") / F.lit(4096.0)) * 256)
    ranges = F.when(F.col("n") < 4096, F.col("n")).otherwise(big)  # some ten thousand at most
    hist = [(r["low"], r["words"]) for r in counts.groupBy(ranges).agg(F.min("n").alias("low"), F.count("*").alias("words")).collect()]
    own, known = _cut(hist, WORDS), _cut(hist, LOOKUP)
    top = counts.filter(F.col("n") >= known).select("w", "n").toArrow()  # at most LOOKUP rows
    entries = sorted(zip(top.column("w").to_pylist(), top.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    tokens, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for c, n, m in counts.filter(F.col("n") < own).groupBy(_ending_column("w").alias("c")).agg(F.sum("n"), F.count("*")).collect():
        tokens[c], kinds[c] = n, m
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_own = sum(1 for _, n in entries if n >= own)
    return Vocabulary([w for w, _ in entries], np.array([n for _, n in entries], np.int64), n_own, tokens, kinds, texts, total[0] + texts, total[1] + (texts > 0)), known


def encode(df: DataFrame, voc: Vocabulary) -> DataFrame:
    """df's columns but the last (a text's bytes), then n_tokens, known, count_log (sum of log10(count+1)), class_log, symbols (uint16) and rare (words to be joined)."""
    shared = df.sparkSession.sparkContext.broadcast(voc)  # bounded by LOOKUP
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        n = len(v.entries)
        get = dict(zip(v.entries, range(n), strict=True)).get
        rare_log = v.class_log()
        cls = np.array([ending(w) for w in v.entries[v.n_own :]], np.int64)
        symbol = np.concatenate([np.arange(v.n_own), v.n_own + cls, [0]])
        log = np.append(np.log10(v.counts + 1.0), 0.0)
        within = np.concatenate([np.zeros(v.n_own), log[v.n_own : n] + rare_log[cls], [0.0]])
        end = v.symbols - 1
        for b in batches:
            for i, j, every, sizes in _joined_texts(b.column(b.num_columns - 1)):
                idx = np.array(list(map(get, every, itertools.repeat(n))), np.int64)
                sym, inside = symbol[idx], within[idx]
                odd = np.flatnonzero(idx == n)
                unknown = [every[k] for k in odd.tolist()]
                c = np.array([ending(w) for w in unknown], np.int64)
                sym[odd], inside[odd] = v.n_own + c, rare_log[c]
                text = np.repeat(np.arange(j - i), sizes)
                add = lambda x, t=text, m=j - i: np.bincount(t, weights=x, minlength=m).astype(np.float64)
                known = sizes - np.bincount(text[odd], minlength=j - i) + (v.texts > 0)
                edge = np.concatenate([[0], np.cumsum(sizes)])
                seqs = [np.append(sym[edge[k] : edge[k + 1]], end).astype(np.uint16).tobytes() for k in range(j - i)]
                rows = np.concatenate([[0], np.cumsum(np.bincount(text[odd], minlength=j - i))]).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(rows), pa.array(unknown, pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [*[x.slice(i, j - i) for x in b.columns[:-1]], pa.array(sizes + 1), pa.array(known), pa.array(add(log[idx]) + np.log10(v.texts + 1.0)), pa.array(add(inside)), pa.array(seqs, pa.binary()), rare],
                    names=[*b.schema.names[:-1], "n_tokens", "known", "count_log", "class_log", "symbols", "rare"],
                )

    return map_batches(df, run, f"{kept}, n_tokens bigint, known bigint, count_log double, class_log double, symbols binary, rare array<binary>")


# Training and scoring


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def _iterate(seqs: DataFrame, model, spark: SparkSession) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts over all training texts.  Tasks emit rows of _ROW symbols, which are added up by row number."""
    shared = spark.sparkContext.broadcast(model)  # symbols x states
    k, n = STATES, len(model[2])

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = shared.value
        total = [np.zeros(k), np.zeros((k, k)), np.zeros((-(-n // _ROW) * _ROW, k)), 0.0]
        for b in regrouped(batches, TEXTS):
            got = expected_counts(_sequences(b.column(0)), start, move, emit)
            total[0] += got[0]
            total[1] += got[1]
            total[2][:n] += got[2]
            total[3] += got[3]
        rows = total[2].reshape(-1, _ROW * k)
        full = np.flatnonzero(rows.any(1))
        head = np.concatenate([total[0], total[1].ravel(), [total[3]]])
        yield batch(row=np.append(full, -1), sums=pa.array([*[rows[r].astype(np.float32).tobytes() for r in full], head.tobytes()], pa.binary()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.float64 if r < 0 else np.float32).astype(np.float64)
                sums[r] = sums[r] + x if r in sums else x
        if sums:
            yield batch(row=pa.array(list(sums), pa.int64()), sums=pa.array([x.tobytes() for x in sums.values()], pa.binary()))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = map_batches(map_batches(seqs, expect, "row bigint, sums binary").repartition(parts, "row"), add, "row bigint, sums binary").collect()
    emit, head = np.zeros((-(-n // _ROW), _ROW * k)), np.zeros(k + k * k + 1)
    for r, x in got:
        if r < 0:
            head = np.frombuffer(x, np.float64)
        else:
            emit[r] = np.frombuffer(x, np.float64)
    shared.unpersist()
    return head[:k], head[k:-1].reshape(k, k), emit.reshape(-1, k)[:n], float(head[-1])


def train(encoded: DataFrame, voc: Vocabulary, iterations: int = ITERATIONS, key: str = "row"):
    """(start, moves, emissions) of the training rows of a written table of encoded texts, and the log likelihood before each iteration."""
    prior, spark = voc.prior(), encoded.sparkSession
    share = max(1, -(-1_000_000 * START_DOCS // max(1, voc.texts)))
    near = encoded.filter((F.octet_length("symbols") <= 2 * START_TOKENS) & (F.pmod(F.xxhash64(key), F.lit(1_000_000)) < share))
    sample = sorted(bytes(r[0]) for r in near.select("symbols").limit(2 * START_DOCS).collect())  # bounded: START_DOCS x START_TOKENS
    model = starting_model([np.frombuffer(x, np.uint16) for x in sample], prior)
    logliks = []
    for _ in range(iterations if voc.texts else 0):
        *counts, loglik = _iterate(encoded.select("symbols"), model, spark)
        model = maximised(*counts, prior, 50.0)
        logliks.append(loglik)
    return model, logliks


def score(df: DataFrame, of_training: Column, work: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learned from those for which of_training holds."""
    spark = df.sparkSession
    docs = df.select(F.col(key), (~of_training).alias("held_out"), utf8(text).alias("bytes"))
    learning = docs.filter(~F.col("held_out"))
    counts = work.keep(count_words(learning.select("bytes")), "counts")
    voc, known = vocabulary(counts, learning.count())
    encoded = encode(docs.select(key, "held_out", F.monotonically_increasing_id().alias("row"), "bytes"), voc)
    encoded = work.keep(encoded, "encoded")
    model, _ = train(encoded.filter(~F.col("held_out")), voc)
    shared = spark.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regrouped(batches, TEXTS):
            got = log_likelihoods(_sequences(b.column(b.num_columns - 1)), *shared.value) / np.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got)], names=[*b.schema.names[:-1], "hmm"])

    scored = map_batches(encoded.select(key, "held_out", "row", "n_tokens", "known", "count_log", "class_log", "symbols"), run, f"`{key}` {kind}, held_out boolean, row bigint, n_tokens bigint, known bigint, count_log double, class_log double, hmm double")
    rare = encoded.select("row", F.explode("rare").alias("w")).join(counts.filter(F.col("n") < known), "w", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("rare_log"), F.count("n").alias("rare_known"))
    both = scored.join(rare, "row", "left").withColumns({"rare_log": F.coalesce("rare_log", F.lit(0.0)), "rare_known": F.coalesce("rare_known", F.lit(0))})
    return both.select(
        key, "held_out", "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"), F.lit(voc.tokens).cast("bigint").alias("train_tokens"),
        (F.col("count_log") + F.col("rare_log") - F.col("n_tokens") * float(np.log10(voc.tokens + voc.distinct + 1.0))).alias("base_score"),
        (F.col("hmm") + F.col("class_log") + F.col("rare_log")).alias("score"),
    )
