"""A quality classifier by importance resampling with hashed n-gram models.

Two bag-of-n-gram models over BUCKETS hash buckets (words and punctuation runs, and pairs of them) are counted: one of
target text, one of all text.  A document's log importance weight is the log ratio of their likelihoods of it (Xie et al.,
"Data Selection for Language Models via Importance Resampling", 2023).  Documents are drawn without replacement by
Gumbel top-k: to the weight a Gumbel noise is added, and the k largest sums are kept.

The draw adds the noise to the plain log ratio, unless ``evidence`` is given: the full ratio grows with length and ranks by
it, since n-grams of a text aren't independent, so ``evidence`` says how many n-grams count as independent, and the weight
becomes the mean per n-gram times it.  Noise is a hash of the id, so reruns agree.

The target model is learned from at most TARGET_DOCS labelled documents (a hash of the id picks them); the raw model, the
weights and the draw cover all documents.  k is the share of good ones among all labels, times the number of documents.

Edge cases: a null, empty or white text has no n-grams and weight 0, neither good nor bad.  Ties at the cut go to the
smaller id, null ids before all others; rows equal in both share their fate, so that more than k rows may be in.  With no labels at all k is all.  Extra columns play no part.  Texts of any length are done whole, in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Workspace, batch, chunks, map_batches, utf8

BUCKETS = 10_000
TARGET_DOCS = 20_000

#: N-grams of a text that the registered queries count as independent.
EVIDENCE = 400

#: Bytes of text whose n-grams are made at once; their arrays take some 50 times as much.
CHUNK = 1 << 20

_LOWER = np.frombuffer(LOWER, np.uint8)
_KIND = np.full(256, 2, np.uint8)  # 0: white, 1: word, 2: punctuation
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = 1
_POWERS = np.cumprod(np.full(1 << 12, 0x100000001B3, np.uint64), dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all (splitmix64's constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(data: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every token and every pair of neighbouring tokens of the texts data[at[i]:at[i+1]]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[at[:-1][at[:-1] < len(data)]] = True
    cut = np.flatnonzero(new)
    size = np.diff(np.append(cut, len(data)))
    place = np.arange(len(data)) - np.repeat(cut, size)
    h = np.add.reduceat((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _POWERS[place & (len(_POWERS) - 1)], cut)
    token = kind[cut] > 0
    cut, h = cut[token], _mix(h[token])
    text = np.searchsorted(at, cut, "right") - 1
    pair = text[1:] == text[:-1]
    two = _mix(h[:-1][pair] * np.uint64(0x9E3779B97F4A7C15) + h[1:][pair])
    return np.concatenate([text, text[1:][pair]]), (np.concatenate([h, two]) % np.uint64(buckets)).astype(np.int64)


def _counts(df: DataFrame) -> np.ndarray:
    """Bucket counts of (all text, target text); df: bytes, target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            target = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, at in chunks(b.column(0), CHUNK):
                text, bucket = ngrams(data, at)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[target[i:j][text]], minlength=BUCKETS)
        full = np.flatnonzero(total[0])
        yield batch(bucket=full, every=total[0][full], target=total[1][full])

    rows = map_batches(df, run, "bucket bigint, every bigint, target bigint").groupBy("bucket").agg(F.sum("every"), F.sum("target")).collect()  # at most BUCKETS
    out = np.zeros((2, BUCKETS), np.int64)
    for bucket, every, target in rows:
        out[:, bucket] = every, target
    return out


def learn(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str = "toxic") -> tuple[np.ndarray, float]:
    """(log ratio of each bucket, share of good documents among the labelled)."""
    good = (F.col(quality) == 1) & (F.coalesce(F.col(toxic), F.lit(0)) == 0)
    seen = labels.filter(F.col(key).isNotNull() & F.col(quality).isNotNull())
    n, ok, pure = seen.agg(F.count("*"), F.count(F.when(F.col(quality) == 1, 1)), F.count(F.when(good, 1))).first()
    unit = 1_000_000
    take = F.pmod(F.xxhash64(F.lit("target"), key), F.lit(unit)) < -(-unit * TARGET_DOCS // max(1, pure))
    picked = F.broadcast(seen.filter(good & take).select(F.col(key).alias("__id")).distinct().limit(2 * TARGET_DOCS))  # bounded
    rows = df.select(F.col(key).alias("__key"), utf8(text).alias("bytes")).join(picked, F.col("__key") == F.col("__id"), "left")
    every, target = _counts(rows.select("bytes", F.col("__id").isNotNull().alias("target")))
    p, q = (target + 1) / (target.sum() + BUCKETS), (every + 1) / (every.sum() + BUCKETS)
    share = ok / n if n else 1.0
    return (np.log(p) - np.log(q) if target.sum() else np.zeros(BUCKETS)), share


def weigh(df: DataFrame, ratio: np.ndarray, key: str = "doc_id", text: str = "text", evidence: float | None = None) -> DataFrame:
    """(key, n_grams, log_weight, gumbel_key) of every row; log_weight is the plain log ratio."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in chunks(b.column(1), CHUNK):
                text, bucket = ngrams(data, at)
                n = np.bincount(text, minlength=j - i)
                w = np.bincount(text, weights=shared.value[bucket], minlength=j - i).astype(np.float64)  # numpy gives int for no n-grams
                yield batch(**{key: b.column(0).slice(i, j - i), "n_grams": n, "log_weight": w})

    out = map_batches(df.select(key, utf8(text)), run, f"`{key}` {kind}, n_grams bigint, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    noise = -F.log(-F.log(uniform))
    weight = F.col("log_weight") if evidence is None else F.col("log_weight") / F.greatest("n_grams", F.lit(1)) * float(evidence)
    return out.withColumn("gumbel_key", weight + noise)


def top_k(df: DataFrame, k: int, value: str, tie: str, out: str = "selected") -> DataFrame:
    """df with a flag of the k rows of the largest value, ties by the smaller id.  df is read several times: give it a written table.

    The k-th largest value is found by counting rows in ever narrower ranges of the value; rows are never gathered or sorted as a whole.
    """
    n, low, high = df.agg(F.count("*"), F.min(value), F.max(value)).first()
    if k >= n:
        return df.withColumn(out, F.lit(True))
    if k <= 0:
        return df.withColumn(out, F.lit(False))
    above, bins = 0, 1000  # rows over the range [low, high] that holds the k-th
    while True:
        width = (high - low) / bins
        inside = df.filter((F.col(value) >= low) & (F.col(value) <= high))
        if not width or low + width == low:
            break
        slot = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
        counts = dict(inside.groupBy(slot.alias("slot")).agg(F.struct(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))).collect())
        for slot_ in sorted(counts, reverse=True):
            if above + counts[slot_]["n"] >= k:
                break
            above += counts[slot_]["n"]
        low, high = counts[slot_]["low"], counts[slot_]["high"]
        if low == high:
            break
    # All rows left share one value: the k - above smallest ids of them are in.
    tied = df.filter(F.col(value) == low)
    rows, known = tied.agg(F.count("*"), F.count(tie)).first()
    edge, wanted = F.col(value) == low, k - above
    if wanted < rows:
        first = F.col(tie).isNull()  # null ids come first
        nulls = rows - known
        edge &= first | (F.col(tie) <= F.lit(_nth_smallest(tied, wanted - nulls, tie))) if wanted > nulls else first
    return df.withColumn(out, F.coalesce((F.col(value) > low) | edge, F.lit(False)))


def _nth_smallest(df: DataFrame, n: int, column: str) -> int:
    """The n-th smallest of an integer column's values that aren't null, by halving its range."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        middle = (low + high) // 2
        if df.filter(F.col(column) <= middle).count() >= n:
            high = middle
        else:
            low = middle + 1
    return low


def resample(df: DataFrame, labels: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", share: float | None = None, evidence: float | None = None) -> DataFrame:
    """(key, n_grams, log_weight, gumbel_key, selected) of every row; share: of all documents, else as good as the labels say."""
    ratio, good = learn(df, labels, key, text)
    keys = work.keep(weigh(df, ratio, key, text, evidence), "weights")
    return top_k(keys, round(keys.count() * (good if share is None else share)), "gumbel_key", key)
