"""Language identification by a byte convolutional network, trained in numpy.

Text is cut into windows of WINDOW bytes, the last one padded.  Filters of several widths slide over the window's
byte symbols (A-Z lower-cased; digits, white space and other ASCII one symbol each; every byte from 0x80 its own), each
keeps its maximum, and a softmax over the maxima gives the window's languages.  A text's are the mean over its windows,
weighted by their bytes.  A filter on one-hot bytes is a sum of table look-ups, one table per offset; for prediction
the tables of two neighbouring offsets are merged into one of byte pairs, so a filter of width four costs two look-ups.

Training uses at most TRAIN_DOCS labelled documents, dealt evenly over the languages by a hash of the id; of each it sees
one window for every WINDOW_EVERY bytes begun, TRAIN_WINDOWS at most, dealt evenly over the whole text and placed by the
hash inside their parts.  Everything else covers all rows and whole texts.  Over MAX_LANGUAGES languages are an error.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if there is nothing to learn
from.  Texts of any length are done whole, in chunks.  Ties go to the language that sorts first.  Rows with a null id or a null
label are predicted like others; null labels are not learned from.  A column named like a result is replaced.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, map_batches, text_at, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8

#: The bound of the labelled sample, and of the number of languages.
TRAIN_DOCS = 4000
TRAIN_WINDOWS, WINDOW_EVERY = 4, 2048
MAX_LANGUAGES = 1000

#: Windows that are predicted at once; their activations stay in cache.
_AT_ONCE = 64


def _symbols() -> np.ndarray:
    table = np.full(256, 3, np.uint8)
    for b in (0x20, *range(0x09, 0x0E)):
        table[b] = 1
    table[ord("0") : ord("9") + 1] = 2
    for b in range(26):
        table[ord("a") + b] = table[ord("A") + b] = 4 + b
    table[0x80:] = np.arange(30, 158)
    return table


SYMBOLS, KINDS = _symbols(), 158


@dataclasses.dataclass
class Model:
    languages: list[str]
    kernels: list[np.ndarray]  # for each width: (width, KINDS, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def tables(self) -> tuple[np.ndarray, ...]:
        """Look-up tables by pair of symbols: width 2; width 3's first two and last; width 4's first two and last two."""
        k2, k3, k4 = self.kernels
        pair = lambda a, b: np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(KINDS * KINDS, FILTERS))
        return pair(k2[0], k2[1]), pair(k3[0], k3[1]), np.ascontiguousarray(k3[2]), pair(k4[0], k4[1]), pair(k4[2], k4[3])

    def probabilities(self, symbols: np.ndarray, tables: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """symbols: (WINDOW, windows).  (windows, languages)."""
        t2, t3, s3, t4, u4 = tables or self.tables()
        pairs = symbols[:-1].astype(np.int32) * KINDS + symbols[1:]
        top = [
            t2[pairs].max(0),
            (t3[pairs[:-1]] + s3[symbols[2:]]).max(0),
            (t4[pairs[:-2]] + u4[pairs[2:]]).max(0),
        ]
        h = np.maximum(np.concatenate(top, 1) + self.bias, 0)
        z = h @ self.weights + self.offset
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def window_symbols(text: bytes, start: int = 0) -> np.ndarray:
    """One window, padded with 0."""
    out = np.zeros(WINDOW, np.uint8)
    raw = np.frombuffer(text[start : start + WINDOW], np.uint8)
    out[: len(raw)] = SYMBOLS[raw]
    return out


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 5, seed: int = 7, rate: float = 0.01, size: int = 64) -> Model:
    """Adam on cross-entropy.  windows: (n, WINDOW) symbols.  Each time a window is seen it may be cut short, so that short texts are learned too."""
    rng = np.random.default_rng(seed)
    n_out, n_hid = len(languages), FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.1, (w, KINDS, FILTERS)) for w in WIDTHS] + [np.zeros(n_hid), rng.normal(0, 0.3, (n_hid, n_out)), np.zeros(n_out)]
    for p in params[: len(WIDTHS)]:
        p[:, 0, :] = 0
    params = [p.astype(np.float32) for p in params]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), size):
            x, y = windows[order[i : i + size]].copy(), labels[order[i : i + size]]
            cut = np.where(rng.random(len(x)) < 0.4, rng.integers(8, WINDOW, len(x)), WINDOW)
            x[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
            tops, where = [], []
            for k, w in zip(params, WIDTHS, strict=False):
                a = sum(k[j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
                where.append(a.argmax(1))
                tops.append(np.take_along_axis(a, where[-1][:, None, :], 1)[:, 0])
            raw = np.concatenate(tops, 1) + params[3]
            h = np.maximum(raw, 0)
            z = h @ params[4] + params[5]
            z = np.exp(z - z.max(1, keepdims=True))
            dz = z / z.sum(1, keepdims=True)
            dz[np.arange(len(y)), y] -= 1
            dz /= len(y)
            dh = (dz @ params[4].T) * (raw > 0)
            grads = []
            for m, (k, w) in enumerate(zip(params, WIDTHS, strict=False)):
                g, d = np.zeros_like(k), dh[:, m * FILTERS : (m + 1) * FILTERS]
                f = np.broadcast_to(np.arange(FILTERS), d.shape)
                for j in range(w):  # only the position of the maximum is to blame
                    np.add.at(g[j], (np.take_along_axis(x, where[m] + j, 1), f), d)
                grads.append(g)
            grads += [dh.sum(0), h.T @ dz, dz.sum(0)]
            step += 1
            pace = rate * (1 - 0.8 * epoch / max(1, epochs - 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, (m1, m2) in zip(params, grads, moments, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                p -= (pace * m1 / (np.sqrt(m2) + 1e-8)).astype(np.float32)
    return Model(languages, params[:3], *params[3:])


def learn(df: DataFrame, of_training: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model of the rows for which ``of_training`` holds and text and label are known; None if there are none."""
    rows = df.filter(of_training & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    languages = sorted(r["lang"] for r in counts)
    quota, unit = max(1, TRAIN_DOCS // len(languages)), 1_000_000
    take = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(unit, -(-unit * quota // r["count"])))])
    picked = rows.filter(F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(unit)) < take[F.col("lang")])
    picked = picked.limit(2 * TRAIN_DOCS + MAX_LANGUAGES).select("id", "lang", utf8("text").alias("raw"))
    picked = picked.withColumn("size", F.octet_length("raw")).withColumn("n", F.least(F.greatest(F.ceil(F.col("size") / WINDOW_EVERY), F.lit(1)), F.lit(TRAIN_WINDOWS)))
    picked = picked.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    part = F.floor(F.col("size") / F.col("n"))
    start = F.col("j") * part + F.pmod(F.xxhash64(F.lit("window"), "id", "j"), F.greatest(part - WINDOW + 1, F.lit(1))) + 1
    windows = picked.select("id", "lang", F.substring("raw", start.cast("int"), F.lit(WINDOW)).alias("window"))
    sample = sorted(windows.collect(), key=lambda r: (r["id"] is None, r["id"] or 0, r["lang"], bytes(r["window"])))  # bounded: TRAIN_WINDOWS of each picked text
    number = {x: i for i, x in enumerate(languages)}
    x = np.stack([window_symbols(bytes(r["window"])) for r in sample])
    y = np.array([number[r["lang"]] for r in sample])
    return train(x, y, languages)


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def predict(model: Model, tables: tuple[np.ndarray, ...], data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and scores of the texts data[at[i]:at[i+1]]."""
    n, sizes = len(at) - 1, np.diff(at)
    count = -(-sizes // WINDOW)
    text_of = np.repeat(np.arange(n), count)
    first = np.cumsum(count) - count
    start = at[:-1][text_of] + (np.arange(len(text_of)) - first[text_of]) * WINDOW
    end = np.minimum(start + WINDOW, at[1:][text_of])
    total = np.zeros((n, len(model.languages)))
    symbols = SYMBOLS[data]
    letters = np.zeros(n, bool)
    ascii_letter = (symbols >= 4) & (symbols < 30)
    if len(data):
        full = np.flatnonzero(sizes)
        letters[full] = np.maximum.reduceat(ascii_letter, at[full])
    reach = np.arange(WINDOW)[:, None]
    for i in range(0, len(start), _AT_ONCE):
        s, e = start[i : i + _AT_ONCE], end[i : i + _AT_ONCE]
        where = s[None, :] + reach
        x = symbols[np.minimum(where, len(symbols) - 1)]
        x[where >= e[None, :]] = 0
        np.add.at(total, text_of[i : i + _AT_ONCE], model.probabilities(x, tables) * (e - s)[:, None])
    best = total.argmax(1)
    score = total[np.arange(n), best] / np.maximum(sizes, 1)
    names = [model.languages[k] for k in best]
    for k in np.flatnonzero(~letters).tolist():
        if not _has_letter(data[at[k] : at[k + 1]].tobytes()):
            names[k], score[k] = "und", 0.0
    return names, np.clip(score, 0, 1)


def identify(df: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the language and score of every row."""
    df = df.drop(*[c for c in (pred, score) if c != text])
    schema = T.StructType([*df.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    if model is None:
        return df.withColumns({pred: F.lit("und"), score: F.lit(0.0)})
    shared = df.sparkSession.sparkContext.broadcast(model)
    df, place, width = text_at(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables()
        for b in batches:
            for i, j, data, at in chunks(b.column(place)):
                names, scores = predict(shared.value, tables, data, at)
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in b.columns[:width]], pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return map_batches(df, run, schema)
