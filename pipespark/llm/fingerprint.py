"""Canonical exact document fingerprints, with DataFrame and SQL functions only.

The canonical form of a text is NFKC, full case folding, NFKC again, every run of white space one space, none at
the ends.  Its fingerprint is 128 bits: two xxhash64 of the form, the second over a leading constant as well.
Equal fingerprints of different texts would be a false match, so buckets that hold several documents are compared by
bytes: grouping by (fingerprint, form) combines equal forms before anything is shuffled, and a bucket that still has
several forms has them numbered in byte order; all but the first get the number as a suffix.  An edited text that has the
hash of a document's is compared with that document's form in the same way.

Edge cases: a null text counts as empty; the empty text has a fingerprint of its own, shared by all texts of white
space only.  Texts of any length are done whole.  Repeated rows and repeated ids are kept; rows of equal id follow
each other in the order of their text, in one task for each id; null ids come first.  Extra columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace

#: Repeated fingerprints (16 bytes each) that are sent to every task; with more of them, the texts are shuffled to meet them.
BROADCAST_ROWS = 1_000_000

#: Ranges of keys at most; their bounds are a literal of the plan.
MAX_RANGES = 20_000


def _form(text: str) -> Column:
    """The canonical form of a text column that has no nulls.

    Spark SQL reaches Unicode normalisation and case folding through its own bundled ICU classes.
    """
    compose = "java_method('com.ibm.icu.text.Normalizer', 'compose', {}, true)"
    fold = f"java_method('com.ibm.icu.lang.UCharacter', 'foldCase', {compose.format(f'`{text}`')}, true)"
    # After NFKC these are the white-space characters that are left.
    return F.trim(F.regexp_replace(F.expr(compose.format(fold)), "[\\t-\\r \\x85\\u1680\\u2028\\u2029]+", " "))


def wide_hash(form: Column) -> list[Column]:
    """The two halves of the 128 bits."""
    return [F.xxhash64(form), F.xxhash64(F.lit("wide"), form)]


def hashed(df: DataFrame, text: str, form: str, a: str, b: str, hasher=wide_hash) -> DataFrame:
    df = df.withColumn(form, _form(text))
    return df.withColumns(dict(zip((a, b), hasher(F.col(form)), strict=True)))


def _rendered(a: str, b: str, n: str | None) -> Column:
    text = F.concat(F.lower(F.lpad(F.hex(a), 16, "0")), F.lower(F.lpad(F.hex(b), 16, "0")))
    return text if n is None else F.concat(text, F.when(F.col(n) > 0, F.concat(F.lit("-"), F.col(n).cast("string"))).otherwise(""))


def _marks(docs: DataFrame, work: Workspace, key: str, hasher) -> DataFrame:
    """(k, a, b): a hash of each row's key and the two halves of its text's."""
    return work.keep(hashed(docs, "text", "form", "a", "b", hasher).select(F.xxhash64(key).alias("k"), "a", "b"), "marks")


def _forms(docs: DataFrame, marks: DataFrame, wanted: DataFrame, work: Workspace, key: str, hasher) -> DataFrame:
    """(a, b, form, n, forms) of every form of the wanted fingerprints, numbered from 0 in byte order; forms is how many a fingerprint has.

    Only texts whose key has a wanted fingerprint are made canonical again.
    """
    few = lambda side: F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    side = few(wanted)
    keys = work.keep(marks.join(side, ["a", "b"], "left_semi").select("k").distinct(), "keys")
    some = docs.withColumn("k", F.xxhash64(key)).join(few(keys), "k", "left_semi").select("text")
    forms = hashed(some, "text", "form", "a", "b", hasher).join(side, ["a", "b"], "left_semi").groupBy("a", "b", "form").agg(F.lit(1).alias("one"))
    own = W.partitionBy("a", "b")
    return forms.select("a", "b", "form", (F.row_number().over(own.orderBy("form")) - 1).alias("n"), F.count("*").over(own).alias("forms"))


def _collisions(docs: DataFrame, marks: DataFrame, work: Workspace, key: str, hasher) -> DataFrame | None:
    """(a, b, form, n) of the fingerprints that different forms share, or None if there are none."""
    many = work.keep(marks.groupBy("a", "b").agg(F.count("*").alias("rows")).filter("rows > 1").select("a", "b"), "repeated")
    if not many.limit(1).count():
        return None
    shared = work.keep(_forms(docs, marks, many, work, key, hasher).filter("forms > 1").drop("forms"), "collisions")
    return shared if shared.limit(1).count() else None


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def fingerprints(df: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", hasher=wide_hash) -> DataFrame:
    """(key, fingerprint) of every row."""
    docs = _texts(df, key, text)
    shared = _collisions(docs, _marks(docs, work, key, hasher), work, key, hasher)
    out = hashed(docs, "text", "form", "a", "b", hasher)
    if shared is None:
        return out.select(key, _rendered("a", "b", None).alias("fingerprint"))
    return out.join(shared, ["a", "b", "form"], "left").select(key, _rendered("a", "b", "n").alias("fingerprint"))


def _bucket(column: str, bounds: list[int]) -> Column:
    """How many bounds (sorted) are at most the column's value, by bisection; 0 for null."""
    at = "".join(f"{b}L," for b in bounds)[:-1]
    steps = max(1, math.ceil(math.log2(len(bounds) + 1)))
    move = "CASE WHEN x.lo >= x.hi THEN x WHEN get(bounds, (x.lo + x.hi) div 2) <= id THEN struct(cast((x.lo + x.hi) div 2 + 1 as int) as lo, x.hi as hi) ELSE struct(x.lo as lo, cast((x.lo + x.hi) div 2 as int) as hi) END"
    move = move.replace("bounds", f"array({at})").replace("<= id", f"<= `{column}`")
    return F.expr(f"coalesce(aggregate(sequence(1, {steps}), struct(0 as lo, {len(bounds)} as hi), (x, i) -> {move}, x -> x.lo), 0)")


def with_next(df: DataFrame, columns: list[str], work: Workspace, key: str = "doc_id") -> DataFrame:
    """df with, for each of the columns, ``next_<column>`` of the next row in ascending order of an integer key; after the last row comes the first.

    The rows are cut into ranges of keys, and each range gets a copy of the first row of the range after it, so that
    ``lead`` inside a range is enough: the only wide move is one shuffle by range.
    """
    pieces = min(MAX_RANGES, 4 * int(work.spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = F.percentile_approx(key, F.array(*[F.lit(i / pieces) for i in range(pieces)]), max(10_000, 10 * pieces))
    ends = df.agg(cuts.alias("cuts"), F.min(key).alias("low"), F.count("*").alias("rows"), F.count(key).alias("keys")).first()
    bounds = sorted({ends["low"], *(ends["cuts"] or [])} - {None})
    if ends["rows"] > ends["keys"]:
        firsts = [None, *bounds]  # null keys are range 0
    else:
        firsts = bounds
    base = 0 if ends["rows"] > ends["keys"] else 1
    ranged = df.withColumn("__range", _bucket(key, bounds) if bounds else F.lit(0)).withColumn("__copy", F.lit(0))
    if not firsts:
        firsts = [None]
    # Range r (numbered from base) is followed by r+1, the last one by the first.
    after = [(k, base + (i - 1) % len(firsts)) for i, k in enumerate(firsts)]
    follow = F.broadcast(work.spark.createDataFrame(after, "__first bigint, __to int"))  # one row for each range
    copies = df.join(follow, F.col(key).cast("bigint").eqNullSafe(F.col("__first"))).withColumn("__range", F.col("__to")).withColumn("__copy", F.lit(1)).drop("__first", "__to")
    w = W.partitionBy("__range").orderBy("__copy", F.col(key).asc_nulls_first(), *columns)
    both = ranged.unionByName(copies)
    return both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).filter("__copy = 0").drop("__range", "__copy")


def compared(df: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", part: int = 4, hasher=wide_hash) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last 1/part of characters comes from the start of the next row's text.

    (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); likeness is 1.0 for equal
    fingerprints and else 0.0: an exact digest knows no degrees.
    """
    docs = _texts(df, key, text)
    marks = _marks(docs, work, key, hasher)
    shared = _collisions(docs, marks, work, key, hasher)
    own = hashed(docs, "text", "form", "a", "b", hasher)
    if shared is None:
        own = own.withColumn("n", F.lit(0))
    else:
        own = own.join(shared, ["a", "b", "form"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pairs = with_next(own.select(key, "text", "a", "b", "n"), ["text", "a", "b", "n"], work, key)
    pairs = pairs.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("cut", F.floor(F.col("n_chars") / part).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")), F.substring("next_text", F.lit(1), F.col("cut")))
    pairs = pairs.withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    pairs = hashed(pairs, "edited", "edited_form", "ea", "eb", hasher)
    # Equal hashes are believed only when the forms are equal too.
    meet = (F.col("a") == F.col("ea")) & (F.col("b") == F.col("eb"))
    pairs = pairs.withColumn("alike", F.when(meet, _form("text") == F.col("edited_form")).otherwise(False))
    after = (F.col("a") == F.col("next_a")) & (F.col("b") == F.col("next_b")) & (F.col("n") == F.col("next_n"))
    narrow = [F.col(c) for c in (key, "n_chars", "edited_sha256", "a", "b", "n", "ea", "eb", "alike")] + [after.alias("after")]
    flat = work.keep(pairs.select(*narrow), "compared")
    strange = flat if shared is not None else flat.filter(~F.col("alike"))
    hits = work.keep(strange.select(F.col("ea").alias("a"), F.col("eb").alias("b")).distinct().join(marks.select("a", "b").distinct(), ["a", "b"], "left_semi"), "hits")  # copies are one row before they are dealt
    if not hits.limit(1).count():
        flat = flat.withColumn("en", F.lit(0))
    else:
        # Edited texts that have the hash of some document's: numbered like the form they equal, after all forms if they equal none.
        forms = work.keep(_forms(docs, marks, hits, work, key, hasher), "hit-forms")
        known = forms.select(F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("form").alias("edited_form"), F.col("n").alias("en"))
        last = forms.select(F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("forms").alias("other")).distinct()
        flat = pairs.select(*narrow, "edited_form").join(known, ["ea", "eb", "edited_form"], "left").join(last, ["ea", "eb"], "left").withColumn("en", F.coalesce("en", "other", F.lit(0)))
    return flat.select(
        key, "n_chars", "edited_sha256",
        _rendered("a", "b", "n").alias("fingerprint"), _rendered("ea", "eb", "en").alias("edited_fingerprint"),
        F.col("alike").cast("double").alias("near_edited"), F.col("after").cast("double").alias("near_next"),
    )
