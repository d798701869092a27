"""WARC 1.0 archives: distributed writing, and reading in splits with boundary-chain verification.

Writing is Spark's text writer: a row is a record's header and block, and the writer's line separator is the two
line ends that close a record, so every part file is a well-formed uncompressed archive.

Reading cuts the files at the magic line ``WARC/1.0`` wherever it stands, which Spark does in splits of a file of any
size.  What follows a magic is only a candidate: the line may also stand inside a payload.  Each task emits its
candidates' offsets and the offset at which the header's Content-Length puts the record's successor.  A record is real
if the chain of successors from the start of the file reaches it.  The chain is followed by pointer jumping: first
inside blocks of a bounded number of bytes, then between blocks, doubling the step in each round.

Edge cases: a null payload is empty; a null URL leaves the header out, and each control character or space in a URL is
written as %20; a null id is written as ``null`` and comes after all others when the first of equal payloads is chosen; rows that
repeat the smallest id of a payload are all responses.  An empty table gives archives without records.  A record whose
successor lies beyond the end of the file is truncated: it ends the chain and is left out.  Payloads that are read may hold
any bytes, the magic line included; a response whose block is no HTTP message is all payload.  Extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, bounded

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"

#: Bytes of a file whose candidates one task chains: some ten thousand in general, two million at the very most.
BLOCK_BYTES = 64 << 20

#: Repeated payload digests that are sent to every task; with more of them the pages are shuffled to meet them.
BROADCAST_ROWS = 1_000_000

#: Base-32 digits as Spark's conv writes them, and as RFC 4648 does.
DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 20 bits, five hexadecimal digits, are four digits of base 32."""
    hexa = F.sha1(data)
    fours = [F.lpad(F.conv(F.substring(hexa, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), *DIGITS)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def write(df: DataFrame, path: str, work: Workspace, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per row.  Of rows with equal payloads of at least ``least`` bytes, the one of the smallest id is a
    response and the others are revisits that refer to it and have no block; all other rows are responses."""
    rows = df.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    # SHA-1 collisions can be made on purpose, so equality is by length and a second hash as well.
    rows = rows.withColumns({"size": F.octet_length("payload"), "digest": sha1_base32(F.col("payload").cast("binary")), "second": F.xxhash64("payload")})
    same = ["digest", "size", "second"]
    marks = work.keep(rows.select("id", *same), "digests")
    first = marks.filter(F.col("size") >= least).groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").select(*same, "first")
    first = work.keep(first, "repeated")
    few = first.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(first) if few else first, same, "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    safe = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, F.lit("")).otherwise(F.concat(http, F.col("payload")))
    header = F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        _line("WARC-Record-ID", _urn(F.col("id"))),
        F.lit(f"WARC-Date: {date}\r\n"),
        _line("WARC-Target-URI", safe),
        _line("WARC-Refers-To", F.when(again, _urn(F.col("first")))),
        _line("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("X-Payload-Length", F.col("size").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"),
    )
    rows.withColumn("block", block).select(F.concat(header, F.col("block")).alias("value")).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic lines: (file, split, seq, value); seq rises inside a split.

    Splits and seq belong to one read: another may be dealt to tasks otherwise.  What is to be joined by them must be written once.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("file_size"), "value").withColumn("seq", F.monotonically_increasing_id())


def _field(name: str) -> Column:
    """A header field's value, the first if there are several; null if there is none."""
    got = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t\r]*$", 1)
    return F.when(got == "", None).otherwise(got)


def _candidates(pieces: DataFrame) -> DataFrame:
    """Header fields and, where the piece holds the whole block, the payload's length and digest, computed where the bytes are."""
    head = F.substring_index("value", END, 1)
    rows = pieces.withColumns({"piece": F.octet_length("value").cast("bigint"), "head": head})
    rows = rows.withColumn("head_bytes", F.octet_length("head").cast("bigint"))
    rows = rows.withColumns({"length": _field("Content-Length").try_cast("bigint"), "type": F.lower(_field("WARC-Type")), "id": _field("WARC-Record-ID"), "refers": _field("WARC-Refers-To"), "said_digest": _field("WARC-Payload-Digest"), "said_bytes": _field("X-Payload-Length").try_cast("bigint"), "uri": _field("WARC-Target-URI")})
    sound = (F.col("head_bytes") < F.col("piece")) & (F.col("length") >= 0)
    rows = rows.withColumn("extent", F.when(sound, F.lit(len(MAGIC)) + F.col("head_bytes") + len(END) + F.col("length") + len(END)))
    return rows.withColumn("whole", F.coalesce(F.lit(len(MAGIC)) + F.col("piece") >= F.col("extent"), F.lit(False)))


def _payload(value: str) -> Column:
    """The payload's bytes of a whole record: the block without its HTTP header."""
    block = F.expr(f"substring(cast({value} as binary), cast(head_bytes + {len(END)} + 1 as int), cast(length as int))")
    text = block.cast("string")
    http = (F.col("type") == "response") & text.startswith("HTTP/") & text.contains(END)
    start = F.octet_length(F.substring_index(text, END, 1)) + len(END) + 1
    return F.when(http, F.substring(block, start, F.col("length").cast("int"))).otherwise(block)


def _exits(table: pa.Table, block: int) -> pa.Table:
    """For each candidate of a block: the first offset outside of the block that its chain comes to (-1: the chain breaks off)."""
    at, to = _sorted(table)
    jump = _jumps(at, to)
    while True:
        further = np.where(jump >= 0, jump[np.maximum(jump, 0)], -1)
        further = np.where(further >= 0, further, jump)
        if (further == jump).all():
            break
        jump = further
    last = np.where(jump >= 0, jump, np.arange(len(at)))
    outside = to[last]
    outside[_broken(at, to, block)[last]] = -1
    return pa.table({"f": pa.array(np.full(len(at), table.column("f")[0].as_py()), pa.int64()), "at": at, "exit": outside})


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    at, to = (table.column(c).to_numpy() for c in ("at", "to"))
    order = np.argsort(at, kind="stable")
    return at[order], to[order].copy()


def _jumps(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Position of each candidate's successor among the block's own candidates, -1 if it isn't one."""
    k = np.minimum(np.searchsorted(at, to), len(at) - 1)
    return np.where(at[k] == to, k, -1)


def _broken(at: np.ndarray, to: np.ndarray, block: int) -> np.ndarray:
    """Successors that lie inside the block but are no candidate; or none at all."""
    return (to < 0) | ((to // block == at // block) & (_jumps(at, to) < 0))


def _reached(table: pa.Table) -> pa.Table:
    """The block's candidates that its entry's chain comes to: the marked set doubles its reach in each round."""
    at, to = _sorted(table)
    entry = table.column("entry")[0].as_py()
    jump, mark = _jumps(at, to), at == entry
    while (jump >= 0).any():
        mark[jump[mark & (jump >= 0)]] = True
        jump = np.where(jump >= 0, jump[np.maximum(jump, 0)], -1)
    at = at[mark]
    return pa.table({"f": pa.array(np.full(len(at), table.column("f")[0].as_py()), pa.int64()), "at": at})


def _chain(links: DataFrame, work: Workspace, rounds: int = 60) -> DataFrame:
    """(f, at) of the candidates on the chain from offset 0 of each file.  links: f, at, to, all bigint; to is -1 where there is none."""
    block = BLOCK_BYTES
    links = bounded(links.withColumn("block", F.expr(f"at div {block}")))
    exits = work.keep(links.groupBy("f", "block").applyInArrow(lambda t: _exits(t, block), "f bigint, at bigint, exit bigint").filter("exit >= 0"), "exits")
    reached = links.filter("at = 0").select("f", F.col("at").alias("entry"))
    # Only candidates that are entered from another block matter between blocks.
    steps = exits.select("f", F.col("at").alias("u"), F.col("exit").alias("v"))
    entered = steps.select("f", F.col("v").alias("u")).union(reached.select("f", F.col("entry").alias("u"))).distinct()
    steps = work.keep(steps.join(entered, ["f", "u"], "left_semi"), "steps")
    reached = work.keep(reached, "reached")
    n = reached.count()
    for _ in range(rounds):
        new = reached.join(steps, (steps["f"] == reached["f"]) & (F.col("u") == F.col("entry"))).select(reached["f"], F.col("v").alias("entry"))
        grown = work.keep(reached.union(new).distinct(), "reached")
        m = grown.count()
        if m == n:
            break
        reached, n = grown, m
        far = steps.select("f", F.col("u").alias("v"), F.col("v").alias("w"))
        steps = work.keep(steps.join(far, ["f", "v"]).select("f", "u", F.col("w").alias("v")), "steps")
    entries = reached.withColumn("block", F.expr(f"entry div {block}"))
    return links.join(entries, ["f", "block"]).groupBy("f", "block").applyInArrow(_reached, "f bigint, at bigint")


def _placed(rows: DataFrame) -> DataFrame:
    """rows with ``at``, the offset of the magic line before each piece; -1 for what stands before a file's first.

    The offset is the lengths of the pieces before it: those of earlier splits by their totals, those of its own by a running sum.
    """
    step = F.col("piece") + len(MAGIC)
    totals = rows.groupBy("f", "split").agg(F.sum(step).alias("total"))  # one row for each split
    before = F.coalesce(F.sum("total").over(W.partitionBy("f").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("f", "split", before.alias("start"))
    inside = F.coalesce(F.sum(step).over(W.partitionBy("f", "split").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(starts, ["f", "split"]).withColumn("at", F.col("start") + F.col("inside") - len(MAGIC)).drop("start", "inside")


def read(spark: SparkSession, path: str, work: Workspace, payloads: bool = False) -> DataFrame:
    """(file, at, type, id, uri, refers, said_digest, said_bytes, payload_bytes, payload_digest[, payload]) of every real record.

    payload_bytes and payload_digest (bare base32 SHA-1) are of the bytes read.  With ``payloads`` the bytes come too; without,
    only those of records that hold a magic line are moved at all.
    """
    narrow = ["f", "split", "seq", "file_size", "piece", "head_bytes", "length", "extent", "whole", "type", "id", "uri", "refers", "said_digest", "said_bytes"]
    raw = _pieces(spark, path)
    if payloads:
        raw = work.keep(raw, "pieces-whole")
    rows = _candidates(raw).withColumn("f", F.xxhash64("file"))
    got = rows.withColumn("payload", F.when(F.col("whole"), _payload("value")))
    got = got.select("file", *narrow, F.octet_length("payload").cast("bigint").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    found = work.keep(_placed(work.keep(got, "pieces")), "candidates")
    links = found.filter("at >= 0").select("f", "at", F.coalesce(F.when(F.col("at") + F.col("extent") <= F.col("file_size"), F.col("at") + F.col("extent")), F.lit(-1)).alias("to"))
    real = work.keep(_chain(links, work), "real")
    records = found.join(real, ["f", "at"]).filter(F.col("extent").isNotNull() & (F.col("at") + F.col("extent") <= F.col("file_size")))
    columns = ["file", "at", "type", "id", "uri", "refers", "said_digest", "said_bytes", "payload_bytes", "payload_digest"]
    torn = records.filter(~F.col("whole"))
    if not payloads:
        whole = records.filter("whole").select(*columns)
        if not torn.limit(1).count():
            return whole
        # The files with such records are read once more and written, and their offsets made again from that.
        files = work.keep(torn.select("file").distinct(), "torn-files")
        small = files.count() <= BROADCAST_ROWS
        again = work.keep(_pieces(spark, path).join(F.broadcast(files) if small else files, "file", "left_semi"), "torn-pieces")
        places = again.select(F.xxhash64("file").alias("f"), "file", "split", "seq", F.octet_length("value").cast("bigint").alias("piece"))
        return whole.union(_joined(again, work.keep(_placed(places), "torn-places"), torn).select(*columns))
    # All bytes: the pieces meet their records by their place in the split.
    place = records.filter("whole").select("file", "split", "seq", *[c for c in columns if c != "file"], "head_bytes", "length")
    full = raw.withColumn("head", F.substring_index("value", END, 1))
    whole = full.select("file", "split", "seq", "head", "value").join(place, ["file", "split", "seq"]).withColumn("payload", _payload("value")).select(*columns, "payload")
    return whole.union(_joined(raw, found, torn).select(*columns, "payload"))


def _joined(raw: DataFrame, found: DataFrame, torn: DataFrame) -> DataFrame:
    """Records whose payload holds magic lines, put together from their pieces; each group is one record's bytes.

    raw: written pieces; found: their offsets.  All pieces of a record are joined at once.
    """
    owner = torn.select("f", F.col("at").alias("own"), (F.col("at") + F.col("extent")).alias("end"), F.col("head_bytes").alias("hb"), F.col("length").alias("len"), *[F.col(c).alias(f"o_{c}") for c in ("type", "id", "uri", "refers", "said_digest", "said_bytes")])
    # A torn record meets only the pieces of the blocks of the file that it covers.
    blocks = F.explode(F.sequence(F.expr(f"own div {BLOCK_BYTES}"), F.expr(f"(end - 1) div {BLOCK_BYTES}")))
    owner = owner.withColumn("block", blocks)
    parts = found.filter("at >= 0").withColumn("block", F.expr(f"at div {BLOCK_BYTES}"))
    parts = parts.join(owner, ["f", "block"]).filter("at >= own and at < end").select("file", "split", "seq", "at", *[c for c in owner.columns if c not in ("f", "block")])
    raw = raw.select("file", "split", "seq", F.col("value").cast("binary").alias("value"))
    many = raw.join(parts, ["file", "split", "seq"]).groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"), *[F.first(c).alias(c) for c in ("hb", "len", "o_type", "o_id", "o_uri", "o_refers", "o_said_digest", "o_said_bytes")])
    glued = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["value"])), MAGIC.encode().hex().upper()))
    rows = many.withColumn("all", glued).withColumns({"head_bytes": F.col("hb"), "length": F.col("len"), "type": F.col("o_type"), "id": F.col("o_id"), "uri": F.col("o_uri"), "refers": F.col("o_refers"), "said_digest": F.col("o_said_digest"), "said_bytes": F.col("o_said_bytes"), "at": F.col("own")})
    rows = rows.withColumn("value", F.col("all").cast("string")).withColumn("head", F.substring_index("value", END, 1)).withColumn("payload", _payload("value"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": sha1_base32(F.col("payload"))})
