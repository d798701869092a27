import hashlib
import subprocess
import sys
from pathlib import Path

import pytest
import tiktoken
from pipespark.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files():
    return queries.tokenizer_files()


@pytest.fixture(scope="module")
def reference(files):
    return tiktoken.Encoding("own", pat_str=files[1], mergeable_ranks=bpe.read_ranks(files[0]), special_tokens={})


ODD = ["", " ", "a", "\x00\x1c\u0085  x", "é" * 50, "👩‍👩‍👧 🏳️‍🌈 naïve", "x" * 30_000, "it's WE'LL 12 345  \t\n  end  ", "<|endoftext|>", "日本語テキスト", "́́a", "a b　c", "﻿�"]


def test_ids_equal_tiktoken_and_offsets_cover(files, reference):
    ranks = bpe.read_ranks(files[0])
    codec = bpe.Codec(ranks, bpe.merge_pairs(ranks), files[1])
    for t in ODD:
        ids = codec.encode(t)
        assert ids == reference.encode_ordinary(t), t[:40]
        assert codec.decode(ids) == t.encode()
        at = codec.offsets(t)
        assert len(at) == len(ids)
        if t:
            assert at[0][0] == 0 and at[-1][1] == len(t)
            assert all(a[1] in (b[0], b[0] + 1) for a, b in zip(at, at[1:], strict=False))  # one more where a character is split
    cut = codec.encode("👩")[:1]
    assert codec.decode(cut) == "👩".encode()[: len(codec.decode(cut))] and "�" in codec.decode_text(cut)


def test_encode_decode_frames_keep_columns(spark, files):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    back = bpe.decode(bpe.encode(df, *files), files[0])
    assert back.columns == ["doc_id", "text", "ids_sha256", "ids", "decoded"]
    for r in back.collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(df.limit(0), *files).count() == 0
    again = bpe.encode(back, *files, whole="decoded", keep_text=False)
    assert again.columns == ["doc_id", "ids_sha256", "ids", "decoded"] and all(r.decoded for r in again.collect())


def test_query_whole_table(spark, reference):
    got = {r.doc_id: r for r in queries.op7_byte_bpe(spark, SF).collect()}
    docs = queries.table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


#: Encodes one batch of 256 texts of 9 kB, whose words hardly repeat, as a task does; prints the MB that it took beyond what the codec holds.
LONG = """
import random, re, sys
import pyarrow as pa
from pipespark.llm import bpe, queries

def held(name):
    return int(re.search(name + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

path, pattern = queries.tokenizer_files()
class Held:
    pass
class Here:  # a broadcast is its value
    sparkContext = property(lambda self: self)
    def broadcast(self, value):
        Held.value = value
        return Held
class Frame:
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    schema, columns, sparkSession = StructType([StructField("doc_id", LongType()), StructField("text", StringType())]), ["doc_id", "text"], Here()
    drop = lambda self, *names: self
bpe.map_batches = lambda df, run, schema: run
run = bpe.encode(Frame(), path, pattern, whole="same", keep_text=False)
draw = random.Random(5)
texts = [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(1500)) for _ in range(256)]
one = lambda rows: iter([pa.RecordBatch.from_pydict({"doc_id": list(range(len(rows))), "text": rows})])
list(run(one(["start"])))
before = held("VmRSS")
out = list(run(one(texts)))
assert sum(b.num_rows for b in out) == 256 and all(x for b in out for x in b.column(2).to_pylist())
print(held("VmHWM") - before)
"""


def test_memory_of_a_task_is_bounded_by_bytes_of_text():
    done = subprocess.run([sys.executable, "-c", LONG], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert float(done.stdout) < 120
