import re
import zlib
from collections import defaultdict

import numpy as np
from pipespark.llm import mixing, queries, sharding
from pipespark.llm.common import Workspace

SF = "/root/testdata/sf0.01"


def check_shards(rows, docs, shards):
    sizes = {d[0]: len((d[1] or "").encode()) + 1 for d in docs}
    total = sum(sizes.values())
    assert len(rows) == len(docs)
    cum, largest = 0, max(sizes.values(), default=0)
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.doc_id):
        assert r.size == sizes[r.doc_id]
        assert r.shard == min(shards - 1, (2 * cum + r.size) * shards // (2 * total))
        cum += r.size
        by[r.shard].append(r)
    for own in by.values():
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= largest


def test_shards_of_whole_table(spark):
    docs = [(d.doc_id, d.text) for d in queries.table(spark, SF, "documents").collect()]
    rows = queries.op6_byte_shards(spark, SF).collect()
    check_shards(rows, docs, 16)
    crc = {k: zlib.crc32((t or "").encode()) for k, t in docs}
    assert all(r.text_crc32 == crc[r.doc_id] and r.law == "bytes" for r in rows)


def test_shards_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "é" * 5000), (4, "x"), (7, "y" * 70_000), (9, "z")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in docs], "doc_id long, text string, size string")
    check_shards(sharding.byte_shards(df, Workspace(spark), 4).collect(), docs, 4)
    assert sharding.byte_shards(df.limit(0), Workspace(spark), 4).count() == 0
    same = spark.createDataFrame([(None, "a")] * 3 + [(5, "b")] * 3, "doc_id long, text string")
    got = sorted((r.shard, r.slot) for r in sharding.byte_shards(same, Workspace(spark), 2).collect())
    assert got == [(s, k) for s in (0, 1) for k in range(3)]


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: list(map(ord, s))) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 2 * sizes[s]}
        if not over:
            return t | {s: 2.0 * sizes[s] for s in capped}
        capped |= over


def check_mix(rows, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, own, taken, rates, biggest = defaultdict(int), {}, defaultdict(int), defaultdict(list), defaultdict(int)
    for k, t, s in docs:
        own[k] = (size(t), s)
        sizes[s] += size(t)
        biggest[s] = max(biggest[s], size(t))
    want = brute_targets(sizes)
    assert len(rows) == len(docs)
    for r in rows:
        n, s = own[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s])
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken in (0, n, 2 * n)
        taken[s] += r.taken
        rates[s].append((n, r.rate))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, min(biggest[s], 0.02 * want[s] + 3)), s
        n, r = np.array(rates[s]).T
        assert abs((n * r).sum() - want[s]) <= 1e-6 * max(1, want[s])
        free = (r < 2) & (n > 0)  # one tilt for the source: log rate in proportion to size
        if free.sum() > 1:
            assert np.ptp(np.log(r[free]) / n[free]) < 1e-6


def test_mix_of_whole_table_and_reruns(spark):
    docs = [(d.doc_id, d.text, d.source) for d in queries.table(spark, SF, "documents").collect()]
    rows = queries.op9_entropy_mixing(spark, SF).collect()
    check_mix(rows, docs)
    again = queries.op9_entropy_mixing(spark, SF).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in again}


def test_mix_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 50)  # so that a cell of equal sizes is ranked in parts
    docs = [(i, "w " * 10, "hot") for i in range(700)] + [(1000 + i, "w " * i, s) for i in range(80) for s in ("a",)] + [(2000, None, None), (2001, "one two", None), (3000, " \n", "empty")]
    docs += [(4000 + i, "x " * (1 + i % 7), "bé") for i in range(90)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, source string, size string")
    rows = mixing.mix(df, Workspace(spark)).collect()
    check_mix(rows, docs)
    assert mixing.mix(df.limit(0), Workspace(spark)).count() == 0
