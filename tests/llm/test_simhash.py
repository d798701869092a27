import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pipespark.llm import queries, simhash
from pipespark.llm.common import Workspace
from pipespark.llm.components import components, roots

SF = "/root/testdata/sf0.01"


def brute_print(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    fps = np.array(fps, np.uint64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
    order = np.argsort(ids)
    rank = np.empty(len(ids), int)
    rank[order] = np.arange(len(ids))
    root = roots(len(ids), rank[a], rank[b])
    return {i: int(np.array(ids)[order][root[rank[k]]]) for k, i in enumerate(ids)}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_no_pair_within_the_radius_escapes_all_masks(x, flips):
    y = x
    for i in flips:
        y ^= 1 << i
    assert any((x ^ y) & m == 0 for m in simhash.masks(4))


def test_masks_are_balanced():
    assert len(simhash.masks(4)) == 31
    assert all(30 <= (m & (2**64 - 1)).bit_count() <= 36 for m in simhash.masks(4))


def test_query_equals_brute_force(spark):
    docs = queries.table(spark, SF, "documents").collect()
    fps = {d.doc_id: brute_print(d.text) for d in docs}
    want = brute_components(list(fps), list(fps.values()))
    got = queries.op10_simhash(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]


def test_edges_and_large_buckets(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    near = {centre ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)}
    far = {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(near | far)
    rows = [(1000 + i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    work = Workspace(spark)
    points = spark.createDataFrame(rows, "id long, fp long")
    got = {r.node: r.component for r in components(simhash.near_links(points, work, 4, block=40), work).collect()}
    want = brute_components([i for i, _ in rows], fps)
    assert {i: got.get(i, i) for i in want} == want


def test_nulls_short_texts_ties_and_clashing_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n ", "c"), (4, "One two", "d"), (4, "one TWO", "e"), (5, "one two three four five " * 3000, "f"), (None, "zzz yyy xxx www", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(df, Workspace(spark)).collect()]
    assert len(got) == len(rows)
    by = {k: (f, c) for k, f, c in got}
    assert by[1] == by[2] == by[3] == (0, 1)
    assert by[4][1] == 4 and by[4][0] & (2**64 - 1) == brute_print("one two")
    assert by[5][1] == 5 and by[None][1] is None
    assert simhash.near_duplicates(df.limit(0), Workspace(spark)).count() == 0


@pytest.mark.parametrize("at_once", [0, 10**6])
@pytest.mark.parametrize("n", [2, 50, 400])
def test_components_of_chains_and_stars(spark, n, at_once):
    pairs = [(i, i + 1) for i in range(n)] + [(10_000, 10_000 + i) for i in range(1, n)] + [(7_000_000, 7_000_000)]
    random.Random(n).shuffle(pairs)
    df = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    got = {r.node: r.component for r in components(df, Workspace(spark), at_once=at_once).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, **{10_000 + i: 10_000 for i in range(n)}}
