import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline as pipeline
import numpy as np
import pytest
from pipespark.llm import queries, similar, simhash
from pipespark.llm.common import Workspace
from pipespark.llm.components import roots
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bag(text, size=5):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_copies(a, b):
    s, x, y = similarity(bag(a), bag(b)), Counter(words(a)), Counter(words(b))
    w = sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0
    return s >= 0.8 or (w >= 0.8 and s >= 0.1)


def brute_links(rows):
    texts = dict(rows)
    index = defaultdict(set)
    for k, t in texts.items():
        for x in bag(t) or [None]:
            index[x].add(k)
    pairs = {(min(a, c), max(a, c)) for own in index.values() for a in own for c in own if a != c}
    return {p for p in pairs if near_copies(texts[p[0]], texts[p[1]])}


def groups_of(ids, pairs):
    ids = sorted(ids)
    at = {k: i for i, k in enumerate(ids)}
    a, b = (np.array([at[p[j]] for p in pairs], int) for j in (0, 1))
    return {k: ids[r] for k, r in zip(ids, roots(len(ids), a, b).tolist(), strict=True)}


def docs_frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_similar_groups_of_whole_table(spark):
    rows = [(d.doc_id, d.text) for d in queries.table(spark, SF, "documents").collect()]
    links = brute_links(rows)
    want = groups_of([k for k, _ in rows], links)
    got = {r.doc_id: r.component_id for r in similar.similar_groups(queries.table(spark, SF, "documents"), Workspace(spark)).collect()}
    assert got == want


@pytest.mark.parametrize(("block", "star"), [(512, 1000), (7, 20)])
def test_a_large_group_of_near_copies_is_compared_in_blocks(spark, monkeypatch, block, star):
    monkeypatch.setattr(similar, "STAR", star)
    monkeypatch.setattr(similar, "HUBS", 3)
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3) if i % 5 else rng.randint(0, 30)):  # some are too far from most others
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(150))) for i in range(60)]
    rows += [(2000 + i, base_text) for i, base_text in enumerate([None, "", "\n", "one two", "ONE two", "one two three"])]
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs_frame(spark, rows), Workspace(spark), block=block).collect()}
    assert got == groups_of([k for k, _ in rows], brute_links(rows))
    assert got[2000] == got[2001] == got[2002] == 2000 and got[2004] == 2003 and got[2005] == 2005


def edited_pairs(n_each, seed=3):
    """Texts and near copies with one long edit: appended to, cut short, or with a block replaced; similarity 0.8 at least."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(20_000)]
    rows, of = [], {}
    for kind in ("appended", "cut", "block"):
        for _ in range(n_each):
            base = [rng.choice(vocabulary) for _ in range(rng.randint(150, 600))]
            n, other = len(base), [rng.choice(vocabulary) for _ in range(200)]
            near = {"appended": base + other[: int(0.22 * n)], "cut": base[: int(0.83 * n)], "block": base[: n // 2] + other[: int(0.085 * n)] + base[n // 2 + int(0.085 * n) :]}[kind]
            of[len(rows)] = kind
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(near))]
    return rows, of


def scattered_pairs(n, seed, lengths=(15, 400), share=0.06):
    """Texts and copies in which single words are replaced, dropped or put in, up to ``share`` of them and one at least."""
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(30_000)]
    rows = []
    for _ in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(*lengths))]
        near = list(w)
        for _ in range(rng.randint(1, max(1, int(share * len(w))))):
            at = rng.randrange(len(near))
            near[at : at + 1] = rng.choice(([rng.choice(vocabulary)], [], [near[at], rng.choice(vocabulary)]))
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(near))]
    return rows


def test_near_copies_with_one_long_edit_are_all_found(spark):
    rows, of = edited_pairs(40)
    links = brute_links(rows)
    assert len(links) >= 0.9 * len(of)
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs_frame(spark, rows), Workspace(spark)).collect()}
    assert got == groups_of([k for k, _ in rows], links)


def test_near_copies_with_scattered_edits_are_found_and_others_left_alone(spark):
    rows = scattered_pairs(400, 5)
    rng = random.Random(9)
    for k in range(10_000, 10_060):  # the same words in another order, and texts that share half of their words, are no copies
        w = words(rows[2 * (k - 10_000)][1])
        rows.append((k, " ".join(rng.sample(w, len(w)))))
        rows.append((k + 1000, " ".join([*w[: len(w) // 2], *(f"other{k}x{i}" for i in range(len(w)))])))
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs_frame(spark, rows), Workspace(spark)).collect()}
    want = groups_of([k for k, _ in rows], brute_links(rows))
    assert all(want[got[k]] == want[k] for k in got) and sum(got[k] != want[k] for k in got) <= 4
    assert sum(got[k] == got[k + 1] for k in range(0, 800, 2)) >= 0.97 * 400
    assert all(got[k] == k for k in got if k >= 10_000)


@pytest.mark.parametrize("common", [64, 3])
def test_sketches_hold_every_similar_pair_and_no_passage_pairs_its_texts(spark, common):
    rows, _ = edited_pairs(15)
    passage = " ".join(f"licence{i}" for i in range(60))
    rows = [(k, f"{t} {passage}" if k % 4 < 2 else t) for k, t in rows] + [(1000 + i, f"{passage} only{i} {i}") for i in range(100)]
    links = brute_links(rows)
    work = Workspace(spark)
    sigs = work.keep(similar.signatures(docs_frame(spark, rows), 5, "doc_id", "text").withColumn("c", F.col("id")), "sigs")
    pairs, groups = similar.sketch_pairs(sigs, work, 0.8, common)
    got = [(r.a, r.b) for r in pairs.collect()]
    of = defaultdict(set)
    for r in groups.collect():
        of[r.id].add(r.c)
    found = set(got)
    assert len(got) == len(found) < 300
    assert all(p in found or of[p[0]] & of[p[1]] for p in links)
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs_frame(spark, rows), work, block=30).collect()}
    assert got == groups_of([k for k, _ in rows], links)


def test_jaccard_equals_sets():
    rng = np.random.default_rng(0)
    bags = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(60)] + [np.zeros(0, np.uint64)] * 2
    got = similar.jaccard(bags)
    for i, x in enumerate(bags):
        for j, y in enumerate(bags):
            want = similarity(set(x.tolist()), set(y.tolist()))
            assert abs(got[i, j] - want) < 1e-6
            assert similar.near((x, x), (y, y), 0.4) == (want >= 0.4)


TEXTS = ["a b a c a", "a a b", "", "c c c c c c", "b a c a a", " \t", "One TWO three\x0bfour  five one two three four five one two", "é é\u2003é", "x" * 9000 + " " + "x" * 9001, "x" * 9001 + " " + "x" * 9000]


def test_hashes_of_words_and_shingles_stand_for_them(spark):
    data = "".join(TEXTS).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in TEXTS)])
    text, h = similar.word_hashes(np.frombuffer(data, np.uint8), at)
    every = [w.encode() for t in TEXTS for w in words(t)]
    assert text.tolist() == [i for i, t in enumerate(TEXTS) for _ in words(t)]
    assert len({*zip(every, h.tolist(), strict=True)}) == len(set(every)) == len(set(h.tolist()))
    _, x, first = similar.shingles_of(text, h, 5, len(TEXTS))
    y, begin = similar.occurrences(text, h, len(TEXTS))
    sets, bags = ([v[e[i] : e[i + 1]] for i in range(len(TEXTS))] for v, e in ((x, first), (y, begin)))
    for i, t in enumerate(TEXTS):
        assert len(sets[i]) == len(bag(t)) and len(bags[i]) == len(words(t)) and (np.diff(bags[i].astype(object)) > 0).all()
        for j, u in enumerate(TEXTS):
            assert len(np.intersect1d(sets[i], sets[j])) == len(bag(t) & bag(u))
            assert len(np.intersect1d(bags[i], bags[j])) == sum((Counter(words(t)) & Counter(words(u))).values())
    one = similar.votes(text, h, len(TEXTS), 2)
    for i, t in enumerate(TEXTS):
        distinct = np.array(sorted({v >> 16 for v, k in zip(h.tolist(), text.tolist(), strict=True) if k == i}), np.uint64)
        assert one[i].tolist() == [simhash.vote(similar._remixed(distinct, p + 4)) for p in range(2)]
    empty = similar.word_hashes(np.zeros(0, np.uint8), np.zeros(3, np.int64))
    assert similar.votes(*empty, 2, 2).tolist() == [[0, 0]] * 2 and similar.shingles_of(*empty, 5, 2)[2].tolist() == [0, 0, 0]


def test_stages_take_effect_and_keep_the_columns(spark):
    work = Workspace(spark)
    docs = queries.table(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    seen = {d.doc_id: d for d in docs.collect()}
    after = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = work.keep(stage(spark, docs, SF), name)
        assert docs.columns == COLUMNS
        rows = docs.collect()
        assert all(tuple(r) == tuple(seen[r.doc_id]) for r in rows)
        after[name] = Counter(r.doc_id for r in rows)
    assert len(after["language"]) >= 0.99 * len(seen)
    kept, before = after["quality"], after["language"]
    good = [k for k in before if labels.get(k) == 1]
    bad = [k for k in before if labels.get(k) == 0]
    assert sum(k in kept for k in good) >= 0.96 * len(good) and sum(k in kept for k in bad) <= 0.15 * len(bad)
    links = brute_links([(k, seen[k].text) for k in after["quality"]])
    want = groups_of(list(after["quality"]), links)
    for k in set(after["quality"]) - set(after["near_dedup"]):
        assert want[k] != k  # only copies go
    assert set(after["near_dedup"]) == set(want.values())
    assert max(after["near_dedup"].values()) == 1 and set(after["mixture"].values()) <= {1, 2}
    last = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in last) == after["mixture"] and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_run_is_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    rows = pipeline.run(spark, sf).collect()
    assert rows and all(r.round_trip for r in rows) and pipeline.ORACLE_SQL is None
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in pipeline.run(spark, sf).collect())


def test_odd_rows_pass_every_stage(spark):
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the same words here and there again", "en", None, 5), (3, "the same words here and there again", "en", None, 5), (4, "the same words here and there again", "de", "b", 5), (None, "the same words here and there again", None, "b", 1), (6, "word " * 40_000, "en", "a", 9), (7, "!!! 123", "en", "a", 7)]
    df = spark.createDataFrame([(*r, "extra") for r in odd], "doc_id long, text string, lang string, source string, n_chars long, selected string")
    work = Workspace(spark)
    for name, stage in pipeline.STAGES:
        out = stage(spark, work.keep(df, "in"), SF).collect()
        empty = stage(spark, work.keep(df.limit(0), "in"), SF)
        assert empty.count() == 0
        ids = Counter(r.doc_id for r in out)
        if name == "language":
            assert set(ids) == {3, 4, 6, None}
        if name == "quality":
            assert None in ids
        if name == "near_dedup":
            assert ids == Counter([1, 3, 6, 7, None])
        if name == "tokens":
            assert len(out) == len(odd) and all(r.round_trip for r in out)


def test_executors_find_the_package_from_any_folder(tmp_path):
    root = Path(pipeline.__file__).resolve().parent
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.queries()["op5_byte_cnn"](s, "/root/testdata/sf0.001").count() == 200
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=180, env=env)


def test_mixture_does_not_depend_on_how_its_input_is_read(spark):
    docs = Workspace(spark).keep(queries.table(spark, SF, "documents").repartition(9).withColumn("copies", F.lit("mine")).withColumn("row", F.col("doc_id")), "in")
    name, seen = "spark.sql.leafNodeDefaultParallelism", []
    for before, after in (("4", "24"), ("24", "4")):
        try:
            spark.conf.set(name, before)
            out = dict(pipeline.STAGES)["mixture"](spark, docs, SF)
            spark.conf.set(name, after)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
            rows = out.collect()
        finally:
            spark.conf.unset(name)
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert out.columns == [*COLUMNS, "copies", "row"] and all(r.row == r.doc_id and r["copies"] == "mine" for r in rows)
        seen.append(Counter(r.doc_id for r in rows))
    assert seen[0] == seen[1]


def test_codecs_are_told_apart_by_their_vocabulary(spark, tmp_path):
    import base64

    from pipespark.llm import bpe

    df = spark.createDataFrame([(1, "aabb")], "doc_id long, text string").coalesce(1)
    for i in range(3):  # one worker sees vocabulary after vocabulary
        ranks = [bytes([b]) for b in range(256)] + [(b"aa", b"bb", b"ab")[i]]
        (tmp_path / f"{i}.tiktoken").write_text("".join(f"{base64.b64encode(t).decode()} {n}\n" for n, t in enumerate(ranks)))
        assert bpe.encode(df, str(tmp_path / f"{i}.tiktoken"), r"\w+").first().ids == [[256, 98, 98], [97, 97, 256], [97, 256, 98]][i]
