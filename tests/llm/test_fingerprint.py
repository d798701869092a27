import hashlib
import re
import unicodedata

from pipespark.llm import fingerprint, queries
from pipespark.llm.common import Workspace
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def form(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub("[\t-\r \x85   ]+", " ", t).strip(" ")


def edited(rows):
    """rows: (id, text) in ascending id."""
    out = []
    for i, (k, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        out.append((k, t[: len(t) - cut] + after[:cut], after))
    return out


def check(got, rows, digest=lambda f: f):
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    prints, n = {}, 0
    for (k, t), (_, e, after) in zip(rows, edited(rows), strict=True):
        r = by[k]
        assert r.n_chars == len(t or "")
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert prints.setdefault(form(t), r.fingerprint) == r.fingerprint
        assert r.near_edited == float(r.fingerprint == r.edited_fingerprint) == float(form(t) == form(e)) or digest("a") != "a"
        assert r.near_next == float(form(t) == form(after))
        n += 1
    assert len(set(prints.values())) == len(prints)  # different forms, different fingerprints


def test_query_equals_brute_force(spark):
    rows = sorted((d.doc_id, d.text) for d in queries.table(spark, SF, "documents").collect())
    check(queries.op4_canonical_digest(spark, SF).collect(), rows)


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "Ａﬁ"), (5, "afi"), (6, "STRASSE straße"), (7, "strasse  STRASSE "), (9, "éx"), (11, "Éx"), (12, "😀" * 9), (15, "a" * 90_000), (16, "b"), (17, "İ"), (18, "i̇"), (2**40, "end of it all")]


def test_odd_texts_gaps_and_clashes(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ODD], "doc_id long, text string, fingerprint string")
    got = fingerprint.compared(df, Workspace(spark)).collect()
    check(got, ODD)
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[1] == by[2] == by[3] and by[4] == by[5] and by[6] == by[7] and by[9] == by[11] and by[17] == by[18]
    assert fingerprint.compared(df.limit(0), Workspace(spark)).count() == 0
    one = fingerprint.compared(df.filter("doc_id = 6"), Workspace(spark)).collect()
    check(one, [(6, "STRASSE straße")])


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "null one"), (None, "null two"), (3, "x y z w"), (3, "x y z w"), (8, "last text here")], "doc_id long, text string")
    got = fingerprint.compared(df, Workspace(spark)).collect()
    assert len(got) == 5
    eights = [r for r in got if r.doc_id == 8]  # followed by the first: null ids come first, in the order of their texts
    assert eights[0].edited_sha256 == hashlib.sha256(b"last text hnul").hexdigest() or eights[0].edited_sha256 == hashlib.sha256(("last text here"[:11] + "null one"[:3]).encode()).hexdigest()


def test_equal_digests_of_different_texts_are_told_apart(spark):
    weak = lambda f: [F.length(f).cast("bigint"), F.lit(0).cast("bigint")]
    rows = [(i, t) for i, t in enumerate(["abcd", "ABCD", "wxyz", "abcd", "longer text", "mnop", "abce", "single one here"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.compared(df, Workspace(spark), hasher=weak).collect()}
    prints = {}
    for k, t in rows:
        prints.setdefault(form(t), set()).add(got[k].fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    assert len({next(iter(v)) for v in prints.values()}) == len(prints)
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df, Workspace(spark), hasher=weak).collect()}
    assert plain == {k: got[k].fingerprint for k in plain}
    named = {f: next(iter(v)) for f, v in prints.items()}
    for k, e, after in edited(rows):
        assert got[k].near_edited == float(form(e) == form(rows[k][1])) and got[k].near_next == float(form(after) == form(rows[k][1]))
        assert got[k].edited_fingerprint == named[form(e)] if form(e) in named else got[k].edited_fingerprint not in named.values()


def test_edited_texts_are_compared_by_bytes_too(spark):
    """No two documents share a hash, but edited texts have those of their own and of other documents."""
    weak = lambda f: [F.length(f).cast("bigint"), F.lit(0).cast("bigint")]
    rows = [(0, "abcd"), (1, "xyzwvu"), (2, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.compared(df, Workspace(spark), hasher=weak).collect()}
    assert [got[k].near_edited for k in range(3)] == [0.0, 0.0, 1.0]
    assert got[0].edited_fingerprint != got[0].fingerprint and got[1].edited_fingerprint != got[1].fingerprint and got[2].edited_fingerprint == got[2].fingerprint
