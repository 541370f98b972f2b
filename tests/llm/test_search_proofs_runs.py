"""Vector search, Merkle manifests and periodic runs against brute force, and their odd cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def plain_search(rows, asks, k=5, scale=256):
    """(query_id, rank, vec_id, score) of every query; rows: vec_id, embedding."""
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x * scale) for x in v)]
    found = []
    for a, (q, v) in enumerate(whole):
        if q is not None and asks(q):
            near = [(-max(min(sum(x * y for x, y in zip(v, w, strict=False)), 2**63 - 1), -(2**63)), c is None, c or 0) for b, (c, w) in enumerate(whole) if a != b]
            found += [(q, n + 1, None if none else c, -s) for n, (s, none, c) in enumerate(sorted(near)[:k])]
    return sorted(found, key=str)


def rows_of(df):
    return sorted([(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()], key=str)


def test_op11_against_all_pairs(spark):
    from inkwell.llm.registry import queries

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(queries()["op11_vector_search"](spark, SF)) == plain_search(rows, lambda i: i % 50 == 0)


def test_vectors_with_ties_gaps_and_odd_components(spark):
    from inkwell.llm import vector_search

    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(rnd.choice([19, 19, 7, 0]))]) for i in range(240)]
    rows += [(i, list(v)) for i, v in rows[:30]]  # repeated rows
    rows += [(None, [1.0] * 19), (None, [2.0] * 19), (1000, None), (1001, [None, 1.0]), (1002, [math.nan]), (1003, [math.inf]), (1004, [1.0] * 19), (1005, [1.0] * 19)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, score string").repartition(3)
    assert rows_of(vector_search.search(df, F.col("vec_id") % 4 == 0)) == plain_search(rows, lambda i: i % 4 == 0)
    # Beyond exact doubles, and beyond a 64-bit integer.
    large = [(i, [rnd.uniform(-1, 1) * s for _ in range(20)]) for i in range(60) for s in [rnd.choice([1.0, 1e7, 1e20, 1e200])]]
    df = spark.createDataFrame(large, "vec_id bigint, embedding array<double>")
    assert rows_of(vector_search.search(df, F.col("vec_id") % 3 == 0)) == plain_search(large, lambda i: i % 3 == 0)
    none = spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>")
    assert vector_search.search(none, F.col("vec_id") % 50 == 0).collect() == [] and vector_search.search(none.limit(0), F.lit(True)).collect() == []


def test_bounds_hold_and_prune():
    from inkwell.llm import vector_search as vs

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 64)).cumsum(axis=1) * 20
    v = np.floor(centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 64)))
    blocks = [vs.Block(np.arange(a, b), np.arange(a, b), np.ones(b - a, np.uint8), v[a:b]) for a, b in ((0, 200), (200, 3000))]
    q, x = blocks
    exact = q.vectors @ x.vectors.T
    for a, b in zip(q.levels, x.levels, strict=True):
        assert (a @ b.T >= exact - 1e-6 * np.abs(exact) - 1e-6).all()
    least = np.sort(exact, axis=1)[:, -5]
    i, _ = vs.pruned(q, x, least)
    assert len(i) < 0.5 * exact.size
    i, j, score = vs.search_block(q, x, 5)
    assert (score == exact[i, j]).all() and (score.reshape(200, 5) == -np.sort(-exact, axis=1)[:, :5]).all()


def encoded(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(hashes, arity=2):
    """The root and each leaf's list of (before, after)."""
    proofs, level, at = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
    while len(level) > 1:
        runs = [level[k : k + arity] for k in range(0, len(level), arity)]
        for n, k in enumerate(at):
            run, place = runs[k // arity], k % arity
            proofs[n].append((run[:place], run[place + 1 :]))
            at[n] = k // arity
        level = [sha("".join(r)) for r in runs]
    return level[0], proofs


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, sha(encoded(*r)), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = [tree([x[2] for x in sorted(groups[g])]) for g in names]
    root, upper = tree([s for s, _ in made])
    found = []
    for g, (subroot, proofs), up in zip(names, made, upper, strict=True):
        for (_, _, leaf, r), own in zip(sorted(groups[g], key=lambda x: x[:3]), proofs, strict=True):
            folded = leaf
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                folded = sha(encoded(*r[:3], r[3] + 1, r[4]))
            for before, after in own + up:
                folded = sha("".join([*before, folded, *after]))
            proof = sha("".join(h for before, after in own + up for h in [*before, *after]))
            found.append((r[0], leaf, subroot, root, proof, folded, folded == root))
    return sorted(found, key=str)


OP12_COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_op12_against_a_plain_tree(spark):
    from inkwell.llm.registry import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = sorted([tuple(r[c] for c in OP12_COLUMNS) for r in queries()["op12_merkle"](spark, SF).collect()], key=str)
    assert found == plain_manifest(rows) and 0 < sum(not r[-1] for r in found) < len(found) / 3


def write_documents(spark, tmp_path, rows, extra="leaf string"):
    kind = f"doc_id bigint, source string, lang string, n_chars bigint, text string, {extra}"
    spark.createDataFrame([(*r, "x") for r in rows], kind).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")


def test_manifests_of_odd_rows(spark, tmp_path):
    from inkwell.llm import merkle

    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "é", None, ""]), rnd.choice(["en", "de", None, "", "ü", "z"]), rnd.choice([0, None, 2**63 - 1, 5]), rnd.choice([None, "", "text é", "x" * 9])) for i in range(57)]
    rows += rows[:9] * 3 + [(None, None, None, None, None)] * 3 + [(5, "other", "en", 1, "same number")] + [(900, None, "alone", 4, "t")]
    write_documents(spark, tmp_path, rows)
    found = sorted([tuple(r[c] for c in OP12_COLUMNS) for r in merkle.op12_merkle(spark, str(tmp_path)).collect()], key=str)
    assert found == plain_manifest(rows)
    # Three under a parent, one group only, and no rows.
    leaves = spark.createDataFrame([("g", k, hashlib.sha256(str(k).encode()).digest()) for k in range(23)], "g string, key bigint, leaf binary")
    root, proofs = tree([sha(str(k)) for k in range(23)], 3)
    for r in merkle.manifest(leaves, 3).collect():
        assert (r["root"].hex(), r["subroot"].hex()) == (root, root)
        assert [(s["before"].hex(), s["after"].hex()) for s in r["steps"]] == [("".join(b), "".join(a)) for b, a in proofs[r["key"]]]
    write_documents(spark, tmp_path / "none", [])
    assert merkle.op12_merkle(spark, str(tmp_path / "none")).collect() == []


def plain_runs(words, least=24, times=3):
    """Runs by the definition: every period, longest stretches, smallest periods."""
    n, found = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            end = i
            while end < n - p and words[end] == words[end + p]:
                end += 1
            if end - i + p >= max(least, times * p):
                found.setdefault((i, end - i + p), p)
            i = end
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_planted(i, text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text or "").split(" ") if w]
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    return words


def plain_row(i, text):
    words = plain_planted(i, text)
    runs = plain_runs(words)
    gone = {k for s, m, p in runs for k in range(s + p, s + m)}
    best = (None,) * 4
    if runs:
        s, m, p = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = (s, m, p, 1000 * m // p)
    return (i, len(runs), *best, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_op13_against_the_definition(spark, tmp_path):
    from inkwell.llm import periodic

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [d for d in docs if len(d[1] or "") < 6000]
    rnd = random.Random(11)
    unit = lambda n, k: [rnd.choice("abcdefgh"[:k]) for _ in range(n)]
    for i in range(10_000, 10_150):
        words: list[str] = []
        for _ in range(rnd.randrange(1, 5)):
            u = unit(rnd.randrange(1, 14), rnd.choice([1, 2, 3, 8]))
            words += (u * rnd.randrange(1, 20))[: rnd.randrange(1, 90)] + unit(rnd.randrange(0, 6), 8)
        docs.append((i, rnd.choice([" ", "\n", "\t  \x0b"]).join(words)))
    docs += [(20_000, None), (20_001, ""), (20_002, " \n "), (None, "a " * 40), (None, None), (20_003, "x" * 30), (20_004, "a b " * 30), *docs[:5]]
    spark.createDataFrame([(*d, "r", 1) for d in docs], "doc_id bigint, text string, runs string, n_words int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = sorted([tuple(r[c] for c in names) for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect()], key=str)
    assert found == sorted([plain_row(*d) for d in docs], key=str) and sum(r[1] > 0 for r in found) > 100
    # The same in ranges of lags, where copies are scanned once.
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    whole, ranges = periodic.periodic_runs(rows), periodic.periodic_runs(rows, range_places=300)
    assert sorted(map(str, whole.collect())) == sorted(map(str, ranges.collect()))
    assert periodic.periodic_runs(rows.limit(0)).collect() == []


def test_a_very_long_text_of_one_word_is_cut_into_ranges(spark):
    from inkwell.llm import periodic

    text = "word " * 30_000 + "end"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    r = periodic.periodic_runs(docs, range_places=1 << 28).first()
    assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (30_001, [(0, 30_000, 1)], "word end")


@pytest.mark.parametrize("name", ["op11_vector_search", "op12_merkle", "op13_periodic_runs"])
def test_the_queries_have_the_rows_of_their_sql(spark, name):
    import duckdb

    from inkwell.llm.registry import oracle_sql, queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, con.sql(f"SELECT {', '.join(df.columns)} FROM ({oracle_sql()[name]})").fetchall()))
