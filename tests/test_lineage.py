"""Lineage, JSON lines, chunked hashes, quarantine, the guard, ranks and quantiles on small planted inputs."""

import hashlib
import json
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import audits, contracts, dataset, lineage, metrics, scan
from inkwell.sources import jsonl, store

CONFIG = {"dataset_id": "d", "dataset_version": "1", "split_seed": 3, "note": "é"}
CASE = "case_id string, participant_id string, group_id string, dataset_id string, dataset_version string, quality_status string, split string"


@pytest.fixture(scope="module")
def made(spark):
    rows = [(f"c{k}", f"u{k}", f"u{k}", "d", "1", "OK" if k else None, ("train", "validation", "test")[k % 3]) for k in range(12)]
    cases = store.keeper(spark, "test")(lineage.with_case_hash(spark.createDataFrame(rows, CASE)), "cases")
    manifests = dataset.split_manifests(cases, "d", "1", 3)
    stated = store.keeper(spark, "test")(lineage.state(CONFIG, cases, manifests, lineage.standard_audits(CONFIG, cases, manifests)), "stated")
    return cases, manifests, stated


def plain_hash(value):
    return "sha256:" + hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_case_and_config_hashes_are_those_of_canonical_json(made):
    cases, _, stated = made
    for r in cases.collect():
        assert r.case_manifest_hash == plain_hash({k: v for k, v in r.asDict().items() if k not in ("split", "case_manifest_hash")})
    levels = {(r.level, r.name): r for r in stated.collect()}
    assert levels["config", "config"].hash == plain_hash(CONFIG) and levels["cases", "cases"].n == 12
    assert {k for k in levels} == {("config", "config"), ("cases", "cases"), *[("split", s) for s in dataset.SPLITS], ("audit", "leakage"), ("audit", "splits")}


def test_roots_ignore_order_and_partitions(spark):
    rows = [(f"id-{k}", f"h{k}", k % 2) for k in range(500)] + [("id-1", "h1", 1)]
    root = lambda df: {r.side: (r.root, r.n) for r in lineage.root(df, F.col("id"), F.col("h"), ["side"]).collect()}
    a = root(spark.createDataFrame(rows, "id string, h string, side int").repartition(1))
    random.Random(1).shuffle(rows)
    b = root(spark.createDataFrame(rows, "id string, h string, side int").repartition(7))
    c = root(spark.createDataFrame([(i, "other" if i == "id-400" else h, s) for i, h, s in rows], "id string, h string, side int"))
    assert a == b and a[1] == c[1] and a[0] != c[0] and a[1][1] == 251


def test_an_untouched_dataset_has_no_changes(made):
    cases, manifests, stated = made
    assert lineage.changes(stated, CONFIG, cases, manifests).collect() == []


def test_changes_show_at_their_level(spark, made):
    cases, manifests, stated = made
    found = lambda *a: {tuple(r) for r in lineage.changes(*a).collect()}
    case = F.col("case_id") == "c5"
    edited = cases.withColumn("quality_status", F.when(case, "BAD").otherwise(F.col("quality_status")))
    assert found(stated, CONFIG, edited, manifests) == {("CASE_HASH", "c5"), ("CASES_ROOT", "cases")}
    # Hashed anew, the case is in order by itself, but not the root.
    assert found(stated, CONFIG, lineage.with_case_hash(edited), manifests) == {("CASES_ROOT", "cases")}
    assert found(stated, CONFIG | {"note": "e"}, cases, manifests) == {("CONFIG_HASH", "config")}
    # A case in another split has the hash that it had.
    moved = cases.withColumn("split", F.when(case, "train").otherwise(F.col("split")))
    assert found(stated, CONFIG, moved, dataset.split_manifests(moved, "d", "1", 3)) == {("SPLIT_HASH", "train"), ("SPLIT_HASH", "test")}
    gone = stated.where("name <> 'leakage'").unionByName(spark.createDataFrame([("audit", "other", "h", 0)], stated.schema))
    assert found(gone, CONFIG, cases, manifests) == {("LEVEL_UNKNOWN", "leakage"), ("LEVEL_ABSENT", "other")}


def test_lineage_is_stored_beside_the_manifest(spark, made, tmp_path):
    _, _, stated = made
    path = f"file://{tmp_path}/d"
    store.write_lineage(stated, path)
    assert sorted(map(tuple, store.read_lineage(spark, path).collect())) == sorted(map(tuple, stated.collect()))


def test_another_split_rule_is_found(made):
    cases, manifests, _ = made
    other = manifests.withColumn("split_version", F.lit("other"))
    assert {r.rule for r in audits.splits(cases, other, "d", "1", 3).collect()} == {"SPLIT_VERSION"}
    status = {r.audit: (r.status, r.violations, r.rules) for r in audits.summary({"good": audits.splits(cases, manifests, "d", "1", 3), "bad": audits.splits(cases, other, "d", "1", 3)}).collect()}
    assert status == {"good": ("PASS", 0, ""), "bad": ("FAIL", 3, "SPLIT_VERSION=3")}


def lines_of(folder):
    return [x for f in sorted(Path(folder).glob("*.jsonl")) for x in f.read_text().splitlines()]


def test_cases_are_written_as_lines_in_order(spark, tmp_path):
    rows = [(f"c{k % 7}", f"x{k:03d}", (k * 0.5, None if k % 3 else [k]), "é\n") for k in range(100)]
    df = spark.createDataFrame(rows, "case_id string, id string, z struct<b: double, a: array<int>>, text string").repartition(5)
    jsonl.write_cases(df, "thing", str(tmp_path / "out"), ["id"])
    expected = [json.dumps({"case_id": c, "thing": {"id": i, "text": t, "z": {"a": a, "b": b}}}, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for c, i, (b, a), t in sorted(rows, key=lambda r: r[:2])]
    assert lines_of(tmp_path / "out") == expected and (tmp_path / "out" / "_SUCCESS").exists() and not (tmp_path / "out" / "_temporary").exists()
    with pytest.raises(Exception, match="has files already"):
        jsonl.write_cases(df, "thing", str(tmp_path / "out"), ["id"])
    assert lines_of(tmp_path / "out") == expected
    jsonl.write_cases(df.limit(0), "thing", f"file://{tmp_path}/out", ["id"], overwrite=True)
    assert lines_of(tmp_path / "out") == [] and len(list((tmp_path / "out").glob("*.jsonl"))) == 1
    with pytest.raises(ValueError, match="text column"):
        jsonl.write_lines(df, str(tmp_path / "out"))


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 57, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="broken"):
        jsonl.write_lines(bad, str(tmp_path / "out"))
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []


def test_files_are_hashed_in_chunks(spark, tmp_path):
    big = tmp_path / "tables" / "a" / "a file.parquet"
    big.parent.mkdir(parents=True)
    big.write_bytes(bytes(range(256)) * 5000)
    (big.parent / "one.parquet").write_bytes(b"1")
    found = {r.file: (r.table, r.length, r.sha256) for r in store.file_hashes(spark, f"file://{tmp_path}", chunk=1000).collect()}
    assert {v for v in found.values()} == {("a", big.stat().st_size, hashlib.sha256(big.read_bytes()).hexdigest()), ("a", 1, hashlib.sha256(b"1").hexdigest())}


def test_bad_lines_are_found_with_their_place(spark, tmp_path):
    lines = ['{"a": 1}', "", "  ", '{"a": ', "[1]", "3", '{"b": {}}', '"text"', "null"] * 30
    (tmp_path / "one.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.jsonl").write_text("{}\nnot json")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        found = sorted((Path(r.file).name, r.line, r.reason, r.text) for r in jsonl.quarantine(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    reason = {3: "NOT_JSON", 4: "NOT_OBJECT", 5: "NOT_OBJECT", 7: "NOT_OBJECT", 8: "NOT_OBJECT"}
    assert found == sorted([("one.jsonl", k + 1, reason[k % 9], x) for k, x in enumerate(lines) if k % 9 in reason] + [("two.jsonl", 2, "NOT_JSON", "not json")])


def test_the_guard_gives_paths_at_any_depth(spark):
    deep = {"k": 1}
    for _ in range(12):
        deep = {"in": [0, deep]}
    deep["in"][1]["in"] = [{"emotion": 1}]
    rows = [("a", json.dumps({"x": {"careless": 2, "y": [[{"emotion": None}]]}})), ("b", '{"x": "\\"emotion\\": 1", "attention\\u005fscore": {"wrong_reason": 1}}'), ("c", None), ("d", "[]"), ("e", "3"), ("f", json.dumps(deep))]
    found = sorted((r.id, r.field, r.path) for r in contracts.out_of_scope(spark.createDataFrame(rows, "id string, meta string"), "meta", "id").collect())
    assert found == [
        ("a", "careless", "meta.x.careless"), ("a", "emotion", "meta.x.y[0][0].emotion"), ("b", "attention_score", "meta.attention_score"), ("b", "wrong_reason", "meta.attention_score.wrong_reason"),
        ("f", "emotion", "meta.in[1].in[0].emotion"),
    ]
    with pytest.raises(Exception, match="MALFORMED|parse"):
        contracts.out_of_scope(spark.createDataFrame([("a", "{")], "id string, meta string"), "meta", "id").collect()


def test_quantiles_and_ranks_of_many_values(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.normal(size=997)] + [("b", float(x)) for x in rng.integers(0, 4, 200)] + [("c", 2.5), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    found = {r.k: r for r in scan.quantiles(df, ("k",), "v", {"low": 0.1, "mid": 0.5, "top": 1.0}, store.keeper(spark, "test")).collect()}
    for k in "abc":
        values = [v for g, v in rows if g == k and v is not None]
        assert [found[k].low, found[k].mid, found[k].top] == pytest.approx(np.quantile(values, [0.1, 0.5, 1.0]).tolist())
    scored = [(i, "hot", int(rng.random() < 0.3), float(rng.normal())) for i in range(3000)] + [(i, "flat", i % 2, 0.5) for i in range(10)]
    got = {r.label: r for r in metrics.ranking(spark.createDataFrame(scored, "id long, label string, target int, score double")).collect()}
    pos, neg = (np.sort([s for _, lab, t, s in scored if lab == "hot" and t == k]) for k in (1, 0))
    wins = np.searchsorted(neg, pos).sum() / len(pos) / len(neg)
    order = sorted(((s, t) for _, lab, t, s in scored if lab == "hot"), reverse=True)
    hits = np.cumsum([t for _, t in order])
    precision = sum(h / (k + 1) for k, (h, (_, t)) in enumerate(zip(hits, order, strict=True)) if t) / hits[-1]
    assert got["hot"].roc_auc == pytest.approx(wins) and got["hot"].average_precision == pytest.approx(precision)
    assert (got["flat"].roc_auc, got["flat"].average_precision) == (0.5, 0.5) and not math.isnan(got["hot"].roc_auc)
