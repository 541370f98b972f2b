"""Splits, traces, status, wire rules, contracts, truth, audits, metrics and datasets on small planted inputs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from inkwell.functions.canonical import json_hash
from inkwell.operators import audits, contracts, dataset, features, metrics, parse, trace, truth, wire
from inkwell.plans import pipeline
from inkwell.sources import store
from tests.test_pen import RECORD, actions, regions


def plain_sizes(n, ratios):
    """Sizes by repeated single steps."""
    names = ("train", "validation", "test")
    shares = [n * r for r in ratios]
    sizes = [max(1, int(s)) for s in shares]
    while sum(sizes) > n:
        i = max((i for i in range(3) if sizes[i] > 1), key=lambda i: (sizes[i] - shares[i], names[i]))
        sizes[i] -= 1
    while sum(sizes) < n:
        sizes[max(range(3), key=lambda i: (shares[i] - int(shares[i]), -i))] += 1
    return sizes


def test_split_sizes_of_all_totals(spark):
    for ratios in ((0.7, 0.15, 0.15), (0.98, 0.01, 0.01), (0.2, 0.3, 0.5), (0.05, 0.05, 0.9)):
        rows = spark.range(3, 201).select("id", dataset.split_sizes(F.col("id"), ratios).alias("s")).collect()
        assert [r.s for r in rows] == [plain_sizes(r.id, ratios) for r in rows]
    assert plain_sizes(23, (0.7, 0.15, 0.15)) == [16, 4, 3]
    with pytest.raises(ValueError):
        dataset.split_sizes(F.lit(10), (0.5, 0.5, 0.5))


def test_splits_within_groups_follow_the_hash_order(spark):
    rows = [(w, f"g{w}-{k}") for w in (1, 2) for k in range(11 + w)]
    found = dataset.assign_splits(spark.createDataFrame(rows + rows[:3], "w int, group_id string"), 7, within=("w",)).collect()
    for w in (1, 2):
        order = sorted((g for v, g in rows if v == w), key=lambda g: (hashlib.sha256(f"7:{g}".encode()).hexdigest(), g))
        a, b, _ = plain_sizes(len(order), (0.7, 0.15, 0.15))
        assert {r.group_id: (r.place, r.split) for r in found if r.w == w} == {g: (k, "train" if k < a else "validation" if k < a + b else "test") for k, g in enumerate(order)}
    with pytest.raises(Exception, match="three groups"):
        dataset.assign_splits(spark.createDataFrame([("a",), ("b",)], "group_id string"), 7).collect()


def test_one_repeated_id_fails_all_events_of_a_session(spark):
    rows = actions([("q1", "p-1"), ("q2", "p-1")])
    rows[3] = (rows[2][0], *rows[3][1:])
    run = pipeline.run(spark.createDataFrame(rows, RECORD), regions(spark))
    errors = [r.error for r in run.traces.collect()]
    assert len(errors) > 2 and set(errors) == {"DUPLICATE_POINT_ID"}


def test_flags_stand_in_order_of_first_sight(spark):
    rows = actions([("q1", "p-1"), (None, "p-1")])
    rows[0] = rows[0][:8] + (None, *rows[0][9:])
    rows[1] = rows[1][:5] + (None, *rows[1][6:])
    run = pipeline.run(spark.createDataFrame(rows, RECORD), regions(spark))
    asked = spark.createDataFrame([("s",), ("nothing",)], "session_id string")
    found = {r.session_id: r for r in trace.run_status(run.points, run.strokes, run.mappings, run.events, run.traces, asked).collect()}
    assert found["s"].quality_flags[:3] == ["MISSING_TIMESTAMP", "MISSING_PAGE", "INCOMPLETE"]
    assert found["s"].quality_flags[-2:] == ["MAPPING_UNKNOWN", "UNKNOWN_EVENT"] and found["s"].quality_status == "DEGRADED"
    assert (found["nothing"].quality_status, found["nothing"].quality_flags) == ("INVALID", ["EMPTY_INPUT"])


def test_other_sessions_and_segments_raise(spark):
    records = spark.createDataFrame(actions([("q1", "p-1")]), RECORD)
    assert pipeline.run(records, regions(spark), session_id="s", task_segment_id="g").events.count() == 2
    for wrong in ({"session_id": "other"}, {"task_segment_id": "other"}):
        with pytest.raises(Exception, match="isn't other"):
            pipeline.run(records, regions(spark), **wrong).events.collect()


def test_a_caller_names_segments_that_are_missing(spark):
    rows = [r[:3] + ("" if i < 2 else None, *r[4:]) for i, r in enumerate(actions([("q1", "p-1"), ("q2", "p-1")]))]
    run = pipeline.run(spark.createDataFrame(rows, RECORD), regions(spark), task_segment_id=None)
    assert {r.task_segment_id for r in run.events.collect()} == {None}
    from inkwell.operators.events import detect_events

    assert {r.task_segment_id for r in detect_events(run.mappings, task_segment_id="seg").collect()} == {"seg"}


def test_nested_fields_and_source_index(spark):
    schema = RECORD + ", source_index double, normalized struct<x_raw: double, timestamp_ms: double>"
    first, second = actions([("q1", "p-1")])
    rows = [(*first, 7.0, (1.5, None)), (*second, -1.0, None)]
    found = {r.raw_order: r for r in parse.parse_points(spark.createDataFrame(rows, schema)).collect()}
    assert (found[0].x_raw, found[0].timestamp_ms, found[0].source_index) == (1.5, None, 7)
    assert (found[1].x_raw, found[1].timestamp_ms, found[1].source_index) == (second[9], 50, 1)


def test_wire_provenance(spark):
    whole = {"dataset_type": "synthetic", "generator_version": "1", "seed": 3, "scenario_id": "a", "ground_truth_source": "plan", "manifest_hash": "sha256:" + "0" * 64}
    assert wire.checked_provenance(whole) == whole and wire.checked_provenance(None) == {} and wire.checked_provenance({"seed": None}) == {}
    for bad in ({"emotion": "sad"}, {"seed": True}, {"seed": "1"}, whole | {"manifest_hash": "sha256:1"}, {"dataset_type": "synthetic"}):
        with pytest.raises(ValueError):
            wire.checked_provenance(bad)
    run = pipeline.run(spark.createDataFrame(actions([("q1", "p-1")]), RECORD), regions(spark))
    wired = wire.wire_events(run.events, whole)
    assert tuple(wired.columns) == wire.COLUMNS and json.loads(wired.first().provenance) == whole
    assert {r.rule for r in wire.violations(wired).collect()} == {"SYNTHETIC_IDENTITY"}
    named = wired.withColumns({c: F.concat(F.lit("sim_"), c) for c in ("session_id", "participant_id", "task_segment_id")})
    assert wire.violations(named).count() == 0 and wire.out_of_context(named, "sim_s", "sim_g").count() == 0 and wire.out_of_context(named, "s", None).count() == 2
    assert {r.rule for r in wire.violations(named.withColumn("algorithm_version", F.lit(" Current"))).collect()} == {"MOVING_VERSION"}
    batch = wire.batches(wire.wire_events(run.events), "v1").first()
    assert (batch.n_events, batch.one_version, len(batch.events), batch.contract_version) == (2, True, 2, wire.BATCH_VERSION)
    for versions in (("latest", None), ("v1", "v2")):
        with pytest.raises(ValueError):
            wire.batches(wired, *versions)


def test_record_rules(spark):
    run = pipeline.run(spark.createDataFrame(actions([("q1", "p-1"), (None, "p-1")]), RECORD), regions(spark))
    assert contracts.event_violations(run.events).count() == 0 and contracts.stroke_violations(run.strokes).count() == 0 and contracts.region_violations(regions(spark)).count() == 0
    e, n = run.events, F.col("sequence")
    bad = e.withColumns(
        {
            "end_time_ms": F.when(n == 0, -1).when(n == 1, None).otherwise(F.col("end_time_ms")),
            "question_id": F.when(n != 3, F.col("question_id")),
            "quality_status": F.when(n == 4, "DEGRADED").otherwise(F.col("quality_status")),
            "start_time_ms": F.when(n == 4, None).otherwise(F.col("start_time_ms")),
            "quality_flags": F.when(n == 4, F.array().cast("array<string>")).otherwise(F.col("quality_flags")),
        }
    )
    assert {r.event_id[-1]: r.rule for r in contracts.event_violations(bad).collect()} == {"0": "TIME_ORDER", "1": "VALID_WITHOUT_TIME", "3": "QUESTION_MISSING", "4": "UNEXPLAINED_TIME"}
    assert [r.rule for r in contracts.stroke_violations(run.strokes.withColumn("duration_ms", F.lit(3))).collect()] == ["DURATION"] * 2
    shapes = [("few", [(0.0, 0.0), (1.0, 1.0)], "norm", "polygon"), ("out", [(0.0, 0.0), (2.0, 0.0), (1.0, 1.0)], "norm", "polygon"), ("odd", [(0.0, 0.0), (float("nan"), 0.0), (1.0, 1.0)], "norm", "polygon"), ("three", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], "norm", "rectangle"), ("raw", [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)], "legacy", "rectangle")]
    found = contracts.region_violations(spark.createDataFrame(shapes, "region_id string, polygon array<struct<x: double, y: double>>, coordinate_space string, region_type string")).collect()
    assert {r.region_id: r.rule for r in found} == {"few": "TOO_FEW_CORNERS", "out": "OUT_OF_RANGE", "odd": "NOT_FINITE", "three": "RECTANGLE_CORNERS"}
    texts = [("a", '{"x": {"emotion": 1, "y": [{"careless": 2}]}}'), ("b", '{"note": "his \\"emotion\\": none"}'), ("c", None)]
    assert sorted(map(tuple, contracts.out_of_scope(spark.createDataFrame(texts, "id string, meta string"), "meta", "id").select("id", "field").collect())) == [("a", "careless"), ("a", "emotion")]


def test_records_of_earlier_layouts(spark):
    points = contracts.legacy_points(spark.createDataFrame([("p", "s", 4, (7, 1.0, 2.0, 0.5)), ("q", "s", 5, None)], "point_id string, session_id string, raw_index int, normalized struct<timestamp_ms: long, x: double, y: double, pressure: double>"))
    assert [(r.raw_order, r.timestamp_ms, r.x_raw, r.pressure_raw, r.pen_state, r.quality_flags) for r in points.collect()] == [(4, 7, 1.0, 0.5, "UNKNOWN", []), (5, None, None, None, "UNKNOWN", [])]
    s = contracts.legacy_strokes(spark.createDataFrame([("a", "s", 5, 9, ["p"], (0.0, 0.0, 1.0, 1.0))], "stroke_id string, session_id string, start_timestamp_ms long, end_timestamp_ms long, raw_order array<string>, bbox struct<x: double, y: double, width: double, height: double>")).first()
    assert (s.point_refs, s.processed_order, s.duration_ms) == (["p"], ["p"], 4)
    rows = contracts.legacy_events(spark.createDataFrame([("a", "RETURN", "s", None, ["X"]), ("b", "WRITING", "s", 3, None)], "event_id string, event_type string, session_id string, occurred_at_ms long, quality_flags array<string>")).collect()
    assert [(r.question_id, r.quality_status, r.quality_flags, r.start_time_ms) for r in rows] == [("UNKNOWN", "DEGRADED", ["X", "TIME_UNAVAILABLE"], None), (None, "VALID", [], 3)]
    boxes = spark.createDataFrame([("r", "p", "q", 1.0, 2.0, 3.0, 4.0)], "region_id string, page_id string, question_id string, x double, y double, width double, height double")
    assert [tuple(c) for c in contracts.legacy_rectangles(boxes).first().polygon] == [(1.0, 2.0), (4.0, 2.0), (4.0, 6.0), (1.0, 6.0)]
    with pytest.raises(Exception, match="negative"):
        contracts.legacy_rectangles(boxes.withColumn("width", F.lit(-1.0))).collect()
    assert contracts.legacy_mappings(spark.createDataFrame([("a", 1, 2)], "stroke_id string, start_timestamp_ms long, start_time_ms long")).columns == ["stroke_id", "start_time_ms"]


def test_truth_narrows_by_page_then_question(spark):
    episodes = spark.createDataFrame(
        [("s", "a", 0, "p1", "q1", ["x"]), ("s", "b", 1, "p1", "q2", ["x", "y"]), ("s", "c", 2, "p2", None, ["y"]), ("s", "d", 3, None, "q1", ["z"])],
        "session_id string, episode_id string, episode_index long, page_id string, question_id string, point_refs array<string>",
    )
    events = [("one", "WRITING", None, None, ["z"]), ("page", "RETURN", "p1", None, ["y"]), ("question", "PAGE_CHANGE", "p1", "q2", ["x"]), ("many", "WRITING", None, None, ["x"]), ("none", "WRITING", None, None, ["lost"]), ("wrong", "WRITING", "p9", "q9", ["x"]), ("empty", "WRITING", None, None, [])]
    aligned = truth.align(episodes, spark.createDataFrame([("s", *e) for e in events], "session_id string, event_id string, event_type string, page_id string, question_id string, source_point_ids array<string>"))
    found = {r.truth_event_id: (r.alignment_status, r.matched_episode_ids) for r in aligned.collect()}
    assert found == {"one": ("ONE_TO_ONE", ["d"]), "page": ("ONE_TO_ONE", ["b"]), "question": ("ONE_TO_ONE", ["b"]), "many": ("ONE_TO_MANY", ["a", "b"]), "none": ("UNMATCHED", []), "wrong": ("ONE_TO_MANY", ["a", "b"]), "empty": ("UNMATCHED", [])}
    rows = truth.targets(episodes, aligned)
    assert {r.episode_id: r.target for r in rows.collect()} == {"a": [0] * 8, "b": [0, 0, 0, 1, 0, 1, 0, 0], "c": [0] * 8, "d": [1] + [0] * 7}
    assert [tuple(r) for r in truth.cooccurrence(rows).collect()] == [("RETURN", "PAGE_CHANGE", 1)]
    assert {r.event_type: r.n for r in truth.distribution(rows).collect()}["WRITING"] == 1 and audits.alignment(aligned).count() == 4


def test_pauses_and_quality_of_features(spark):
    rows = actions([("q1", "p-1"), ("q1", "p-1")])
    rows[1] = (*rows[1][:11], 1.5, 0.5, rows[1][13])  # out of range: a flag of the point alone
    run = pipeline.run(spark.createDataFrame(rows, RECORD), regions(spark))
    first, second = features.episodes(run.mappings).orderBy("episode_index").collect()
    assert (first.quality_valid, second.quality_valid) == (0.0, 1.0) and first.quality_flags == ["INVALID_NORM_COORDINATE"]
    assert first.path_length_norm is None and first.bbox_width_norm is None and second.bbox_width_norm == pytest.approx(0.01)
    alone = pipeline.run(spark.createDataFrame(rows[2:3], RECORD), regions(spark))
    assert features.episodes(alone.mappings).first().pause_inside_s is None


def test_normalizer_sees_train_only(spark):
    run = pipeline.run(spark.createDataFrame(actions([("q1", "p-1"), ("q2", "p-1"), ("q1", "p-1")]), RECORD), regions(spark))
    rows = features.episodes(run.mappings).withColumn("split", F.when(F.col("episode_index") < 2, "train").otherwise("test"))
    stats = {r.feature: r for r in features.normalizer(rows).collect()}
    assert stats["visit_index"].constant and (stats["visit_index"].mean, stats["visit_index"].std) == (1.0, 1.0)
    last = [r for r in features.normalized(rows, features.normalizer(rows)).collect() if r.split == "test"][0]
    assert last.values[features.FEATURES.index("visit_index")] == 1.0 and len(last.values) == len(last.mask) == 12


def test_feature_names():
    assert audits.feature_names(list(features.FEATURES)) == []
    assert audits.feature_names([*features.FEATURES[1:], "page_id", "odd"]) == [("ABSENT", "duration_s"), ("UNKNOWN", "odd"), ("UNKNOWN", "page_id"), ("IDENTIFYING", "page_id")]


def test_split_manifests_are_audited(spark):
    cases = spark.createDataFrame([(f"c{k}", f"u{k}", f"u{k}", ("train", "validation", "test")[k % 3]) for k in range(9)], "case_id string, participant_id string, group_id string, split string")
    good = dataset.split_manifests(cases, "d", "1", 3)
    assert audits.splits(cases, good, "d", "1", 3).count() == 0
    name = F.col("split_name")
    bad = good.where("split_name <> 'test'").withColumn("case_ids", F.when(name == "train", F.concat("case_ids", F.array(F.lit("c1"), F.lit("zz")))).otherwise(F.col("case_ids"))).withColumn("split_seed", F.when(name == "train", 4).otherwise(F.col("split_seed")))
    found = {(r.rule, r.id) for r in audits.splits(cases, bad, "d", "1", 3).collect()}
    assert found >= {("SPLIT_ABSENT", "test"), ("SPLIT_SEED", "train"), ("COUNT", "train"), ("CASE_UNKNOWN", "zz"), ("CASE_LABEL", "c1"), ("CASE_REPEATED", "c1"), ("CASE_UNLISTED", "c2"), ("PARTICIPANTS", "train")}
    assert {r.split: (r.participants, r.cases) for r in dataset.split_counts(cases).collect()} == {s: (3, 3) for s in dataset.SPLITS}
    scenarios = dataset.scenario_counts(spark.createDataFrame([("a",), ("a",)], "scenario_type string"), {"a": "f", "b": "g"})
    assert {tuple(r) for r in scenarios.collect()} == {("f", "a", 2), ("g", "b", 0)}


def test_labels_of_unknown_events_raise(spark):
    reviews = spark.createDataFrame([("s", "e1", "WRITING", None, "UNCERTAIN")], "session_id string, event_id string, predicted_event_type string, expected_event_type string, label string")
    put = lambda *rows: trace.apply_labels(reviews, spark.createDataFrame(rows, "event_id string, label string")).collect()
    assert put(("e1", "NO"))[0].label == "NO"
    with pytest.raises(Exception, match="no event under review"):
        put(("e2", "NO"))
    with pytest.raises(Exception, match="unknown label"):
        put(("e1", "MAYBE"))


def test_metrics_of_some_labels_and_coverage(spark):
    rows = spark.createDataFrame([(i, lab, int(i % 3 == 0), 0.1 * (i % 7)) for i in range(30) for lab in ("a", "b")] + [(i, "one", 1, 0.9) for i in range(30)], "id long, label string, target int, score double")
    both, one = metrics.overall(rows).first(), metrics.overall(rows, labels=["one"]).first()
    assert (both.evaluable_labels, one.evaluable_labels, one.macro_roc_auc, one.micro_f1) == (2, 0, None, 1.0)
    for bad in ([], ["a", "a"], ["zz"]):
        with pytest.raises(ValueError):
            metrics.overall(rows, labels=bad)
    asked = spark.createDataFrame([(i, "test") for i in range(4)], "id long, split string")
    assert tuple(metrics.coverage(asked.where("id < 3").unionByName(asked.where("id = 0")), asked).first()) == ("test", 4, 4, 3, 1)
    assert metrics.differing(rows, rows).count() == 0 and metrics.differing(rows, rows.where("id > 0").withColumn("target", F.when(F.col("id") == 1, 5).otherwise(F.col("target")))).count() == 6


def test_json_hashes_ignore_how_it_is_written(spark):
    texts = [('{"b": 1, "a": [1, "é"]}',), ('{"a":[1,"\\u00e9"],"b":1}',), (None,)]
    found = [r[0] for r in spark.createDataFrame(texts, "t string").select(json_hash(F.col("t"))).collect()]
    assert found[0] == found[1] == hashlib.sha256('{"a":[1,"é"],"b":1}'.encode()).hexdigest() and found[2] is None
    with pytest.raises(Exception, match="can't be hashed"):
        spark.createDataFrame([('{"a": NaN}',)], "t string").select(json_hash(F.col("t"))).collect()


def test_datasets_are_verified(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    tables = {"a": spark.createDataFrame([(1, "train"), (2, "test")], "x int, split string"), "b": spark.createDataFrame([], "y int")}
    store.write_dataset(tables, path)
    assert store.verify(spark, path, ["a", "b"]).count() == 0
    read = store.read_dataset(spark, path, ["a", "b"])
    assert sorted(map(tuple, read["a"].select("x", "split").collect())) == [(1, "train"), (2, "test")] and read["b"].count() == 0
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        store.write_dataset(tables, path)
    store.write_dataset(tables, path, overwrite=True)
    data = sorted((tmp_path / "d" / "tables" / "a").rglob("*.parquet"))
    (data[0].parent / "extra.parquet").write_bytes(data[0].read_bytes())
    data[1].unlink()
    assert {r.rule for r in store.verify(spark, path, ["a", "c"]).collect()} == {"UNLISTED_FILE", "MISSING_FILE", "TABLE_ABSENT"}
    with pytest.raises(ValueError, match="MISSING_FILE"):
        store.read_dataset(spark, path, ["a"])


def test_json_lines_are_read_strictly(spark, tmp_path):
    from inkwell.sources import pen

    whole = {"point_id": "p", "session_id": "s", "page_id": None, "timestamp_ms": 1, "sequence": 0, "x": 1.0, "y": 2.0}
    path = tmp_path / "points.jsonl"
    path.write_text(json.dumps(whole) + "\n\n" + json.dumps(whole | {"point_id": "q"}) + "\n")
    schema = "point_id string, session_id string, page_id string, timestamp_ms long, sequence long, x double, y double"
    assert [r.point_id for r in pen.read_points(spark, str(path), schema).orderBy("point_id").collect()] == ["p", "q"]
    path.write_text('{"point_id": \n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        pen.read_points(spark, str(path), schema).collect()
    squares = pen.default_regions(spark)
    assert contracts.region_violations(squares).count() == 0 and squares.count() == 4 and squares.select("page_id").distinct().count() == 2


def test_sequences_own_each_episode_once(spark):
    run = pipeline.run(spark.createDataFrame(actions([("q1", "p-1"), ("q2", "p-1"), ("q1", "p-1")]), RECORD), regions(spark))
    rows = features.episodes(run.mappings).withColumn("split", F.lit("train"))
    found = features.sequences(rows)
    assert audits.ownership(found, rows).count() == 0
    wrong = rows.where("episode_index > 0").withColumn("participant_id", F.when(F.col("episode_index") == 2, "other").otherwise(F.col("participant_id")))
    new = rows.limit(1).withColumn("episode_id", F.lit("new"))
    assert {(r.rule, r.id) for r in audits.ownership(found, wrong.unionByName(new)).collect()} == {("EPISODE_UNKNOWN", "s::stroke-0001"), ("EPISODE_PARTICIPANT", "s::stroke-0003"), ("EPISODE_UNOWNED", "new")}
    assert {r.rule for r in audits.ownership(found.unionByName(found), rows).collect()} == {"EPISODE_REPEATED"}
    odd = rows.withColumn("duration_s", F.lit(float("inf")))
    assert {(r.rule, r.id) for r in audits.inputs(odd.limit(1)).collect()} >= {("SPLIT_EMPTY", "test"), ("SPLIT_EMPTY", "validation")} and audits.inputs(odd).where("rule = 'NOT_FINITE'").count() == 3
