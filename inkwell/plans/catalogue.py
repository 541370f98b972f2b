"""Registered queries and the SQL that DuckDB compares them with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.canonical import json_hash
from inkwell.operators import audits, contracts, dataset, features, lineage, metrics, parse, replay, strokes, trace, truth, wire
from inkwell.plans import pipeline
from inkwell.plans.sql import ORACLES
from inkwell.sources import jsonl, pen, store


def _round(c: str | Column) -> Column:
    return F.floor(F.col(c) * 1_000_000 + 0.5 if isinstance(c, str) else c * 1_000_000 + 0.5) / 1_000_000


def _joined(c: str) -> Column:
    return F.array_join(c, ",")


def _points(spark, sf):
    return parse.parse_points(pen.pen_points(spark, sf), placed=True)


def _strokes(spark, sf):
    """Points are read several times, so they are written first."""
    return strokes.build_strokes(store.keeper(spark, "points")(_points(spark, sf), "points"), pen.STROKES)


def _run(spark, sf, keep_events: bool = True, one_pass: bool = False) -> pipeline.Run:
    return pipeline.run(pen.pen_points(spark, sf), pen.pen_regions(spark), pen.STROKES, pen.MAPPING, pen.EVENTS, session_end_ms=pen.SESSION_END_MS, keep_events=keep_events, one_pass=one_pass, placed=True, counted=pen.pen_ids(spark, sf))


def _lazy_run(spark, sf) -> pipeline.Run:
    """A run of which one table is read once."""
    return _run(spark, sf, keep_events=False, one_pass=True)


def _splits(points: DataFrame) -> DataFrame:
    return dataset.assign_splits(points.select(F.col("participant_id").alias("group_id")), 20260930).select(F.col("group_id").alias("participant_id"), "split")


def _lazy_episodes(spark, sf):
    """Episodes with the split of their participant, for queries that read them once."""
    return _episodes_of(_lazy_run(spark, sf), pen.pen_ids(spark, sf))


def _episodes(spark, sf, *columns: str):
    """The same, written, for queries that read them several times. columns: those that are read, if not all."""
    e = _lazy_episodes(spark, sf)
    return store.keeper(spark, "episodes")(e.select(*columns) if columns else e, "episodes")


def _episodes_of(r: pipeline.Run, points: DataFrame) -> DataFrame:
    """points: what has as many rows of each participant. A participant has no more mappings than points."""
    return features.episodes(r.mappings, pen.FEATURES, _splits(points), points)


def _cases(spark, sf):
    points = pen.pen_ids(spark, sf)
    cases = points.select(F.col("session_id").alias("case_id"), "participant_id", F.col("participant_id").alias("group_id")).distinct()
    return cases.join(_splits(points), "participant_id")


def _frames(spark, sf):
    p = store.keeper(spark, "points")(_points(spark, sf), "points")
    return replay.replay_frames(p, strokes.build_strokes(p, pen.STROKES))


def _aligned(spark, sf):
    return truth.align(_episodes(spark, sf), pen.truth_events(_points(spark, sf)))


def _targets(spark, sf):
    e = _episodes(spark, sf)
    return truth.targets(e, truth.align(e, pen.truth_events(_points(spark, sf))))


def _predictions(spark, sf):
    """A fixture: targets and scores of two labels by formula over the orders."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    a = o.select(k.alias("id"), F.lit("a").alias("label"), (c % 3 == 0).cast("int").alias("target"), (((k * 7919 + c % 3 * 211) % 1000) / 1000.0).alias("score"))
    b = o.select(k.alias("id"), F.lit("b").alias("label"), (c % 7 < 2).cast("int").alias("target"), ((((k * 104729 - c % 7 * 31) % 500 + 500) % 500) / 500.0).alias("score"))
    return a.unionByName(b)


def _leakage(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    split = F.when(F.col("o_orderkey") % 10 == 0, "test").when(F.col("o_orderkey") % 10 == 1, "validation").otherwise("train")
    return dataset.leakage(o.select(split.alias("split"), F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order")), ["customer", "order"])


def _split(spark, sf):
    return dataset.assign_splits(spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("string").alias("group_id")), 20260930)


def _nation_splits(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").cast("string").alias("group_id"))
    return dataset.assign_splits(c, 20260930, within=("nation",))


def _status(r: pipeline.Run) -> DataFrame:
    """The status of all sessions and of one without points."""
    asked = r.points.select("session_id").unionByName(r.points.sparkSession.createDataFrame([("s-none",)], "session_id string"))
    return trace.run_status(r.points, r.strokes, r.mappings, r.events, r.traces, asked).withColumn("quality_flags", _joined("quality_flags"))


def _seeds(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select(F.col("c_custkey").alias("participant"), F.col("c_nationkey").alias("scenario"), dataset.derive_seed(20260929, F.col("c_custkey"), F.col("c_nationkey")).alias("seed"))


def _page_changes(spark, sf):
    e = _lazy_run(spark, sf).events.where("event_type = 'PAGE_CHANGE'")
    return e.select("session_id", F.col("stroke_ref").alias("stroke_id"), F.col("reason").alias("change"))


def _events(spark, sf, *types: str) -> DataFrame:
    e = _lazy_run(spark, sf).events
    e = e.where(F.col("event_type").isin(*types)) if types else e
    return e.select("event_id", "event_type", "session_id", "sequence", "question_id", "previous_question_id", "next_question_id", "page_id", "start_time_ms", "end_time_ms", "stroke_ref", "quality_status", _joined("quality_flags").alias("quality_flags"), "reason")


def _with_run(f):
    return lambda spark, sf: f(_run(spark, sf))


def _with_events(f):
    """For queries that read the run's events several times, and no other table of it."""
    return lambda spark, sf: f(_run(spark, sf, one_pass=True))


def _with_lazy_run(f):
    return lambda spark, sf: f(_lazy_run(spark, sf))


#: Points that the fixture's index hasn't lost.
KNOWN = "raw_order % 97 <> 5"


def _single(points: DataFrame) -> DataFrame:
    """Points without those lost, one of each id."""
    return points.where(KNOWN).dropDuplicates(["session_id", "point_id"])


def _wired(r: pipeline.Run) -> DataFrame:
    return wire.wire_events(r.events, {"dataset_type": "observed", "generator_version": "1.2.0"})


def _broken_wire(r: pipeline.Run) -> DataFrame:
    """Wire events of which some have had a rule broken."""
    k = F.col("sequence") % 31
    w = r.events.select("event_id", "sequence").join(_wired(r), "event_id")
    timed = F.col("start_time_ms").isNotNull() & F.col("end_time_ms").isNotNull()
    return w.withColumns(
        {
            "end_time_ms": F.when((k == 1) & timed, F.col("start_time_ms") - 1).when((k == 2) & (F.col("quality_status") == "VALID"), None).otherwise(F.col("end_time_ms")),
            "algorithm_version": F.when(k == 3, " Latest ").otherwise(F.col("algorithm_version")),
            "point_refs": F.when(k == 4, F.array(F.lit(""))).otherwise(F.col("point_refs")),
        }
    )


def _reviewed(r: pipeline.Run) -> DataFrame:
    """Events beside a truth of which every 11th differs; every third is labelled by whether it agrees."""
    e, n = r.events, F.col("sequence")
    known = e.select("session_id", "sequence", F.when(n % 11 == 10, "UNKNOWN").otherwise(F.col("event_type")).alias("event_type"))
    labels = e.where(n % 3 == 0).select("event_id", F.when(n % 11 == 10, "NO").otherwise("YES").alias("label"))
    return trace.apply_labels(trace.review_template(e, known), labels)


def _audited(r: pipeline.Run) -> DataFrame:
    """References with lost points, every tenth stroke lost, and one case twice."""
    cases = r.points.select("session_id").distinct()
    cases = cases.unionByName(cases.where("session_id = 's-1'"))
    kept = r.strokes.where(F.col("stroke_index") % 10 != 3)
    return audits.references(r.points.where(KNOWN), kept, r.mappings, r.events, cases)


def _broken_ranges(spark, sf):
    k = F.col("episode_index")
    e = _lazy_episodes(spark, sf)
    e = e.withColumn("question_occupancy", F.when(k % 13 == 12, 1.5).otherwise(F.col("question_occupancy")))
    e = e.withColumn("duration_s", F.when(k % 17 == 16, -1.0).otherwise(F.col("duration_s")))
    return audits.ranges(e.withColumn("quality_valid", F.when(k % 19 == 18, 0.5).otherwise(F.col("quality_valid"))))


def _moved_splits(spark, sf):
    e = _episodes(spark, sf)
    cases = _cases(spark, sf).select(F.col("case_id").alias("session_id"), "split")
    moved = e.withColumn("split", F.when(F.col("episode_index") % 23 == 22, "test").otherwise(F.col("split")))
    return audits.inherited_splits(moved, cases, cases)


def _ownership(spark, sf):
    """Sequences against episodes of which some have since been moved, changed or lost."""
    e, k = _episodes(spark, sf), F.col("episode_index")
    moved = e.where(k % 31 != 30).withColumns({"split": F.when(k % 23 == 22, "elsewhere").otherwise(F.col("split")), "duration_s": F.when(k % 29 == 28, -1.0).otherwise(F.col("duration_s"))})
    return audits.ownership(features.sequences(e), moved)


def _split_audit(spark, sf):
    cases = _cases(spark, sf)
    manifests = dataset.split_manifests(cases, "pen", "1.0.0", 20260930)
    first = cases.where("split = 'train'").agg(F.min("case_id").alias("_first"))
    moved = cases.join(F.broadcast(first), F.col("case_id") == F.col("_first"), "left").withColumn("split", F.when(F.col("_first").isNotNull(), "test").otherwise(F.col("split"))).drop("_first")
    return audits.splits(moved, manifests, "pen", "1.0.0", 20260930)


def _stored(spark, sf):
    """The run's tables written as a dataset, verified, and read again: rows of each."""
    folder = store.scratch_dir(spark, "dataset")
    r = _run(spark, sf, keep_events=False)  # each table is read once, when it is written
    tables = {"points": r.points, "mappings": r.mappings.drop("norm_points", "raw_points"), "events": r.events, "episodes": _episodes_of(r, pen.pen_ids(spark, sf))}
    store.write_dataset(tables, folder)
    found = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in store.read_dataset(spark, folder, list(tables)).items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def _normalized(spark, sf):
    """Per split and feature: episodes, those where it is known, and the sum of the z-scores."""
    e = _episodes(spark, sf)
    rows = features.normalized(e, features.normalizer(e)).select("split", F.posexplode(F.arrays_zip("values", "mask")).alias("k", "x"))
    total = F.floor(F.sum("x.values") * 100 + 0.5) / 100
    return rows.groupBy("split", F.get(F.array(*map(F.lit, features.FEATURES)), F.col("k")).alias("feature")).agg(F.count("*").alias("n"), F.sum("x.mask").alias("known"), total.alias("total"))


def _sequences(spark, sf):
    s = features.sequences(_lazy_episodes(spark, sf))
    masks = F.transform("feature_mask", lambda m: F.array_join(m, "|"))
    total = F.aggregate(F.flatten("values"), F.lit(0.0), lambda a, x: a + x)
    return s.select("session_id", _joined("episode_ids").alias("episode_ids"), F.array_join(masks, ",").alias("masks"), (F.floor(total * 100 + 0.5) / 100).alias("total"), F.col("n").cast("long").alias("n"))


def _hashes(spark, sf):
    payload = F.to_json(F.struct(F.col("point_id").alias("point"), F.col("raw_order").alias("order"), F.col("device_id").alias("device")), {"ignoreNullFields": "false"})
    return pen.pen_points(spark, sf).select("session_id", "raw_order", json_hash(payload).alias("payload_hash"))


def _deltas(spark, sf):
    p = _predictions(spark, sf)
    return metrics.deltas(metrics.confusion(p), metrics.confusion(p, 0.4), ["f1"]).select("label", _round("f1").alias("f1"))


#: A dataset's config, as its lineage has it.
CONFIG = {"dataset_id": "pen", "dataset_version": "1.0.0", "dataset_seed": 20260929, "split_seed": 20260930, "split_ratio": {"train": 0.7, "validation": 0.15, "test": 0.15}}


def _lineage(spark, sf):
    """What a reload finds where, since its lineage was stated, every 17th case has changed, every 71st names another version, one has gone
    over to test in the manifests and the labels, the config has another seed, and an audit isn't what was stored."""
    folder = store.scratch_dir(spark, "lineage")
    number = F.regexp_extract("case_id", r"(\d+)$", 1).cast("long")
    cases = _cases(spark, sf).withColumns({"dataset_id": F.lit("pen"), "dataset_version": F.lit("1.0.0"), "raw_records_hash": F.sha2("case_id", 256), "quality_status": F.lit("OK")})
    keep = store.keeper(spark, "lineage")
    cases = keep(lineage.with_case_hash(cases), "cases")
    manifests = keep(dataset.split_manifests(cases, "pen", "1.0.0", 20260930), "manifests")
    tables = {"cases": cases, "split_manifests": manifests}
    store.write_dataset({k: df.withColumnRenamed("split", "split_label") for k, df in tables.items()}, folder)
    store.write_lineage(lineage.state(CONFIG, cases, manifests, lineage.standard_audits(CONFIG, cases, manifests)), folder)
    read = store.read_dataset(spark, folder, list(tables))
    cases, manifests = read["cases"].withColumnRenamed("split_label", "split"), read["split_manifests"]
    moved = F.lit(cases.where("split = 'train'").agg(F.min("case_id")).first()[0])
    changed = cases.withColumns(
        {
            "quality_status": F.when(number % 17 == 3, "DEGRADED").otherwise(F.col("quality_status")),
            "dataset_version": F.when(number % 71 == 5, "2.0.0").otherwise(F.col("dataset_version")),
            "split": F.when(F.col("case_id") == moved, "test").otherwise(F.col("split")),
        }
    )
    own = F.col("case_ids")
    over = F.when(F.col("split_name") == "train", F.array_remove(own, moved)).when(F.col("split_name") == "test", F.array_append(own, moved)).otherwise(own)
    stated = store.read_lineage(spark, folder).withColumn("n", F.col("n") + F.when(F.col("name") == "leakage", 1).otherwise(0))
    return lineage.changes(stated, CONFIG | {"dataset_seed": 1}, changed, manifests.withColumn("case_ids", over))


def _case_lines(spark, sf):
    """Strokes written as lines of their case and read back."""
    folder = store.scratch_dir(spark, "lines")
    s = _strokes(spark, sf).select(F.col("session_id").alias("case_id"), "stroke_id", "page_id", "n_points", "start_time_ms", "point_refs")
    jsonl.write_cases(s, "stroke", folder, ["stroke_id"])
    kind = "case_id string, stroke struct<n_points: bigint, page_id: string, point_refs: array<string>, start_time_ms: bigint, stroke_id: string>"
    rows = spark.read.text(folder, pathGlobFilter="*.jsonl")
    return rows.select("value", F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.case_id", "r.stroke.stroke_id", F.sha2("value", 256).alias("line_hash"))


def _guarded(spark, sf):
    """Fields that no output may have, planted at depth in every 13th event's metadata, some with an escaped key."""
    k = F.col("event_id") % 13
    nested = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "list": [1, {"careless": 2, "deep": {"emotion": null}}]}'))
    text = F.when(k == 3, nested).when(k == 5, F.lit('{"a": {"attention\\u005fscore": 1}, "note": "the word \\"emotion\\": none"}')).otherwise(F.col("props"))
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", text.alias("metadata"))
    return contracts.out_of_scope(rows, "metadata", "event_id")


def _quarantined(spark, sf):
    """Lines of which every 19th isn't JSON, every 23rd isn't an object and every 29th is blank."""
    folder = store.scratch_dir(spark, "raw-lines")
    i = F.col("event_id")
    line = F.when(i % 19 == 1, F.concat(F.lit('{"event_id": '), i.cast("string"))).when(i % 23 == 2, F.concat(F.lit("["), i.cast("string"), F.lit("]"))).when(i % 29 == 3, "  ")
    spark.read.parquet(f"{sf}/events.parquet").select(F.coalesce(line, F.to_json(F.struct("event_id", "event_type"))).alias("value")).write.text(folder)
    return jsonl.quarantine(spark, folder).select("reason", "text")


def _broken_events(r: pipeline.Run) -> DataFrame:
    """Rules that planted changes of events break."""
    k, timed = F.col("sequence") % 37, F.col("start_time_ms").isNotNull() & F.col("end_time_ms").isNotNull()
    e = r.events.withColumns(
        {
            "end_time_ms": F.when((k == 1) & timed, F.col("start_time_ms") - 1).when((k == 2) & (F.col("quality_status") == "VALID"), None).otherwise(F.col("end_time_ms")),
            "question_id": F.when((k == 3) & (F.col("event_type") != "WRITING"), None).otherwise(F.col("question_id")),
            "point_refs": F.when(k == 4, F.array(F.lit(""))).otherwise(F.col("point_refs")),
        }
    )
    return contracts.event_violations(e)


def _exported(r: pipeline.Run) -> DataFrame:
    """Batches of a run of which every 97th point of long sessions is lost."""
    found = wire.export(_wired(r), r.points.where(KNOWN), r.strokes, "v1", strict=False)
    return found.select("batch_id", "session_id", "status", "unresolved", "n_events", F.size(F.coalesce("events", F.array())).alias("handed_on"))


def _broken_regions(spark, sf):
    """Regions around each part's size, some with too few corners, out of range or no rectangle."""
    k = F.col("p_partkey")
    side = (F.col("p_size") / 100.0).cast("double")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    square = F.array(corner(zero, zero), corner(side, zero), corner(side, side), corner(zero, side))
    shape = F.when(k % 7 == 1, F.slice(square, 1, 2)).when(k % 7 == 2, F.slice(square, 1, 3)).when(k % 7 == 3, F.transform(square, lambda p: corner(p["x"] + 1.0, p["y"]))).otherwise(square)
    kind = F.when(k % 2 == 0, "rectangle").otherwise("polygon")
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("r-"), k).alias("region_id"), kind.alias("region_type"), shape.alias("polygon"), F.lit("norm").alias("coordinate_space"))
    return contracts.region_violations(rows)


def _broken_strokes(spark, sf):
    k = F.col("stroke_index") % 11
    s = _strokes(spark, sf).withColumns({"duration_ms": F.when(k == 1, F.col("duration_ms") + 1).when(k == 2, -1).otherwise(F.col("duration_ms")), "end_time_ms": F.when(k == 3, F.col("start_time_ms") - 5).otherwise(F.col("end_time_ms"))})
    return contracts.stroke_violations(s)


def _audit_summary(spark, sf):
    """PASS or FAIL of four audits, each with the rules that fail."""
    e = _episodes(spark, sf)
    cases = _cases(spark, sf)
    own = cases.select(F.col("case_id").alias("session_id"), "split")
    moved = e.withColumn("split", F.when(F.col("episode_index") % 23 == 22, "test").otherwise(F.col("split")))
    manifests = dataset.split_manifests(cases, "pen", "1.0.0", 20260930)
    return audits.summary({"feature_ranges": audits.ranges(e), "inherited_splits": audits.inherited_splits(moved, own, own), "splits": audits.splits(cases, manifests, "pen", "1.0.0", 20260930), "inputs": audits.inputs(e)})


def _prediction_coverage(spark, sf):
    """Orders by split, of which every 31st has no prediction and every 47th has two."""
    o, k = spark.read.parquet(f"{sf}/orders.parquet"), F.col("o_orderkey")
    rows = o.select(k.alias("id"), F.when(k % 10 == 0, "test").when(k % 10 == 1, "validation").otherwise("train").alias("split"))
    kept = rows.where("id % 31 <> 7")
    return metrics.coverage(kept.unionByName(kept.where("id % 47 = 11")), rows)


def _differing(spark, sf):
    """Predictions of a second run that has lost some rows and has other targets in some."""
    p = _predictions(spark, sf)
    other = p.where("id % 101 <> 13").withColumn("target", F.when(F.col("id") % 89 == 5, 1 - F.col("target")).otherwise(F.col("target")))
    return metrics.differing(p, other)


OVERALL = ("micro_precision", "micro_recall", "micro_f1", "macro_f1", "macro_roc_auc", "macro_average_precision", "evaluable_labels", "hamming_loss", "subset_accuracy")
def _feature_columns() -> list[Column]:
    return [_round(f).alias(f) if f not in ("visit_index", "return_count", "quality_valid") else F.col(f) for f in features.FEATURES]



def queries() -> dict:
    return {
        "parse_points": lambda s, d: _points(s, d).select("session_id", "point_id", "raw_order", "timestamp_ms", _round("x_norm").alias("x_norm"), _round("y_norm").alias("y_norm"), "pen_state", _joined("quality_flags").alias("flags")),
        "flag_histogram": lambda s, d: _points(s, d).select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n")),
        "export_eligible": lambda s, d: parse.eligible(_points(s, d)).groupBy("session_id").agg(F.count("*").alias("n")),
        "degraded_points": lambda s, d: _points(s, d).groupBy("session_id").agg(F.count(F.when(F.size("quality_flags") > 0, 1)).alias("degraded"), F.count("*").alias("total")),
        "strokes_basic": lambda s, d: _strokes(s, d).select("session_id", "stroke_id", "page_id", "n_points", "start_time_ms", "end_time_ms", "duration_ms"),
        "strokes_path": lambda s, d: _strokes(s, d).select("session_id", "stroke_id", _round("path_length_norm").alias("path_length")),
        "strokes_bbox": lambda s, d: _strokes(s, d).select("session_id", "stroke_id", F.col("bbox_space").alias("space"), _round("bbox.width").alias("width"), _round("bbox.height").alias("height")),
        "strokes_processed_order": lambda s, d: _strokes(s, d).select("session_id", "stroke_id", _joined("processed_order").alias("processed_order")),
        "stroke_quality": lambda s, d: _strokes(s, d).select("session_id", "stroke_id", _joined("quality_flags").alias("flags")),
        "stroke_mapping": _with_lazy_run(lambda r: r.mappings.select("session_id", "stroke_id", "question_id", "region_id", "status", "mapping_method", _round("confidence").alias("confidence"), _joined("quality_flags").alias("flags"))),
        "mapping_status_counts": _with_lazy_run(lambda r: r.mappings.groupBy("status", "mapping_method").agg(F.count("*").alias("n"))),
        "page_changes": _page_changes,
        "writing_evidence": lambda s, d: _events(s, d, "WRITING"),
        "visits_returns": lambda s, d: _events(s, d, "QUESTION_VISIT", "RETURN"),
        "question_leaves": lambda s, d: _events(s, d, "QUESTION_LEAVE"),
        "revisions": lambda s, d: _events(s, d, "REVISION_CANDIDATE"),
        "unknown_events": lambda s, d: _events(s, d, "UNKNOWN"),
        "process_ends": lambda s, d: _events(s, d, "PROCESS_END"),
        "process_events": lambda s, d: _events(s, d),
        "event_type_counts": _with_lazy_run(lambda r: r.events.groupBy("event_type", "quality_status").agg(F.count("*").alias("n"))),
        "replay_frames": lambda s, d: _frames(s, d).select("session_id", "frame_index", "point_id", "stroke_id", "page_id"),
        "replay_page_order": lambda s, d: replay.page_order(_frames(s, d)),
        "trace_resolution": _with_run(lambda r: trace.traces(r.events, r.strokes, _single(r.points))),
        "trace_errors": _with_run(lambda r: r.traces.where("error IS NOT NULL").groupBy("session_id", "event_type", "error").agg(F.count("*").alias("n"))),
        "run_status": _with_run(_status),
        "wire_events": _with_lazy_run(lambda r: _wired(r).withColumns({c: _joined(c) for c in ("point_refs", "stroke_refs")})),
        "wire_violations": _with_events(lambda r: wire.violations(_broken_wire(r))),
        "wire_batches": _with_lazy_run(lambda r: wire.batches(_wired(r), "v1").withColumn("event_ids", F.array_join(F.transform("events", lambda e: e["event_id"]), ",")).drop("events")),
        "wire_unresolved_refs": _with_run(lambda r: wire.unresolved(_wired(r), r.points.where(KNOWN), r.strokes.where(F.col("stroke_index") % 10 != 3)).withColumns({c: _joined(c) for c in ("missing_points", "missing_strokes")})),
        "review_template": _with_events(_reviewed),
        "review_summary": _with_events(lambda r: trace.review_summary(_reviewed(r))),
        "group_split": _split,
        "nation_splits": _nation_splits,
        "seed_derivation": _seeds,
        "leakage_audit": _leakage,
        "integrity_audit": _with_run(_audited),
        "split_manifests": lambda s, d: dataset.split_manifests(_cases(s, d), "pen", "1.0.0", 20260930).drop("group_ids").withColumns({c: _joined(c) for c in ("participant_ids", "case_ids")}),
        "split_counts": lambda s, d: dataset.split_counts(_cases(s, d)),
        "split_audit": _split_audit,
        "case_quality": _with_run(lambda r: dataset.case_quality(r.points, r.strokes, r.mappings, r.events)),
        "stored_dataset": _stored,
        "payload_hash": _hashes,
        "features_12": lambda s, d: _lazy_episodes(s, d).select("episode_id", "session_id", "participant_id", "stroke_id", "question_id", "status", "split", "episode_index", *_feature_columns()),
        "features_missingness": lambda s, d: features.missingness(_lazy_episodes(s, d), "split").withColumn("rate", _round("rate")),
        "feature_range_audit": _broken_ranges,
        "feature_split_audit": _moved_splits,
        "sequences": _sequences,
        "sequence_ownership": _ownership,
        "sequence_lengths": lambda s, d: features.sequences(_lazy_episodes(s, d)).groupBy(F.col("n").cast("long").alias("n")).agg(F.count("*").alias("cases")),
        "sequence_audit": lambda s, d: features.length_audit(features.sequences(_episodes(s, d))).withColumns({c: _round(c) for c in ("mean", "median", "p90")}),
        "normalizer_stats": lambda s, d: features.normalizer(_episodes(s, d)).select("feature", _round("mean").alias("mean"), _round("std").alias("std"), "constant"),
        "normalized_features": _normalized,
        "truth_alignment": lambda s, d: _aligned(s, d).withColumn("matched", _joined("matched_episode_ids")).drop("matched_episode_ids"),
        "alignment_audit": lambda s, d: audits.alignment(_aligned(s, d)),
        "targets_multihot": lambda s, d: _targets(s, d).select("episode_id", F.array_join("target", "").alias("target")),
        "target_distribution": lambda s, d: truth.distribution(_targets(s, d)),
        "target_cooccurrence": lambda s, d: truth.cooccurrence(_targets(s, d)),
        "confusion": lambda s, d: metrics.confusion(_predictions(s, d)).select("label", "tp", "fp", "fn", "tn", *[_round(c).alias(c) for c in ("precision", "recall", "f1", "mcc")]),
        "ranking": lambda s, d: metrics.ranking(_predictions(s, d)).select("label", _round("roc_auc").alias("roc_auc"), _round("average_precision").alias("average_precision")),
        "overall_metrics": lambda s, d: metrics.overall(_predictions(s, d)).select(*[_round(c).alias(c) if c != "evaluable_labels" else F.col(c) for c in OVERALL]),
        "metric_deltas": _deltas,
        "lineage_changes": _lineage,
        "case_lines": _case_lines,
        "guarded_fields": _guarded,
        "quarantined_lines": _quarantined,
        "event_violations": _with_events(_broken_events),
        "stroke_violations": _broken_strokes,
        "region_violations": _broken_regions,
        "wire_export": _with_run(_exported),
        "audit_summary": _audit_summary,
        "prediction_coverage": _prediction_coverage,
        "differing_predictions": _differing,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
