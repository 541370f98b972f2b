"""Periodic runs of words by an all-lag vectorised scan, and texts without the repeats.

1. A text's words become numbers. The array is compared with itself shifted by every lag up to n / MIN_EXPONENT; stretches of equal
   places are run-lengthed, and a stretch of length m at lag p is a run of m + p words.
2. A stretch that counts is so long that it covers four places in a row of any grid with its length less 3 as step. Each lag is
   compared at such a grid first, all lags of a range in one array; only lags that agree there are compared as a whole. This loses
   nothing: a lag without four equal places in a row on the grid has no stretch long enough.
3. A run of several times its period is found at the multiples of its smallest period too, in the same place (Fine and Wilf), so of
   stretches from the same first to the same last word the smallest lag stays.
4. Texts so long that all lags would be too much for one task are cut into ranges of lags, a row for each text and range, dealt to as
   many tasks; their runs are joined to the texts again. Copies of such a text are scanned once.

A run is a longest stretch of words with smallest period q and a length of at least MIN_WORDS and MIN_EXPONENT * q. ``collapsed`` leaves
out each word that stands in a run after the run's first q words.

Cases: null and empty texts have no words, no runs and an empty collapsed text; runs may overlap; rows need no doc_id, and repeated rows
have a row each; an empty table gives an empty table; columns of the same names as the new ones are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut, let, prepare, table

MIN_WORDS, MIN_EXPONENT = 24, 3
#: White space between words.
BLANKS = "\t\n\x0b\x0c\r "
#: Places compared in one task at most, if all lags of a range had to be compared as a whole; places compared at a time.
RANGE_PLACES, CHUNK = 1 << 30, 1 << 20
_TOGETHER = 4
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SPLIT = str.maketrans(dict.fromkeys(BLANKS, " "))


def words_of(text: str | None) -> list[str]:
    return [w for w in (text or "").translate(_SPLIT).split(" ") if w]


def numbered(words: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def least_stretch(lag: np.ndarray) -> np.ndarray:
    """Equal places in a row that a run of this period has at least."""
    return np.maximum(MIN_WORDS - lag, (MIN_EXPONENT - 1) * lag)


def likely_lags(ids: np.ndarray, low: int, high: int) -> np.ndarray:
    """The lags from low up to but not high that agree in four places in a row on their grid."""
    n, found = len(ids), []
    while low < high:
        step = least_stretch(np.arange(low, high)) - (_TOGETHER - 1)
        counts = np.maximum((n - np.arange(low, high) - _TOGETHER) // step + 1, 0)
        upto = max(1, int(np.searchsorted(np.cumsum(counts), CHUNK)))
        lags, counts, step = np.arange(low, low + upto), counts[:upto], step[:upto]
        lag = np.repeat(lags, counts)
        place = (np.arange(len(lag)) - np.repeat(np.cumsum(counts) - counts, counts)) * np.repeat(step, counts)
        for k in range(_TOGETHER):
            same = ids[place + k] == ids[place + lag + k]
            place, lag = place[same], lag[same]
        found.append(np.unique(lag))
        low += upto
    return np.concatenate([*found, np.zeros(0, np.int64)])


def stretches(ids: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of words that stay the same shifted by the lag, if long enough."""
    same = np.concatenate([[False], ids[lag:] == ids[:-lag], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= max(MIN_WORDS - lag, (MIN_EXPONENT - 1) * lag)
    return starts[long], (ends - starts)[long] + lag


def runs_of(ids: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with a period from low up to but not high, by start and period; of multiples the smallest in the range."""
    found: dict[tuple[int, int], int] = {}
    for lag in likely_lags(ids, low, min(high, len(ids) // MIN_EXPONENT + 1)).tolist():
        for start, length in zip(*(x.tolist() for x in stretches(ids, lag)), strict=True):
            found.setdefault((start, length), lag)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs) -> str:
    """The text without the words of each run after its first period."""
    if not runs:
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return " ".join([w for w, gone in zip(words, (np.cumsum(change) > 0).tolist(), strict=False) if not gone])


def _with(batch: pa.RecordBatch, drop: tuple[str, ...], **columns: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in (*columns, *drop)]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *columns.values()], names=[*names, *columns])


def _run_array(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], _RUN_TYPE)


def _scan_whole(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        all_words = [words_of(t) for t in batch.column("text").to_pylist()]
        runs = [runs_of(numbered(w), 1, len(w)) for w in all_words]
        collapsed = pa.array([collapse(w, r) for w, r in zip(all_words, runs, strict=True)], pa.string())
        yield _with(batch, ("text",), n_words=pa.array(list(map(len, all_words)), pa.int64()), runs=_run_array(runs), collapsed=collapsed)


def _scan_ranges(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("text", "low", "high")), strict=True)
        yield _with(batch, ("text", "low", "high"), runs=_run_array([runs_of(numbered(words_of(t)), low, high) for t, low, high in rows]))


def _finish(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        all_words = [words_of(t) for t in batch.column("text").to_pylist()]
        runs = [[tuple(r.values()) for r in own or ()] for own in batch.column("runs").to_pylist()]
        collapsed = pa.array([collapse(w, r) for w, r in zip(all_words, runs, strict=True)], pa.string())
        yield _with(batch, ("text",), n_words=pa.array(list(map(len, all_words)), pa.int64()), runs=_run_array(runs), collapsed=collapsed)


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), range_places: int = RANGE_PLACES) -> DataFrame:
    """keep, n_words, runs (array of start, length, period by start and period) and collapsed of every row. docs: text and the columns of keep."""
    kind = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], f"n_words bigint, runs {_RUNS}, collapsed string"])
    rows = docs.select(*keep, "text")
    most = F.expr("(coalesce(length(text), 0) + 1) div 2")  # words at most
    places = (most * (most / MIN_EXPONENT)).cast("double")
    short = rows.where(places <= range_places).mapInArrow(_scan_whole, kind)
    long = rows.where(places > range_places).withColumn("_text", F.sha2("text", 256))
    # A range has as many lags as fit, so a text's ranges grow with the square of its words.
    lags = F.greatest(F.lit(1), F.floor(range_places / most)).cast("long")
    ranges = long.select("_text", "text").dropDuplicates(["_text"]).withColumn("low", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(most / MIN_EXPONENT).cast("long") + 1, lags)))
    dealt = ranges.withColumn("high", F.col("low") + lags).repartition(F.xxhash64("_text", "low"))
    found = cut(dealt.mapInArrow(_scan_ranges, f"_text string, runs {_RUNS}"), "lag-ranges").select("_text", F.explode("runs").alias("r"))
    # Of one place the smallest period of all ranges; a text has fewer runs than words.
    found = found.groupBy("_text", "r.start", "r.length").agg(F.min("r.period").alias("period"))
    found = found.groupBy("_text").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])).cast(_RUNS)
    merged = long.join(found.withColumn("runs", runs), "_text", "left").drop("_text")
    return short.unionByName(merged.mapInArrow(_finish, kind))


def planted(text: Column, doc_id: Column) -> Column:
    """The text, or for every tenth crc32 of the number one whose words repeat from a place on."""
    h = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(ws: Column) -> Column:
        n, g = F.size(ws), F.floor(h / 10)
        made = lambda a: let((a + 1 + F.floor((n - a) / (3 + g % 8))).cast("int"), lambda end: F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, a + (i - a) % (end - a)))))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(let((g % F.greatest(n, F.lit(1))).cast("int"), made))

    return F.when(h % 10 == 0, F.array_join(let(words, repeated), " ")).otherwise(text)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first. Null if there is none."""
    first = F.get(runs, F.lit(0))
    return F.aggregate(runs, first, lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Every document's runs, some planted, and the text without its repeats, as digests."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))).withColumn("_best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = F.col("_best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
