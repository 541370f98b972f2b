"""Best-fit packing of documents into sequences by bin completion.

Lengths are bounded by the capacity, so the whole corpus is summed up by one count per length, and ``fill`` plans on these counts,
all of them at once. Best-fit decreasing gives the first incumbent. The search then completes the bin of the largest remaining
length by undominated fillings, least waste first, taking each as often as the counts last; a branch is cut once its waste leaves
no room to beat the incumbent, and the search ends at the lower bound or after ``EFFORT`` steps with the better packing of the two.
Spark ranks every piece within its length and looks its place up in the plan, whose size doesn't depend on the corpus.

Cases: a null text is an empty one and takes one token; repeated rows each get a place; equal lengths are ranked by key and content; an empty
table gives no places; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, prepare, table, tokenizer_file
from inkwell.llm.tokens import file_encoder

CAPACITY = 2048
#: Steps of the search: fillings looked at, and comparisons of each with those before it. All pieces are placed whatever it is.
EFFORT = 500_000

Pattern = tuple[int, tuple[int, ...]]


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts per length: (number of bins, lengths in each). Bins filled alike are one group."""
    rooms: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    used = np.zeros(capacity + 1, bool)
    for x in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[x])
        while left:
            fits = np.flatnonzero(used[x:])
            room = x + int(fits[0]) if len(fits) else capacity
            n, pattern = rooms[room].pop() if len(fits) else (left, ())
            used[room] = bool(rooms[room]) if len(fits) else used[room]
            each = min(room // x, left)
            take = min(n, left // each)
            for bins, more in ((n - take, 0), (take, each)):
                if bins and (more or len(fits)):
                    at = room - more * x
                    rooms[at].append((bins, pattern + (x,) * more))
                    used[at] = True
            left -= take * each
    return [group for groups in rooms for group in groups]


def _dominated(b: tuple[int, ...], a: tuple[int, ...]) -> bool:
    """Whether filling a's items have room for all of b's: then a is no worse."""
    rooms = list(a)
    for x in b:
        at = next((i for i, room in enumerate(rooms) if room >= x), None)
        if at is None:
            return False
        rooms[at] -= x
    return True


def _exact(sizes: list[int], left: np.ndarray, reach: list[int], at: int, total: int) -> Iterator[tuple[int, ...]]:
    """Fillings of this very total from sizes[at:], the longest items first. reach: bit t of entry i says whether sizes[i:] can make t."""
    if not total:
        yield ()
        return
    for j in range(at, len(sizes)):
        if not reach[j] >> total & 1:
            return
        x = sizes[j]
        for k in range(min(total // x, int(left[x])), 0, -1):
            if reach[j + 1] >> (total - k * x) & 1:
                for rest in _exact(sizes, left, reach, j + 1, total - k * x):
                    yield (x,) * k + rest


class Budget:
    """Steps that a search has left."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self, steps: int = 1) -> bool:
        self.left -= steps
        return self.left > 0


def fillings(left: np.ndarray, room: int, budget: Budget) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of the room from the counts, least waste first. Between two results the counts must be the same."""
    if room and left[room]:
        yield (room,)  # it dominates all others
        return
    a = np.arange((room + 1) // 2, room)
    pair = (left[a] > 0) & (left[room - a] > 0) & ((2 * a != room) | (left[a] > 1))
    kept = [(int(x), room - int(x)) for x in a[pair][::-1]]
    yield from kept  # two items are dominated by the one above only
    sizes = (np.flatnonzero(left[1 : room + 1]) + 1)[::-1].tolist()
    reach, mask = [1], (1 << (room + 1)) - 1
    for x in reversed(sizes):
        bits, n, k = reach[-1], min(int(left[x]), room // x), 1
        while n:
            take = min(n, k)
            bits, n, k = bits | (bits << (x * take)) & mask, n - take, 2 * k
        reach.append(bits)
    reach.reverse()
    for total in range(room, -1, -1):
        if reach[0] >> total & 1:
            for f in _exact(sizes, left, reach, 0, total):
                if not budget.spend(1 + len(kept)):
                    return
                if not any(_dominated(f, g) for g in kept):
                    kept.append(f)
                    yield f


def completions(left: np.ndarray, capacity: int, budget: Budget) -> Iterator[Pattern]:
    """Ways to complete bins of the largest length: each filling as often as the counts last, then for one bin only."""
    largest = int(np.flatnonzero(left)[-1])
    left[largest] -= 1
    found = fillings(left, capacity - largest, budget)
    for f in found:
        left[largest] += 1
        pattern = (largest, *f)
        size, times = np.unique(pattern, return_counts=True)
        n = int((left[size] // times).min())
        yield n, pattern
        if n > 1:
            yield 1, pattern
        left[largest] -= 1
    left[largest] += 1


def fill(counts: dict[int, int], capacity: int = CAPACITY, effort: int = EFFORT) -> list[Pattern]:
    """(number of bins, lengths in each) that use up the counts, in as few bins as the search finds."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    best = best_fit(left, capacity)
    least = sum(n for n, _ in best)
    total = int((left * np.arange(capacity + 1)).sum())
    bound = max(-(-total // capacity), int(left[capacity // 2 + 1 :].sum()))
    path: list[Pattern] = []
    bins = waste = 0
    budget = Budget(effort)
    stack = [completions(left, capacity, budget)] if total else []
    while stack and least > bound and budget.spend():
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                n, pattern = path.pop()
                bins, waste = bins - n, waste - n * (capacity - sum(pattern))
                for x in pattern:
                    left[x] += n
            continue
        n, pattern = step
        lost = n * (capacity - sum(pattern))
        if waste + lost > (least - 1) * capacity - total:
            continue
        path.append(step)
        bins, waste = bins + n, waste + lost
        for x in pattern:
            left[x] -= n
        if left.any():
            stack.append(completions(left, capacity, budget))
        else:
            best, least = list(path), bins
            stack.append(iter(()))
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): the pieces of a length from that rank on stand at that offset, one per sequence."""
    ranks, rows, sequence = dict.fromkeys(counts, 0), [], 0
    for n, lengths in fill(counts, capacity):
        at = 0
        for x in lengths:
            rows.append((x, ranks[x], sequence, at))
            ranks[x] += n
            at += x
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids (binary, little-endian unsigned 32-bit); only documents beyond the capacity are cut."""

    def run(batches):
        encoder = file_encoder(tokenizer, words=True)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = [
                (doc, k, k * capacity, (x + end)[4 * k * capacity : 4 * (k + 1) * capacity])
                for doc, x in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True)
                for k in range(-(-(len(x) + 4) // (4 * capacity)))
            ]
            doc, k, start, ids = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset. Read several times: give a table, not a long computation."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row per length
    if not counts:
        return pieces.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    slots = spark.sparkContext.broadcast(plan(counts, capacity))
    # A length may be as frequent as you like: it is ranked in many parts, whose first ranks are sums over the parts before.
    parts = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # By its ids as well, so that rows of one number, or of none, are dealt too.
    same = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64(*same), F.lit(parts)))
    sizes = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    firsts = sizes.withColumn("_first", F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*same)) - 1
    ranked = dealt.withColumn("_own", own).join(firsts, ["length", "_part"]).withColumn("_rank", F.col("_own") + F.col("_first")).drop("_part", "_own", "_first")

    def run(batches):
        rows = slots.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, (batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64) << 44) + rank, "right") - 1
            found = rows[at]
            cols = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in cols], pa.array(found[:, 2] + rank - found[:, 1]), pa.array(found[:, 3])], names=[*cols, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, `offset` bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of docs with their places; ids_crc32 is taken of the ids, which stay only if asked for."""
    found = pieces(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return place(cut(found if keep_ids else found.drop("ids"), "pieces"), capacity)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), keep_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
