"""Exact top-k inner products by multi-resolution segment statistics.

1. Vectors become integers and are written once with a number for each row. Rows are packed into blocks: vectors, and for each
   resolution the means and deviations of their segments, each times the root of the segment's length.
2. With these, the squared distance of two vectors is at least the squared distance of their statistics (Cauchy-Schwarz in each
   segment), and both have the same norms; so the inner product (|q|^2 + |x|^2 - d^2) / 2 is at most that of their statistics.
3. Queries are packed into blocks of their own. A block is first searched in itself, which gives each query a score that its k-th best
   has at least.
4. Each block of rows meets each block of queries once, dealt to many tasks: pairs whose bound reaches the query's least score are
   bounded again at the next resolution, and survivors get their exact integer product. A block keeps k rows a query at most, and
   raises the least score as it goes. A window over these gives the k best of all.

Nothing is dropped unless k others have a higher score, so results are exact. All pairs of a query and a row are bounded, by stated
queries in blocks; what is joined are blocks.

Cases: vectors that are null or hold a null or non-finite component (or one that is infinite once scaled) take no part; vectors of
different lengths are compared as if the shorter ended in zeros, empty ones score 0; rows without a vec_id are no queries, and stand
behind all numbers in ties, then by row; a repeated query row is a query of its own, and the other copies are candidates for it; scores
beyond a 64-bit integer are held at its ends; an empty table, or one without queries, gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, prepare, table

K, SCALE, EVERY = 5, 256, 50
#: Segments of a vector at each resolution, coarse to fine.
RESOLUTIONS = (4, 16)
#: Rows of a block at most, bytes of its vectors at most, rows compared at a time, and pairs whose exact product is taken at a time.
BLOCK_ROWS, BLOCK_BYTES, STEP, PAIRS = 2048, 1 << 23, 512, 1 << 15
#: Relative error of a bound by rounding, at most.
SLACK = 1e-9
_NO_ID, _TOP = (1 << 63) - 1, (1 << 63) - 1
_PACKED = "n bigint, rows binary, ids binary, known binary, vectors binary"
_FOUND = "query_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint"


@dataclass
class Block:
    rows: np.ndarray
    ids: np.ndarray
    known: np.ndarray
    vectors: np.ndarray

    def __post_init__(self):
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.most = np.abs(self.vectors).max(initial=0.0)
        self.levels = [statistics(self.vectors, s) for s in RESOLUTIONS if s < self.vectors.shape[1]]

    @classmethod
    def of(cls, cell: dict, size: int) -> Block:
        vectors = np.frombuffer(cell["vectors"], np.float64).reshape(cell["n"], size)
        return cls(np.frombuffer(cell["rows"], np.int64), np.frombuffer(cell["ids"], np.int64), np.frombuffer(cell["known"], np.uint8), vectors)


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, times the root of its length."""
    size = vectors.shape[1]
    starts = np.arange(segments) * size // segments
    lengths = np.diff(np.append(starts, size))
    sums, squares = np.add.reduceat(vectors, starts, axis=1), np.add.reduceat(vectors**2, starts, axis=1)
    means = sums / np.sqrt(lengths)
    return np.concatenate([means, np.sqrt(np.maximum(squares - means**2, 0.0))], axis=1)


def products(a: np.ndarray, b: np.ndarray, most: float, paired: bool) -> np.ndarray:
    """Exact inner products of whole numbers, of rows a and b in pairs or of all with all, as 64-bit integers held at their ends."""
    if most * a.shape[1] < 2.0**53:  # all sums are exact
        return (np.einsum("ij,ij->i", a, b) if paired else a @ b.T).astype(np.int64)
    ints = [np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape) for m in (a, b)]
    found = (ints[0] * ints[1]).sum(axis=1) if paired else ints[0] @ ints[1].T
    return np.clip(found, -_TOP - 1, _TOP).astype(np.int64)


def pruned(q: Block, part: Block, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places whose bounds reach the query's least score at all resolutions, other than a row and itself."""
    reach = least - SLACK * (q.norms * part.norms.max(initial=0.0) + 1)
    near = q.rows[:, None] != part.rows[None]
    if q.levels and np.isfinite(reach).any():
        near &= ~(q.levels[0] @ part.levels[0].T < reach[:, None])  # so that a bound that isn't a number keeps its pair
    i, j = np.nonzero(near)
    for a, b in zip(q.levels[1:], part.levels[1:], strict=True):
        keep = [~(np.einsum("ij,ij->i", a[i[s : s + PAIRS]], b[j[s : s + PAIRS]]) < reach[i[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)]
        keep = np.concatenate([*keep, np.zeros(0, bool)])
        i, j = i[keep], j[keep]
    return i, j


def search_block(q: Block, rows: Block, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The k best rows of the block for each query, of those that may reach its least score: places of queries and rows, and scores."""
    least = np.full(len(q.rows), -np.inf) if least is None else least.copy()
    best = [np.zeros(0, np.int64)] * 3
    for start in range(0, len(rows.rows), STEP):
        s = slice(start, start + STEP)
        part = Block(rows.rows[s], rows.ids[s], rows.known[s], rows.vectors[s])
        i, j = pruned(q, part, least)
        if not len(i):
            continue
        most = q.most * part.most
        if 8 * len(i) > len(q.rows) * len(part.rows) and most * q.vectors.shape[1] < 2.0**53:
            score = products(q.vectors, part.vectors, most, False)[i, j]
        else:
            score = np.concatenate([products(q.vectors[i[a : a + PAIRS]], part.vectors[j[a : a + PAIRS]], most, True) for a in range(0, len(i), PAIRS)])
        near = score >= np.where(np.isfinite(least), least, -np.inf)[i] - SLACK * np.abs(score)
        i, j, score = (np.concatenate([x, y]) for x, y in zip(best, (i[near], j[near] + start, score[near]), strict=True))
        # By query, then score from the highest (-1 - x can't overflow), then number.
        order = np.lexsort((rows.rows[j], rows.ids[j], 1 - rows.known[j], -1 - score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        best = [i[keep], j[keep], score[keep]]
        full = rank == k - 1
        least[i[full]] = np.maximum(least[i[full]], score[full].astype(np.float64))
    return tuple(best)


def pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of rows (row, id, v), each with a number of its own."""
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * size)))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        lists = pa.concat_arrays(whole.column("v").chunks) if len(whole.column("v").chunks) != 1 else whole.column("v").chunk(0)
        lengths = np.diff(lists.offsets.to_numpy())
        vectors = np.zeros((len(lists), size))
        vectors[np.arange(size)[None] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        ids = whole.column("id")
        data = [whole.column("row").to_numpy().astype(np.int64), ids.fill_null(_NO_ID).to_numpy().astype(np.int64), ids.is_valid().to_numpy().astype(np.uint8), vectors]
        row = {"n": len(lists)} | {n: x.tobytes() for n, x in zip(("rows", "ids", "known", "vectors"), data, strict=True)}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("n", pa.int64()), *[(n, pa.binary()) for n in ("rows", "ids", "known", "vectors")]]))

    def run(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                take = min(most - n, batch.num_rows)
                held.append(batch.slice(0, take))
                batch, n = batch.slice(take), n + take
                if n == most:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return rows.select("row", "id", "v").mapInArrow(run, _PACKED)


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_row, query_id, rank, row, vec_id, score: the k best rows for each query. vectors: vec_id, embedding."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * scale)
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), scaled.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("v").isNotNull() & whole)
    # floor() of a large double isn't a long, so whole numbers stay doubles.
    floors = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    rows = cut(rows.withColumn("v", floors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    size, n = rows.agg(F.max(F.size("v")), F.count_if("asks")).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_row bigint, query_id bigint, rank int, row bigint, vec_id bigint, score bigint")
    size = max(size, 1)
    asked = pack(rows.where("asks").repartition(-(-n // max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * size))))), size)

    def least(batches):
        for batch in batches:
            for cell in batch.to_pylist():
                q = Block.of(cell, size)
                found = np.full(len(q.rows), -np.inf)
                i, _, score = search_block(q, q, k)
                full = np.arange(len(i)) - np.searchsorted(i, i) == k - 1
                found[i[full]] = score[full]
                yield pa.RecordBatch.from_pylist([cell | {"least": found.tobytes()}])

    asked = asked.mapInArrow(least, "n bigint, rows binary, ids binary, known binary, vectors binary, least binary").withColumn("number", F.monotonically_increasing_id())
    asked = cut(asked, "queries")
    numbers = F.array(*[F.lit(r["number"]) for r in asked.select("number").collect()])  # one for each block of queries
    queries = asked.select("number", F.struct("n", "rows", "ids", "known", "vectors", "least").alias("q"))
    blocks = pack(rows, size).select(F.struct("n", "rows", "ids", "known", "vectors").alias("x"), F.explode(numbers).alias("number"))

    def compare(batches):
        for batch in batches:
            for cell in batch.to_pylist():
                q, x = Block.of(cell["q"], size), Block.of(cell["x"], size)
                i, j, score = search_block(q, x, k, np.frombuffer(cell["q"]["least"], np.float64))
                ids = pa.array(x.ids[j], mask=x.known[j] == 0)
                yield pa.RecordBatch.from_arrays([pa.array(q.rows[i]), pa.array(q.ids[i]), pa.array(x.rows[j]), ids, pa.array(score)], names=["query_row", "query_id", "row", "vec_id", "score"])

    found = blocks.join(queries, "number").select("q", "x").mapInArrow(compare, _FOUND)
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "row", "vec_id", "score")


def op11_vector_search(spark, sf_dir: str) -> DataFrame:
    """The five best rows for each vector whose vec_id is divisible by 50."""
    prepare(spark)
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0).select("query_id", "rank", "vec_id", "score")
