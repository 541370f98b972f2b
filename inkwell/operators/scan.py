"""Scans over the ordered rows of a key that may be far more than a task holds.

A key's rows are cut into pieces that follow each other in its order. Windows see one piece at a time; a summary, a row for each piece,
then carries what holds at the boundaries (the row before, the last known values, counts) from piece to piece and is joined back. Results
are those of windows over the whole key.

Cases: the keys, the piece and the order's columns mustn't be null (callers stand a value in); rows that are alike in key and order have
an arbitrary order among them, as in windows; a key of one piece is carried nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a piece, about.
PIECE_ROWS = 1 << 16


def by_number(number: Column, size: int = PIECE_ROWS) -> Column:
    """The piece of a row whose order is a number that counts rows, gaps aside."""
    return F.floor(number / size).cast("long")


def by_counts(rows: DataFrame, keys: Sequence[str], buckets: Sequence[str], size: int = PIECE_ROWS, name: str = "_piece") -> DataFrame:
    """rows with the piece: consecutive buckets together, until they have so many rows. buckets: columns that never fall in the order.

    A bucket is in one piece, so a piece has so many rows more than size as its last bucket has.
    """
    counts = rows.groupBy(*keys, *buckets).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(*buckets)) - F.col("_n")
    return rows.join(counts.select(*keys, *buckets, F.floor(before / size).cast("long").alias(name)), [*keys, *buckets])


def by_range(rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Callable[[DataFrame, str], DataFrame], name: str = "_piece") -> DataFrame:
    """rows with the piece: the part of a range partitioning by keys and order, whatever the order's columns hold. Ranges are drawn from a
    sample, so the rows are written with theirs (keep)."""
    return keep(rows.repartitionByRange(*keys, *order).withColumn(name, F.spark_partition_id().cast("long")), "ranges")


def scan(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], piece: str = "_piece", lag: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, ends: str | None = None,
) -> DataFrame:
    """rows with, of the rows of the same keys in order: lag, values of the row before; last, values last known before the row; total,
    sums up to the row and with it; ends, whether the row is the last."""
    lag, last, total = lag or {}, last or {}, total or {}
    own = Window.partitionBy(*keys, piece).orderBy(*order)
    prior = own.rowsBetween(Window.unboundedPreceding, -1)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.struct(*order)
    across = Window.partitionBy(*keys).orderBy(piece)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.struct(*[v.alias(n) for n, v in lag.items()]) if lag else None

    made, sums, carried = {}, [], {}
    if lag:
        made["_lag"] = F.lag(whole).over(own)
        sums.append(F.max_by(whole, at).alias("_lag_"))
        carried["_lag_"] = F.lag("_lag_").over(across)
    for n, v in last.items():
        made[f"_own_{n}"] = F.last(v, ignorenulls=True).over(prior)
        sums.append(F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_to_{n}"))
        carried[f"_to_{n}"] = F.last(f"_to_{n}", ignorenulls=True).over(earlier)
    for n, v in total.items():
        made[f"_own_{n}"] = F.sum(v).over(upto)
        sums.append(F.sum(v).alias(f"_to_{n}"))
        carried[f"_to_{n}"] = F.sum(f"_to_{n}").over(earlier)
    if ends:
        made["_alone"] = F.lead(F.lit(True)).over(own).isNull()
        sums.append(F.lit(True).alias("_there"))
        carried["_there"] = F.lead(F.lit(True)).over(across).isNull()
    summary = rows.groupBy(*keys, piece).agg(*sums).withColumns(carried)
    found = rows.withColumns(made).join(summary, [*keys, piece])
    values = {}
    if lag:
        first = F.coalesce("_lag", "_lag_")
        values |= {n: first[n] for n in lag}
    values |= {n: F.coalesce(f"_own_{n}", f"_to_{n}") for n in last}
    values |= {n: F.coalesce(f"_own_{n}", F.lit(0)) + F.coalesce(f"_to_{n}", F.lit(0)) for n in total}
    if ends:
        values[ends] = F.col("_alone") & F.col("_there")
    return found.withColumns(values).drop(*made, *carried)


def whole(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], lag: dict[str, Column] | None = None, last: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None, ends: str | None = None,
) -> DataFrame:
    """What scan gives, by windows over the whole key, for keys that a task holds."""
    own = Window.partitionBy(*keys).orderBy(*order)
    prior = own.rowsBetween(Window.unboundedPreceding, -1)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {n: F.lag(v).over(own) for n, v in (lag or {}).items()}
    made |= {n: F.last(v, ignorenulls=True).over(prior) for n, v in (last or {}).items()}
    made |= {n: F.coalesce(F.sum(v).over(upto), F.lit(0)) for n, v in (total or {}).items()}
    if ends:
        made[ends] = F.lead(F.lit(True)).over(own).isNull()
    return rows.withColumns(made)


def longer(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The keys of more rows than most. There is one at most for each so many rows, so all tasks know them."""
    return F.broadcast(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key))


def longest(rows: DataFrame, key: str) -> int:
    """Rows of the key that has most."""
    return rows.groupBy(key).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def together(rows: DataFrame, key: str) -> DataFrame:
    """rows shuffled by key. The number of parts is stated, since adaptive execution would else make about as many as there are cores: what
    follows costs far more than its bytes tell, and where there are a few parts more than cores, most cores wait for the last."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def by_length(
    rows: DataFrame, key: str, most: int, short: Callable[[DataFrame], DataFrame], long: Callable[[DataFrame], DataFrame], counted: DataFrame | None = None,
    known: int | None = None, placed: bool = False,
) -> DataFrame:
    """short of the rows of keys that have so many at most, which stand together by key, and long of the others' rows. Whether there is a
    longer key is looked up first; mostly there is none, and the rows are then read once. counted: what has as many rows of each key and
    is cheaper to read. known: so many rows that no key has more, if that is known; where it isn't more than most, nothing is looked up.
    placed: whether the rows come from an operator that has put them together by key; they aren't shuffled again then.
    """
    stand = lambda r: r if placed else together(r, key)
    if known is not None and known <= most:
        return short(stand(rows))
    several = longer(rows if counted is None else counted, key, most)
    if several.isEmpty():
        return short(stand(rows))
    return short(stand(rows.join(several, key, "left_anti"))).unionByName(long(rows.join(several, key, "left_semi")))


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """keys and, for each name in shares, the exact quantile (linear between the two values next to it). Values are counted, and the counts
    summed in order over range partitions; nulls are left out, and a key without values has no row."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = scan(by_range(counts, keys, (value,), keep), keys, (value,), total={"_upto": F.col("_n")})
    every = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    at = {n: (F.col("_all") - 1) * F.lit(float(p)) for n, p in shares.items()}
    sides = [F.min(F.when(F.col("_upto") > f(t), F.col(value))).cast("double").alias(f"_{n}_{f.__name__}") for n, t in at.items() for f in (F.floor, F.ceil)]
    found = upto.join(every, list(keys)).groupBy(*keys, "_all").agg(*sides)
    return found.select(*keys, *[(F.col(f"_{n}_floor") + (F.col(f"_{n}_ceil") - F.col(f"_{n}_floor")) * (t - F.floor(t))).alias(n) for n, t in at.items()])
