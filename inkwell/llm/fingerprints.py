"""I-Match document fingerprints [native]: hashes of the sorted distinct terms within a document-frequency band, over several
random subsets of that lexicon.

Terms are lower-case runs of letters and digits, known by their 64-bit hash. The lexicon holds all terms that between ``LOW`` and
``HIGH`` of all documents have. The documents' distinct terms are n times their mean number, and a term of the lexicon takes at least
LOW * n of them, so it has at most (mean distinct terms of a document) / LOW terms whatever the size of the corpus: 155,000 for 310
terms a document. It is therefore sent to all tasks, as one array of terms in buckets. Everything else stays in a document's row.

Cases: a null text is an empty one; a text without lexicon terms is known by the hash of the whole text; equal texts have equal
fingerprints; documents with equal numbers are ordered by the hash of their text, a null number is the smallest; repeated rows follow
each other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import let, table

LOW, HIGH = 0.002, 0.2
#: (bits, subsets): so many random subsets, each with a share of 2 ** -bits of the lexicon.
SUBSETS = ((0, 1), (3, 2), (6, 20), (8, 24), (10, 16))
#: Documents that are ordered together, in at most so many ranges of numbers with further parts.
GROUP_ROWS, RANGES = 64, 1024


def terms(text: Column) -> Column:
    """Hashes of a text's distinct terms."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[int]:
    """Hashes of all terms within the band, counted over all documents."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce(F.col("text"), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return [r["term"] for r in counts.where((F.col("n") >= low * n) & (F.col("n") <= high * n)).select("term").collect()]


def numbers(values: np.ndarray) -> Column:
    """A constant array. It is one string until the optimizer folds it, so no expression per value is made."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def in_lexicon(lexicon: list[int]):
    """A test whether a term's hash is in the lexicon, by the bucket that its lower bits name."""
    if not lexicon:
        return lambda t: F.lit(False)
    bits = max(len(lexicon), 2).bit_length()
    known = np.array(lexicon, np.int64)
    bucket = known & ((1 << bits) - 1)
    flat = numbers(known[np.argsort(bucket, kind="stable")])
    starts = numbers(np.searchsorted(np.sort(bucket), np.arange((1 << bits) + 1)) + 1)

    def test(t: Column) -> Column:
        at = t.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        first = F.get(starts, at).cast("int")
        return F.array_contains(F.slice(flat, first, F.get(starts, at + 1).cast("int") - first), t)

    return test


def subset_tests() -> dict[tuple[int, int], list[int]]:
    """(shift, mask) and values: a term is in a subset if these bits of its hash have the subset's value."""
    tests: dict[tuple[int, int], list[int]] = {}
    for bits, n in SUBSETS:
        mask, places = (1 << bits) - 1, (64 - bits) // max(bits, 1)
        for i in range(n):
            tests.setdefault((bits * (i % places), mask), []).append((37 * (i // places) + 11 * i) & mask)
    return tests


def fingerprint(text: str, lexicon: list[int]) -> Column:
    """One hash per lexicon subset, 0 where the text has no term of it. text: the name of a column."""
    in_band = F.filter(terms(F.col(text)), in_lexicon(lexicon))

    def of_subset(s: Column) -> Column:
        return F.when(F.size(s) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(s))

    def of_bits(s: Column, shift: int, mask: int, values: list[int]) -> Column:
        """The subsets by these bits: terms of any of them first, which are few, then those of each."""
        part = lambda t: F.shiftrightunsigned(t, shift).bitwiseAND(F.lit(mask))
        has = lambda value: lambda t: part(t) == value
        return let(F.filter(s, lambda t: part(t).isin(values)), lambda near: F.array(*[let(F.filter(near, has(v)), of_subset) for v in values]))

    def hashes(s: Column) -> Column:
        tests = subset_tests()
        own = [F.array(of_subset(s)) if not mask else of_bits(s, shift, mask, values) for (shift, mask), values in tests.items()]
        return F.when(F.size(s) == 0, F.array_repeat(F.xxhash64(F.col(text)), sum(map(len, tests.values())))).otherwise(F.concat(*own))

    return let(F.sort_array(in_band), hashes)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets of which either text has terms."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), None).otherwise((x == y).cast("int")))
    return let(F.array_compact(pairs), lambda p: F.when(F.size(p) == 0, 0.0).otherwise(F.aggregate(p, F.lit(0), lambda s, x: s + x) / F.size(p)))


def in_groups(docs: DataFrame) -> DataFrame:
    """docs with _hash, _range and _group: ascending with (doc_id, hash of the text), a few dozen documents each even where the numbers
    are uneven, missing or all the same."""
    docs = docs.withColumn("_hash", F.xxhash64("text"))
    n, least = docs.agg(F.count("*"), F.min("doc_id")).first()
    # One number for both: equal doc_ids are told apart behind the point, as far as a double goes; what is left equal stays together.
    place = F.coalesce(F.col("doc_id"), F.lit((least or 0) - 2)).cast("double") + F.col("_hash") / 2.0**64 + 0.5
    ranges = min(RANGES, max(1, ceil(n / GROUP_ROWS)))
    low, high, bounds = docs.select(place.alias("p")).agg(F.min("p"), F.max("p"), F.percentile_approx("p", [i / ranges for i in range(1, ranges)] or [0.5], 20 * RANGES)).first()
    bounds = sorted({low or 0.0, *(bounds or [])})
    starts, ends = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, [*bounds[1:], (high or 0.0) + 1]))
    parts = max(1, ceil(n / ranges / GROUP_ROWS))

    def group(p: Column) -> Column:
        at = F.greatest(F.size(F.filter(starts, lambda b: b <= p)) - 1, F.lit(0))
        share = lambda k: (p - F.get(starts, k)) / F.greatest(F.get(ends, k) - F.get(starts, k), F.lit(1e-9))
        return let(at, lambda k: F.struct(k.alias("range"), F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(share(k) * parts))).cast("int").alias("group")))

    # Never null, which spares a filter that would keep one shuffle from serving both uses of the rows.
    known = lambda c: F.coalesce(F.col(c), F.lit(0))
    return docs.withColumn("_at", let(place, group)).withColumn("_range", known("_at.range")).withColumn("_group", known("_at.group")).drop("_at")


def with_next(docs: DataFrame, shown: Column) -> DataFrame:
    """docs (doc_id, text) with own (the value of shown) and, of the next document in descending order, next_text and next_own; after
    the last comes the first.

    A window per group finds it; the last of a group takes the first of the next group that has rows.
    """
    grouped = in_groups(docs)
    order = Window.partitionBy("_range", "_group").orderBy(F.desc_nulls_last("doc_id"), F.desc("_hash"), F.desc("text"))
    placed = grouped.repartition("_range", "_group").withColumn("_next", F.lead(F.struct("text")).over(order)).withColumn("_place", F.row_number().over(order)).withColumn("own", shown)
    firsts = placed.where("_place = 1").select(F.col("_range").alias("_r"), F.col("_group").alias("_g"), F.struct("text", "own").alias("_first"))
    placed = placed.withColumn("_next_own", F.lead("own").over(order))
    # The groups in order: within a range by a window, from range to range by another over a row per range.
    groups = grouped.select("_range", "_group").distinct()
    within = Window.partitionBy("_range").orderBy(F.desc("_group"))
    ranges = groups.groupBy("_range").agg(F.max("_group").alias("_top"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("_range"))
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = ranges.select("_range", F.coalesce(F.lead(F.struct("_range", "_top")).over(down), F.first(F.struct("_range", "_top")).over(whole)).alias("_after"))
    links = groups.withColumn("_lower", F.lead("_group").over(within)).join(after, "_range")
    links = links.select("_range", "_group", F.when(F.col("_lower").isNull(), F.col("_after._range")).otherwise(F.col("_range")).alias("_r"), F.coalesce("_lower", "_after._top").alias("_g"))
    heads = links.join(firsts, ["_r", "_g"]).select(F.col("_range").alias("_r"), F.col("_group").alias("_g"), "_first")
    joined = placed.join(heads, (placed["_range"] == heads["_r"]) & (placed["_group"] == heads["_g"]) & placed["_next"].isNull(), "left")
    last = F.col("_next").isNull()
    return joined.select("doc_id", "text", "own", F.when(last, F.col("_first.text")).otherwise(F.col("_next.text")).alias("next_text"), F.when(last, F.col("_first.own")).otherwise(F.col("_next_own")).alias("next_own"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and the likeness of its own to that and to the next document's."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = lexicon(docs)
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = with_next(docs, fingerprint("text", words)).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", fingerprint("edited", words).alias("edited_own"), "next_own")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.lower(F.hex(x))), "-")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("edited_own")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
