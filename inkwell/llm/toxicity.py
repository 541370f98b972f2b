"""Toxicity by class-conditional Kneser-Ney models, one of toxic and one of ordinary documents.

Each class models a word by its continuation count, the number of different words that it follows in the class's documents, so that
copies of a document or a repeated line don't count as many. Counts are discounted by up to three, and what that frees goes to the
shared backoff: the continuation counts of both classes together. A word of at most three contexts in either class thus scores by the
shared backoff alone, neither toxic nor ordinary: the same ratio as a word never seen, whatever its own counts. (A further level,
words given the word before them, was measured and is left out: see the README.)

A document is scored by its length-normalised log-likelihood under the toxic model less that under the ordinary one: over all its
words, over its most toxic passage of ``WINDOW`` words, and over its ``STRONGEST`` strongest words. A logistic curve fitted on at
most ``FIT_ROWS`` training rows turns the three into a score.

All training documents and words are counted in Spark. The model is a table of all words whose ratio isn't that of the backoff; it
grows with the corpus. Only its ``HOT`` most frequent words are sent to every task; texts with other words of the table are joined with
it, the rest are scored where they stand. Words and texts are known by 64-bit hashes.

Cases: a null or empty text has ratios of 0 and the score that the curve gives them; without training rows of both classes all
scores are 0; documents with several labels are toxic if one says so; null labels and labels without doc_id are none; repeated rows
are scored alike; an empty table gives an empty table; columns of any name pass through; labels, lang, source and doc_id are never
inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut, id_filter, key_filter, prepare, table

WINDOW, STRONGEST = 50, 3
#: What a count of 1, of 2, and of 3 or more gives to the backoff.
DISCOUNTS = (1.0, 2.0, 3.0)
#: Words that all tasks know; the ratios of all others are joined.
HOT = 1 << 18
FIT_ROWS = 20_000
#: Words of text whose pairs a task sums up before it passes them on.
HELD = 1_000_000
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W_]+")
_MEMO = 300_000
_memo: dict[str, int] = {}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of the words, in order."""
    import xxhash

    if missing := set(words).difference(_memo):
        if len(_memo) + len(missing) > _MEMO:
            _memo.clear()
            missing = set(words)
        for w in missing:
            _memo[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words)).view(np.int64)


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the documents that may be learnt from, as a table of their own.

    Neither side is small for sure, so the join shuffles both, but only texts that an id filter lets through.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    known = cut(known.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), "labels")
    ids = id_filter(known, "doc_id")
    bitmap = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        for batch in batches:
            yield batch.filter(bitmap.value.passes(batch.column("at"))).select(["doc_id", "text"])

    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text", ids.place(F.col("doc_id").cast("long")).alias("at"))
    return cut(rows.mapInArrow(run, "doc_id bigint, text string").hint("merge").join(known, "doc_id"), "training")


def count_words(train: DataFrame) -> DataFrame:
    """key (of a word), toxic, ordinary: numbers of different words before it in the documents of each class."""

    def pairs(found: list[tuple[np.ndarray, bool]]):
        """The different pairs of each class."""
        for wanted in (True, False):
            words = [w for w, toxic in found if toxic == wanted]
            if not words:
                continue
            key, before = np.concatenate(words), np.concatenate([np.append(0, w[:-1]) for w in words])
            both = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (before.view(np.uint64) >> np.uint64(1))
            _, at = np.unique(both, return_index=True)
            short = (before[at].view(np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)  # enough to tell a word's neighbours apart
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(short), pa.array(np.full(len(at), 1 if wanted else 2, np.int8))], names=["key", "before", "classes"])

    def run(batches):
        found, n = [], 0
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = hashes(words_of(text))
                if len(words):
                    found.append((words, toxic > 0))
                    n += len(words)
            if n > HELD:
                yield from pairs(found)
                found, n = [], 0
        yield from pairs(found)

    rows = train.select("text", "toxic").mapInArrow(run, "key bigint, before int, classes tinyint")
    rows = rows.groupBy("key", "before").agg(F.bit_or("classes").alias("classes"))
    in_class = lambda bit: F.sum((F.col("classes").bitwiseAND(bit) > 0).cast("long"))
    return rows.groupBy("key").agg(in_class(1).alias("toxic"), in_class(2).alias("ordinary"))


def discount(n: Column) -> Column:
    return F.when(n >= 3, DISCOUNTS[2]).when(n == 2, DISCOUNTS[1]).when(n == 1, DISCOUNTS[0]).otherwise(0.0)


def ratios(counts: DataFrame) -> tuple[DataFrame, float]:
    """key, n, r: log of the toxic by the ordinary probability of each word that isn't left to the backoff; and that of all others.

    r has the ratio by all training documents, then with one toxic and with one ordinary count less: the documents that the curve is
    fitted on are scored without what they have added themselves. Where the discounts take all of both counts, the shared probability
    cancels out.
    """
    t, o = F.col("toxic"), F.col("ordinary")
    total = counts.agg(F.sum(t), F.sum(o), F.sum(discount(t)), F.sum(discount(o)), F.count("*")).first()
    nt, no, free_t, free_o, words = (float(x or 0) for x in total)
    both, least = nt + no + 0.5 * words + 0.5, 1e-9  # a class without words has the shared probabilities

    def ratio(t: Column, o: Column) -> Column:
        shared = (t + o + 0.5) / both
        p = [(n - discount(n) + (free + least) * shared) / (of + least) for n, free, of in ((t, free_t, nt), (o, free_o, no))]
        return F.log(p[0] / p[1])

    less = lambda n: F.greatest(n - 1, F.lit(0))
    own = counts.where((t > discount(t)) | (o > discount(o)))
    found = cut(own.select("key", (t + o).alias("n"), F.array(ratio(t, o), ratio(less(t), o), ratio(t, less(o))).alias("r")), "ratios")
    return found, log((free_t + least) / (nt + least)) - log((free_o + least) / (no + least))


def features_of(ratio: np.ndarray, places: np.ndarray) -> list[float]:
    """Mean ratio, mean ratio of the best window, mean of the strongest different words of a text. ratio: of each word; places: the
    text's words in it."""
    if not len(places):
        return [0.0, 0.0, 0.0]
    each = ratio[places]
    sums = np.concatenate([[0.0], np.cumsum(each)])
    n = min(WINDOW, len(each))
    strongest = np.sort(ratio[np.unique(places)])[-STRONGEST:]
    return [float(each.mean()), float((sums[n:] - sums[:-n]).max() / n), float(strongest.sum() / STRONGEST)]


def features(docs: DataFrame, found: DataFrame, other: float, hot: int = HOT) -> DataFrame:
    """text_key, kind, x: the features of each different text. docs: text_key, kind (place in r), text.

    The hot words, which follow most others, are known to all tasks. A text none of whose words is in the rest of the table, as a filter
    of its keys says, is done where it stands; of the other texts, each such word is a row that is joined with the ratios.
    """
    spark = docs.sparkSession
    top = found.orderBy(F.desc("n"), "key").limit(hot).toArrow().sort_by("key")
    ratio = np.array(top["r"].combine_chunks().flatten(), np.float64).reshape(-1, 3)
    rest = None  # what isn't hot; ties at the edge may be in both
    if len(top) == hot:
        rest = key_filter(found.where(F.col("n") <= min(top["n"].to_pylist())) if hot else found, "key")
    known = spark.sparkContext.broadcast((top["key"].to_numpy(), ratio, rest))
    names, types = ["text_key", "kind", "x", "blob", "cold"], [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.int64())]

    def run(batches):
        (keys, ratio, table), seen = known.value, set()
        for batch in batches:
            rows: list[tuple] = []
            for key, kind, text in zip(*(batch.column(c).to_pylist() for c in ("text_key", "kind", "text")), strict=True):
                if (key, kind) in seen:
                    continue
                seen.add((key, kind))
                words, at = np.unique(hashes(words_of(text)), return_inverse=True)
                place = np.searchsorted(keys, words)
                is_hot = keys[np.minimum(place, len(keys) - 1)] == words if len(keys) else np.zeros(len(words), bool)
                is_cold = ~is_hot & table.has(words) if table else np.zeros(len(words), bool)
                if is_cold.any():
                    # Places: hot words, then the cold ones, then all others as one.
                    cold = words[is_cold]
                    place[~is_hot] = len(keys) + len(cold)
                    place[is_cold] = len(keys) + np.arange(len(cold))
                    blob = zlib.compress(np.concatenate([[len(cold), len(words)], place, at]).astype(np.uint32).tobytes(), 1)
                    rows.append((key, kind, None, blob, cold))
                else:
                    values = np.full(len(words), other)
                    values[is_hot] = ratio[place[is_hot], kind]
                    rows.append((key, kind, features_of(values, at), None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def finish(batches):
        ratio = known.value[1]
        for batch in batches:
            out = []
            for kind, blob, at, value in zip(*(batch.column(c).to_pylist() for c in ("kind", "blob", "at", "value")), strict=True):
                n, words, *_ = numbers = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.int64)
                own = np.full(n + 1, other)
                own[np.array(at or [], np.int64)] = value or []
                out.append(features_of(np.concatenate([ratio[:, kind], own])[numbers[2 : 2 + words]], numbers[2 + words :]))
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("kind"), pa.array(out, pa.list_(pa.float64()))], names=["text_key", "kind", "x"])

    coded = cut(docs.select("text_key", "kind", "text").mapInArrow(run, "text_key bigint, kind int, x array<double>, blob binary, cold array<bigint>"), "coded")
    done = coded.where("blob IS NULL").groupBy("text_key", "kind").agg(F.first("x").alias("x"))
    open_ = coded.where("blob IS NOT NULL")
    rare = open_.select("text_key", "kind", F.posexplode("cold").alias("at", "key")).dropDuplicates(["text_key", "kind", "at"]).join(found, "key")
    rare = rare.select("text_key", "kind", F.struct("at", F.get("r", F.col("kind")).alias("value")).alias("rare")).groupBy("text_key", "kind").agg(F.collect_list("rare").alias("rare"))
    rare = rare.select("text_key", "kind", F.col("rare.at").alias("at"), F.col("rare.value").alias("value"))
    whole = open_.groupBy("text_key", "kind").agg(F.first("blob").alias("blob")).join(rare, ["text_key", "kind"], "left")
    return done.unionByName(whole.select("text_key", "kind", "blob", "at", "value").mapInArrow(finish, "text_key bigint, kind int, x array<double>"))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample_of(train: DataFrame, fit_rows: int) -> DataFrame:
    """doc_id, toxic, text: a row of each of at most fit_rows doc_ids, by the order of their hashes; of an id's rows, the one with the
    least text, however many there are."""
    ids = train.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = train.join(F.broadcast(ids), "doc_id")  # at most fit_rows numbers
    return rows.groupBy("doc_id").agg(F.min(F.struct("toxic", "text")).alias("row")).select("doc_id", "row.*")


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """row (struct of all columns of docs) and score."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text).alias("text_key"))
    train = labelled(docs.select("doc_id", "text"), labels)
    if train.select("toxic").distinct().count() < 2:
        return rows.select("row", F.lit(0.0).alias("score"))
    found, other = ratios(cut(count_words(train), "word-counts"))
    known = features(sample_of(train, fit_rows).select(F.xxhash64(text).alias("text_key"), F.when(F.col("toxic") > 0, 1).otherwise(2).alias("kind"), "text"), found, other).collect()
    weights = [float(w) for w in fit_curve(np.array([r["x"] for r in known]), np.array([float(r["kind"] == 1) for r in known]))]
    z = sum((F.lit(w) * F.get("x", F.lit(k)) for k, w in enumerate(weights[:-1])), F.lit(weights[-1]))
    scores = features(docs.select(F.xxhash64(text).alias("text_key"), F.lit(0).alias("kind"), "text"), found, other)
    scores = scores.select("text_key", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))
    return rows.hint("merge").join(scores, "text_key").select("row", "score")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below THRESHOLD, with all their columns."""
    return score(docs, labels).where(F.col("score") < THRESHOLD).select("row.*")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    doc_id, found = F.col("row.doc_id"), F.col("score")
    return scored.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (found >= THRESHOLD).cast("int").alias("predicted"))
