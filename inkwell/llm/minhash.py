"""Near-duplicate classes by ProbMinHash: five-word shingles, exponential arrivals, banding, exact verification.

1. Each text's shingles, weighted by how often the text has them, give a signature of ``REGISTERS`` registers. A shingle sends
   exponential arrivals, at the rate of its weight, to random registers; a register keeps the shingle that came first, so two texts
   agree in a register with the probability Jaccard similarity of their weighted shingles, which is what links are verified by. A
   shingle stops once its next arrival is later than all registers.
2. Texts with the same shingles and counts are one text from here on, however many copies there are, and known by a number of its
   own, so rows that share a doc_id but not a text stay apart.
3. Texts that agree in all registers of a band share a bucket. In each bucket everything is compared with one centre, the text with
   most company over all its buckets: a row per text and bucket, never all pairs. Large buckets are dealt to many tasks. Links make
   classes.
4. Where a bucket's texts are then in several classes, those outside its largest class are compared with all its texts, in blocks;
   every two texts of a bucket have then been compared or are in one class.
5. A link needs a probability Jaccard similarity of ``SIMILAR`` or more: the sum, over shared shingles i, of
   1 / sum over j of max(x_j / x_i, y_j / y_i). Where no shingle repeats, that is the Jaccard similarity of the sets; a part that one
   text has many more times than the other makes them less alike.

Cases: texts of fewer than five words have one shingle of all their words; null and empty texts are copies of each other; a null
doc_id gives a null class, and ``deduplicate`` keeps its row; repeated rows are copies; rows of one doc_id with different texts are
in the classes of their texts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut, id_filter, prepare, table

WORDS, SIMILAR = 5, 0.8
#: Bands of so many registers: a pair of similarity 0.8 misses all of them with a probability of (1 - 0.8 ** 4) ** 24 = 3e-6.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: What similarities may miss SIMILAR by, since they are sums of fractions; and products of block matrices, of single precision.
ROUNDING, COARSE = 1e-9, 1e-3
#: Texts and bytes of shingle sets in a block of a bucket, and columns of the matrices that blocks are compared by.
BLOCK_TEXTS, BLOCK_BYTES, COLUMNS = 64, 1 << 18, 1 << 14
#: Rows of a file of labels.
LABELS_A_FILE = 100_000
#: Texts of a bucket that one task compares with its centre.
SALT_TEXTS = 512
_WORD = re.compile(r"[^\W_]+")
_MEMO = 300_000
_memo: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their counts."""
    import xxhash

    words = _WORD.findall((text or "").lower())
    if missing := set(words).difference(_memo):
        if len(_memo) + len(missing) > _MEMO:
            _memo.clear()
            missing = set(words)
        for w in missing:
            _memo[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_memo.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(WORDS, len(h))
    if not n:
        return np.zeros(1, np.uint64), np.ones(1, np.int64)
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = mix(total + h[k : len(h) - n + 1 + k])
    return np.unique(total, return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """ProbMinHash registers of several weighted sets at once: the upper halves of the winning shingles' hashes."""
    m, n = REGISTERS, len(sets)
    doc = np.repeat(np.arange(n), [len(e) for e, _ in sets])
    element, rate = np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets]).astype(np.float64)
    first, winner = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    single = np.array([len(e) == 1 for e, _ in sets])  # of one shingle, which wins everywhere
    winner.reshape(n, m)[single] = np.array([e[0] for e, _ in sets], dtype=np.uint64)[single][:, None]
    live = np.flatnonzero(~single[doc])
    doc, element, rate, now, k = doc[live], element[live], rate[live], np.zeros(len(live)), 0
    while len(doc):
        k += 1
        draw = mix(element + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        now = now - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        at = doc * m + (mix(draw ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, now)
        won = first[at] == now
        winner[at[won]] = element[won]
        on = now < first.reshape(n, m).max(axis=1)[doc]
        doc, element, rate, now = doc[on], element[on], rate[on], now[on]
    return (winner >> np.uint64(32)).astype(np.uint32).reshape(n, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return keys.view(np.int64)


def row_hash() -> Column:
    """Tells the rows of one text or doc_id from each other, but for repeated rows."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def digest_of(made: tuple[np.ndarray, np.ndarray]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(made[0].tobytes() + made[1].tobytes())


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, row, digest (of shingles and counts), bands (array<long>)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            sig = signatures(sets)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(band_keys(sig).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(list(map(digest_of, sets)), pa.binary()), bands], names=["doc_id", "row", "digest", "bands"])

    return docs.select("doc_id", row_hash().alias("row"), "text").mapInArrow(run, "doc_id bigint, row bigint, digest binary, bands array<bigint>")


def packed(made: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The lower halves of the shingle hashes, ascending, their counts where one is over 1, and a byte that tells whether there are any."""
    halves, at = np.unique(made[0].astype(np.uint32), return_inverse=True)
    counts = np.bincount(at, made[1]).astype(np.uint32)
    return halves.tobytes() + (counts.tobytes() + b"\1" if (counts > 1).any() else b"\0")


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts."""
    weighted = data[-1]
    n = len(data) // (8 if weighted else 4)
    return np.frombuffer(data, np.uint32, n), np.frombuffer(data, np.uint32, n, 4 * n).astype(np.float64) if weighted else np.ones(n)


def shingle_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """id, shingles: the packed weighted set; n_bytes: its size. Of the texts in members (id, digest, row), each from the row that
    stands for it."""
    known = id_filter(members, "row")
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        done = set()
        for batch in batches:
            batch = batch.filter(shared.value.passes(batch.column("at")))
            made = [shingles(t) for t in batch.column("text").to_pylist()]
            digest = list(map(digest_of, made))
            new = [k for k, d in enumerate(digest) if d not in done and not done.add(d)]
            sets = [packed(made[k]) for k in new]
            yield pa.RecordBatch.from_arrays([pa.array([digest[k] for k in new], pa.binary()), pa.array(sets, pa.binary()), pa.array(list(map(len, sets)), pa.int64())], names=["digest", "shingles", "n_bytes"])

    found = docs.select("text", known.place(row_hash()).alias("at")).mapInArrow(run, "digest binary, shingles binary, n_bytes bigint")
    return found.join(members.select("id", "digest"), "digest").dropDuplicates(["id"]).select("id", "shingles", "n_bytes")


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets (hashes ascending, weights).

    With r_j = y_j / x_j, max(x_j / x_i, y_j / y_i) is the first where r_j <= r_i and the second elsewhere, so sums over j are sums of
    weights up to and beyond r_i.
    """
    (ha, x), (hb, y) = a, b
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    ratio = y[ib] / x[ia]
    if ratio.min() == ratio.max():  # as with sets: all shared shingles stand in one proportion
        return float(len(ia) and (x[ia] / (x.sum() + (y.sum() - y[ib].sum()) / ratio[0])).sum())
    order = np.argsort(ratio, kind="stable")
    ratio, xs, ys = ratio[order], x[ia][order], y[ib][order]
    upto = np.searchsorted(ratio, ratio, side="right")
    # Those of the first set alone have ratio 0, those of the second alone an infinite one.
    low = (x.sum() - xs.sum() + np.append(0.0, np.cumsum(xs))[upto]) / xs
    high = (y.sum() - np.append(0.0, np.cumsum(ys))[upto]) / ys
    return float((1.0 / (low + high)).sum())


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (id, centre) whose weighted sets have a probability Jaccard similarity of SIMILAR or more."""

    def verify(batches):
        for batch in batches:
            both = zip(batch.column("shingles").to_pylist(), batch.column("centre_shingles").to_pylist(), strict=True)
            ok = [probability_jaccard(unpacked(x), unpacked(y)) >= SIMILAR - ROUNDING for x, y in both]
            yield batch.select(["id", "centre"]).filter(pa.array(ok, pa.bool_()))

    full = pairs.join(sets.select("id", "shingles"), "id").join(sets.select(F.col("id").alias("centre"), F.col("shingles").alias("centre_shingles")), "centre")
    return full.select("id", "centre", "shingles", "centre_shingles").mapInArrow(verify, "id bigint, centre bigint")


def bounds(queries: list[tuple[np.ndarray, np.ndarray]], members: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """What the similarity of every query with every member is at most.

    With shares p and q of the weights, it is at most the sum of min(p_i, q_i), and so of sqrt(p_i q_i), which is a product of matrices,
    taken over a bounded number of columns at a time.
    """
    known = np.unique(np.concatenate([h for h, _ in queries]))

    def places(sets):
        flat = np.concatenate([h for h, _ in sets])
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[at] == flat
        roots = np.concatenate([np.sqrt(w / w.sum()) for _, w in sets])
        return np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])[hit], at[hit], roots[hit]

    both = np.zeros((len(queries), len(members)), np.float32)
    (qi, qc, qw), (mi, mc, mw) = places(queries), places(members)
    for start in range(0, len(known), COLUMNS):
        q, m = np.zeros((len(queries), COLUMNS), np.float32), np.zeros((len(members), COLUMNS), np.float32)
        for matrix, i, c, w in ((q, qi, qc, qw), (m, mi, mc, mw)):
            here = (c >= start) & (c < start + COLUMNS)
            matrix[i[here], c[here] - start] = w[here]
        both += q @ m.T
    return both


def rest_links(left: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (id, centre) between texts of one bucket that the centres have left in different classes. left: id, key; labels: id, label.

    In a bucket, the texts outside its largest class are queries against all its texts, in blocks of bounded size dealt to
    many tasks. A block pair is compared where it stands, and gives a link per query and class at most.
    """
    known = left.select("id", "key").join(labels, "id")
    by_class = known.join(sets.select("id", "n_bytes"), "id").groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"))
    total = by_class.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK_TEXTS, size / BLOCK_BYTES))
    # Both texts of a bucket of two have been compared already.
    # Written, so that a bucket with most of the rows is a plain join's, which Spark deals anew.
    unsettled = cut(total.where("classes > 1 AND n > 2").select("key", F.col("top.label").alias("main"), blocks(F.col("n"), F.col("size")).alias("blocks")), "unsettled")
    dealt = known.join(unsettled, "key").join(sets.select("id", "shingles"), "id")
    packed = F.collect_list(F.struct("id", "label", "shingles"))
    members = dealt.groupBy("key", F.pmod(F.xxhash64("id"), "blocks").alias("block")).agg(packed.alias("members"))
    queries = dealt.where("label <> main").groupBy("key", "blocks", F.pmod(F.xxhash64("id"), "blocks").alias("own")).agg(packed.alias("queries"))
    queries = queries.select("key", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    def compare(batches):
        for batch in batches:
            found = []
            for qs, ms in zip(batch.column("queries"), batch.column("members"), strict=True):
                qs, ms = qs.as_py(), ms.as_py()
                a, b = ([unpacked(x["shingles"]) for x in xs] for xs in (qs, ms))
                near = bounds(a, b)
                here: dict[tuple[int, int], int] = {}
                for i, j in zip(*np.nonzero(near >= SIMILAR - COARSE), strict=True):
                    pair = (qs[i]["id"], ms[j]["label"])
                    if qs[i]["label"] != ms[j]["label"] and pair not in here and probability_jaccard(a[i], b[j]) >= SIMILAR - ROUNDING:
                        here[pair] = ms[j]["id"]
                found += [(q, m) for (q, _), m in here.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["id", "centre"])

    return queries.join(members, ["key", "block"]).select("queries", "members").mapInArrow(compare, "id bigint, centre bigint").distinct()


def buckets(texts: DataFrame) -> DataFrame:
    """id, key, n: the buckets that several texts share, and how many do. Only keys that a filter lets through are shuffled again."""
    shared = cut(texts.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    known = id_filter(shared, "key")
    bitmap = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bands = batch.column("bands")
                ids = pa.array(np.repeat(batch.column("id").to_numpy(zero_copy_only=False), np.diff(bands.offsets.to_numpy())))
                yield pa.RecordBatch.from_arrays([ids, bands.flatten()], names=["id", "key"]).filter(bitmap.value.passes(batch.column("at").flatten()))

    keys = texts.select("id", "bands", F.transform("bands", known.place).alias("at")).mapInArrow(run, "id bigint, key bigint")
    return cut(keys.join(shared, "key"), "buckets")


def links(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links (id, centre) between distinct texts (id, digest, row, bands)."""
    left = buckets(texts)
    company = left.groupBy("id").agg(F.sum("n").alias("company"))
    salts = F.ceil(F.col("n") / SALT_TEXTS).cast("long")
    left = cut(left.join(company, "id").select("id", "key", "n", "company", F.pmod(F.xxhash64("id"), salts).alias("salt")), "members")
    members = left.select("id").distinct()
    sets = cut(shingle_sets(docs, cut(texts.select("id", "digest", "row").join(members, "id"), "members")), "shingles")
    top = left.groupBy("key").agg(F.max(F.struct("company", (-F.col("id")).alias("_id"))).alias("top"), F.max("n").alias("n"))
    centres = top.select("key", (-F.col("top._id")).alias("centre"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    against = left.join(cut(centres, "centres"), ["key", "salt"]).where("id <> centre").select("id", "centre").distinct()
    good = cut(similar(against, sets), "links")
    labels = members.join(components(good), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    return good.unionByName(cut(rest_links(left, cut(labels, "classes"), sets), "links"))


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id that is connected with it. edges: id, centre. Each round writes its labels, in files of some
    LABELS_A_FILE rows, since there are many rounds and labels are short."""
    both = cut(edges.select(F.col("id").alias("a"), F.col("centre").alias("b")).unionByName(edges.select(F.col("centre").alias("a"), F.col("id").alias("b"))).distinct(), "edges")
    files = -(-max(both.count(), 1) // LABELS_A_FILE)
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")).coalesce(files), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        # A label's own label is as good, so long chains halve in each round.
        via = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", "label", "near").join(via, "near", "left").select("id", F.col("label").alias("old"), F.least("label", "near", "far").alias("label"))
        step = cut(step.coalesce(files), "labels")
        if step.where("label <> old").isEmpty():
            return step.select("id", "label")
        labels = step.select("id", "label")


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, row, label (the number of its class) and first (the smallest doc_id of the class) of every row."""
    signed = cut(sign(docs), "signatures")
    texts = signed.groupBy("digest").agg(F.min("row").alias("row"), F.first("bands").alias("bands"), F.min("doc_id").alias("first"))
    texts = cut(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    labels = components(links(texts, docs))
    names = cut(texts.select("digest", "id", "first").join(labels, "id", "left").select("digest", "first", F.coalesce("label", "id").alias("label")), "names")
    names = names.select("digest", "label").join(names.groupBy("label").agg(F.min("first").alias("first")), "label")
    return signed.select("doc_id", "row", "digest").join(names, "digest").select("doc_id", "row", "label", "first")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id: the smallest doc_id of the document's class."""
    return labelled(docs).select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("class_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the smallest doc_id, with all its columns; rows without a doc_id stay."""
    top = labelled(docs.select("doc_id", "text")).where("doc_id IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("top"))
    kept = cut(top.select(F.col("top.doc_id").alias("kept_id"), F.col("top.row").alias("kept_row")), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), row_hash().alias("_hash"))
    found = rows.join(kept, (rows["_id"] == kept["kept_id"]) & (rows["_hash"] == kept["kept_row"]), "left_semi").dropDuplicates(["_id", "_hash"])
    return found.unionByName(rows.where("_id IS NULL")).select("_row.*")


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return classes(table(spark, sf_dir, "documents"))
