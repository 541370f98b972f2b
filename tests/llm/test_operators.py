"""The ten operators on small tables, against brute force, exact round trips or planted cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text: str, n: int, seed: int) -> str:
    words, r = text.split(), random.Random(seed)
    for k in r.sample(range(len(words)), n):
        words[k] = f"x{seed}y{k}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts() -> list[tuple[int | None, str | None]]:
    base = prose(200, 1)
    rows = [(i, prose(60 + i, 100 + i)) for i in range(10)]
    rows += [(20 + i, edited(base, i % 9, i)) for i in range(24)] + [(50, base), (51, base), (60, ""), (61, None), (62, "a b"), (63, "Ünïcødé 漢字 \U0001f600 it's\r\n\tend "), (70, prose(5000, 7))]
    return [*rows, (None, "no number here"), rows[0]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "own") for i, t in texts], "doc_id bigint, text string, lang string, source string")


def test_elias_fano_selects_and_round_trips():
    from inkwell.llm.elias_fano import EliasFano

    for values in ([], [0], [5, 5, 5], sorted(random.Random(3).randrange(10**6) for _ in range(500)), list(range(300))):
        made = EliasFano.from_bytes(EliasFano.encode(np.array(values, dtype=np.uint64)).to_bytes())
        n = len(values)
        assert made.block(0, n).tolist() == values and [made.select(i) for i in range(n)] == values
        for start, stop in ((0, n // 2), (n // 3, n), (n // 2, min(n, n // 2 + 70))):
            assert made.block(start, stop).tolist() == values[start:stop]
        for i in (-1, n):
            with pytest.raises(IndexError):
                made.select(i)
    long = EliasFano.encode(np.arange(10_000, dtype=np.uint64) * 1000)
    assert len(long.to_bytes()) * 8 / 10_000 < 13


def test_encoders_match_the_libraries(texts):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    from inkwell.llm.tokens import file_encoder, rank_encoder, read_ranks

    own = [t or "" for _, t in texts] + ["  two  spaces ", "x\n\ny z", "a b ​ c", "don't  DON'T", "1234 56,78.", "<|endoftext|> x", "İ, İstanbul", "e\u0301\u0301 ﬁn", "x²³ ½a", "a\x1cb\x85c", "'s 'S s're"]
    for name, words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        t.encode_special_tokens = True
        assert [array("I", x).tolist() for x in file_encoder(public_tokenizers.path(name), words).encode(own)] == [t.encode(x, add_special_tokens=False).ids for x in own]
        t.encode_special_tokens = False
        assert [array("I", x).tolist() for x in file_encoder(public_tokenizers.path(name), words, special_as_text=False).encode(own)] == [t.encode(x, add_special_tokens=False).ids for x in own]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    expected = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    encoder, by_id = rank_encoder(path)
    found = [array("I", x).tolist() for x in encoder.encode(own)]
    assert found == [expected.encode_ordinary(x) for x in own]
    assert [b"".join(by_id[i] for i in ids).decode() for ids in found] == own


def test_a_full_memo_changes_nothing(texts):
    import public_tokenizers

    from inkwell.llm.tokens import Encoder, file_encoder

    own = [t for _, t in texts]
    for name, words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        known = file_encoder(public_tokenizers.path(name), words)
        small = Encoder(known.tokenizer, words, memo=5)
        assert [small.encode([t])[0] for t in own] == known.encode(own)


def test_byte_bpe_offsets_and_split_characters():
    from inkwell.llm.byte_bpe import Decoder, decode_stream

    parts = [b"a\xe6", b"\xbc\xa2", b"b"]
    made = Decoder(parts)
    ids = np.array([0, 1, 2])
    starts, ends = made.offsets(ids, made.data([0, 1, 2]))
    assert made.data([0, 1, 2]) == "a漢b".encode() and made.data([0]) == b"a\xe6"
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(0, 2), (1, 2), (2, 3)] and "".join(decode_stream(parts)) == "a漢b"


def test_byte_bpe_tables_round_trip(docs, texts):
    import public_tokenizers

    from inkwell.llm import byte_bpe

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = byte_bpe.decode(byte_bpe.encode(docs.where("doc_id IS NOT NULL"), ranks), ranks).collect()
    known = dict(texts)
    for r in rows:
        text = known[r["doc_id"]] or ""
        assert bytes(r["data"]).decode() == text and len(r["starts"]) == len(r["ends"]) == len(r["ids"])
        assert not text or (r["starts"][0] == 0 and r["ends"][-1] == len(text))


def test_token_files_hold_all_documents(spark, docs, texts, tmp_path):
    import public_tokenizers

    from inkwell.llm import token_files
    from inkwell.llm.tokens import file_encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [r.asDict() for r in token_files.read(spark, token_files.write(docs, f"file://{tmp_path}/t", path)).orderBy("start").collect()]
    ordered = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in rows] == [i for i, _ in ordered]
    start = 0
    for r, x in zip(rows, file_encoder(path).encode([t for _, t in ordered]), strict=True):
        assert (r["start"], bytes(r["ids"])) == (start, x + b"\0\0\0\0")
        start += r["n_tokens"]


def test_packing_is_gapless_and_whole(docs, texts):
    import public_tokenizers

    from inkwell.llm import packing
    from inkwell.llm.tokens import file_encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs, path).collect()
    whole: dict = {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["piece"])):
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["start"] == 2048 * r["piece"]
    for (i, _), x in zip(texts, file_encoder(path, words=True).encode([t for _, t in texts]), strict=True):
        whole[i] = whole.get(i, 0) + len(x) // 4 + 1
    assert sum(r["length"] for r in rows) == sum(whole.values())
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_bin_completion_against_exhaustive_search():
    from collections import Counter

    from inkwell.llm.packing import fill

    def least(items, room):
        def fits(rest, rooms, n):
            if not rest:
                return True
            tried = set()
            for i, x in enumerate(rooms):
                if x >= rest[0] and x not in tried:
                    tried.add(x)
                    if fits(rest[1:], [*rooms[:i], x - rest[0], *rooms[i + 1 :]], n):
                        return True
            return len(rooms) < n and fits(rest[1:], [*rooms, room - rest[0]], n)

        return next(n for n in range(len(items) + 1) if fits(sorted(items, reverse=True), [], n))

    for seed in range(60):
        r = random.Random(seed)
        items = [r.randint(1, 20) for _ in range(r.randint(0, 10))]
        found = fill(Counter(items), 20)
        assert sum(n for n, _ in found) == least(items, 20) and sorted(x for n, b in found for x in b * n) == sorted(items) and all(sum(b) <= 20 for _, b in found)


def test_bin_completion_beats_best_fit_on_many_items():
    from collections import Counter

    from inkwell.llm.packing import best_fit, fill

    r = random.Random(1)
    counts = Counter(r.randint(400, 700) for _ in range(5000))
    left = np.zeros(2049, np.int64)
    for size, n in counts.items():
        left[size] = n
    found = fill(counts)
    used = Counter()
    for n, pattern in found:
        assert sum(pattern) <= 2048
        for x in pattern:
            used[x] += n
    assert used == counts and sum(n for n, _ in found) < sum(n for n, _ in best_fit(left, 2048))


def test_minhash_classes_are_those_of_all_pairs(docs, texts):
    from inkwell.llm import minhash

    found = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    sets = {i: set(zip(*[re.findall(r"[^\W_]+", (t or "").lower())[k:] for k in range(5)], strict=False)) for i, t in texts if i is not None and i < 60}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {i: found[i] for i in sets} == label and found[None] is None and found[60] == found[61] == 60


def test_blocks_link_what_centres_leave_apart(spark, docs):
    """Without any link by centres, the blocks alone find the classes of a bucket."""
    from inkwell.llm import minhash
    from inkwell.llm.common import cut

    rows = docs.where("doc_id BETWEEN 20 AND 50").dropDuplicates(["text"])
    ids = rows.selectExpr("doc_id AS id").distinct()
    signed = minhash.sign(rows).selectExpr("doc_id AS id", "digest", "row")
    # Copies share a digest; each of them gets its set here.
    sets = cut(minhash.shingle_sets(rows, signed), "test-sets")
    found = minhash.rest_links(ids.selectExpr("id", "7L AS key"), ids.selectExpr("id", "id AS label"), sets)
    own = {r["id"]: set(minhash.unpacked(bytes(r["shingles"]))[0].tolist()) for r in sets.collect()}
    expected = {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])}
    assert {(min(r), max(r)) for r in map(tuple, found.collect())} == expected


def test_quality_rules(docs, texts):
    from inkwell.llm import quality

    bad = [(200, "\n".join(["Home | About | News | Contact | Log in"] * 8 + [prose(10, 5)]) + " " + prose(30, 6)), (201, prose(60, 3)), (202, "same three words " * 40)]
    rows = docs.sparkSession.createDataFrame(bad, "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    found = {r["doc_id"]: r for r in quality.judge(rows).collect()}
    for i, t in [*texts, *bad]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams: dict = {}
        for k in range(len(words) - 2):
            grams.setdefault(tuple(words[k : k + 3]), []).append(k)
        repeated = len({k + j for ks in grams.values() if len(ks) > 1 for k in ks for j in range(3)})
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), repeated)
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or "")) and r["base_failed"] == (len(words) < 50 or 100 * repeated > 50 * len(words))
    assert found[201]["kept"] and not found[202]["kept"] and not found[200]["kept"]


def test_licenses_against_a_plain_scan(docs):
    from inkwell.llm import licenses

    own = [(1, "Under the MIT License. x " * 2), (2, None), (3, "apache license, version 2.0 cc by nc"), (4, "under the K mit license"), (5, "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files")]
    rows = {r["doc_id"]: r for r in licenses.scan(docs.sparkSession.createDataFrame(own, "doc_id bigint, text string")).collect()}
    for i, t in own:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted((k, label) for label, p in licenses.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert rows[i]["n_words"] == len(words) and sorted((x["start"], x["label"]) for x in rows[i]["verified"] if x["base"]) == places
    assert [x["label"] for x in rows[5]["verified"]] == ["mit"]


def test_fingerprints(docs, texts):
    from inkwell.llm import fingerprints

    known = [(i, t or "") for i, t in dict(texts).items() if i is not None]
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    ordered = sorted(known, reverse=True)
    for (i, t), (_, after) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        half = len(t) // 2
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    assert rows[50]["fingerprint"] == rows[51]["fingerprint"] and rows[51]["near_next"] == 1.0


def test_warc_round_trip(spark, tmp_path):
    from inkwell.llm import warc

    html = "<p>" + "é" * 60 + "</p>"
    pages = [(1, "http://a/1", html), (2, "http://a/2", html), (3, None, "short"), (4, "http://a/4", "short"), (5, "http://a/\r\nX: 1", None), (6, "http://a/6", html)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = {r["page_id"]: r for r in warc.read_archives(spark, warc.write_archives(warc.resolve(frame), f"file://{tmp_path}/w")).collect()}
    for i, _, h in pages:
        body = (h or "").encode()
        assert (rows[i]["payload_bytes"], rows[i]["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (rows[i]["record_type"], rows[i]["refers_to"]) == (("revisit", 1) if i in (2, 6) else ("response", None))
        assert bytes(rows[i]["block"]) == (b"" if i in (2, 6) else body)


def test_url_rules_and_templates(spark):
    from inkwell.llm import urls

    pages = [(1, "https://EXAMPLE.org/es/x?y"), (2, "http://example.org/en/12"), (3, "http://x.org#f"), (4, None), (5, "nothing"), (6, "http://shop.com/de/1"), (7, "http://notorg/a"), (8, "http://shop.com/fr/2")]
    pages += [(100 + i, f"http://bad.com/de/{i}") for i in range(30)] + [(200, "http://bad.com/xx/1")]
    rows = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id bigint, url string")).collect()}
    assert [(rows[i]["host"], rows[i]["path"], rows[i]["rule"]) for i in range(1, 9)] == [
        ("example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("x.org", "", None), ("", "", None), ("", "", None), ("shop.com", "/de/1", "com/de/"), ("notorg", "/a", None), ("shop.com", "/fr/2", "com/fr/"),
    ]
    assert rows[1]["verdict"] == "block" and rows[200]["verdict"] == "block" and rows[8]["verdict"] == "allow" and len(rows) == len(pages)


def test_the_curve_sees_one_row_of_each_number(spark):
    from inkwell.llm import toxicity

    train = spark.createDataFrame([(7, f"t{k:03}", 1) for k in range(500)] + [(k, "x", 0) for k in range(8, 12)], "doc_id bigint, text string, toxic int")
    assert sorted(tuple(r) for r in toxicity.sample_of(train, 100).collect()) == [(7, 1, "t000"), *[(k, 0, "x") for k in range(8, 12)]]
    assert toxicity.sample_of(train, 3).count() == 3


def test_toxicity_on_held_out_labels(spark):
    from inkwell.llm.registry import queries

    sf = "/root/testdata/sf0.1"
    scored = queries()["op1_toxicity"](spark, sf)
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("toxic", "score", "predicted").collect()
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) > 0.8 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.01 * len(clean) and all(0 <= r["score"] <= 1 for r in rows)


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near-duplicates", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, columns = stage(spark, docs, SF).cache(), docs.columns
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert left and left <= ids and docs.columns == columns
        ids = left
    assert {r[0] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == ids


@pytest.mark.parametrize("name", ["quality", "licenses", "fingerprints", "minhash", "packing", "byte_bpe", "token_files", "toxicity"])
def test_empty_tables(spark, name, tmp_path):
    import public_tokenizers

    from inkwell.llm import byte_bpe, fingerprints, licenses, minhash, packing, quality, token_files, toxicity

    none = spark.createDataFrame([], "doc_id bigint, text string, score double, `at` bigint")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    made = {
        "quality": lambda: quality.clean(none),
        "licenses": lambda: licenses.scan(none),
        "fingerprints": lambda: fingerprints.fingerprints(none),
        "minhash": lambda: minhash.deduplicate(none),
        "packing": lambda: packing.pack(none, public_tokenizers.path("word_bpe_49k.json")),
        "byte_bpe": lambda: byte_bpe.digests(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
        "token_files": lambda: token_files.read(spark, token_files.write(none, f"file://{tmp_path}/e", public_tokenizers.path("byte_bpe_50k.json"))),
        "toxicity": lambda: toxicity.reject_toxic(none, labels),
    }
    assert made[name]().count() == 0


def test_toxicity_scores_rare_words_of_large_classes(spark):
    """A word with four contexts among 2,400 toxic documents has its own ratio, joined or hot; a text's features don't depend on which."""
    from inkwell.llm import toxicity

    r = random.Random(4)
    rows = [(f"{prose(8, k)} {'zzugly' if k < 9 else ''} {'zzonce' if k == 11 else ''} {'zzfine' if 2400 <= k < 2440 else ''}", int(k < 2400)) for k in range(4800)]
    r.shuffle(rows)
    counts = toxicity.count_words(spark.createDataFrame(rows, "text string, toxic int"))
    found, other = toxicity.ratios(counts)
    contexts: dict = {}
    for text, toxic in rows:
        words = toxicity.words_of(text)
        for before, w in zip(["", *words], words, strict=False):
            contexts.setdefault(w, (set(), set()))[0 if toxic else 1].add(before)
    named = dict(zip(toxicity.hashes(list(contexts)).tolist(), contexts, strict=True))
    assert {named[x["key"]]: (x["toxic"], x["ordinary"]) for x in counts.collect()} == {w: (len(t), len(o)) for w, (t, o) in contexts.items()}
    by_word = {named[x["key"]]: x["r"] for x in found.collect()}
    assert by_word["zzugly"][0] > 1 and by_word["zzfine"][0] < 0 and "zzonce" not in by_word
    texts = ["w1 zzugly w2", "zzunseen zzonce w5 qqqq", "", prose(300, 9), None]
    docs = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "text_key bigint, kind int, text string")
    expected = {}
    for k, t in enumerate(texts):
        each = [by_word.get(w, [other])[0] for w in toxicity.words_of(t)]
        best = max((sum(each[i : i + 50]) / min(50, len(each)) for i in range(max(1, len(each) - 49))), default=0.0) if each else 0.0
        top = sorted({w: by_word.get(w, [other])[0] for w in toxicity.words_of(t)}.values())[-3:]
        expected[k] = [sum(each) / max(1, len(each)), best, sum(top) / 3]
    for hot in (0, 5, 65_536):
        assert {x["text_key"]: x["x"] for x in toxicity.features(docs, found, other, hot).collect()} == {k: pytest.approx(x) for k, x in expected.items()}


def test_toxicity_passes_any_columns_through(spark):
    from inkwell.llm import toxicity

    rows = [(i, f"{prose(20, i)} {'ugly stuff' if i % 3 == 0 else ''}", 5.0, "x") for i in range(60)] + [(None, "no number", 1.0, None), (7, None, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double, text_key string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (3, None)], "doc_id int, toxic int")
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.schema == docs.schema and 0 < kept.count() <= len(rows)


def test_weights_decide_which_texts_are_alike(spark):
    """Pairs that repeat a part alike, or a few more times, are linked; one that repeats it 200 times isn't. Registers agree as often as texts are alike."""
    from inkwell.llm import minhash

    rows = []
    for k in range(40):
        a = prose(200, 900 + k).split()
        more = [1, 2, 2, 200][k % 4]
        rows += [(2 * k, " ".join(a[:80] + a[80:110] * (1 if k % 2 else 30) + a[110:])), (2 * k + 1, " ".join(a[:80] + a[80:110] * (more if k % 2 else 30) + a[110:] + ["q1"]))]
    made = {i: minhash.shingles(t) for i, t in rows}
    as_float = {i: (h, w.astype(float)) for i, (h, w) in made.items()}
    likeness = [minhash.probability_jaccard(as_float[2 * k], as_float[2 * k + 1]) for k in range(40)]
    sig = minhash.signatures([made[i] for i, _ in rows])
    agree = [(sig[2 * k] == sig[2 * k + 1]).mean() for k in range(40)]
    assert abs(np.mean(np.array(agree) - likeness)) < 0.02 and max(abs(np.array(agree) - likeness)) < 0.25
    found = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {i: i - i % 2 if likeness[i // 2] >= 0.8 else i for i, _ in rows} and 20 < sum(x >= 0.8 for x in likeness) < 40


def test_probability_jaccard_is_its_definition():
    from inkwell.llm import minhash

    rng = np.random.default_rng(7)
    for n in (1, 3, 40, 300):
        sides = []
        for _ in range(2):
            h = np.unique(rng.integers(0, 2 * n, n).astype(np.uint32))
            sides.append((h, rng.choice([1.0, 1.0, 2.0, 3.0, 50.0], len(h))))
        (ha, x), (hb, y) = sides
        xs, ys = dict(zip(ha.tolist(), x, strict=True)), dict(zip(hb.tolist(), y, strict=True))
        plain = sum(1 / sum(max(xs.get(j, 0) / xs[i], ys.get(j, 0) / ys[i]) for j in {*xs, *ys}) for i in xs if i in ys)
        assert minhash.probability_jaccard(*sides) == pytest.approx(plain)
        assert minhash.bounds([sides[0]], [sides[1]])[0, 0] >= plain - 1e-3
        ones = [(h, np.ones(len(h))) for h, _ in sides]
        both = len(np.intersect1d(ha, hb))
        assert minhash.probability_jaccard(*ones) == pytest.approx(both / (len(ha) + len(hb) - both))
        data = minhash.packed((ha.astype(np.uint64), x.astype(np.int64)))
        assert all((a == b).all() for a, b in zip(minhash.unpacked(data), sides[0], strict=True))
