"""The queries' own results on whole small tables against plain Python restatements, and each operator's odd cases."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import time
import zlib
from array import array
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
BLANK = "[^\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def run(spark, name, sf=SF):
    from inkwell.llm.registry import queries

    return queries()[name](spark, sf).collect()


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


def test_op2_has_the_rows_of_its_sql(spark):
    import duckdb

    from inkwell.llm.sql import OP2

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    key = lambda r: tuple(str(x) for x in r)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[c] for c in names) for r in run(spark, "op2_warc")), key=key) == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({OP2})").fetchall(), key=key)


def test_op3_against_the_library(spark, documents):
    t, start = tokenizer("byte_bpe_50k.json"), 0
    found = {r["doc_id"]: r for r in run(spark, "op3_token_files")}
    for i, text in documents:
        ids = array("I", [*t.encode(text, add_special_tokens=False).ids, 0])
        assert tuple(found[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op4_against_the_library(spark, documents):
    t = tokenizer("word_bpe_49k.json")
    found = {(r["doc_id"], r["piece"]): r for r in run(spark, "op4_packing")}
    bins, total = defaultdict(list), 0
    for i, text in documents:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        for k in range(0, len(ids), 2048):
            r, own = found.pop((i, k // 2048)), array("I", ids[k : k + 2048])
            assert (r["start"], r["length"], r["ids_crc32"]) == (k, len(own), zlib.crc32(own.tobytes()))
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert not found and len(bins) <= -(-total // 2048) + 1
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_op6_against_tiktoken(spark, documents):
    import public_tokenizers
    import tiktoken

    from inkwell.llm.tokens import read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r["doc_id"]: r for r in run(spark, "op6_byte_bpe")}
    for i, text in documents:
        ids = t.encode_ordinary(text)
        parts = [t.decode_single_token_bytes(x) for x in ids]
        split = sum(p[:1] >= b"\x80" and p[0] < 0xC0 for p in parts[1:])
        assert tuple(found[i]) == (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), split)


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def plain_scan(words):
    """Labels and base places of a text by the same rules, one template at a time."""
    from inkwell.llm import licenses as lic

    base = sorted((k, label) for label, p in lic.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
    labels, score = {label for _, label in base}, 1.0 if base else 0.0
    grams = defaultdict(list)
    for k in range(len(words) - lic.K + 1):
        grams[tuple(words[k : k + lic.K])].append(k)
    for label, passage in lic.PASSAGES:
        t = passage.split()
        n = len(t) - lic.K + 1
        votes = defaultdict(list)
        for q in range(n):
            for p in grams.get(tuple(t[q : q + lic.K]), ()):
                votes[p - q].append((p, q))
        groups: list[list] = []
        for d in sorted(votes):
            if groups and d - groups[-1][0] <= lic.APART:
                groups[-1][0] = d
                groups[-1][1] += votes[d]
            else:
                groups.append([d, list(votes[d])])
        for _, hits in groups:
            share = len({q for _, q in hits}) / n
            first, last = min(p for p, _ in hits), max(p for p, _ in hits)
            shared = len(set(t) & set(words[first : last + lic.K])) / len(set(t))
            if share >= lic.VOTES and shared >= lic.SHARED:
                labels.add(label)
                score = max(score, min(share, shared))
    return base, ",".join(sorted(labels)), score


def test_op5_against_a_plain_scan(spark, documents):
    found = {r["doc_id"]: r for r in run(spark, "op5_licenses")}
    for i, text in documents:
        words = license_words(text)
        base, labels, score = plain_scan(words)
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None)
        assert (r["base_labels"], r["labels"]) == (",".join(sorted({x for _, x in base})), labels) and r["score"] == pytest.approx(score)


def test_whole_licences_are_found_where_words_are_lost(spark):
    from inkwell.llm import licenses

    text = licenses.PASSAGES[8][1].split()
    edited = [w for k, w in enumerate(text) if k % 40 != 20]
    rows = [(1, "Copyright me. " + " ".join(edited) + " the end"), (2, " ".join(text[:12])), (3, None), (3, None)]
    found = [(r["doc_id"], [x["label"] for x in r["verified"]]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert len(licenses.PASSAGES[8][1].split()) > 66 and sorted(found)[0] == (1, ["mit", "mit"]) and len(found) == 4


def plain_similarity(x, y):
    """Probability Jaccard of two Counters by its definition."""
    union = {*x, *y}
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in union) for i in x if i in y)


def exhaustive_classes(rows):
    """The smallest number in each one's class, over all pairs that share a shingle."""
    grams = lambda ws: zip(*[ws[k:] for k in range(5)], strict=False) if len(ws) > 4 else [tuple(ws)]
    sets = {i: Counter(grams(re.findall(r"[^\W_]+", t.lower()))) for i, t in rows}
    by_set = defaultdict(list)
    for i, s in sets.items():
        by_set[frozenset(s.items())].append(i)
    texts, places, parent = [Counter(dict(s)) for s in by_set], defaultdict(list), list(range(len(by_set)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for k, s in enumerate(texts):
        share = defaultdict(float)
        for e, n in s.items():
            for j, m in places[e]:
                share[j] += min(n / s.total(), m / texts[j].total())
        for j, most in share.items():
            if most >= 0.8 - 1e-9 and plain_similarity(s, texts[j]) >= 0.8 - 1e-9:
                parent[find(k)] = find(j)
        for e, n in s.items():
            places[e].append((k, n))
    least: dict = {}
    for k, members in enumerate(by_set.values()):
        least[find(k)] = min([least.get(find(k), 1 << 62), *members])
    return {i: least[find(k)] for k, members in enumerate(by_set.values()) for i in members}


def test_op7_finds_all_classes_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r["doc_id"]: r["class_id"] for r in run(spark, "op7_minhash", sf)} == exhaustive_classes(rows)


def test_no_text_is_lost_to_a_repeated_number(spark):
    from inkwell.llm import minhash

    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a, 1.5), (1, b, 2.5), (2, a + " more", 3.5), (None, a, 4.5), (None, None, 5.5), (3, None, 6.5), (4, "", 7.5), (1, b, 2.5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row double")
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["row"] for r in kept.collect()) == [1.5, 2.5, 4.5, 5.5, 6.5]


def plain_quality(text):
    """Base counts and verdict of a text, and its text without failing lines."""
    import regex

    from inkwell.llm import quality as q

    words = re.findall(BLANK, text)
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    grams = defaultdict(list)
    for k in range(len(words) - 2):
        grams[tuple(words[k : k + 3])].append(k)
    repeated = len({k + j for ks in grams.values() if len(ks) > 1 for k in ks for j in range(3)})
    chars = lambda x: sum(map(len, re.findall(BLANK, x)))

    def good(line):
        n = len(re.findall(BLANK, line))
        count = lambda pattern: len(regex.findall(pattern, line))
        bars = count(q.NAVIGATION)
        return not (
            count(r"[#*$%&|<>]") > 0.3 * n
            or (bars >= 2 and bars > 0.3 * n)
            or (n >= 3 and count("[!?]") > 0.5 * n)
            or (n >= 3 and count(r"(?<![^\s])\p{Lu}{2,}(?![^\s!?.,;:])|(?<![^\s])\p{Lu}(?=[!?]{2})") > 0.7 * n)
            or (n <= 12 and any(p in line.lower() for p in q.BOILERPLATE))
            or (n < 10 and not regex.search(r"""[.!?:;…。！？]["'”’»)\]]*[\x20\x09-\x0D]*\Z""", line))
        )

    kept = sum(chars(x) for x in set(lines) if good(x))
    lost = 1 - kept / chars(text) if chars(text) else 1.0
    failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    clean = "\n".join(x for x in text.split("\n") if not re.search(BLANK, x) or good(x))
    return (len(words), chars(text), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, failed, not failed and lost <= 0.4), clean


def test_op8_against_plain_rules(spark, documents):
    found = {r["doc_id"]: r for r in run(spark, "op8_quality_rules")}
    for i, text in documents:
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == plain_quality(text)[0], text[:300]


def test_clean_hands_on_the_lines_that_pass(spark):
    from inkwell.llm import quality

    prose = "\n".join(" ".join(f"Word{k}x{j}" for j in range(14)) + " ends." for k in range(12))
    text = f"Home | About | Contact\n{prose}\n\nAccept all cookies\nALL IN CAPITALS HERE NOW!!\nUnended short line"
    rows = [(1, text, len(text), "x"), (1, text, len(text), "x"), (2, None, None, None), (3, "", 0, ""), (None, prose, len(prose), "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int, kept string")
    kept = quality.clean(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["n_chars"], r["kept"]) for r in kept) == [(0, prose, len(prose), "y")] + 2 * [(1, plain_quality(text)[1], len(prose) + 1, "x")]
    assert quality.clean(docs, remove_lines=False).where("doc_id = 1").first()["text"] == text and quality.clean(docs).schema == docs.schema


def spark_hash(data: bytes, seed: int = 42) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, seed=seed & (2**64 - 1))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chain(values) -> int:
    seed = 42
    for v in values:
        seed = spark_hash(struct.pack("<q", v), seed)
    return signed(seed)


def test_op9_against_plain_fingerprints(spark, documents):
    import regex

    from inkwell.llm import fingerprints as f

    terms = lambda t: {signed(spark_hash(w.encode())) for w in regex.findall(r"[\p{L}\p{N}]+", t.lower())}
    counts, n = Counter(x for _, t in documents for x in terms(t)), len(documents)
    band = {x for x, k in counts.items() if f.LOW * n <= k <= f.HIGH * n}

    def fingerprint(text):
        own = sorted(terms(text) & band)
        tests = [(s, m, v) for (s, m), values in f.subset_tests().items() for v in values]
        if not own:
            return [signed(spark_hash(text.encode()))] * len(tests)
        parts = [[t for t in own if (t & (2**64 - 1)) >> s & m == v] if m else own for s, m, v in tests]
        return [chain(p) if p else 0 for p in parts]

    def likeness(a, b):
        pairs = [x == y for x, y in zip(a, b, strict=True) if x or y]
        return sum(pairs) / len(pairs) if pairs else 0.0

    shown = lambda p: "-".join(f"{x & (2**64 - 1):x}" for x in p)
    found = {r["doc_id"]: r for r in run(spark, "op9_fingerprints")}
    down = documents[::-1]
    for (i, text), (_, after) in zip(down, [*down[1:], down[0]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new, following = fingerprint(text), fingerprint(edited), fingerprint(after)
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"].lower(), r["edited_fingerprint"].lower()) == (shown(own), shown(new))
        assert r["near_edited"] == pytest.approx(likeness(own, new)) and r["near_next"] == pytest.approx(likeness(own, following))


def test_op9_orders_equal_and_missing_numbers(spark):
    from pyspark.sql import functions as F

    from inkwell.llm import fingerprints

    texts = [f"text number {k} of many with words w{k % 7} w{k % 5}" for k in range(300)]
    for number in (lambda k: 5, lambda k: None, lambda k: k // 100):
        docs = spark.createDataFrame([(number(k), t) for k, t in enumerate(texts)], "doc_id bigint, text string")
        rows = fingerprints.with_next(docs, F.lit(1)).collect()
        assert sorted(r["text"] for r in rows) == sorted(texts) == sorted(r["next_text"] for r in rows)


def plain_urls(pages):
    """Host, path, rule and verdict of each page, by the same tree in plain dictionaries."""
    from inkwell.llm import urls as u

    def general(s):
        if re.fullmatch("[0-9]+", s):
            return "{n}"
        if re.fullmatch(r"[0-9]+\.[A-Za-z0-9]+", s):
            return "{n}" + re.search(r"\.[A-Za-z0-9]+$", s)[0]
        if re.fullmatch("[0-9a-fA-F-]{12,}", s):
            return "{hash}"
        return "{name}" if re.search("[0-9]", s) else s

    rows = []
    for i, url in pages:
        after = url.partition("://")[2] if url and "://" in url else ""
        host = re.match("[^/?#]*", after)[0]
        path = re.match("[^?#]*", after[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, None))
        rows.append((i, host, path, rule, verdict, tuple(general(s) for s in path.split("/") if s)))
    leaves = defaultdict(lambda: [0, 0, 0])
    for _, host, _, _, verdict, shape in rows:
        for h in (host, "*"):  # no test has a host of that name
            leaf = leaves[h, shape]
            leaf[0] += 1
            leaf[1] += verdict is not None
            leaf[2] += verdict == "block"
    literal, groups = defaultdict(lambda: [0, 0]), defaultdict(int)
    for (h, s), (n, labelled, _) in leaves.items():
        for k in range(len(s)):
            literal[h, s[: k + 1]][0] += n
            literal[h, s[: k + 1]][1] += labelled
            groups[h, s[:k]] += n

    def rare(n, labelled, total, segment):
        return n < 0.05 * total and labelled < 5 and not segment.startswith("{")

    forks = {}
    for h, s in leaves:
        forks[h, s] = next((k for k in range(len(s)) if rare(*literal[h, s[: k + 1]], groups[h, s[:k]], s[k])), len(s))
    below, places = defaultdict(lambda: [0, 0]), defaultdict(int)
    for (h, s), fork in forks.items():
        for k in range(fork + 1, len(s)):
            below[h, s[:fork], k, s[k]][0] += leaves[h, s][0]
            below[h, s[:fork], k, s[k]][1] += leaves[h, s][1]
            places[h, s[:fork], k] += leaves[h, s][0]
    templates = {}
    for (h, s), fork in forks.items():
        rest = [("{any}" if rare(*below[h, s[:fork], k, s[k]], places[h, s[:fork], k], s[k]) else s[k]) for k in range(fork + 1, len(s))]
        templates[h, s] = (*s[:fork], *["{any}"][: len(s) - fork], *rest)
    nodes, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for k, t in templates.items():
        for d in range(len(t) + 1):
            nodes[k[0], t[:d]][0] += leaves[k][1]
            nodes[k[0], t[:d]][1] += leaves[k][2]
            if d:
                children[k[0], t[: d - 1]].add(t[:d])
    borders = [round(math.sin(k * math.pi / 32) ** 2, 6) for k in range(1, 16)]
    pooled = {}
    for (h, _), ts in children.items():
        cells = defaultdict(list)
        for t in ts:
            n, b = nodes[h, t]
            if n:
                cells[sum(b / n >= x for x in borders)].append(t)
        pools, before = [], None
        for _, same in sorted(cells.items()):
            n, b = sum(nodes[h, t][0] for t in same), sum(nodes[h, t][1] for t in same)
            if before:
                n1, b1 = before
                base = (b + b1) / (n + n1)
                if abs(b / n - b1 / n1) > 1.96 * math.sqrt(base * (1 - base) * (1 / n + 1 / n1)):
                    pools.append([])
            else:
                pools.append([])
            pools[-1] += same
            before = n, b
        for pool in pools:
            for t in pool:
                pooled[h, t] = sum(nodes[h, x][0] for x in pool), sum(nodes[h, x][1] for x in pool)

    def share(h, t):
        n, b = nodes[h, ()]
        out = b / n if n else 0.0
        for d in range(1, len(t) + 1):
            n, b = pooled.get((h, t[:d]), (0, 0))
            out = (b + 5 * out) / (n + 5)
        return out

    for i, host, path, rule, verdict, shape in rows:
        weight = min(nodes[host, ()][0], 100)
        own = (share(host, templates[host, shape]) * weight + 5 * share("*", templates["*", shape])) / (weight + 5)
        yield i, host, path, rule, verdict or ("block" if own >= 0.5 else "allow"), None if verdict else own


def test_op10_against_a_plain_tree(spark):
    from inkwell.llm import urls

    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    pages += [(10_000 + k, u) for k, u in enumerate([None, "", "nothing", "http://", "HTTP://A.COM", "x://B.org/?q", "http://a.com/de", "http://deep.com/" + "/".join("abcdefgh") + "/x?y"])]
    pages += [(20_000 + k, f"http://wide.com/{'de' if k % 3 else 'topic' + chr(97 + k % 26) * 3}/{chr(97 + k % 26)}zz/{k}") for k in range(120)]
    pages += [pages[0], (None, "http://wide.com/fr/1")]
    found = [tuple(r) for r in urls.judge(spark.createDataFrame(pages, "page_id bigint, url string")).collect()]
    key = lambda r: tuple(str(x) for x in r[:5])
    expected = sorted(plain_urls(pages), key=key)
    found.sort(key=key)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert all(a[5] == b[5] if b[5] is None else a[5] == pytest.approx(b[5]) for a, b in zip(found, expected, strict=True))


def test_pipeline_against_its_stages_in_plain_python(spark, documents):
    import corpus_pipeline

    toxic = {r["doc_id"] for r in run(spark, "op1_toxicity") if r["predicted"]}
    left = [(i, t) for i, t in documents if i not in toxic]
    left = [(i, plain_quality(t)[1]) for i, t in left if plain_quality(t)[0][-1]]
    classes = exhaustive_classes(left)
    left = [(i, t) for i, t in left if classes[i] == i]
    tok = tokenizer("word_bpe_49k.json")
    expected = {(i, k // 2048): (k, min(2048, n - k)) for i, t in left for n in [len(tok.encode(t, add_special_tokens=False).ids) + 1] for k in range(0, n, 2048)}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"]) for r in found} == expected and len(found) == len(expected)
    bins = defaultdict(int)
    for r in found:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1


def test_warc_copies_and_odd_rows(spark, tmp_path):
    from inkwell.llm import warc

    html = "<p>" + "é" * 60 + "</p>"
    pages = [(k, f"http://h/{k}", html, 1) for k in range(5, 40)] + [(3, None, html, 1), (3, None, html, 1), (None, "http://n/", html, 1), (50, "http://s/", "short", 1), (51, "http://s/", "short", 1), (60, "u", None, 1)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string, payload int").repartition(3)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(warc.resolve(frame), folder)
    rows = sorted(warc.read_archives(spark, manifest).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    assert [r["page_id"] for r in rows] == [3, 3, *range(5, 40), 50, 51, 60, None]
    assert [r["record_type"] for r in rows] == ["response"] * 2 + ["revisit"] * 35 + ["response"] * 3 + ["revisit"]
    assert {r["refers_to"] for r in rows if r["record_type"] == "revisit"} == {3} and rows[0]["url"] is None and rows[2]["url"] == "http://h/5"
    import gzip
    import pathlib

    heads = b"".join(gzip.decompress(p.read_bytes()) for p in pathlib.Path(f"{tmp_path}/w/archives").glob("*.warc.gz"))
    assert heads.count(b"WARC-Type: warcinfo") == manifest.count() and heads.count(b"WARC-Refers-To: <urn:uuid:") == 36 == heads.count(b"WARC-Refers-To-Date: ")
    response = warc.record_id(3, hashlib.sha256(html.encode()).hexdigest()).encode()
    assert heads.count(b"WARC-Refers-To: " + response) == 36 and heads.count(b"WARC-Type: response\r\nWARC-Record-ID: " + response) == 2
    none = warc.write_archives(warc.resolve(frame.where("false")), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, none).count() == 0


def test_urls_of_a_thousand_segments(spark):
    from inkwell.llm import urls

    pages = [(k, "http://deep.com/" + "/".join("abc"[(i + k) % 3] * (1 + i % 2) for i in range(1000)) + f"/{k}") for k in range(3)]
    pages += [(10, "http://flat.com/de/1"), (11, "http://flat.com/xx/1")]
    began = time.time()
    rows = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id bigint, url string")).collect()}
    assert time.time() - began < 60
    assert len(rows) == 5 and rows[10]["rule"] == "com/de/" and all(len(rows[k]["path"]) > 2000 and rows[k]["share"] == rows[0]["share"] for k in range(3))


def test_like_siblings_are_merged_though_unlike_their_parent(spark):
    """Two branches with nearly the same share, far from their parent's, have their pages counted together; a third keeps apart."""
    from inkwell.llm import urls

    def pages(branch, n, b):
        return [("=h", f"{branch}{k}", [branch], 1, 1.0, float(k < b)) for k in range(n)]

    leaves = pages("left", 40, 38) + pages("right", 50, 47) + pages("other", 400, 4)
    merged = urls.merged(urls.generalise(spark.createDataFrame(leaves, "tree string, leaf string, shape array<string>, pages bigint, n double, b double")))
    assert sorted((r["n"], r["b"]) for r in merged.collect()) == [(90.0, 85.0), (90.0, 85.0), (400.0, 4.0)]


def test_segments_below_a_wildcard_are_judged_by_their_place(spark):
    from inkwell.llm import urls

    shapes = [["shop", f"item-{chr(97 + k % 26)}{chr(97 + k // 26)}", "view" if k % 2 else f"only-{chr(97 + k % 26)}{chr(97 + k // 26)}"] for k in range(100)]
    leaves = [("=h", str(k), s, 1, 0.0, 0.0) for k, s in enumerate(shapes)]
    steps = urls.generalise(spark.createDataFrame(leaves, "tree string, leaf string, shape array<string>, pages bigint, n double, b double"))
    found = {tuple(x["segment"] for x in sorted(r["t"])) for r in steps.groupBy("leaf").agg(F.collect_list(F.struct("at", "segment")).alias("t")).collect()}
    assert found == {("shop", "{any}", "view"), ("shop", "{any}", "{any}")}


def test_empty_and_null_urls(spark):
    from inkwell.llm import urls

    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string, host string")).count() == 0
    assert [tuple(r)[1:5] for r in urls.judge(spark.createDataFrame([(1, None, "x")], "page_id bigint, url string, host string")).collect()] == [("", "", None, "allow")]
