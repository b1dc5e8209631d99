"""Each operator against a brute-force version, and its edge cases."""

import collections
import hashlib
import io
import json
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quayside.llm import chat_format, exact_dedup, html_extract, lm_score, mixing, ngram_join, packing, quality_rules, queries, toxicity, warc
from quayside.llm._shared import components, join_by_key

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i * i % 9973}" for i in range(60_000))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS).withColumns({"_h": F.lit("clash"), "n": F.lit(1), "key": F.lit("x"), "token": F.lit(0)})


@pytest.fixture(scope="module")
def edge(spark):
    """Null text, id and source; empty, blank and very long texts; repeated rows and ties; clashing columns."""
    return docs_of(spark, [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, "One two.", "b"), (4, "One two.", "b"), (None, "One  two.", "b"), (5, "one Two. three four five six", "b"), (6, LONG, "c"), (7, LONG + " end", "c"), (None, None, None)])


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [(1, "x", "a")]).where("false")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_join_by_key_with_hot_keys(spark):
    left = spark.range(2000).withColumn("k", F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("v")).where("k <> '1500'")
    out = {r["id"]: r["v"] for r in join_by_key(left, right, "k", "n", F.col("id"), hot_share=0.01).collect()}
    assert len(out) == 2000 and out[5] == 899 and out[1000] == 1000 and out[1500] is None


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(1000, n) for n in range(1001, 1200)] + [(n, n + 1) for n in range(2000, 2040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 1 packing
def test_binary_lengths():
    for n in (1, 2, 7, 2047, 2048, 2049, 10_000):
        parts = packing.binary_lengths(n, 2048)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts)


def test_encoder_equals_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    judge = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    judge.encode_special_tokens = True
    own = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    random.seed(1)
    signs = ["a", "B", " ", "  ", "\n", "\t", "'s", "1", "!", "é", "<|endoftext|>", "\x1c", "\x85", "𝔘", "'"]
    for size in (packing.PART_CHARS, 3):
        monkeypatch.setattr(packing, "PART_CHARS", size)
        for _ in range(2000):
            text = "".join(random.choices(signs, k=random.randint(0, 12)))
            assert own.encoded(text) == np.array(judge.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_equals_the_tokenizer_on_documents(documents):
    from tokenizers import Tokenizer

    judge = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    judge.encode_special_tokens = True
    own = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in documents.collect():
        assert own.encoded(r["text"] or "") == np.array(judge.encode(r["text"] or "", add_special_tokens=False).ids, "<u4").tobytes()


def pack(docs):
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()


def test_packing(documents, edge, empty):
    own = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = pack(documents)
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for d in documents.collect():
        ids, at = own.encoded(d["text"] or "") + np.array([1], "<u4").tobytes(), 0
        for r in sorted(by_doc[d["doc_id"]], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["offset"]) == (at, len(ids) // 4, 0)
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert [r["bucket"] for r in sorted(rows, key=lambda r: r["sequence_id"])] == sorted(r["length"] for r in rows)
    ends = collections.Counter(r["doc_id"] for r in pack(edge) if r["start"] + r["length"] == r["doc_tokens"])
    assert ends == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1, 7: 1, None: 2}
    assert pack(empty) == []


# 2 quality rules
def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = collections.defaultdict(list)
    for j in range(len(words) - 2):
        places[tuple(words[j : j + 3])].append(j)
    covered = {p + k for ps in places.values() if len(ps) > 1 for p in ps for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, documents, edge, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = {r["doc_id"]: r for r in quality_rules.quality(documents).collect()}
    for d in documents.collect():
        want = base_counts(d["text"] or "")
        r = rows[d["doc_id"]]
        assert tuple(r[n] for n in names) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert sorted(r["n_words"] for r in quality_rules.quality(edge).collect()) == [0, 0, 0, 0, 2, 2, 2, 6, 60_000, 60_001]
    assert quality_rules.quality(empty).count() == 0


def test_quality_judges_lines(spark):
    prose = "The cat sat on the mat and looked at the rain that fell outside for hours.\n" + "\n".join("Line " + " ".join(f"w{i}x{j}" for j in range(12)) + "." for i in range(6))
    menu = "\n".join(f"Home{i} | News{i} | Sport{i} | Page{i}" for i in range(14))
    rows = {r["doc_id"]: r for r in quality_rules.quality(docs_of(spark, [(1, prose, ""), (2, prose + "\nAccept all cookies", ""), (3, menu + "\n" + prose[:80], "")])).collect()}
    assert rows[1]["kept"] and rows[2]["kept"] and not rows[3]["kept"] and not rows[3]["base_failed"]
    assert "cookies" not in rows[2]["cleaned"] and "w5x11." in rows[2]["cleaned"]


# 3 toxicity
def test_toxicity_learns_and_generalises(spark):
    random.seed(5)
    common = ["".join(random.choices("abdeilmnorst", k=random.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = random.choices(common, k=random.randint(30, 80))
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(random.randrange(len(words)), random.choice(["zkwuggler", "zkwuggling", "zkwuggled"]))
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, " ".join(random.choices(common, k=40) + ["zkwuggles!!"] * 3), "a"), (2001, None, "a"), (None, "fine", "a"), (2001, None, "a")]
    out = toxicity.score(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] < 900]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out if r["doc_id"] is not None)
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) > 0.95 * len(held)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[2000]["predicted"] == 1 and by_id[2001]["predicted"] == 0 and not by_id[None]["held_out"] and len(out) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)


def test_toxicity_of_given_documents(spark):
    """Held out from training, by the given labels: better than chance by far, and the plain computation of a score."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["score"], toxic[r["doc_id"]], r["predicted"]) for r in toxicity.score(docs, labels).collect() if r["held_out"] and r["doc_id"] in toxic]
    bad, good = [x for x in held if x[1]], [x for x in held if not x[1]]
    auc = sum((x[0] > y[0]) + 0.5 * (x[0] == y[0]) for x in bad for y in good) / (len(bad) * len(good))
    assert len(bad) >= 5 and auc > 0.7 and sum(x[2] for x in good) <= 0.05 * len(good)
    model = toxicity.Model(np.random.default_rng(1).normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32), 0.25)
    for text in ("", "one", "Two words, é!", "x" * 50 + " word " * 300_000):
        words = ["".join(w) for w in re.findall(r"[^\W_]+", text.lower())]
        means = []
        for word in dict.fromkeys(words):
            grams = [model.values[b] for b in toxicity.subwords(word)[0]]
            means.append((words.count(word), sum(map(float, grams)) / max(1, len(grams))))
        logit = 0.25 + sum(n * m for n, m in means) / (len(words) + toxicity.PRIOR_WORDS)
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)


def test_toxicity_without_labels(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.score(edge, none).collect()} == {0}
    assert toxicity.score(empty, none).count() == 0
    assert toxicity.drop_toxic(edge, none).columns == edge.columns and toxicity.drop_toxic(edge, none).count() == 10


# 4 WARC
def test_warc_round_trip(spark, tmp_path):
    body = "<p>" + "x" * 200
    pages = spark.createDataFrame(
        [(3, "u3", body), (1, "u1", body), (2, None, body), (2, "u2b", body), (4, "u4", "short"), (5, "u5", "short"), (6, "u\r\n6", None), (None, "un", body), (7, "é", "é" * 300_000)],
        "page_id bigint, url string, html string",
    ).withColumns({"archive": F.lit("clash"), "_n": F.lit(1)})
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=500)
    assert manifest.count() > 1
    rows = warc.read_archives(manifest).collect()
    found = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows), key=str)
    n = len(body)
    assert found == sorted([(1, "response", None, n), (2, "revisit", 1, n), (2, "revisit", 1, n), (3, "revisit", 1, n), (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 0), (None, "revisit", 1, n), (7, "response", None, 600_000)], key=str)
    assert {r["payload_digest"] for r in rows if r["page_id"] in (1, 2, 3)} == {hashlib.sha256(body.encode()).hexdigest()}
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


def test_warc_reader_is_strict():
    good = [warc.record_bytes(i, "u", b"payload" * 50_000, hashlib.sha256(b"payload" * 50_000).hexdigest(), None, False) for i in range(3)]
    out = list(warc.read_records(io.BytesIO(b"".join(good)), keep_payload=True))
    assert [r["page_id"] for r in out] == [0, 1, 2] and out[1]["payload"] == b"payload" * 50_000
    wrong = warc.record_bytes(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), None, False)
    for bad in (wrong, good[0][:-20], good[0][:100]):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))


# 5 n-gram Jaccard join
def components_of(rows, width=5, percent=80):
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        n = min(width, len(w))
        sets.append((i, frozenset(b" ".join(w[j : j + n]) for j in range(len(w) - n + 1)) if w else frozenset()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("block_rows", [256, 3])
def test_ngram_join_equals_brute_force(spark, documents, monkeypatch, block_rows):
    """Variants that link to an original only, chains, shared passages; in one block and in many."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block_rows)
    random.seed(7)
    word = lambda: "".join(random.choices("abcdefgh", k=4))
    first = [word() for _ in range(120)]
    rows = []
    for _ in range(25):
        copy = list(first)
        for at in random.sample(range(120), 2):
            copy[at] = word()
        rows.append(" ".join(copy))
    chain = list(first)
    for _ in range(12):
        chain[random.randrange(120)] = word()
        rows.append(" ".join(chain))
    passage = [word() for _ in range(40)]
    rows += [" ".join([word() for _ in range(60)] + passage) for _ in range(15)] + [" ".join(first).upper(), "two words", "Two  words", "", " "]
    rows += [r["text"] for r in documents.orderBy("doc_id").limit(60).collect()]
    numbered = list(enumerate(rows))
    random.shuffle(numbered)
    out = ngram_join.similar_documents(docs_of(spark, [(i, t, "a") for i, t in numbered]))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == components_of(sorted(numbered))


def test_ngram_join_edges(spark, edge, empty):
    rows = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(edge).collect()), key=str)
    n6, n7 = (next(r[1] for r in rows if r[0] == i) for i in (6, 7))
    assert rows == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (None, 1, 4), (5, 2, 5), (6, n6, 6), (7, n7, 6), (None, 0, None)], key=str)
    assert ngram_join.similar_documents(empty).count() == 0
    kept = ngram_join.drop_similar(edge)
    assert kept.columns == edge.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None"]
    assert ngram_join.drop_similar(empty).count() == 0 and ngram_join.similar_pairs(empty).count() == 0


def test_ngram_join_tells_rows_apart(spark):
    """Several texts under one id, ids that are null, full copies, and a component without any id."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a, "s"), (2, a + " x", "s"), (2, b, "s"), (3, b + " y", "s"), (3, b + " y", "s"), (None, a + " z", "s"), (9, "unlike all else here", "s"), (None, "p " * 9 + "q r s t u v w", "s"), (None, "p " * 9 + "q r s t u v w", "t")]
    docs = docs_of(spark, rows).withColumns({"_row": F.lit(1), "_d": F.lit(2), "content": F.lit("c")})
    found = sorted(((r["doc_id"], r["component_id"], r["n_links"]) for r in ngram_join.similar_documents(docs).collect()), key=str)
    assert found == sorted([(1, 1, 2), (2, 1, 2), (2, 2, 1), (3, 2, 1), (3, 2, 1), (None, 1, 2), (9, 9, 0), (None, None, 0), (None, None, 0)], key=str)
    kept = ngram_join.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["_row"], r["content"]) for r in kept.collect()), key=str) == sorted([(1, a, 1, "c"), (2, b, 1, "c"), (9, rows[6][1], 1, "c"), (None, rows[7][1], 1, "c")], key=str)


def test_ngram_join_of_large_groups(spark):
    """Many variants of one text that are all near the limit, and many texts that share passages and are not similar."""
    random.seed(13)
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    first, passages = [word() for _ in range(100)], [[word() for _ in range(40)] for _ in range(6)]
    rows = []
    for k in range(400):
        copy = list(first)
        for at in random.sample(range(100), random.choice([1, 1, 2])):
            copy[at] = word()
        rows.append((2 * k, " ".join(copy), "a"))
        rows.append((2 * k + 1, " ".join(random.choice(passages) + random.choice(passages) + [word() for _ in range(15)]), "a"))
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(5)))) for i, t, _ in rows}
    ids = sorted(sets)
    want = collections.Counter()
    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                want.update((x, y))
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.similar_documents(docs_of(spark, rows)).collect()}
    assert got == {i: want[i] for i in ids} and sum(want.values()) > 10_000


def test_ngram_join_finds_every_link(spark, monkeypatch):
    """Also those inside a component, with a chain, copies, a null id and large components in chunks."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 7)
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefgh", k=4))
    first = [word() for _ in range(120)]
    rows = []
    for _ in range(30):
        copy = list(first)
        copy[random.randrange(120)] = word()
        rows.append(" ".join(copy))
    chain = list(first)
    for _ in range(12):
        chain[random.randrange(120)] = word()
        rows.append(" ".join(chain))
    rows += [" ".join(first), " ".join(first).upper(), " ".join(word() for _ in range(50)), "", "two words"]
    numbered = list(enumerate(rows))
    sets = {}
    for i, text in numbered:
        w = text.lower().split()
        sets[i] = frozenset(zip(*(w[k:] for k in range(5)))) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    rep = {i: min(k for k in sets if sets[k] == x) if x else i for i, x in sets.items()}
    reps = sorted({rep[i] for i in sets if sets[i]})
    want = {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    docs = docs_of(spark, [*((i, t, "a") for i, t in numbered), (None, rows[0], "a")])
    pairs = [tuple(r) for r in ngram_join.similar_pairs(docs).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 400
    links = collections.Counter(x for pair in want for x in pair)
    out = ngram_join.similar_documents(docs).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in out if r["doc_id"] is not None) == [(i, rep[i], links[rep[i]]) for i in sorted(sets)]
    assert [(r["class_id"], r["n_links"]) for r in out if r["doc_id"] is None] == [(rep[0], links[rep[0]])]


# 6 mixing
def test_mixing(spark, documents, edge, empty):
    sizes = {"a": 1000, "b": 100, None: 5000, "é": 300}
    rows, i = [], 0
    for source, total in sizes.items():
        for _ in range(total // 10):
            rows.append((i, "w " * 10, source))
            i += 1
    out = mixing.mix(docs_of(spark, rows)).collect()
    order = ["a", "b", "é", None]
    weight = dict(zip(order, (1, 2, 3, 1)))
    left, full = float(sum(sizes.values())), set()
    while True:
        level = (left - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        full |= more
    taken = collections.Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(3 * sizes[r["source"]] if r["source"] in full else weight[r["source"]] * level)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 10 for r in out)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs_of(spark, rows).repartition(7)).collect()), key=str)
    again = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(docs_of(spark, rows)).collect())
    assert again == {r["doc_id"]: r["copies"] for r in out if r["copies"]}
    assert mixing.mix(edge).count() == 10 and mixing.mix(empty).count() == 0
    clash = edge.withColumns({c: F.lit(c) for c in ("_src", "_size", "_row", "_copies", "target")})
    times = collections.Counter((r["doc_id"], r["copies"]) for r in mixing.mix(clash).collect())
    mixed = mixing.mixed_documents(clash).collect()
    assert mixing.mixed_documents(clash).columns == clash.columns and all((r["_h"], r["_src"], r["_size"]) == ("clash", "_src", "_size") for r in mixed)
    assert len(mixed) == sum(copies * n for (_, copies), n in times.items()) and mixing.mixed_documents(empty).count() == 0
    for source in ("src0", "src1"):
        some = [r for r in mixing.mix(documents).collect() if r["source"] == source]
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) <= max(r["size"] for r in some)


# 7 chat formatting
def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "", None, "\\", "\\\\<|", "<\\p", "\\n", "a\nb\n", "<", "|im_end|>", "<|im_end|>\n", "é<|" * 3]
    rows = [(1, n, ["user", "assistant"][n % 2], t) for n, t in enumerate(texts)] + [(2, 0, "odd\n<|role\\", "x"), (2, 1, None, "y"), (2, 1, None, "y"), (None, None, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("s", F.lit("clash"))
    formatted = chat_format.format_turns(chat_format.canonical_turns(turns))
    parsed = {r["conv_id"]: r for r in chat_format.parse_formatted(formatted).collect()}
    assert [(t["role"], t["text"]) for t in parsed[1]["turns"]] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert "".join(parsed[1]["loss_texts"]) == "".join(t or "" for n, t in enumerate(texts) if n % 2)
    assert [(t["role"], t["text"]) for t in parsed[2]["turns"]] == [("odd\n<|role\\", "x"), ("", "y"), ("", "y")]
    assert parsed[None]["loss_texts"] == ["z"]
    for r in formatted.collect():
        assert r["formatted"].count("<|im_end|>") == len(r["loss_mask"]) == r["formatted"].count("<|im_start|>")
    assert chat_format.digests(chat_format.parse_formatted(chat_format.format_turns(turns.where("false")))).count() == 0


def test_chat_of_very_long_texts(spark):
    text = "<|im_start|>\\ é\n" * 200_000
    turns = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    mapped = chat_format.turns_of_records(queries._as_records(turns), "record")
    parsed = chat_format.parse_formatted(chat_format.format_turns(mapped)).first()
    assert parsed["turns"][1]["text"] == text == "".join(parsed["loss_texts"])


def test_chat_layouts(spark):
    two = [("user", "hi"), ("assistant", "yo")]
    records = [
        ({"prompt": "hi", "response": "yo"}, "prompt", two),
        ({"instruction": "hi", "output": "yo", "id": 7}, "instruction", two),
        ({"instruction": "do", "input": "this", "output": "yo"}, "instruction with input", [("user", "do\n\nthis"), ("assistant", "yo")]),
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, "messages", two),
        ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, "conversations", two),
        ({"other": 1}, None, None),
    ]
    raw = [json.dumps(r) for r, _, _ in records] + ["{broken", None]
    df = spark.createDataFrame([(n, r) for n, r in enumerate(raw)], "n int, record string")
    out = [(r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat_format.canonical_records(df, "record").orderBy("n").collect()]
    assert out == [(layout, turns) for _, layout, turns in records] + [(None, None)] * 2
    rows = spark.createDataFrame([(9, 4, json.dumps(r)) for r, _, _ in records[:1]] + [(9, 0, json.dumps(records[3][0])), (8, 0, json.dumps(records[4][0]))], "conv_id int, turn int, json string").withColumn("_json", F.lit("clash"))
    turns = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat_format.turns_of_records(rows, "json").collect()}
    assert turns == {(c, t + k): two[k] for c, t in ((9, 4), (9, 0), (8, 0)) for k in (0, 1)}
    for bad in ('{"other":1}', "{broken", None):
        with pytest.raises(Exception):
            chat_format.turns_of_records(spark.createDataFrame([(1, 0, bad)], "conv_id int, turn int, json string"), "json").collect()
    table = spark.createDataFrame([(1, "hi", "yo", "z")], "conv_id int, prompt string, response string, extra string")
    assert [(r["role"], r["text"]) for r in chat_format.canonical_turns(table).orderBy("turn").collect()] == two
    with pytest.raises(ValueError):
        chat_format.canonical_turns(df)


# 8 exact dedup
def brute_dedup(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return sorted((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g if i is not None)


@pytest.mark.parametrize("content_hash", [exact_dedup.hash128, lambda t: F.pmod(F.crc32(t), F.lit(3)).cast("string")])
def test_exact_dedup(spark, documents, edge, content_hash):
    """A hash of three values makes every group collide; the bytes still decide."""
    rows = [(r["doc_id"], r["text"]) for r in documents.union(edge.select(*documents.columns).withColumn("doc_id", F.col("doc_id") + 10_000)).collect()]
    out = exact_dedup.exact_duplicates(docs_of(spark, [(i, t, "a") for i, t in rows]), content_hash).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in out if r["doc_id"] is not None) == brute_dedup(rows)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in out) and len(out) == len(rows)


def test_exact_dedup_edges(edge, empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7"]
    assert exact_dedup.drop_copies(empty).count() == 0


@pytest.mark.parametrize("content_hash", [exact_dedup.hash128, lambda t: F.pmod(F.crc32(t), F.lit(2)).cast("string")])
def test_drop_copies_by_row(spark, content_hash):
    """A unique text stays under whatever id, one row of full copies does, and a null id gives way."""
    rows = [(1, "aaa", "s"), (2, "aaa", "s"), (2, "unique text", "s"), (3, "r", "s"), (3, "r", "s"), (None, "aaa", "s"), (None, "n", "s"), (None, "n", "t"), (None, "m", "s")]
    docs = docs_of(spark, rows).withColumns({c: F.lit(c) for c in ("_d", "_k", "_t", "_row", "keep_id", "group_size")})
    kept = exact_dedup.drop_copies(docs, content_hash)
    assert kept.columns == docs.columns and {r["_k"] for r in kept.collect()} == {"_k"}
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, "aaa"), (2, "unique text"), (3, "r"), (None, "n"), (None, "m")], key=str)


# 9 HTML extraction
def test_html(spark):
    page = """<html><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies.</div><main><article><header><h1>Title</h1></header>
      <p>One <b>two</b> &amp; three&nbsp;four<p>Para<script>if(a<b){"</p>"}</script> more<aside>side</aside><form>Name <input></form>
      <div class="post-comments"><p>nice post</p></div><p>End.</article></main><footer>x</footer>"""
    assert html_extract.main_text(page) == "Title\nOne two & three four\nPara more\nEnd."
    assert html_extract.main_text('<div id="site-header">Site</div><div class="content"><div class="entry-header">Title</div><p>Text.</p></div>') == "Title\nText."
    good = "the cat is in the house of the man and it was good " * 6
    plain = f"<div><a href=x>Home</a></div><p>{good}</p><p>short one</p><p>{good}</p><div>Imprint</div>"
    assert html_extract.main_text(plain) == f"{good.strip()}\nshort one\n{good.strip()}"
    assert html_extract.main_text("<p " + "'" * 50_000) == "" and html_extract.main_text("<!-- x") == ""
    rows = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", page), (2, "u", page)], "page_id bigint, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    out = html_extract.extract(rows).collect()
    assert [r["n_chars"] for r in out] == [0, 0, len(html_extract.main_text(page))] + [len(html_extract.main_text(page))] and len(out) == 4
    assert html_extract.extract(rows.where("false")).count() == 0


def test_html_attributes_by_whole_name():
    """Values of other attributes and names that only end like one say nothing."""
    for tag in ('body style="overflow:hidden"', "article data-state='hidden'", 'article data-role="banner"', "article data-class=sidebar", 'article title="x class=sidebar"', "article style = overflow:hidden"):
        assert html_extract.main_text(f"<{tag}><article><p>Text.</p></article>") == "Text.", tag
    for tag in ("div hidden", 'div aria-hidden="true"', "div x=1 HIDDEN", "div class = 'x sidebar'", 'div/class="sidebar"', 'div a="1"role=banner'):
        assert html_extract.main_text(f"<article><p>Text.</p><{tag}>away</div></article>") == "Text.", tag
    assert html_extract._names("'" * 50_000 + "=" * 50_000) == (set(), False, False)


def test_html_place_does_not_decide_alone():
    """A decoy with a content class hides no article; long rich blocks outside a true content element stay, the menu goes."""
    good = ("the cat is in the house of the man and it was good " * 6).strip()
    menu = "<ul><li><a href=x>Home</a></li></ul><div>Imprint</div>"
    article = f"<p>{good}</p><p>short one</p><p>{good}</p>"
    for name in ("post", "entry", "story", "main-teaser-content"):
        assert html_extract.main_text(f'{menu}<div class="{name}">Read more</div><div>{article}</div>{menu}').endswith(f"{good}\nshort one\n{good}"), name
    both = f"{menu}<article>{article}<p>More.</p>{article}</article>{menu}<section>{article}</section>{menu}"
    inside = f"{good}\nshort one\n{good}"
    assert html_extract.main_text(both) == f"{inside}\nMore.\n{inside}\n{inside}"
    assert html_extract.main_text(f"{menu}{article}{menu}") == inside
    assert html_extract.main_text(f"{menu}<article><p>Short.</p></article>{menu}") == "Short."


def test_html_of_given_pages(spark):
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert html_extract.main_text(r["html"]) == "\n".join(b for b in blocks if b)


def test_html_without_content_elements(spark, monkeypatch):
    """The block rules alone find the article where no element names it, without menus; stop words matter to the given pages."""
    found = total = 0
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    texts = [html_extract.main_text(page) for page in pages]
    for page, text in zip(pages, texts):
        lines = html_extract.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>")).split("\n")
        have = collections.Counter(text.split("\n"))
        assert not collections.Counter(x for x in lines if x) - have
        found, total = found + sum(map(len, lines)), total + len(text) - text.count("\n")
    assert found >= 0.9 * total
    monkeypatch.setattr(html_extract, "stop_density", lambda text: 0.0)
    assert [html_extract.main_text(page) for page in pages] != texts


def test_html_names_do_not_decide_alone():
    """Names that speak of other elements, wrappers with a surrounding name, and names that contradict each other."""
    good = ("the cat is in the house of the man and it was good " * 6).strip()
    body = f"<p>{good}</p><p>Short.</p><p>{good}</p>"
    for page in (
        '<div class="content has-sidebar"><article>{}</article></div>', '<div class="layout no-sidebar">{}</div>', '<form id="aspnetForm"><main>{}</main></form>',
        '<div id="content" class="legal">{}</div>', '<div class="notice">{}</div>', '<form action="x">{}</form>',
    ):
        assert html_extract.main_text(page.format(body)) == f"{good}\nShort.\n{good}", page
    comments = f'<div class="comments"><div class="content"><p>{good[:130]}</p></div></div>'
    assert html_extract.main_text(f"<article>{body}{comments}</article>") == f"{good}\nShort.\n{good}"
    assert html_extract.main_text(f"<aside><article>{body}</article></aside>") == ""
    assert len(html_extract.main_text(f"<article>{'<p>' + good + '</p>' * 3}{body * 2000}</article>")) > 1_000_000


# 10 language model
def counted(rows):
    """Exact counts of the words, with None for the end, of the training texts."""
    counts = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*t.encode().lower().split(), None])
    return counts


@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_lm_score(documents, edge, empty, broadcast_bytes):
    """By a broadcast model and by its regions."""
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    counts = counted(rows)
    n, v = sum(counts.values()), len(counts)
    out = {r["doc_id"]: r for r in lm_score.score(documents, broadcast_bytes=broadcast_bytes).collect()}
    for i, t in rows:
        tokens = [*t.encode().lower().split(), None]
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
    held = [r for r in out.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    odd = lm_score.score(edge, broadcast_bytes=broadcast_bytes).collect()
    assert len(odd) == 10 and sorted(r["n_tokens"] for r in odd) == [1, 1, 1, 1, 3, 3, 3, 7, 60_001, 60_002]
    assert lm_score.score(empty, broadcast_bytes=broadcast_bytes).count() == 0


def test_filter_holds_quantised_counts():
    """Levels come back exactly but for the filter's false positives, which only raise them; absent n-grams are mostly absent."""
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**46, 20_000, dtype=np.uint64))
    counts = rng.geometric(0.3, len(keys)) ** 2
    bloom = lm_score.LogFrequencyFilter.holding(keys, counts)
    got, want = bloom.levels(keys), lm_score.level_of(counts)
    assert (got >= want).all() and (got == want).mean() > 0.95
    others = np.setdiff1d(rng.integers(0, 2**46, 20_000, dtype=np.uint64), keys)
    assert (bloom.levels(others) > 0).mean() < 0.05
    assert (bloom.levels(others) > 0).any()


def test_saved_model_scores_other_documents(spark, documents, monkeypatch, tmp_path):
    """Over many shards and groups, broadcast or not, with the same scores; only probes of the filter tell about n-grams."""
    monkeypatch.setattr(lm_score, "shard_bits", lambda keys: 3)
    monkeypatch.setattr(lm_score, "group_bytes", lambda keys: 20_000)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    train = documents.where(~lm_score.held_out(F.col("doc_id"))).select("text")
    made = lm_score.fit(train, order=3, path=f"file://{tmp_path}/model")
    model = lm_score.LanguageModel.load(spark, f"file://{tmp_path}/model")
    assert made == model and model.bits == 3 and model.regions(spark).count() == 8
    counts = counted(rows)
    assert (model.n_tokens, model.vocabulary, model.n_texts) == (sum(counts.values()), len(counts), counts[None])
    other = docs_of(spark, [(1, rows[0][1], "a"), (2, "never seen " + rows[1][1], "a"), (None, None, "a"), (3, "x", "a")])
    one, two = ({r["doc_id"]: tuple(r) for r in lm_score.score_with(other, model, broadcast_bytes=b).collect()} for b in (1 << 30, 0))
    assert one.keys() == two.keys() and all(one[i][:3] == two[i][:3] and one[i][3:] == pytest.approx(two[i][3:]) for i in one)
    regions = {r["shard"]: lm_score._Region.of(r.asDict()) for r in model.regions(spark).collect()}
    for i, text in ((1, rows[0][1]), (2, "never seen " + rows[1][1])):
        words = [*text.encode().lower().split(), None]
        c = [counts[w] for w in words]
        p = [(x + 0.1) / (model.n_tokens + 0.1 * (model.vocabulary + 1)) for x in c]
        tokens, lengths = lm_score.tokens_of([text.encode()])
        for keys in lm_score.gram_keys(tokens, lengths, 3):
            keys = lm_score._gram_part(keys, 3)
            many = [float(lm_score.count_of(regions[int(k) >> 40].grams.levels(np.array([k], np.uint64)))[0]) for k in keys]
            history = [model.n_texts, *c[:-1]]
            p, c = [(m + 2000 * q) / (max(h, m) + 2000) for m, q, h in zip(many, p, history)], many
        assert one[i][4] == pytest.approx(sum(math.log10(min(x, 1.0)) for x in p))


def test_pipeline(spark):
    """Each stage against brute force on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_join", "mixing", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = kept
        kept = spark.createDataFrame(stage(spark, before, SF).collect(), docs.schema)
        assert kept.columns == docs.columns
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        left = {r["doc_id"] for r in kept.collect()}
        if name == "exact_dedup":
            assert left == {i for i, keep, _ in brute_dedup(rows) if i == keep}
        elif name == "ngram_join":
            assert left == {i for i, (_, c) in components_of(rows).items() if i == c}
        else:
            assert len(left) > 0.8 * len(rows)
    mixed = corpus_pipeline.STAGES[3][1](spark, kept, SF)
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, SF)
    ends = packed.where("start + length = doc_tokens").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in ends} == dict(collections.Counter(r["doc_id"] for r in mixed.collect()))


def test_pipeline_on_odd_tables(spark, edge, empty, monkeypatch, tmp_path):
    """The whole pipeline over null, empty, long, repeated and clashing rows, and over no rows."""
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([(5, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/sf/labels.parquet")
    for name, docs, ids in (("odd", edge.withColumns({c: F.lit(c) for c in ("_d", "_src", "_row")}), {1, 3, 4, 5, 6}), ("none", empty, set())):
        docs.write.parquet(f"file://{tmp_path}/sf/{name}.parquet")
        monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, table, name=name: spark.read.parquet(f"{sf_dir}/{name if table == 'documents' else table}.parquet"))
        stages = []
        real = corpus_pipeline.written
        monkeypatch.setattr(corpus_pipeline, "written", lambda df, label, stages=stages: stages.append(real(df, label)) or stages[-1])
        packed = corpus_pipeline.run(spark, f"file://{tmp_path}/sf")
        monkeypatch.setattr(corpus_pipeline, "written", real)
        assert all(kept.columns == docs.columns for kept in stages[:4]) and {r["doc_id"] for r in stages[2].collect()} == ids
        assert {r["doc_id"] for r in packed.collect()} <= ids and "sequence_id" in packed.columns


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings", "benchmark"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cursor = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(names)
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=str) == sorted(cursor.fetchall(), key=str)
