"""The manifest against a plain Merkle tree in Python."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quayside.llm import merkle, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(leaves):
    """The top, and for each leaf its place and the others of its run, level by level."""
    paths, own, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, p in enumerate(own):
            first = p - p % 8
            paths[k].append((p - first, nodes[first:p] + nodes[p + 1 : first + 8]))
            own[k] = p // 8
        nodes = [digest("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def tampered(row):
    suspect = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"]) if suspect and row["text"] is not None else row["text"]


def brute(rows):
    by_lang = collections.defaultdict(list)
    for row in rows:
        by_lang[row["lang"]].append(row)
    trees = []
    for lang in sorted(by_lang, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(by_lang[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        leaves = [leaf_of(r, r["text"]) for r in own]
        trees.append((own, leaves, *tree_of(leaves)))
    root, above = tree_of([t[2] for t in trees])
    out = []
    for (own, leaves, top, paths), outer in zip(trees, above):
        for row, leaf, path in zip(own, leaves, paths):
            node = leaf_of(row, tampered(row))
            for place, others in path + outer:
                node = digest("".join(others[:place] + [node] + others[place:]))
            out.append((row["doc_id"], leaf, top, root, digest("".join("".join(others) for _, others in path + outer)), node, node == root))
    return sorted(out, key=str)


def claimed():
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.in_lower_case(F.col("text"))).otherwise(F.col("text"))


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null values, langs of one row, many langs, a hot lang, a very long text, clashing names."""
    rng = random.Random(1)
    langs = [None, "", "a", "é", *(f"l{k}" for k in range(12)), *(["en"] * 30)]
    rows = [(i, rng.choice(["Ab c", "x", None, "ÄÖ Q", ""]), rng.choice(langs), rng.choice(["s", None]), rng.choice([1, None])) for i in [*range(300), 5, 5, None, None, 2**60 + 1]]
    rows += [rows[3], rows[3], (999, "Word " * 300_000, "long", "s", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({"tree": F.lit("x"), "idx": F.lit(1), "n": F.lit(2), "digest": F.lit("q"), "claim": F.lit(0)})


@pytest.mark.parametrize("levels", [1, 4])
def test_equals_plain_tree(odd, levels):
    got = sorted((tuple(r)[:7] for r in merkle.manifest(odd, claimed=claimed(), levels=levels).collect()), key=str)
    assert got == brute(odd.collect()) and {r[6] for r in got} == {True, False}


def test_query_equals_plain_tree(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(map(tuple, queries.op12_merkle_manifest(spark, SF).collect()), key=str) == brute(rows)


def test_proofs_lead_to_the_root(odd):
    rows = merkle.manifest(odd, levels=2, with_proofs=True).collect()
    assert all(r["verified"] and merkle.folded(r["leaf"], r["proof_at"], r["proof_others"]) == r["root"] for r in rows)
    assert all(r["proof_sha256"] == digest("".join(r["proof_others"])) for r in rows)
    wrong = next(r for r in rows if r["proof_at"])
    assert merkle.folded(digest("other"), wrong["proof_at"], wrong["proof_others"]) != wrong["root"]


def test_small_and_empty(spark, odd):
    assert merkle.manifest(odd.where("false")).count() == 0
    one = merkle.manifest(odd.where("doc_id = 999"), with_proofs=True).collect()
    assert [(r["leaf"], r["subroot"], r["proof_at"], r["proof_sha256"]) for r in one] == [(one[0]["root"], one[0]["root"], [], digest(""))]
    with pytest.raises(ValueError):
        merkle.manifest(odd, levels=0)
