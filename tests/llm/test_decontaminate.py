"""Decontamination against brute force over all windows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quayside.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, window=10, coverage=1.0):
    """For each text its words, the hit ones and the items found."""
    windows = {}
    for item, text in items:
        w = words_of(text)
        size = min(window, max(1, -int(-coverage * len(w) // 1)))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault((size, tuple(w[k : k + size])), set()).add("" if item is None else str(item))
    sizes = {size for size, _ in windows}
    out = []
    for text in docs:
        w, hit, found = words_of(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (size, tuple(w[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[size, tuple(w[k : k + size])]
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def table(spark, rows, name, id_name):
    return spark.createDataFrame(rows, f"{id_name} bigint, text string").withColumns({"n": F.lit(1), "item": F.lit("clash"), "spans": F.lit("x"), "words": F.lit("y"), "_row": F.lit(3)}).repartition(2)


def checked(found, docs, want):
    rows = sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(k for s in r["spans"] for k in range(s["first"], s["end"])), list(r["items"]), r["n_items"], r["contaminated"]) for r in found.collect()), key=str)
    assert rows == sorted(((i, n, len(hit), hit, items, len(items), bool(hit)) for (i, _), (n, hit, items) in zip(docs, want)), key=str)


@pytest.mark.parametrize("window, coverage, max_words", [(10, 1.0, 200_000), (4, 0.6, 25), (1, 1.0, 200_000)])
def test_equals_brute_force(spark, window, coverage, max_words):
    """Few words, so that much is shared: long, short, equal, nested, empty and null items; one automaton and several."""
    rng = random.Random(3)
    some = lambda n, k=5: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(i, some(n)) for i, n in enumerate([30, 12, 11, 10, 9, 4, 3, 60])]
    items += [(20, items[0][1]), (21, items[0][1][5:41]), (1, some(14)), (30, ""), (31, None), (32, " .,! "), (None, some(15)), (None, some(13))]
    docs = [(k, some(rng.choice([0, 3, 12, 40, 300]), rng.choice([3, 5, 8]))) for k in range(25)]
    docs += [(100 + k, f"{some(20, 8)} {(text or '').upper()}; {some(5, 8)} {items[(k + 3) % 8][1]}") for k, (_, text) in enumerate(items)]
    docs += [(200, None), (200, None), (None, items[0][1]), (201, "é " * 30), (202, some(60_000, 8)), (203, items[3][1].replace(" ", "\x00\n—".replace("—", "-")))]
    found = decontaminate.contamination(table(spark, docs, "docs", "doc_id"), table(spark, items, "items", "item_id"), window=window, coverage=coverage, max_words=max_words)
    checked(found, docs, brute([t for _, t in docs], items, window, coverage))


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op13_decontamination(spark, SF).collect())
    want = zip(docs, brute([t for _, t in docs], items))
    assert got == sorted((i, n, len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)) for (i, _), (n, hit, ids) in want)


def test_automaton_holds_every_run():
    """Each run of words of an item leads to a state, and no other run does."""
    rng = random.Random(5)
    items = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 25))] for _ in range(12)]
    made = decontaminate.Automaton.of([(str(k), words, 3) for k, words in enumerate(items)])
    runs = {tuple(w[i:j]) for w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    for run in runs | {tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 9))) for _ in range(500)}:
        state = 0
        for word in run:
            state = made.step[state].get(made.words[word]) if state is not None else None
        assert (state is not None) == (run in runs)
    assert len(made.link) <= 2 * sum(map(len, items)) + 1


def test_spans_go_and_clean_rows_stay(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    noise = " ".join(f"w{k}" for k in range(20))
    docs = [(1, f"Before, {item.upper()}! After. {noise}"), (2, "Clean text.\n"), (3, item), (4, None), (5, f"{item} x {item}. {noise} {noise}"), (6, "")]
    df = table(spark, docs, "docs", "doc_id")
    out = decontaminate.decontaminate(df, table(spark, [(1, item), (2, None)], "items", "item_id"))
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: f"Before, ! After. {noise}", 2: "Clean text.\n", 4: None, 5: f"x . {noise} {noise}", 6: ""}
    none = table(spark, [], "items", "item_id")
    assert decontaminate.decontaminate(df, none).count() == 6 and decontaminate.contamination(df, none).where("contaminated").count() == 0
    assert decontaminate.contamination(df.where("false"), none).count() == 0
