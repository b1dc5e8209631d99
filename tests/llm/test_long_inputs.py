"""Very long texts and pages, and row numbers over ties: what is read in parts equals the whole."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import html_extract, toxicity
from quayside.llm._shared import numbered


def plain_score(model, text):
    """The score by its definition, word by word over the whole text."""
    means = []
    for word in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        buckets, _, n = toxicity.subwords(word)
        assert n == 1
        means.append(float(np.mean(model.values[buckets])))
    total = model.bias + sum(means) / (len(means) + toxicity.PRIOR_WORDS)
    return 1 / (1 + np.exp(-total))


def trained():
    rng = random.Random(5)
    plain, rude = ["lorem", "dolor", "amet", "sit", "elit"], ["vileword", "nastyone"]
    texts = [" ".join(rng.choices(plain, k=20)) for _ in range(60)] + [" ".join(rng.choices(plain + rude * 2, k=20)) for _ in range(60)]
    return toxicity.train(texts, [0] * 60 + [1] * 60)


@pytest.mark.parametrize("part_chars", [1, 7, 50, 1_000_000])
def test_toxicity_of_parts_is_that_of_the_whole(monkeypatch, part_chars):
    """Wherever a text is cut, its words count once each; a text without white space is one part."""
    model = trained()
    monkeypatch.setattr(toxicity, "PART_CHARS", part_chars)
    rng = random.Random(part_chars)
    marks = [" ", "\n", "\t ", ", ", " -- ", "　"]
    for n in (0, 1, 2, 300):
        text = "".join(rng.choice(["lorem", "vileword", "x", "nastyonee", "42"]) + rng.choice(marks) for _ in range(n))
        assert "".join(toxicity._parts(text)) == text
        assert model.score(text) == pytest.approx(plain_score(model, text), abs=1e-6)
    assert list(toxicity._parts("a" * 500)) == ["a" * 500]


def test_toxicity_of_a_very_long_text():
    """Millions of characters are read to the end: the same mix of words has the same score as a shorter text of it."""
    model = trained()
    clean, toxic = "lorem dolor amet sit elit " * 400, "vileword nastyone lorem " * 400
    assert model.score(clean) < 0.1 and model.score(toxic) > 0.9
    assert model.score(clean * 250) < 0.1
    assert model.score(clean * 250 + toxic * 500) > 0.5 > model.score(clean * 500 + toxic)


def test_html_of_a_very_long_page():
    """All paragraphs of a page of millions of characters are there, in order and without the menu between; time grows with the page."""
    rng = random.Random(3)
    words = ["the", "of", "and", "to", "in", "harbour", "vessel", "quay", "morning", "that", "is", "was", "lantern", "stone"]
    paragraphs = [f"{' '.join(rng.choices(words, k=60))} {k}." for k in range(8000)]
    menu = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'

    def page(n):
        return f"<html><body>{menu}<article>{''.join(f'<p>{p}</p>' for p in paragraphs[:n])}</article><footer>Imprint</footer></body></html>"

    seconds = []
    for n in (2000, 8000):
        start = time.monotonic()
        text = html_extract.main_text(page(n))
        seconds.append(time.monotonic() - start)
        assert text == "\n".join(paragraphs[:n])
    assert seconds[1] < 10 * seconds[0] + 1


def test_html_of_one_very_long_block():
    """A single block of a million words, with references and inner tags, is one line."""
    text = html_extract.main_text("<article><p>" + "the ship &amp; <b>the</b>\n quay of old " * 150_000 + "</p></article>")
    assert text == ("the ship & the quay of old " * 150_000).strip()


@pytest.mark.parametrize("partitions", [1, 5])
def test_numbers_are_gapless_and_in_order(spark, partitions):
    """One key on most rows, ties, repeated rows and nulls; an empty table has no numbers."""
    rows = [(None if k % 9 == 0 else 7 if k % 3 else k, k % 50) for k in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(partitions)
    out = numbered(df, ["a", "b"], "seat", "numbers").orderBy("seat").collect()
    assert [r["seat"] for r in out] == list(range(2000))
    assert [(r["a"], r["b"]) for r in out] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert numbered(df.where(F.lit(False)), ["a"], "seat", "numbers").count() == 0
