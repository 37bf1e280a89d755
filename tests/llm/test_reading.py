import random

import numpy as np
import pytest

from stemma.llm import reading as R

EASY = ["The dog ran to the red hill.", "A boy saw the sun.", "We sat by the old tree and ate.", "She had a cup."]
HARD = ["Notwithstanding its preliminary character, the jurisdiction consolidates interpretation.", "Hermeneutic presuppositions problematize the communal administration.", "Such etiology, inasmuch as it subordinates deliberation, undermines legitimacy."]


def text(rng, level):
    return " ".join(rng.choice(HARD if rng.random() < (level - 1) / 4 else EASY) for _ in range(rng.randint(6, 14)))


def corpus(n, seed):
    rng = random.Random(seed)
    levels = [rng.choice([1, 2, 3, 4, 5]) for _ in range(n)]
    return [text(rng, x) for x in levels], [float(x) for x in levels]


def test_held_out_accuracy():
    model = R.fit(*corpus(300, 1), rounds=40)
    texts, levels = corpus(150, 2)
    got = np.array([model.level(model.measure(t)) for t in texts])
    assert np.corrcoef(got, levels)[0, 1] > 0.85
    assert np.mean((got >= R.HARD) == (np.array(levels) >= 4)) > 0.85


def test_sentences():
    assert [(ws, m) for ws, m, _ in R.sentences("One, two. Three?!\n\n Four's x-y; ... 12")] == [(["One", "two"], 1), (["Three"], 0), (["Four's", "x-y"], 1)]
    assert R.sentences("") == R.sentences("12 ... \n") == []


def test_words_kept_are_bounded(monkeypatch):
    model = R.fit(*corpus(60, 3), rounds=5)
    monkeypatch.setattr(R, "_KEPT", 50)
    many = " ".join(f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs")
    before = model.measure(many)
    for _ in range(5):
        model.measure(many + " and more words here to know about")
    assert np.allclose(before, model.measure(many))


def test_documents(spark):
    texts, levels = corpus(200, 5)
    docs = [(i, t) for i, t in enumerate(texts)]
    rng = random.Random(9)
    hard, easy = text(rng, 5) + " " + text(rng, 5), text(rng, 1) + " " + text(rng, 1)
    docs += [(1_000, hard), (1_001, easy), (1_002, None), (1_003, ""), (1_004, "12 34 " * 40), (1_005, "der hund und die katze gehen heute sehr gerne " * 8), (1_006, " ".join(hard.split()[:20])), (1_007, hard), (1_007, hard), (None, hard)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "r", int(x), None) for i, x in enumerate(levels)] + [(1_007, "r", None, None), (None, "r", 3, None), (3, "s", 99, None)], "doc_id long, rater string, level int, text string")
    found = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in R.hard_documents(d, labels.drop("text")).collect())
    assert found == [-1, 1_000]
    model = R.train(d, labels.drop("text"))
    rows = R.score(d, model, "doc_id", "text").collect()
    assert len(rows) == len(docs)
    assert all(r["score"] is None for r in rows if r["doc_id"] in (1_002, 1_003, 1_004))
    assert R.hard_documents(d, labels.drop("text").filter("false")).count() == 0
    assert R.hard_documents(d.filter("false"), labels.drop("text")).count() == 0


@pytest.mark.parametrize("level", [1, 5])
def test_level_is_within_bounds(level):
    model = R.fit(*corpus(80, 4), rounds=5)
    assert 1 <= model.level(model.measure(text(random.Random(0), level))) <= 5
