import random

import numpy as np

from inkwell.llm import brown
from tests.llm.test_operators import rows


def test_every_word_of_enough_occurrences_has_a_class(spark):
    vocabulary = [f"w{k}" for k in range(40_000)]
    docs = []
    for i in range(8):
        random.Random(i).shuffle(vocabulary)
        docs.append((i, " ".join(vocabulary)))
    found = rows(brown.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), classes=4, rounds=1))
    assert len(found) == 8 and all(r["class_tokens"] == 40_000 for r in found)


def test_many_best_classes_are_the_single_ones():
    r = np.random.default_rng(7)
    own = np.append(r.integers(0, 4, 30), [4, 5])
    n = r.integers(0, 9, (32, 32)) * (r.random((32, 32)) < 0.3)
    one = np.eye(6, dtype=int)[own]
    m, right, left, loops = one.T @ n @ one, (n @ one).astype(float)[:30], (n.T @ one).astype(float)[:30], np.diag(n).astype(float)[:30]
    best, gain = brown.best_classes(m, own[:30], right, left, loops, 4)
    for w in range(30):
        to, rise = brown.best_class(m, own[w], right[w], left[w], loops[w], 4)
        assert abs(rise - gain[w]) < 1e-6 and (best[w] == to or abs(rise) < 1e-6)


def test_one_half_without_a_move_ends_nothing(spark, monkeypatch):
    turns = []

    def moves(table, classes, matrix, free, turn):
        turns.append(turn)
        some = [0] if turn in (0, 2) else []
        return np.array(some, dtype=np.int64), np.array(some, dtype=np.int64)

    monkeypatch.setattr(brown, "moves", moves)
    monkeypatch.setattr(brown, "class_bigrams", lambda table, classes, total: np.zeros((total, total), dtype=np.int64))
    brown.cluster(spark.range(1), np.array([3, 2]), 2, 20)
    assert turns == [0, 1, 2, 3, 4, 5]
