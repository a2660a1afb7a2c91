"""Ranked search against scores of all documents for all items."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import lexical
from tests.llm.conftest import words
from tests.llm.test_operators import rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def slow(docs, items, count=10):
    """(item, rank, doc, score) by definition; docs and items are (id, text)."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in own)
    total = sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for doc, c in own:
            m = 25 + (75 * c.total() * n) // total if total else 0
            worth = lambda t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))  # noqa: B023, E731
            score = sum(worth(t) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out.update((item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(scored, key=lambda r: r[:3])[:count]))
    return out


def check(docs, items, **more):
    found = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows(lexical.search(docs, items, **more)))
    assert found == slow([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], more.get("count", 10))
    return found


def test_given_tables_and_edges(spark, documents, edge, empty, small):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    assert check(documents, items)
    own = [(i, t) for i, (_, t, *_) in enumerate(__import__("tests.llm.conftest", fromlist=["edge_rows"]).edge_rows())]
    odd = spark.createDataFrame([*((i, " ".join((t or "").split()[:40])) for i, t in own), (None, None), (None, "X x é"), (3, "漢字 漢字"), (3, "漢字 漢字")], "item_id long, text string")
    assert check(edge, odd)
    assert not check(edge, items.limit(0)) and rows(lexical.search(empty, odd)) == []


def test_small_segments_blocks_and_groups(spark, documents, small, monkeypatch):
    """Many blocks and groups of items give the same rows; the copies' ties go by id."""
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    monkeypatch.setattr(lexical, "TERMS", 400)
    for name, value in (("SEGMENT", 64), ("SINGLE", 2), ("BLOCK", 2), ("BLOCKS", 50)):
        monkeypatch.setattr(lexical, name, value)
    check(documents, items, count=3)


def test_blocks_are_skipped_only_below_the_bound():
    r = random.Random(1)
    vocabulary = words(9, 60)
    docs = [Counter(r.choices(range(60), k=30) if i % 2 else r.choices(range(20), k=30)) for i in range(600)]
    starts = np.append(0, np.cumsum([len(c) for c in docs]))
    number = np.array([t for c in docs for t in sorted(c)])
    values = np.array([lexical.saturation(np.array([c[t]]), np.array([30]), 600, 18000)[0] for c in docs for t in sorted(c)])
    import pyarrow as pa

    batch = lexical.segment(pa.array(range(600)), starts, number, values, len(vocabulary))
    own = lexical.Segment({k: np.frombuffer(batch.column(1 + j)[0].as_buffer(), dtype=lexical.stored(k, len(vocabulary))) for j, k in enumerate(lexical.FIELDS)}, len(vocabulary))
    seen = 0
    scored = own.scores
    heaviest = np.array(sorted((r.randint(0, 9000) for _ in range(60)), reverse=True))
    for _ in range(200):
        chosen = np.array(sorted(r.sample(range(60), r.randint(1, 8))))
        weight = heaviest[chosen] * np.array([r.choice([1, 1, 2]) for _ in chosen])
        power = np.zeros(60, dtype=np.int64)
        power[chosen] = weight
        exact = np.array([sum(int(power[t]) * int(v) for t, v in zip(number[a:b], values[a:b], strict=True)) for a, b in zip(starts, starts[1:], strict=False)])
        looked = []
        own.scores = lambda docs, power: (looked.append(len(docs)), scored(docs, power))[1]  # noqa: B023
        docs_found, scores = own.best(chosen, weight, power, 0, 10)
        best = dict(zip(docs_found.tolist(), scores.tolist(), strict=True))
        tenth = max(1, int(np.sort(exact)[-10]))
        assert best == {i: int(s) for i, s in enumerate(exact) if s >= tenth}
        seen += sum(looked)
    assert seen < 0.9 * 200 * 600


@pytest.mark.parametrize("tf", [1, 2, 1000])
def test_values_fit_a_byte(tf):
    value = lexical.saturation(np.array([tf]), np.array([1]), 10, 1000)
    assert 0 < value[0] < 10**6 and (int(value[0]) + (1 << lexical.SHIFT) - 1) >> lexical.SHIFT < 256
