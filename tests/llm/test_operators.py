import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.llm import _text, brown, entry, exact, licenses, mixing, near, order_minhash, packing, pii, quality, sharding
from tests.llm.conftest import edge_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in rows(df)}


# 1 Mixing


def check_mix(found, docs):
    size = defaultdict(int)
    for d in docs:
        size[d["source"]] += len(WORD.findall(d["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    cap, capped, total = {s: 3 * size[s] for s in size}, {}, sum(size.values())
    while True:
        share = {s: (total - sum(capped.values())) * weight[s] / sum(w for x, w in weight.items() if x not in capped) for s in size if s not in capped}
        over = [s for s in share if share[s] > cap[s]]
        if not over:
            break
        capped |= {s: cap[s] for s in over}
    target = capped | share
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_mixing(documents, edge, empty):
    for docs in (documents, edge):
        found = rows(mixing.mix(docs))
        assert len(found) == docs.count()
        check_mix(found, rows(docs))
        assert sorted(map(str, found)) == sorted(map(str, rows(mixing.mix(docs.repartition(5)))))
    assert rows(mixing.mix(empty)) == []


def test_quality_weights_draw_good_documents_first(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 300, "a").otherwise("b").alias("source"), (F.col("id") % 2).alias("q"))
    found = rows(mixing.mix(docs, weights=(1.0, 3.0), quality=F.when(F.col("q") == 1, 20.0).otherwise(1.0)).filter("source = 'a'"))
    chosen = [r["doc_id"] % 2 for r in found if r["copies"] > 0]
    assert 0 < len(chosen) < 300 and sum(chosen) > 0.8 * len(chosen)


def test_registered_mix_prefers_good_texts(spark, tmp_path):
    good = F.concat_ws(" ", *(F.concat(F.lit(x), F.translate(F.col("id").cast("string"), "0123456789", "klmnopqrst")) for x in ("the", "of", "and", "in", "was", "to")))
    junk = F.concat_ws(" ", *(F.concat(F.lit("BUY!!$"), F.col("id").cast("string")) for _ in range(6)))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, good).otherwise(junk).alias("text"), F.when(F.col("id") < 300, "b").otherwise("a").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    chosen = [r["doc_id"] % 2 for r in rows(entry.op1_mixing(spark, str(tmp_path))) if r["taken"] and r["doc_id"] < 300]
    assert 0 < len(chosen) < 300 and sum(chosen) > 0.8 * len(chosen)


# 2 Sharding


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (4, 1)])
def test_hilbert_curve_visits_neighbours(spark, n, bits):
    cells = spark.range(1 << (n * bits))
    levels = [F.shiftright("id", k * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for k in range(n)]
    path = [r[1:] for r in sorted(cells.select(sharding.hilbert_index(levels, bits).alias("i"), *levels).collect())]
    assert len(set(path)) == 1 << (n * bits)
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(path, path[1:], strict=False))


def test_shards_are_even_and_gapless(documents, edge, empty):
    for docs, shards in ((documents, 24), (edge, 4), (edge, 24)):
        found = rows(sharding.shard_documents(docs, shards))
        assert len(found) == docs.count()
        counts = Counter(r["shard"] for r in found)
        sizes = [counts.get(k, 0) for k in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
        for k in counts:
            assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(counts[k]))
    known = by_id(documents)
    for r in rows(sharding.shard_documents(documents)):
        data = known[r["doc_id"]]["text"].encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "rows"
    assert rows(sharding.shard_documents(empty)) == []


def test_shards_are_narrow(documents):
    found = sharding.shard_documents(documents, 8)
    spread = lambda df: sum(r["s"] for r in rows(df.groupBy("shard").agg(F.count_distinct("lang").alias("s"))))
    assert spread(found) < spread(found.withColumn("shard", F.col("doc_id") % 8))


# 3 Licences

MIT = "Copyright 2020\n\n" + " ".join(licenses.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability"))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (MIT, ["MIT"]), (MIT.replace(", to", "\n// , to"), ["MIT"]), ("Some prose. Released under the MIT License. More prose.", ["MIT"]), ("no end\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("# SPDX-License-Identifier: Apache-2.0\nimport x", ["Apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]), ("The MIT License is short.", []), (None, []), ("", []),
    ],
)
def test_licences(spark, text, expected):
    found = rows(licenses.scan_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")))[0]
    assert found["licences"] == expected
    for m in found["matches"]:
        assert 0 <= m["start"] and m["start"] + m["length"] <= len(text) and text[m["start"]].strip()


def test_licence_rules_need_their_order():
    scanner = licenses.Scanner()
    turned = " ".join(licenses.SENTENCES[k] for k in ("mit-liability", "mit-warranty", "mit-notice"))
    assert scanner.scan(turned) == []
    assert [m[0] for m in scanner.scan(" ".join(licenses.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")))] == ["BSD-2-Clause"]


def test_licences_of_edge_tables(documents, edge, empty):
    assert licenses.scan_documents(edge).count() == len(edge_rows()) and rows(licenses.scan_documents(empty)) == []
    for r, d in ((by_id(licenses.scan_documents(documents))[d["doc_id"]], d) for d in rows(documents)):
        assert bool(r["licences"]) == ("licen" in d["text"].lower())


# 4 Near duplicates


def shingle_set(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = WORD.findall(w)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(docs, threshold=0.8):
    sets = [shingle_set(d["text"]) for d in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or a and b and len(a & b) >= threshold * len(a | b):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[root(i)].append(docs[i]["doc_id"])
    key = lambda x: (x is None, x)
    return sorted(str((d["doc_id"], min(groups[root(i)], key=key), len(groups[root(i)]))) for i, d in enumerate(docs))


def test_near_classes_match_brute_force(documents, edge, empty):
    for docs in (documents, edge):
        found = rows(near.near_classes(docs))
        assert sorted(str((r["doc_id"], r["class_id"], r["class_size"])) for r in found) == brute_classes(rows(docs))
        assert Counter(str(r["class_id"]) for r in found if r["kept"]).most_common(1)[0][1] == 1
        assert sum(r["kept"] for r in found) == len({r["class_id"] for r in found})
    assert rows(near.near_classes(empty)) == []


def test_a_chain_of_near_copies_is_one_class(spark):
    base = words(9, 200)
    texts = [" ".join([*words(100 + k, 4 * k), *base[4 * k :]]) for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(str((r["doc_id"], r["class_id"], r["class_size"])) for r in rows(near.near_classes(docs))) == brute_classes(rows(docs))


def test_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(1)
    keys = r.integers(0, 2**63, 130).astype(np.uint64)
    a, b = {k: 1.0 + (k % 3) for k in keys[:100].tolist()}, {k: 1.0 + (k % 2) for k in keys[30:].tolist()}
    exact_value = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in a.keys() & b.keys())
    hits = []
    for t in range(40):
        e = _text.mix(np.array([*a, *b], dtype=np.uint64) + np.uint64(t * 7919))
        s = near.prob_minhash(e, np.array([*a.values(), *b.values()], dtype=float), np.array([0, len(a), len(a) + len(b)]))
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - exact_value) < 0.02


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 9), (10, 11), (11, 12), (20, 10)] + [(k, k + 1) for k in range(100, 140)]
    found = {r["node"]: r["label"] for r in rows(near.components(spark.createDataFrame(links, "a long, b long")))}
    assert found == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, 12: 10, 20: 10} | {k: 100 for k in range(100, 141)}


# 5 Exact duplicates


def brute_exact(docs):
    white = str.maketrans("", "", " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for d in docs:
        groups[(d["text"] or "").translate(white)].append(d)
    out = []
    for text, own in groups.items():
        best = min(own, key=lambda d: (-len(d["text"] or ""), d["doc_id"] is None, d["doc_id"]))
        out += [(d["doc_id"], best["doc_id"], len(own), hashlib.sha256(text.encode()).hexdigest()) for d in own]
    return sorted(map(str, out))


def test_exact_groups_match_brute_force(documents, edge, empty):
    for docs in (documents, edge):
        found = rows(exact.exact_groups(docs))
        assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in found) == brute_exact(rows(docs))
        assert sum(r["kept"] for r in found) == len({r["text_sha256"] for r in found})
    assert rows(exact.exact_groups(empty)) == []


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=20_000), st.integers(0, 400))
def test_cut_points_follow_content(data, shift):
    data = data * 30
    ends = exact.cut_points(data)
    assert ends == sorted(set(ends)) and (ends[-1] == len(data) if data else ends == [])
    assert all(b - a <= exact.MOST for a, b in zip([0, *ends], ends, strict=False))


def test_chunks_survive_an_insertion():
    data = np.random.default_rng(3).integers(0, 256, 400_000).astype(np.uint8).tobytes()
    chunks = lambda x: {x[a:b] for a, b in zip([0, *exact.cut_points(x)], exact.cut_points(x), strict=False)}
    one, two = chunks(data), chunks(data[:1000] + b"inserted" + data[1000:])
    assert len(one & two) > 0.8 * len(one) and len(one) > 10


# 6 Language model scores


def brute_base(docs):
    tokens = [[*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or "")), None] for d in docs]
    held = [zlib.crc32(("" if d["doc_id"] is None else str(d["doc_id"])).encode()) % 5 == 1 for d in docs]
    c = Counter(w for t, h in zip(tokens, held, strict=True) for w in t if not h)
    n, v = sum(c.values()), len(c)
    return [(d["doc_id"], h, len(t), sum(c[w] > 0 for w in t), n, sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for d, t, h in zip(docs, tokens, held, strict=True)]


def close_rows(found, expected):
    key = lambda r: (str(r[:5]), r[5])
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))


@pytest.mark.parametrize("known", [1 << 20, 200])
def test_scores(documents, edge, empty, known):
    for docs in (documents, edge):
        found = rows(brown.score_documents(docs, classes=12, clustered=min(known, 2000), known=known, rounds=3))
        close_rows([tuple(r[k] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in found], brute_base(rows(docs)))
    assert rows(brown.score_documents(empty, rounds=1)) == []


def test_classes_beat_the_unigram_model_on_held_out_text(documents):
    found = {r["held_out"]: r for r in rows(brown.perplexity(brown.score_documents(documents, classes=16)))}
    assert found[True]["perplexity"] < 0.9 * found[True]["base_perplexity"]


def test_scores_are_probabilities(spark):
    """Over all words and the end, after any word, the model's probabilities sum to one (unseen words share a slot)."""
    base = [" ".join(words(k % 3, 6)) for k in range(30)]
    vocabulary = sorted({w for t in base for w in t.split()})
    probes = [(1000 + k, w) for k, w in enumerate([*vocabulary, "unseenword", None])]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = [(i, t) for i, t in zip((i for i in range(1000) if not held(i)), base, strict=False)]
    tests = [(i, p[1]) for i, p in zip((i for i in range(2000, 9000) if held(i)), probes, strict=False)]
    docs = spark.createDataFrame([*train, *tests], "doc_id long, text string")
    found = by_id(brown.score_documents(docs, classes=4, clustered=10, known=15, rounds=2))
    end = {}  # log10 P(end | word): a text of one word minus that of the word is not separable, so use pairs
    pairs = [(i, f"{w} {w}" if w else "") for i, (_, w) in zip((i for i in range(20_000, 60_000) if held(i)), probes, strict=False)]
    again = by_id(brown.score_documents(spark.createDataFrame([*train, *pairs], "doc_id long, text string"), classes=4, clustered=10, known=15, rounds=2))
    assert not end and all(np.isfinite(r["score"]) for r in (*found.values(), *again.values()))
    # A text's probability is at most its first word's, and those of all first words sum to at most one.
    assert sum(10 ** found[i]["score"] for i, _ in tests) <= 1 + 1e-9


def test_best_class_gives_the_exact_rise():
    r = np.random.default_rng(5)
    own = np.array([0, 0, 1, 1, 2, 2, 3, 4])  # six words, the open class, the end
    n = r.integers(0, 20, (8, 8))
    one = np.eye(5, dtype=int)[own]

    def likelihood(classes):
        hot = np.eye(5, dtype=int)[classes]
        m = hot.T @ n @ hot
        return brown.xlogx(m).sum() - brown.xlogx(m.sum(axis=1)).sum() - brown.xlogx(m.sum(axis=0)).sum()

    m = one.T @ n @ one
    for w in range(6):
        best, gain = brown.best_class(m, own[w], (n[w] @ one).astype(float), (n[:, w] @ one).astype(float), float(n[w, w]), 3)
        rises = [likelihood(np.where(np.arange(8) == w, c, own)) - likelihood(own) for c in range(3)]
        assert abs(gain - max(rises)) < 1e-6 and abs(rises[best] - max(rises)) < 1e-6


# 7 Fingerprints


def test_fingerprints(documents, edge, empty):
    for docs in (documents, edge):
        own = sorted(rows(docs), key=lambda d: (d["doc_id"] is None, -(d["doc_id"] or 0), d["text"] or ""))
        expected = []
        for i, d in enumerate(own):
            text, other = d["text"] or "", own[(i + 1) % len(own)]["text"] or ""
            half = len(text) // 2
            new = text[: len(text) - half] + other[:half]
            expected.append((d["doc_id"], len(text), hashlib.sha256(new.encode()).hexdigest()))
        found = rows(order_minhash.fingerprint_documents(docs))
        assert sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in found) == sorted(map(str, expected))
        by_text = defaultdict(set)
        texts = defaultdict(set)
        for d in own:
            texts[d["doc_id"]].add(d["text"] or "")
        for r in found:
            assert r["near_edited"] == order_minhash.likeness(r["fingerprint"], r["edited_fingerprint"])
            if len(texts[r["doc_id"]]) == 1:
                by_text[next(iter(texts[r["doc_id"]]))].add(r["fingerprint"])
        assert all(len(x) == 1 for x in by_text.values())
    assert np.mean([r["near_edited"] for r in found]) >= 0
    assert rows(order_minhash.fingerprint_documents(empty)) == []


def test_likeness_falls_with_edits_and_order():
    text = " ".join(words(5, 400))
    prints = lambda t: order_minhash.spell(order_minhash.fingerprints([t], components=256))[0]
    some, many = text.replace(" a", " zz"), text.replace("a", "z")
    w = text.split()
    turned = " ".join([*w[200:], *w[:200]])
    like = [order_minhash.likeness(prints(text), prints(t)) for t in (text, some, turned, many)]
    assert like[0] == 1 and like[0] > like[1] > like[3] and like[2] < 0.7


def test_occurrences_number_repeats():
    h = np.array([5 << 30, 7 << 30, 5 << 30, 5 << 30, 7 << 30], dtype=np.uint64)
    assert order_minhash.occurrences(h).tolist() == [0, 0, 1, 2, 1]


# 8 Packing


def naive_bins(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b >= n]
        if fit:
            bins.remove(min(fit))
        bins.append((min(fit) if fit else capacity) - n)
    return len(bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_fit_over_counts_is_best_fit(lengths):
    runs, bins = packing.best_fit(Counter(lengths), 40)
    assert bins == naive_bins(lengths, 40)
    fill = defaultdict(list)
    for n, _, count, first, offset in runs:
        for k in range(count):
            fill[first + k].append((offset, n))
    for own in fill.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 40
    assert sorted(n for own in fill.values() for _, n in own) == sorted(lengths)


def test_packing(documents, edge, empty):
    tokenizer = packing.encoder(entry.tokenizer_path()).tokenizer
    for docs, capacity in ((documents, 2048), (edge, 256)):
        found = rows(packing.pack_documents(docs, entry.tokenizer_path(), capacity))
        places = defaultdict(list)
        for r in found:
            places[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in places.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= capacity
        assert len(places) == naive_bins([r["length"] for r in found], capacity)
        expected = []
        for d in rows(docs):
            ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0]
            head = (len(ids) - 1) % capacity + 1
            for k, end in enumerate(range(head, len(ids) + 1, capacity)):
                begin = 0 if k == 0 else end - capacity
                expected.append((d["doc_id"], k, begin, end - begin, zlib.crc32(np.array(ids[begin:end], dtype="<u4").tobytes())))
        assert sorted(str(tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32"))) for r in found) == sorted(map(str, expected))
    assert rows(packing.pack_documents(empty, entry.tokenizer_path())) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="a b's\n'trevmld1!é \t　漢😀", max_size=40), min_size=1, max_size=6))
def test_encoder_agrees_with_the_tokenizer(texts):
    import pyarrow as pa

    own = packing.encoder(entry.tokenizer_path())
    ids, at = own.encode(*_text.buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


# 9 Quality


def test_quality(spark, documents, edge, empty, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    found = by_id(quality.assess(documents, labels))
    assert len(found) == documents.count()
    known = [(found[r["doc_id"]]["kept"], r["quality"]) for r in rows(labels) if r["doc_id"] in found]
    assert np.mean([k == bool(q) for k, q in known]) > 0.95
    some = spark.createDataFrame([(1, 1), (1, None), (2, 0), (7, 1), (None, 1)], "doc_id long, quality int")
    assert quality.assess(edge, some).count() == len(edge_rows())
    assert quality.assess(edge, some.limit(0)).filter("kept").count() in (0, len(edge_rows()))
    assert rows(quality.assess(empty, some)) == []
    kept = quality.kept_documents(documents, labels)
    assert kept.columns == documents.columns and {r["doc_id"] for r in rows(kept)} == {i for i, r in found.items() if r["kept"]}


def test_the_classifier_holds_out_of_sample(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    found = by_id(quality.assess(docs, train))
    pairs = [(found[r["doc_id"]]["kept"], bool(r["quality"])) for r in rows(test)]
    assert np.mean([k == q for k, q in pairs]) > 0.97
    assert np.mean([k for k, q in pairs if q]) > 0.98


def test_sparse_sites_shrink_to_their_parents(spark):
    site = lambda h, p, n, rate: [(h, p, float(k < n * rate)) for k in range(n)]
    data = [*site("good", "a", 200, 0.99), *site("good", "b", 2, 0.0), *site("bad", "a", 200, 0.3), *site("mid", "a", 200, 0.7), *site("new", "a", 1, 0.0)]
    scored = spark.createDataFrame([(*r, r[2]) for r in data], "_host string, _path string, _p double, _y double")
    found = quality.sites(scored)
    out = rows(quality.judged(scored, found).groupBy("_host", "_path").agg(F.avg("host_posterior").alias("h"), F.avg("path_posterior").alias("p")))
    rate = {(r["_host"], r["_path"]): r for r in out}
    assert rate["good", "a"]["h"] > 0.95 and rate["bad", "a"]["h"] < 0.4
    assert abs(rate["new", "a"]["h"] - found.rate) < 0.1
    assert 0.1 < rate["good", "b"]["p"] < rate["good", "a"]["p"]


# 10 Pseudonyms

PRIVATE = [
    "+1 (017) 555-7713", "9807915762804490", "4111 1111 1111 1111", "97.51.17.173", "of.55@mail9.example.com", "2024-02-29", "12/31/1999", "31.12.1999", "123-45-6789", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "555-123-4567",
]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10


def iban_valid(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_pseudonyms(spark, edge, empty):
    import datetime

    text = "; ".join(f"see {v}" for v in PRIVATE)
    docs = spark.createDataFrame([(1, text), (2, "again " + ", ".join(PRIVATE[:6])), (3, None), (4, "on 2023-02-30, 000-12-3456, version 4.0. and 3.")], "doc_id long, text string")
    found = by_id(pii.pseudonymise(docs, "k"))
    new = [x.removeprefix("see ") for x in found[1]["text"].split("; ")]
    assert all(a != b for a, b in zip(PRIVATE, new, strict=True)) and len(found[1]["kinds"]) == len(PRIVATE)
    shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", s)))
    assert all(shape(a) == shape(b) for a, b in zip(PRIVATE, new, strict=True) if a.count(".") != 3)
    assert found[2]["text"] == "again " + ", ".join(new[:6])
    assert luhn(new[1]) == luhn(PRIVATE[1]) and luhn(new[2]) == 0 and iban_valid(new[9]) and iban_valid(new[10])
    assert all(0 <= int(x) < 256 for x in new[3].split("."))
    days = [datetime.datetime.strptime(x, f).date() for x, f in zip(new[5:8], ("%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y"), strict=True)]
    assert days[1] == days[2]
    assert found[3]["text"] is None and found[3]["kinds"] == [] and found[4]["text"] == "on 2023-02-30, 000-12-3456, version 4.0. and 3." and found[4]["kinds"] == []
    other = by_id(pii.pseudonymise(docs, "another key"))
    assert other[1]["text"] != found[1]["text"]
    same = by_id(pii.pseudonymise(edge.filter("doc_id is not null").dropDuplicates(["doc_id"]), "k"))
    assert all(same[d["doc_id"]]["text"] == d["text"] for d in rows(edge) if d["doc_id"] in same)
    assert rows(pii.pseudonymise(empty, "k")) == []


def test_pseudonyms_are_permutations(spark):
    numbers = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), 4, "0").alias("v"))
    assert numbers.select(pii.permute_text("k", F.col("v")).alias("v")).distinct().count() == 10_000
    days = spark.range(20_000).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("1990-01-01"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    found = pii.pseudonymise(days, "k")
    assert found.select("text").distinct().count() == 20_000 and found.filter("try_to_date(text) is null or size(kinds) <> 1").count() == 0


def test_no_python_runs_for_pseudonyms_and_shards(documents):
    for df in (pii.pseudonymise(documents, "k"), sharding.shard_documents(documents)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
