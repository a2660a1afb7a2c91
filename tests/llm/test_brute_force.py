"""Operators against slow versions written from their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import _registers, _text, brown, licenses, mixing, order_minhash, pii, quality
from tests.llm.conftest import words
from tests.llm.test_operators import luhn, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mixing_takes_the_least_keys(documents, edge):
    for docs in (documents, edge):
        groups = defaultdict(list)
        for r in rows(mixing.draws(docs)):
            groups[r["source"]].append(r)
        for own in groups.values():
            own.sort(key=lambda r: (r["key"], r["doc_id"] is None, r["doc_id"], r["text_hash"]))
            size = own[0]["source_size"]
            epochs = math.floor(own[0]["target"] / size) if size else 0
            rest, before, taken, wanted = own[0]["target"] - epochs * size, 0, Counter(), Counter()
            for r in own:
                assert r["epochs"] == epochs
                once = r["size"] > 0 and before + r["size"] / 2 <= rest
                before += r["size"]
                wanted[r["key"], r["doc_id"], r["text_hash"]] += once
                taken[r["key"], r["doc_id"], r["text_hash"]] += r["once"]
            assert taken == wanted


def test_keys_follow_weights(spark):
    docs = spark.createDataFrame([(k, "a b", w) for k in range(300) for w in (1.0, 4.0)], "doc_id long, text string, w double")
    found = {(r["doc_id"], r["w"]): r["k"] for r in rows(docs.select("doc_id", "w", mixing.draw_key("text", F.col("w"), 7).alias("k")))}
    assert all(abs(found[k, 1.0] - 4 * found[k, 4.0]) < 1e-9 for k in range(300))
    odd = spark.createDataFrame([(1, "a", x) for x in (None, float("nan"), 0.0, -1.0, 1e-9)], "doc_id long, text string, w double")
    assert len({r[0] for r in odd.select(mixing.draw_key("text", F.col("w"), 7)).collect()}) == 1


def test_mixed_documents_are_those_of_the_mix(documents, edge, empty, monkeypatch):
    for docs in (documents, edge, empty):
        wanted = Counter({(r["doc_id"], r["source"], r["text_hash"]): 0 for r in rows(mixing.mix(docs))})
        for r in rows(mixing.mix(docs)):
            wanted[r["doc_id"], r["source"], r["text_hash"]] += r["copies"]
        for most in (100_000, 0):
            monkeypatch.setattr(mixing, "SOURCES", most)
            found = mixing.mixed_documents(docs)
            assert found.columns == docs.columns
            assert Counter((r[0], r[1], r[2]) for r in found.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit("")))).collect()) == +wanted


def brute_licences(ids):
    """Rules in order over a document's sentences (None: unknown): with each, from each start, the next wanted one."""
    used, out = set(), []
    for licence, rule in licenses.tables()[1]:
        for start in range(len(ids)):
            taken = []
            for want in rule:
                first = taken[-1] + 1 if taken else start
                last = first + licenses.GAP if taken else start
                taken += next(([p] for p in range(first, min(last, len(ids) - 1) + 1) if ids[p] == want and p not in used), [])
                if not taken or ids[taken[-1]] != want:
                    break
            if [ids[p] for p in taken] == list(rule):
                used |= set(taken)
                out.append((taken[0], licence))
    return [licence for _, licence in sorted(out)]


def test_licences_match_brute_force():
    scanner, r = licenses.Scanner(), random.Random(4)
    known = licenses.tables()[0]
    names = [n for n, text in licenses.SENTENCES.items() if len(licenses.split(text)) == 1]
    for _ in range(200):
        picked = r.sample(names, r.randint(1, 8))
        if r.random() < 0.5:
            picked.sort(key=list(licenses.SENTENCES).index)
        parts = [licenses.SENTENCES[n] for n in picked]
        for _ in range(r.randint(0, 6)):
            parts.insert(r.randrange(len(parts) + 1), f"Filler {r.random()} is here.")
        ids = [known.get(licenses.normal(p)) for p in parts]
        assert [m[0] for m in scanner.scan("\n\n".join(parts))] == brute_licences(ids)


def test_a_sentence_is_known_however_it_is_wrapped():
    wide = ("\n" + " " * 400).join(licenses.SENTENCES["mit-grant"].split())
    assert [m[0] for m in licenses.Scanner().scan("Intro.\n\n" + wide + "\n\nrest")] == ["MIT"]


def test_class_scores_match_brute_force(spark):
    r = random.Random(3)
    vocabulary = words(1, 30)
    texts = [(i, " ".join(r.choices(vocabulary, weights=range(1, 31), k=r.randint(0, 30))) or None) for i in range(60)]
    texts += [(100 + i, " ".join(words(50 + i, 4))) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    tokens = {i: WORD.findall((t or "").lower()) for i, t in texts}
    train = {i: t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1}
    count = Counter(w for t in train.values() for w in t)
    head = {w for w, n in count.items() if n >= brown.LEAST}
    kind = lambda w: 2 if w is None else 0 if w in head else 1
    pairs = np.zeros((3, 3))
    for t in train.values():
        for a, b in zip([None, *t], [*t, None], strict=True):
            pairs[kind(a), kind(b)] += 1
    seen = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 1.5)
    step = (pairs + brown.SMOOTH * seen) / (pairs.sum(axis=1, keepdims=True) + brown.SMOOTH)
    mass, total = sum(count[w] for w in head), sum(count.values())
    free, base = total - mass + 0.5 * (len(count) - len(head) + 1), total + len(train) + 0.5 * (len(count) + 2)

    def score(t):
        out = 0.0
        for a, b in zip([None, *t], [*t, None], strict=True):
            n = len(train) if b is None else count[b]
            inner = 1.0 if b is None else n / mass if b in head else (n + 0.5) / free
            out += math.log10(brown.SHARE * step[kind(a), kind(b)] * inner + (1 - brown.SHARE) * (n + 0.5) / base)
        return out

    for known in (1 << 20, 5):
        for row in rows(brown.score_documents(docs, classes=1, known=known, rounds=2)):
            assert abs(row["score"] - score(tokens[row["doc_id"]])) < 1e-6


def slow_fingerprint(text):
    """Component by component: all arrivals of the numbered k-mers, the first two of them in the order of the text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    hashes, seen, elements = order_minhash.kmers(points), Counter(), []
    for h in hashes.tolist():
        elements.append(int(_text.mix(np.array([(h + seen[h] * int(order_minhash.FACTORS[40])) % (1 << 64)], dtype=np.uint64))[0]))
        seen[h] += 1
    arrivals = [[] for _ in range(order_minhash.COMPONENTS)]
    for place, e in enumerate(elements):
        state, now = e, 0.0
        while now < 60:
            state = (state + int(_registers.GOLDEN)) % (1 << 64)
            x = int(_text.mix(np.array([state], dtype=np.uint64))[0])
            now += -math.log((x >> 11) * 2.0**-53 + 2.0**-54)
            arrivals[x % order_minhash.COMPONENTS].append((now, place))
    out = []
    for own in arrivals:
        first = list(dict.fromkeys(p for _, p in sorted(own)))[: order_minhash.TAKE]
        total = sum(int(hashes[p]) * int(order_minhash.FACTORS[50 + j]) for j, p in enumerate(sorted(first)))
        out.append(int(_text.mix(np.array([total % (1 << 64)], dtype=np.uint64))[0]) >> 48)
    return out


@pytest.mark.parametrize("text", ["the cat sat on the mat and the cat sat on the mat again", "é漢字 \U0001f600 and more of such letters", "abababababababababab"])
def test_fingerprints_match_brute_force(text):
    assert order_minhash.fingerprints(["x", text, "another text of some length"])[1].tolist() == slow_fingerprint(text)


def test_posteriors_leave_a_document_out(spark):
    r = random.Random(2)
    data = [(r.choice(["a", "b", None]), r.choice(["x", "y", None]), r.random(), r.choice([0.0, 1.0, None])) for _ in range(150)]
    scored = spark.createDataFrame([(h, p, q, q if y is None else y) for h, p, q, y in data], "_host string, _path string, _p double, _y double")
    known = quality.sites(scored)
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for row in rows(quality.judged(scored, known)):
        others = [(h, p, q if y is None else y) for h, p, q, y in data]
        others.remove((row["_host"], row["_path"], row["_y"]))
        host = [y for h, _, y in others if h == row["_host"]]
        path = [y for h, p, y in others if (h, p) == (row["_host"], row["_path"])]
        of_host = (sum(host) + known.rate * known.hosts) / (len(host) + known.hosts)
        of_path = (sum(path) + of_host * known.paths) / (len(path) + known.paths)
        odds = logit(row["_p"]) + logit(of_path) - logit(known.rate)
        assert abs(row["host_posterior"] - of_host) < 1e-9 and abs(row["path_posterior"] - of_path) < 1e-9 and abs(row["posterior"] - 1 / (1 + math.exp(-odds))) < 1e-9


def test_sites_of_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    host, folder = quality.url_site(F.col("url"))
    for r in rows(pages.select("url", host.alias("host"), folder.alias("folder"))):
        parts = re.match(r"\w+://(?:www\.)?([^/:?#]+)[^/?#]*(/[^/?#]+)?(/)?", r["url"].lower() if r["url"] else "")
        assert r["host"] == (parts[1] if parts else None)
        assert r["folder"] is None or r["folder"].lower() == parts[2]


def slow_permutation(key, value):
    a, b = list(value[: len(value) // 2]), list(value[len(value) // 2 :])
    for i in range(pii.ROUNDS):
        moving, other = (a, "".join(b)) if i % 2 == 0 else (b, "".join(a))
        for j, c in enumerate(moving):
            n = int(hashlib.sha256(f"{key}:text:{i}:{j}:{other}".encode()).hexdigest()[:12], 16)
            for first, size in (("0", 10), ("a", 26), ("A", 26)):
                if ord(first) <= ord(c) < ord(first) + size:
                    moving[j] = chr(ord(first) + (ord(c) - ord(first) + n) % size)
    return "".join(a + b)


def test_pseudonyms_match_a_slow_feistel_network(spark):
    cards = ["4041894974608795", "4111 1111 1111 1111", "9807915762804490", "378282246310005"]
    docs = spark.createDataFrame([(k, f"card {c} and a.Name7@mail.example.org.") for k, c in enumerate(cards)], "doc_id long, text string")
    for r in rows(pii.pseudonymise(docs, "k")):
        card = cards[r["doc_id"]]
        plain = card.replace(" ", "")
        body = slow_permutation("k", plain[:-1])
        new = iter(body + next(d for d in "0123456789" if luhn(body + d) == luhn(card)))
        name = slow_permutation("k", "a.name7")
        assert r["text"] == f"card {''.join(' ' if c == ' ' else next(new) for c in card)} and {name[:2]}{name[2].upper()}{name[3:]}@mail.example.org." and r["kinds"] == ["number", "email"]


def test_spellings_of_a_value_are_linked(spark):
    groups = [["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"], ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"], ["bob.B@x.org", "Bob.b@x.org"], ["555-123-4567", "(555) 123-4567"], ["+44 20 7946 0958", "+44 20-7946-0958"]]
    values = [v for g in groups for v in g]
    found = {r["doc_id"]: r["text"] for r in rows(pii.pseudonymise(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string"), "k"))}
    new, at = [found[i] for i in range(len(values))], 0
    for g in groups:
        own, at = new[at : at + len(g)], at + len(g)
        assert len({re.sub("[^0-9a-z]", "", x.lower()) for x in own}) == 1 and not set(own) & set(g)
        for a, b in zip(g, own, strict=True):
            assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", a))) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", b)))


def test_what_is_not_valid_stays(spark):
    text = "token a035d50b74778df8409167469942b and 1234567890123 and +1 22 33"
    assert rows(pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k"))[0]["text"] == text
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([(1, "a")], "kinds long, text string"), "k")
