"""Language-model scores by Brown classes.

Words of the training documents that occur LEAST times or more are clustered by the exchange algorithm: each moves to the class in which the
class bigrams' likelihood rises most. A token's probability is that of its class after the class before, times that of
the word in its class, mixed with the smoothed unigram model. Rarer words form one open class, in
which unseen words have a share too; the end of a text is a class of its own.

All counts are over all training documents. Word counts and the clustered words' bigrams are gathered by shuffles; an
exchange round is one pass over bigram blocks in which each task holds the words of one block. The driver and
all tasks hold the clustered words (a hash and a class each; their number grows with the vocabulary) and counts of the
`known` most frequent words; counts of other words are joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import _text
from inkwell.llm._tables import partitions, stash

#: CLUSTERED None: all words with LEAST occurrences, however many there are.
CLASSES, CLUSTERED, KNOWN, ROUNDS = 48, None, 1 << 20, 8
#: Words with fewer occurrences aren't clustered: they tell little of their neighbours, and how often the open class is
#: met among them tells how often unseen words are.
LEAST = 3
#: Weight of the class model in the mixture, and of the class frequencies in the smoothed transitions.
SHARE, SMOOTH = 0.95, 5.0
#: Entries that a task gathers before it sums them up.
HELD = 1 << 21
#: Words whose classes are chosen at once.
STEP = 512


def unique_sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    ranked = keys[order]
    head = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, np.int64)
    return ranked[head], np.add.reduceat(n[order], head) if len(keys) else n


def gathered(parts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with their numbers, summed up before too many are held."""
    keys, n, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) > HELD:
            own = np.concatenate(held)
            keys, n = unique_sums(np.concatenate([keys, own]), np.concatenate([n, np.ones(len(own), np.int64)]))
            held = []
            if len(keys) > HELD:
                yield keys, n
                keys, n = keys[:0], n[:0]
    own = np.concatenate([np.zeros(0, np.int64), *held])
    yield unique_sums(np.concatenate([keys, own]), np.concatenate([n, np.ones(len(own), np.int64)]))


def word_counts(texts: DataFrame) -> DataFrame:
    """word (a 64-bit hash), n of a table with one string column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[np.ndarray]:
            for batch in batches:
                data, offsets = _text.buffers(batch.column(0))
                for a, b in _text.steps(offsets):
                    yield _text.words(data, offsets[a : b + 1])[0].view(np.int64)

        for keys, n in gathered(parts()):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["word", "n"])

    return texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def least_count(words: DataFrame, most: int) -> int:
    """The least count such that at most `most` words have it or a greater one, by counts' magnitudes in eighths."""
    rows = words.groupBy(F.floor(F.log2("n") * 8).alias("k")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).collect()
    least, total = 1 << 62, 0
    for _, n, low in sorted(((r["k"], r["words"], r["n"]) for r in rows), reverse=True):
        total += n
        if total > most:
            break
        least = low
    return least


def frequent(words: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in ascending order, and counts."""
    found = words.filter(F.col("n") >= least).toArrow()
    word, n = (found.column(c).to_numpy() for c in ("word", "n"))
    order = np.argsort(word)
    return word[order], n[order]


def places(sorted_words: np.ndarray, words: np.ndarray, missing: int) -> np.ndarray:
    if not len(sorted_words):
        return np.full(len(words), missing, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_words, words), len(sorted_words) - 1)
    return np.where(sorted_words[at] == words, at, missing)


def chain(word: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of rows with an end after each row, the tokens before them (an end before the first), and rows' starts."""
    token = np.insert(word, starts[1:], end)
    before = np.append(end, token[:-1])
    return token, before, starts + np.arange(len(starts))


def blocks(texts: DataFrame, head, count: int) -> DataFrame:
    """block, right, left: compressed triples (word, neighbour, n) of the clustered words of a block, n summed up.

    Words are numbers below size; size is the open class and size + 1 the end. Block -1 has pairs of these two."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = head.value
        size = len(own)

        def parts() -> Iterator[np.ndarray]:
            for batch in batches:
                data, offsets = _text.buffers(batch.column(0))
                for a, b in _text.steps(offsets):
                    words, starts = _text.words(data, offsets[a : b + 1])
                    token, before, _ = chain(places(own, words.view(np.int64), size), starts, size + 1)
                    yield before * (size + 2) + token

        for keys, n in gathered(parts()):
            left, right = keys // (size + 2), keys % (size + 2)
            for side, word, other in (("right", left, right), ("left", right, left)):
                block = np.where(word < size, word % count, -1)
                some = (word < size) | (other >= size) & (side == "right")
                order = np.lexsort((other, word, block))
                order = order[some[order]]
                cuts = np.flatnonzero(np.append(True, np.diff(block[order]) != 0)) if len(order) else np.zeros(0, np.int64)
                for a, b in zip(cuts, np.append(cuts, len(order))[1:], strict=True):
                    at = order[a:b]
                    yield pa.RecordBatch.from_arrays([pa.array([block[at[0]]], pa.int32()), pa.array([side]), pa.array([crush(word[at], other[at], n[at])], pa.binary())], names=["block", "side", "data"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {"right": [], "left": []}
        for batch in batches:
            for side, data in zip(batch.column("side").to_pylist(), batch.column("data").to_pylist(), strict=True):
                sums[side].append(data)
        out = []
        for side in ("right", "left"):
            keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for a in range(0, len(sums[side]), 64):
                triples = [expand(x) for x in sums[side][a : a + 64]]
                keys, n = unique_sums(np.concatenate([keys, *(w.astype(np.int64) << 32 | o for w, o, _ in triples)]), np.concatenate([n, *(x[2].astype(np.int64) for x in triples)]))
            out.append(pa.array([crush(keys >> 32, keys & 0xFFFFFFFF, n)], pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), *out], names=["block", "right", "left"])

    found = texts.mapInArrow(pairs, "block int, side string, data binary")
    return stash(found.repartition(count, "block").groupBy("block").applyInArrow(merge, "block int, right binary, left binary"), "blocks")


def crush(word: np.ndarray, other: np.ndarray, n: np.ndarray) -> bytes:
    raw = np.concatenate([word.astype("<u4"), other.astype("<u4"), n.astype("<i8").view("<u4")]).tobytes()
    return len(word).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=16 * size, codec="zstd"), dtype="<u4")
    return raw[:size].astype(np.int64), raw[size : 2 * size].astype(np.int64), raw[2 * size :].view("<i8")


def class_bigrams(table: DataFrame, classes, total: int) -> np.ndarray:
    """Counts of class pairs (total classes): one row a pair reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = classes.value, np.zeros(total * total, dtype=np.int64)
        for batch in batches:
            for right, left in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                word, other, n = expand(right)
                np.add.at(sums, own[word] * total + own[other], n)
                word, other, n = expand(left)
                outer = other >= len(own) - 2  # other pairs were counted from the right
                np.add.at(sums, (own[other] * total + own[word])[outer], n[outer])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["pair", "n"])

    out = np.zeros(total * total, dtype=np.int64)
    for r in table.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out.reshape(total, total)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_class(m: np.ndarray, own: int, right: np.ndarray, left: np.ndarray, self_n: float, free: int) -> tuple[int, float]:
    """The class (below free) to which a word should move, and the rise of the log likelihood.

    m: counts of class pairs; right, left: the word's neighbours by class; self_n: how often it follows itself."""
    m = m.astype(float)
    a, b = right.sum(), left.sum()
    rows, columns = m.sum(axis=1), m.sum(axis=0)
    rows[own] -= a
    columns[own] -= b
    m[own] -= right
    m[:, own] -= left
    m[own, own] += self_n
    right, left = right.copy(), left.copy()
    right[own] -= self_n
    left[own] -= self_n
    out = xlogx(m[:free] + right) - xlogx(m[:free])
    into = (xlogx(m[:, :free] + left[:, None]) - xlogx(m[:, :free])).T
    k = np.arange(free)
    corner = m[k, k]
    gain = out.sum(axis=1) - out[k, k] + into.sum(axis=1) - into[k, k] + xlogx(corner + right[k] + left[k] + self_n) - xlogx(corner)
    gain -= xlogx(rows[:free] + a) - xlogx(rows[:free]) + xlogx(columns[:free] + b) - xlogx(columns[:free])
    best = int(np.argmax(gain))
    return best, float(gain[best] - gain[own])


def best_classes(m: np.ndarray, own: np.ndarray, right: np.ndarray, left: np.ndarray, loops: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """best_class of many words (rows of right and left), by the cells that each word has neighbours in."""
    m = m.astype(float)
    each, k = np.arange(len(own)), np.arange(free)
    gain = np.zeros((len(own), free))
    for near, far, cells_of in ((right, left, m), (left, right, m.T)):
        n = near.astype(float)
        n[each, own] -= loops
        i, d = np.nonzero(n)
        cells = cells_of[:free, d].T.copy()  # without the word itself
        cells[np.arange(len(i)), own[i]] -= near[i, d]
        inner = np.flatnonzero(d == own[i])
        cells[inner] -= far[i[inner], :free]
        cells[inner, d[inner]] += loops[i[inner]]
        rise = xlogx(cells + n[i, d][:, None]) - xlogx(cells)
        low = np.flatnonzero(d < free)
        rise[low, d[low]] = 0.0
        if len(i):
            head = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            gain[i[head]] += np.add.reduceat(rise, head)
        sums = np.tile(cells_of.sum(axis=1)[:free], (len(own), 1))
        a = near.sum(axis=1)
        sums[each, own] -= a
        gain -= xlogx(sums + a[:, None]) - xlogx(sums)
    corner = np.tile(m[k, k], (len(own), 1))
    corner[each, own] += loops - right[each, own] - left[each, own]
    more = (right + left)[:, :free].astype(float)
    more[each, own] -= 2 * loops
    gain += xlogx(corner + more + loops[:, None]) - xlogx(corner)
    best = gain.argmax(axis=1)
    return best, gain[each, best] - gain[each, own]


def moves(table: DataFrame, classes, matrix, free: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Words whose turn it is and that should change their class, and the classes: at most as many rows as words."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, m = classes.value, matrix.value
        total = len(m)
        for batch in batches:
            for block, *sides in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block < 0:
                    continue
                (rw, ro, rn), (lw, lo, ln) = map(expand, sides)
                words = np.unique(np.concatenate([rw, lw]))
                words = words[_text.mix(words.astype(np.uint64) + np.uint64(turn // 2 * 1_000_003)) % np.uint64(2) == turn % 2]
                for begin in range(0, len(words), STEP):
                    some = words[begin : begin + STEP]
                    counts, loops = [], np.zeros(len(some))
                    for w, o, n in ((rw, ro, rn), (lw, lo, ln)):  # in order of w
                        at = slice(*np.searchsorted(w, [some[0], some[-1] + 1]))
                        place = places(some, w[at], -1)
                        there = place >= 0
                        counts.append(np.bincount(place[there] * total + own[o[at][there]], weights=n[at][there], minlength=len(some) * total).reshape(-1, total))
                        same = there & (w[at] == o[at])
                        loops[place[same]] = n[at][same]
                    to, gain = best_classes(m, own[some], *counts, loops, free)
                    moved = (gain > 1e-6) & (to != own[some])
                    yield pa.RecordBatch.from_arrays([pa.array(some[moved], pa.int64()), pa.array(to[moved], pa.int64())], names=["word", "to"])

    found = table.mapInArrow(choose, "word long, to long").toArrow()
    return found.column("word").to_numpy(), found.column("to").to_numpy()


def cluster(table: DataFrame, counts: np.ndarray, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each clustered word (then the open class and the end), and the counts of class pairs.

    The most frequent words start in classes of their own in turn. In a round half of the words, in turn, see the same
    state and move. It ends when both halves of a division had no move, one after the other, or after `rounds`."""
    context, size = table.sparkSession.sparkContext, len(counts)
    own = np.append(np.zeros(size, dtype=np.int64), [classes, classes + 1])
    own[np.argsort(-counts, kind="stable")] = np.arange(size) % classes
    quiet = 0
    for turn in range(rounds):
        shared = context.broadcast(own)
        matrix = context.broadcast(class_bigrams(table, shared, classes + 2))
        word, to = moves(table, shared, matrix, classes, turn)
        own = own.copy()
        own[word] = to
        shared.unpersist()
        matrix.unpersist()
        quiet = 0 if len(word) else quiet + 1
        if quiet > 1 and turn % 2:  # turns 2k and 2k + 1 are the halves of one division
            break
    return own, class_bigrams(table, context.broadcast(own), classes + 2)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, clustered: int | None = CLUSTERED, known: int = KNOWN, rounds: int = ROUNDS) -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), class_tokens.

    Documents whose crc32(id as text) leaves 1 modulo 5 are held out of training; a null id counts as the empty text,
    a null text as empty: it has one token, its end. Words are lower-cased in A-Z. class_tokens counts tokens of
    clustered words. Rows of one id are scored each; extra columns don't matter; an empty table gives no rows."""
    spark = docs.sparkSession
    context = spark.sparkContext
    remainder = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    train = docs.filter(remainder != 1)
    texts = train.select(text.alias("text"))
    words = stash(word_counts(texts), "words")
    total = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    ends = train.count()
    n_all, types = (total[0] or 0) + ends, total[1] + (ends > 0)
    least = least_count(words, known)
    if clustered is None:
        least = min(least, LEAST)  # known are all that are clustered
    word, count = frequent(words, least)
    enough = count >= (LEAST if clustered is None else max(LEAST, least_count(words, clustered)))
    head, head_n = word[enough], count[enough]
    table = blocks(texts, context.broadcast(head), partitions(spark))
    own, pairs = cluster(table, head_n, classes, rounds)
    # Transitions, smoothed with the classes' frequencies; the open class's words, one unseen among them, by counts.
    seen = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * (classes + 2))
    step = (pairs + SMOOTH * seen) / (pairs.sum(axis=1, keepdims=True) + SMOOTH)
    mass = np.bincount(own[: len(head)], weights=head_n, minlength=classes + 2)
    free = (total[0] or 0) - head_n.sum() + 0.5 * (total[1] - len(head) + 1)
    base = n_all + 0.5 * (types + 1)
    kind = np.where(enough, 0, classes)
    kind[enough] = own[: len(head)]
    model = context.broadcast((word, count, kind, step, mass))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, count, kind, step, mass = model.value
        for batch in batches:
            data, offsets = _text.buffers(batch.column(0))
            for a, b in _text.steps(offsets):
                own, starts = _text.words(data, offsets[a : b + 1])
                own = own.view(np.int64)
                token, before, begin = chain(places(word, own, len(word)), starts, len(word) + 1)
                classes_of = np.append(kind, [classes, classes + 1])
                n = np.append(count, [0, ends])
                c, was, k = classes_of[token], classes_of[before], n[token]
                there = token != len(word)
                plain = np.log10((k + 0.5) / base)
                moved = step[was, c]
                in_class = np.where(c == classes, (k + 0.5) / free, np.where(c > classes, 1.0, k / np.maximum(mass[c], 1)))
                mixed = np.log10(SHARE * moved * in_class + (1 - SHARE) * (k + 0.5) / base)
                # Of words that are joined later, what doesn't depend on their counts.
                plain = np.where(there, plain, -np.log10(base))
                mixed = np.where(there, mixed, np.log10(SHARE * moved / free + (1 - SHARE) / base))
                sums = lambda x: np.add.reduceat(x, begin[:-1])  # noqa: E731, B023
                away = np.flatnonzero(~there)
                row = np.searchsorted(begin, away, side="right") - 1
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32()), pa.array(own[away - row]))
                yield pa.RecordBatch.from_arrays(
                    [*(col.slice(a, b - a) for col in batch.columns[1:]), pa.array(np.diff(begin)), pa.array(sums((there & (k > 0)).astype(np.int64))), pa.array(sums((c < classes).astype(np.int64))), pa.array(sums(plain)), pa.array(sums(mixed)), lists],
                    names=["row", "id", "held_out", "n_tokens", "n_known", "class_tokens", "base_score", "score", "rest"],
                )

    id_kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(text.alias("text"), F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (remainder == 1).alias("held_out"))
    scored = stash(rows.mapInArrow(score, f"row long, id {id_kind}, held_out boolean, n_tokens long, n_known long, class_tokens long, base_score double, score double, rest array<long>"), "scored")
    rest = scored.filter(F.size("rest") > 0).select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    rare = words.filter(F.col("n") < least)
    rest = rest.join(rare, "word", "left").select("row", (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("seen"))
    rest = rest.groupBy("row").agg(F.sum("more").alias("more"), F.sum("seen").alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"), "class_tokens",
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of training and held-out documents, by the class model and the unigram model."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


__all__ = ["perplexity", "score_documents"]
