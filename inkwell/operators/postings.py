"""Text queries answered from an index's postings: the words of a query are looked up, texts aren't read.

A posting is one place of a word: term, source_path, ordinal, place, n_words. Files are sorted by term, so that a
condition on terms skips their other row groups and pages. A phrase is a join of its words' places, by grouping them under
the place where it would begin; a chunk's counts and places then decide whether an expression of textquery holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.search import bm25
from inkwell.operators.textquery import Expression, Phrase
from inkwell.sources.index import Statistics

CHUNK = ("source_path", "ordinal")


def wanted(phrases: list[Phrase]) -> Column:
    """Condition on a posting's term: equal to a word, or begins with an open one."""
    whole = sorted({w for p in phrases for w in p.words[: len(p.words) - p.open]})
    starts = sorted({p.words[-1] for p in phrases if p.open and p.words})
    tests = ([F.col("term").isin(whole)] if whole else []) + [F.startswith("term", F.lit(w)) for w in starts]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def occurrences(postings: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """source_path, ordinal, n_words, phrase (its number) and start, for each place where a phrase begins."""
    fits = []
    for i, p in enumerate(phrases):
        for k, word in enumerate(p.words):
            same = F.startswith("term", F.lit(word)) if p.open and k == len(p.words) - 1 else F.col("term") == word
            if p.first:
                same &= F.col("place") == k
            fits.append(F.when(same & (F.col("place") >= k), F.struct(F.lit(i).alias("phrase"), (F.col("place") - k).alias("start"))))
    fits = fits or [F.lit(None).cast("struct<phrase: int, start: int>")]
    rows = postings.filter(wanted(phrases)).select(*CHUNK, "n_words", F.explode(F.array_compact(F.array(*fits))).alias("fit")).select(*CHUNK, "n_words", "fit.*")
    if all(len(p.words) == 1 for p in phrases):
        return rows
    size = F.get(F.lit([len(p.words) for p in phrases]), F.col("phrase"))
    # Dealt out by chunk, which the grouping by chunk that follows needs too.
    whole = rows.repartition(*CHUNK).groupBy(*CHUNK, "n_words", "phrase", "start").agg(F.count(F.lit(1)).alias("words"))
    return whole.filter(F.col("words") == size).drop("words")


def counted(postings: DataFrame, phrases: list[Phrase], placed: list[Phrase] | None = None) -> DataFrame:
    """source_path, ordinal, n_words, a count _f0, _f1 .. for each phrase, and for those in placed the places _p0 .. too; for
    chunks that hold at least one."""
    counts = [F.count_if(F.col("phrase") == i).alias(f"_f{i}") for i in range(len(phrases))]
    places = [F.collect_list(F.when(F.col("phrase") == i, F.col("start"))).alias(f"_p{i}") for i, p in enumerate(phrases) if p in (placed or [])]
    return occurrences(postings, phrases).groupBy(*CHUNK, "n_words").agg(*counts, *places)


def matching(postings: DataFrame, query: Expression) -> DataFrame:
    """Counts of the chunks for which an expression holds. It has to ask for some word: what only leaves words out holds for
    chunks that have no postings of them."""
    if not query.asks():
        raise ValueError("a text query asks for at least one word")
    phrases = query.phrases()
    found = counted(postings, phrases, query.placed())
    return found.filter(query.holds({p: F.col(f"_f{i}") for i, p in enumerate(phrases)}, {p: F.col(f"_p{i}") for i, p in enumerate(phrases) if p in query.placed()}))


def chunks_with(postings: DataFrame, terms: DataFrame, phrases: list[Phrase]) -> list[int]:
    """In how many chunks each phrase stands: of one word from the counts that commits keep, of others from its postings."""
    plain = {p.words[0]: 0 for p in phrases if len(p.words) == 1 and not p.open and not p.first}
    if plain:
        plain |= {r[0]: r[1] for r in terms.filter(F.col("term").isin(sorted(plain))).groupBy("term").agg(F.sum("chunks")).collect()}  # one row a word
    others = [p for p in phrases if len(p.words) != 1 or p.open or p.first]
    hits = counted(postings, others).agg(*(F.count_if(F.col(f"_f{i}") > 0) for i in range(len(others)))).first() if others else ()
    known = dict(zip(others, hits, strict=True))
    return [known[p] if p in known else plain[p.words[0]] for p in phrases]


def ranked(postings: DataFrame, terms: DataFrame, statistics: Statistics, query: Expression) -> DataFrame:
    """source_path, ordinal and score (the sum of BM25 over the scored phrases, lower is better) of chunks that match. Counts of
    chunks and words come from the manifest, those of words from the table of terms: nothing is counted over chunks."""
    own, phrases = query.scored(), query.phrases()
    hits = chunks_with(postings, terms, own)
    score = reduce(lambda a, b: a + b, (bm25(F.col(f"_f{phrases.index(p)}"), F.col("n_words"), statistics.chunks, n, statistics.average) for p, n in zip(own, hits, strict=True)), F.lit(0.0))
    return matching(postings, query).select(*CHUNK, score.alias("score"))
