"""Text queries as expressions over a column of words: phrases, prefixes, nearness, and, or, not.

    all_of(phrase("of the"), none_of(phrase("end"))), near(phrase("cat"), phrase("dog"), distance=5), prefix("th")

Each expression gives a condition and the phrases that count for its score. There is no query syntax to be parsed: what a
user types is a phrase, whatever marks are in it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import fold, phrase_count, with_counts
from inkwell.operators.search import bm25


class Expression:
    def matches(self, words: Column) -> Column:
        raise NotImplementedError

    def scored(self) -> list[Phrase]:
        """Phrases whose occurrences count."""
        return []

    def holds(self, counts: dict[Phrase, Column], places: dict[Phrase, Column]) -> Column:
        """The same as matches, from how often phrases stand in a row and where."""
        raise NotImplementedError

    def phrases(self) -> list[Phrase]:
        """All that it names, those that are left out among them."""
        return self.scored()

    def placed(self) -> list[Phrase]:
        """Phrases whose places it needs."""
        return []

    def asks(self) -> bool:
        """Whether a row has to hold one of its phrases."""
        return True


@dataclass(frozen=True)
class Phrase(Expression):
    """Words one after another; open: the last one may go on; first: only at the start."""

    words: tuple[str, ...]
    open: bool = False
    first: bool = False

    def places(self, words: Column) -> Column:
        """Places (from 0) where it begins."""
        last = len(self.words) - 1

        def here(own: Column, i: Column) -> Column:
            tests = [F.get(own, i + k) == w for k, w in enumerate(self.words[: last + (not self.open)])]
            if self.open:
                tests.append(F.startswith(F.get(own, i + last), F.lit(self.words[last])))
            return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))

        def of(own: Column) -> Column:
            return F.filter(F.array(F.lit(0)) if self.first else F.transform(own, lambda w, i: i), lambda i: here(own, i))

        if not self.words:
            return F.array().cast("array<int>")
        # Held by a lambda's variable, words are found once a row and not once a place.
        return F.get(F.transform(F.array(words), of), F.lit(0))

    def count(self, words: Column) -> Column:
        plain = not (self.open or self.first)
        return phrase_count(words, list(self.words)) if plain else F.size(self.places(words))

    def matches(self, words: Column) -> Column:
        return self.count(words) > 0

    def scored(self) -> list[Phrase]:
        return [self]

    def holds(self, counts: dict[Phrase, Column], places: dict[Phrase, Column]) -> Column:
        return counts[self] > 0


@dataclass(frozen=True)
class Near(Expression):
    """Two phrases with at most `distance` words between them, in any order."""

    one: Phrase
    two: Phrase
    distance: int

    def _close(self, ones: Column, twos: Column) -> Column:
        a, b = (len(p.words) for p in (self.one, self.two))
        close = lambda x, y: ((y >= x + a) & (y - x - a <= self.distance)) | ((x >= y + b) & (x - y - b <= self.distance))
        return F.exists(ones, lambda x: F.exists(twos, lambda y: close(x, y)))

    def matches(self, words: Column) -> Column:
        return self._close(self.one.places(words), self.two.places(words))

    def holds(self, counts: dict[Phrase, Column], places: dict[Phrase, Column]) -> Column:
        return self._close(places[self.one], places[self.two])

    def placed(self) -> list[Phrase]:
        return [self.one, self.two]

    def scored(self) -> list[Phrase]:
        return [self.one, self.two]


@dataclass(frozen=True)
class Combined(Expression):
    parts: tuple[Expression, ...]
    all: bool

    def matches(self, words: Column) -> Column:
        return reduce(lambda a, b: a & b if self.all else a | b, (p.matches(words) for p in self.parts))

    def scored(self) -> list[Phrase]:
        return list(dict.fromkeys(x for p in self.parts for x in p.scored()))

    def holds(self, counts: dict[Phrase, Column], places: dict[Phrase, Column]) -> Column:
        return reduce(lambda a, b: a & b if self.all else a | b, (p.holds(counts, places) for p in self.parts))

    def phrases(self) -> list[Phrase]:
        return list(dict.fromkeys(x for p in self.parts for x in p.phrases()))

    def placed(self) -> list[Phrase]:
        return list(dict.fromkeys(x for p in self.parts for x in p.placed()))

    def asks(self) -> bool:
        return (any if self.all else all)(p.asks() for p in self.parts)


@dataclass(frozen=True)
class Excluded(Expression):
    parts: tuple[Expression, ...]

    def matches(self, words: Column) -> Column:
        return ~reduce(lambda a, b: a | b, (p.matches(words) for p in self.parts))

    def holds(self, counts: dict[Phrase, Column], places: dict[Phrase, Column]) -> Column:
        return ~reduce(lambda a, b: a | b, (p.holds(counts, places) for p in self.parts))

    def phrases(self) -> list[Phrase]:
        return list(dict.fromkeys(x for p in self.parts for x in p.phrases()))

    def placed(self) -> list[Phrase]:
        return list(dict.fromkeys(x for p in self.parts for x in p.placed()))

    def asks(self) -> bool:
        return False


def phrase(text: str, first: bool = False) -> Phrase:
    return Phrase(tuple(fold(text)), first=first)


def prefix(text: str) -> Phrase:
    return Phrase(tuple(fold(text)), open=True)


def near(one: Phrase, two: Phrase, distance: int = 10) -> Near:
    return Near(one, two, distance)


def all_of(*parts: Expression) -> Combined:
    return Combined(parts, True)


def any_of(*parts: Expression) -> Combined:
    return Combined(parts, False)


def none_of(*parts: Expression) -> Excluded:
    """Only beside other parts of all_of: it tells what is left out."""
    return Excluded(parts)


def ranked(rows: DataFrame, query: Expression, words: str = "tokens") -> DataFrame:
    """Rows that match, with score: the sum of BM25 over the scored phrases, lower is better. Corpus statistics (rows, rows
    with each phrase, average length) are one aggregation over all rows, one row on the driver."""
    own = query.scored()
    counts = {f"_f{k}": p.count for k, p in enumerate(own)}
    found = with_counts(rows, words, {"_n": F.size, **counts, "_match": query.matches})
    total = found.agg(F.count(F.lit(1)), F.avg("_n"), *(F.count_if(F.col(n) > 0) for n in counts)).first()
    score = reduce(lambda a, b: a + b, (bm25(F.col(n), F.col("_n"), total[0], hits, total[1]) for n, hits in zip(counts, total[2:], strict=True)), F.lit(0.0))
    return found.filter("_match").withColumn("score", score).drop("_n", *counts, "_match")
