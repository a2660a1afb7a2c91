"""Text helpers as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@cache
def folding() -> tuple[str, str]:
    """Lower-case letters with diacritics and the plain letters under them, by Unicode's decompositions."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]):
        base = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(base) == 1 and base[0] != c and c.lower() == c:
            pairs.append((c, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def tokens(text: Column | str) -> Column:
    """Lower-case words without diacritics: maximal runs of letters, numbers and private-use characters; combining marks
    count as nothing. Texts of one byte a character have neither."""
    lower = F.lower(text)
    plain = F.when(F.octet_length(lower) == F.char_length(lower), lower).otherwise(F.regexp_replace(F.translate(lower, *folding()), r"\p{Mn}", ""))
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def words(text: Column | str) -> Column:
    """Lower-case words as they are spelled: maximal runs of letters and numbers, with their diacritics. A character's lower
    case is one character, wherever it stands: neither a final sigma nor a dot beside an i is made."""
    plain = F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ"))
    return F.regexp_extract_all(F.lower(plain), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fold(text: str) -> list[str]:
    """The words of a Python string as tokens gives them, for queries."""
    import regex

    plain = regex.sub(r"\p{Mn}", "", text.lower().translate(str.maketrans(*folding())))
    return regex.findall(r"[\p{L}\p{N}\p{Co}]+", plain)


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often the words of a phrase stand one after another."""
    if not phrase:
        return F.lit(0)
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda t: t == phrase[0]))
    # Words hold letters and numbers only, so that spaces around them mark their bounds.
    first, rest = phrase[0], " ".join(phrase[1:])
    return F.regexp_count(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f"(?<= ){first}(?= {rest} )"))


def with_counts(rows: DataFrame, words: str, found: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Adds columns that are made of a row's words. They are made once a row, however often later filters and columns name
    them: the words are a lambda's variable, and what a generator gives isn't put back into a filter as an expression."""
    return rows.select("*", F.inline(F.transform(F.array(words), lambda w: F.struct(*(make(w).alias(name) for name, make in found.items())))))


def content_hash(text: Column | str) -> Column:
    return F.sha2(text, 256)


def chunk_id(path: Column, ordinal: Column) -> Column:
    """Stable name of a chunk: 24 hex digits from its path and ordinal."""
    return F.substring(F.sha2(F.concat(path, F.lit("\0"), ordinal.cast("string")), 256), 1, 24)


def mask(value: Column) -> Column:
    """A preview that doesn't tell a secret: its first two characters if it has over four."""
    v = F.trim(value)
    return F.when(F.length(v) > 4, F.concat(F.substring(v, 1, 2), F.lit("***"))).otherwise("***")


def error_text(value: Column) -> Column:
    """White space collapsed, at most 1000 characters."""
    return F.substring(F.regexp_replace(F.trim(value), r"\s+", " "), 1, 1000)


def entropy(value: Column) -> Column:
    """Shannon entropy of a string in bits a character."""
    chars = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    n = F.size(chars)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; null if a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
