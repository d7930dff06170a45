"""Text functions as columns. White space, words and digits are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U:[\s\x1c-\x1f])"


def let(value: Column, f) -> Column:
    """f of value, which is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def is_blank(c: Column) -> Column:
    return ~F.rlike(c, F.lit(r"[^\p{IsWhite_Space}\x1c-\x1f]"))


def normalize_space(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; null gives an empty string."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", " "))


def words(c: Column) -> Column:
    """Lower-case runs of letters, digits, underscores and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_']+"), 0)


def shingles(tokens: Column, n: int = 5) -> Column:
    """Distinct runs of n words; the distinct words if there are fewer."""

    def runs(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.array_distinct(F.when(F.size(t) >= n, each).otherwise(t))

    return let(tokens, runs)


def shingle_hashes(tokens: Column, n: int = 5) -> Column:
    """Sorted distinct 64-bit hashes of the same runs, in time linear in the words."""

    def runs(h: Column) -> Column:
        size = F.size(h) - (n - 1)
        out = F.slice(h, F.lit(1), F.greatest(size, F.lit(0)))
        for i in range(1, n):
            out = F.zip_with(out, F.slice(h, F.lit(i + 1), F.greatest(size, F.lit(0))), lambda x, y: F.xxhash64(x, y))
        return F.sort_array(F.array_distinct(F.when(F.size(h) >= n, out).otherwise(h)))

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), runs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def bounded(c: Column, most: int = 500) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def estimated_tokens(c: Column) -> Column:
    return F.ceil(F.char_length(c) / 4).cast("long")


def luhn_ok(c: Column) -> Column:
    """13 to 19 digits, whatever lies between them, with a valid check digit."""
    return let(F.regexp_replace(c, r"(?U)\D", ""), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))


def occurrences(c: Column, literal: str) -> Column:
    """How often literal occurs, without overlaps."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def split_of_path(path: Column) -> Column:
    """The split that a file's name tells: train, val, dev or test if it begins so, else its stem."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    found = F.regexp_extract(F.lower(name), r"^(train|validation|valid|val|dev|test)(?:[._-]|$)", 1)
    stem = F.when(F.rlike(name, F.lit(r"^.+\.[^.]*$")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return F.when(found.isin("validation", "valid"), "val").when(found != "", found).otherwise(stem)


def split_of(split: Column, path: Column) -> Column:
    """A record's own split, in lower case, or that of its file."""
    own = F.lower(strip(split))
    return F.when(own.isin("validation", "valid"), "val").when(own != "", own).otherwise(split_of_path(path))
