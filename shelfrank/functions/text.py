"""Text expressions: stripping, tokens, n-grams."""

from pyspark.sql import Column, functions as F

from shelfrank.functions.lookup import bind


WHITE_SPACE = " \t\n\r\f\x0b"
WORD = r"[\p{L}\p{N}]+"


def strip(c) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def clean_value(c: Column) -> Column:
    """Everything but ASCII letters and digits becomes a space; runs of spaces collapse."""
    return collapse_spaces(F.regexp_replace(c, r"[^a-zA-Z0-9]", " "))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_count(c: Column) -> Column:
    """Number of tokens, without building the list."""
    return F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD))


def explode_tokens(words: Column) -> Column:
    """One row per word; a text without words gives one row with a null word.

    A plain explode makes the optimizer add a non-empty filter that builds every
    list a second time; this form does not.
    """
    return F.explode_outer(words)


def term_counts(words: Column) -> Column:
    """array of struct(term, tf): the distinct words of a list and how often each stands in it."""

    def runs(ordered):
        n = F.size(ordered)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return bind(
            starts, lambda s: F.transform(s, lambda at, j: F.struct(F.get(ordered, at).alias("term"), (F.coalesce(F.get(s, j + 1), n) - at).cast("long").alias("tf")))
        )

    return bind(F.sort_array(words), runs)


def bigrams(words: Column) -> Column:
    """Adjacent word pairs joined by one blank."""
    return F.when(
        F.size(words) > 1,
        F.zip_with(
            F.slice(words, F.lit(1), F.size(words) - 1),
            F.slice(words, F.lit(2), F.size(words) - 1),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    ).otherwise(F.array().cast("array<string>"))
