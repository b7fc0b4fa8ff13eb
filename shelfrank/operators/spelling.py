"""Spelling repair of query words against the words of a corpus.

A word within two edits of another shares with it what is left of both after at most two
letters are taken out. So the words of the corpus are indexed by what such deletions leave,
unknown query words look their own remains up by an equi-join, and what they meet is
verified by edit distance. Of a long word deletions leave too much: it is cut into three
parts instead, one of which two edits leave whole, at most two places away. Both ways find
every pair.
"""

from pyspark.sql import Column, DataFrame, functions as F

from shelfrank.functions.lookup import small_side
from shelfrank.functions.text import explode_tokens, tokens
from shelfrank.session import materialize

MOST_EDITS = 2
# Words up to this many letters are indexed by deletions; pairs with a longer word by parts.
DELETION_LETTERS = 20
# Shorter words stay as they are; up to the second length one edit is allowed.
LEAST_LETTERS, ONE_EDIT_LETTERS = 3, 4


def allowed_edits(word: Column) -> Column:
    """Edits a query word of this length may be away from its repair."""
    letters = F.length(word)
    return F.when(letters < LEAST_LETTERS, F.lit(0)).when(letters <= ONE_EDIT_LETTERS, F.lit(1)).otherwise(F.lit(MOST_EDITS))


def remains(word: Column, edits: int = MOST_EDITS) -> Column:
    """What is left of a word after up to ``edits`` letters are taken out, itself included; nothing shorter than a letter less than ``LEAST_LETTERS``."""

    def without_one(w):
        places = F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    found = last = F.array(word)
    for _ in range(edits):
        last = F.array_distinct(F.flatten(F.transform(last, without_one)))
        found = F.array_union(found, last)
    return F.filter(found, lambda r: F.length(r) >= LEAST_LETTERS - 1)


def part(word: Column, letters, i: int, shift=0) -> Column:
    """The i-th third of a word of ``letters`` letters, read ``shift`` places further on; null where that leaves the word."""
    at = F.floor(letters * i / 3).cast("int")
    size = F.floor(letters * (i + 1) / 3).cast("int") - at
    start = at + 1 + shift
    return F.when((start >= 1) & (start + size - 1 <= F.length(word)), F.substring(word, start, size))


def index_keys(words: DataFrame) -> DataFrame:
    """(key, candidate, n) of the corpus's ``words`` (word, n): keys ``d:`` of remains, ``p:`` of thirds with the word's length."""
    letters = F.length("word")
    short = words.filter(letters <= DELETION_LETTERS).select("word", "n", F.explode(remains(F.col("word"))).alias("left"))
    long = words.filter(letters > DELETION_LETTERS - MOST_EDITS).select(
        "word", "n", F.posexplode(F.array(*[part(F.col("word"), letters, i) for i in range(3)])).alias("i", "piece")
    )
    return short.select(F.concat(F.lit("d:"), "left").alias("key"), F.col("word").alias("candidate"), "n").unionByName(
        long.select(F.concat_ws(":", F.lit("p"), F.length("word").cast("string"), F.col("i").cast("string"), "piece").alias("key"), F.col("word").alias("candidate"), "n")
    )


def lookup_keys(unknown: DataFrame) -> DataFrame:
    """(key, word) under which each unknown word looks for its candidates."""
    letters = F.length("word")
    short = unknown.filter(letters <= DELETION_LETTERS).select("word", F.explode(remains(F.col("word"))).alias("left"))
    around = range(-MOST_EDITS, MOST_EDITS + 1)
    pieces = [
        F.struct((letters + more).alias("letters"), F.lit(i).alias("i"), part(F.col("word"), letters + more, i, shift).alias("piece"))
        for more in around for i in range(3) for shift in around
    ]
    long = unknown.filter(letters > DELETION_LETTERS - MOST_EDITS).select("word", F.explode(F.array(*pieces)).alias("p")).filter("p.piece is not null")
    return short.select(F.concat(F.lit("d:"), "left").alias("key"), "word").unionByName(
        long.select(F.concat_ws(":", F.lit("p"), F.col("p.letters").cast("string"), F.col("p.i").cast("string"), "p.piece").alias("key"), "word").distinct()
    )


def corpus_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the words of all texts and how often each stands there."""
    return (
        texts.select(explode_tokens(tokens(F.col(text))).alias("word")).filter(F.col("word").isNotNull())
        .groupBy("word").agg(F.count("*").alias("n"))
    )


def spelling_repairs(words: DataFrame, corpus: DataFrame, least: int = 2) -> DataFrame:
    """(word, repair, edits) of the distinct ``words`` the ``corpus`` (word, n) does not know and has something near for.

    A word is known where it stands at least ``least`` times in the corpus. The repair is the known word of the fewest edits, of
    equally near ones the most frequent, then the one that sorts first. Words of fewer than three letters and words with a
    digit stay unrepaired; up to four letters one edit is allowed, else two. Null words are left out.
    """
    # Counted once: the words are read by the look-up of unknown ones and by both indexes.
    known = materialize(corpus.filter(F.col("n") >= least))
    asked = words.select("word").filter(F.col("word").isNotNull() & (allowed_edits(F.col("word")) > 0) & ~F.col("word").rlike(r"\p{N}")).distinct()
    # The queries' keys are the small side as a rule; the corpus's index then never moves.
    unknown = materialize(asked.join(known.select("word"), "word", "left_anti"))
    met = index_keys(known).join(small_side(lookup_keys(unknown)), "key")
    near = met.withColumn("edits", F.levenshtein("word", "candidate", MOST_EDITS)).filter((F.col("edits") >= 0) & (F.col("edits") <= allowed_edits(F.col("word"))))
    best = F.min(F.struct("edits", (-F.col("n")).alias("rarity"), "candidate"))
    return near.groupBy("word").agg(best.alias("b")).select("word", F.col("b.candidate").alias("repair"), "b.edits")


def repair_queries(queries: DataFrame, corpus: DataFrame, text: str = "query_text", least: int = 2) -> DataFrame:
    """(query_id, search_text, n_repaired): each query's words in order, unknown ones repaired, joined by one blank.

    Query ids are unique. A query without words has the empty text.
    """
    words = queries.select("query_id", F.posexplode_outer(tokens(F.col(text))).alias("position", "word"))
    repairs = small_side(materialize(spelling_repairs(words.select("word"), corpus, least).select("word", "repair")))
    shown = words.join(repairs, "word", "left")
    in_order = F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("position", F.coalesce("repair", "word").alias("word")))))
    return shown.groupBy("query_id").agg(F.array_join(in_order.getField("word"), " ").alias("search_text"), F.count("repair").alias("n_repaired"))
