"""Spelling repair of the benchmark's texts, with letters taken out, against the words of all documents."""

from pyspark.sql import functions as F

from checks.fixtures import table
from checks.registry import check
from checks.retrieval_checks import TOKENS
from shelfrank.operators import spelling

# DuckDB's distance counts bytes. Where a word has others than ASCII letters, each letter of the asked word becomes a sign of its own in
# both words and every other letter becomes a tilde, which leaves the distance in letters as it is.
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!\"#$%&()*+,-./:;<=>?@[]^_`{|}"
SHOWN = lambda e: f"regexp_replace(translate({e}, word, left('{SIGNS}', length(word))), '[\\p{{Ll}}\\p{{Lm}}\\p{{Lo}}\\p{{N}}]', '~', 'g')"
DISTANCE = f"CASE WHEN strlen(word) = length(word) AND strlen(candidate) = length(candidate) THEN levenshtein(word, candidate) ELSE levenshtein({SHOWN('word')}, {SHOWN('candidate')}) END"
EDITS = "CASE WHEN length(word) < 3 THEN 0 WHEN length(word) <= 4 THEN 1 ELSE 2 END"
REPAIRS = f"""known AS MATERIALIZED (SELECT candidate, count(*) AS n FROM (SELECT unnest({TOKENS('text')}) AS candidate FROM documents) x GROUP BY ALL HAVING count(*) >= 2),
asked AS MATERIALIZED (SELECT 'b-' || item_id AS query_id, {TOKENS("regexp_replace(text, '([a-z]{4})[a-z]', '\\1', 'g')")} AS words FROM benchmark),
unknown AS MATERIALIZED (SELECT DISTINCT word FROM (SELECT unnest(words) AS word FROM asked) x
  WHERE NOT regexp_matches(word, '\\p{{N}}') AND length(word) >= 3 AND word NOT IN (SELECT candidate FROM known)),
near AS (SELECT word, candidate, n, cast({DISTANCE} AS int) AS edits FROM unknown JOIN known ON length(candidate) BETWEEN length(word) - 2 AND length(word) + 2),
repairs AS MATERIALIZED (SELECT word, candidate AS repair, edits FROM near WHERE edits <= {EDITS} QUALIFY row_number() OVER (PARTITION BY word ORDER BY edits, n DESC, candidate) = 1)"""


def asked(spark, sf):
    text = F.regexp_replace("text", "([a-z]{4})[a-z]", "$1")
    return table(spark, sf, "benchmark").select(F.concat(F.lit("b-"), F.col("item_id")).alias("query_id"), text.alias("query_text"))


def corpus(spark, sf):
    return spelling.corpus_words(table(spark, sf, "documents"))


@check("spelling_repairs", f"WITH {REPAIRS} SELECT * FROM repairs")
def _(spark, sf):
    words = asked(spark, sf).select(F.explode(spelling.tokens(F.col("query_text"))).alias("word"))
    return spelling.spelling_repairs(words, corpus(spark, sf))


@check("repair_queries", f"""WITH {REPAIRS}, w AS (SELECT query_id, unnest(words) AS word, generate_subscripts(words, 1) AS position FROM asked)
 SELECT query_id, coalesce(search_text, '') AS search_text, coalesce(n_repaired, 0) AS n_repaired FROM asked LEFT JOIN
 (SELECT query_id, string_agg(coalesce(repair, word), ' ' ORDER BY position) AS search_text, count(repair) AS n_repaired FROM w LEFT JOIN repairs USING (word) GROUP BY ALL) r USING (query_id)""")
def _(spark, sf):
    return spelling.repair_queries(asked(spark, sf), corpus(spark, sf))
