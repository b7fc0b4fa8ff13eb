"""Secret scans: long unbroken strings, and a random forest that removes false positives.

Candidates are runs of 16 or more letters, digits and ``+ / _ -`` with up to two ``=`` at their
end, tokens of three dotted parts, and values of 8 or more signs assigned to the name of a secret:
any signs but white space inside quotes, and without quotes where a digit is among them. What
stands before ``=`` is a name, no part of the candidate. Each gets its length,
its character transitions (changes of class, and how likely its letter pairs are in the
corpus's own words), the share covered by dictionary words, what its path looks like, and its
neighbouring words. A random forest trained on labelled findings gives the probability that
a candidate is a secret.
"""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfrank.llm.common import pick, stored, utf8

# Candidates are whole matches without groups, as texts are also split by them; short tests come first, for speed.
_NAMED = r"(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)[A-Za-z0-9_-]{0,16}[\"'`]?[ \t]{0,4}[=:][ \t]{0,4}"
_QUOTED = "|".join(f"(?<={q})(?<={_NAMED}{q})[^{q}\\s]{{8,}}(?={q})" for q in ('"', "'", "`"))
_DOTTED = r"(?<![A-Za-z0-9_-])(?:eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{8,}|[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{20,})"
_PLAIN = rf"(?<=[=: \t])(?<=[=:][ \t]{{0,4}})(?<={_NAMED})(?=[^\s\"'`,;0-9]*+[0-9])[^\s\"'`,;]{{8,}}"
# Tried at the start of a run only, so a run is read once whatever its length.
_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})(?![A-Za-z0-9+/_-]*+=[^=\s])[A-Za-z0-9+/_-]{16,}={0,2}"
CANDIDATE = f"(?:{_QUOTED}|{_DOTTED}|{_PLAIN}|{_RUN})"
# Letters of context kept on either side; the forest looks at the words next to a candidate.
CONTEXT = 48
# Long candidates are looked at in pieces of this many characters, each with the start of the next one.
SEGMENT = 256
# Stands around candidates while a text is cut; where a text has it, another control character takes its place.
MARK, OTHER = "\x01", "\x02"
# Names of secrets, of public hashes, and marks of examples.
SECRET_NAME = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
PUBLIC_NAME = r"(?i)(sha-?1|sha-?256|md5|commit|checksum|digest|etag|integrity|uuid|revision)"
EXAMPLE = r"(?i)(example|dummy|placeholder|change_?me|x{6}|your[_-]|sample|fake)"
TEST_PATH = r"(?i)(test|example|sample|mock|fixture|docs?/)"
SECRET_PATH = r"(?i)(\.env|config|secret|credential|\.pem|\.ya?ml|\.properties)"
KEY = ["id", "hash", "bytes"]
FEATURES = [
    "length", "digits", "upper", "distinct", "class_changes", "pair_likelihood", "coverage", "test_path", "secret_path",
    "secret_word", "public_word", "example_word", "assigned", "quoted", "in_address",
]


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, hash, bytes, path, position, start, end, candidate, before, after) of every candidate of every text.

    ``position`` counts a text's candidates from 0; ``start`` and ``end`` are characters. Rows
    alike in id and text give their candidates once. Null and empty texts have none.
    """
    columns = {"id": id_col, "text": text_col} | ({"path": path_col} if path_col else {})
    texts = pick(df, **columns)
    path = F.coalesce(F.col("path").cast("string"), F.lit("")) if path_col else F.lit("")
    raw = utf8(F.col("text"))
    # The pattern runs over a text once: it sets marks, and the parts between them are gaps and candidates in turn.
    marked = F.regexp_replace(F.replace("text", F.lit(MARK), F.lit(OTHER)), f"({CANDIDATE})", f"{MARK}$1{MARK}")
    parts = F.transform(
        F.array(F.split(marked, MARK, -1)),
        lambda cut: F.filter(
            F.transform(
                cut,
                lambda x, i: F.struct(
                    i.alias("part"), x.alias("candidate"), F.right(F.get(cut, i - 1), F.lit(CONTEXT)).alias("before"),
                    F.left(F.get(cut, i + 1), F.lit(CONTEXT)).alias("after"), F.length(F.get(cut, i - 1)).alias("gap"),
                ),
            ),
            lambda x: x["part"] % 2 == 1,
        ),
    )
    split = texts.select("id", path.alias("path"), F.xxhash64(raw).alias("hash"), F.octet_length(raw).alias("bytes"), F.flatten(parts).alias("found"))
    rows = split.select(*KEY, "path", F.posexplode("found").alias("position", "one")).select(*KEY, "path", "position", "one.*")
    once = rows.groupBy(*KEY, "position", "candidate", "before", "after", "gap").agg(F.min("path").alias("path"))
    so_far = Window.partitionBy(*KEY).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("candidate")).over(so_far)
    return once.select(*KEY, "path", "position", (end - F.length("candidate")).alias("start"), end.alias("end"), "candidate", "before", "after")


def dictionary(df: DataFrame, text_col: str = "text", most: int = 5000) -> DataFrame:
    """(word, n): the ``most`` frequent words of three or more letters a-z in all texts; ties by the word."""
    words = pick(df, text=text_col).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(most)


def _segments(strings: DataFrame, size: int, over: int) -> DataFrame:
    """(candidate, part, piece): lower-cased pieces of ``size`` characters of each distinct candidate, each with the ``over`` first ones of the next piece."""
    cut = F.regexp_extract_all(F.lower("candidate"), F.lit(f"(?s)(.{{1,{size}}})"), 1)
    pieces = F.flatten(F.transform(F.array(cut), lambda all_: F.transform(all_, lambda x, i: F.concat(x, F.left(F.coalesce(F.get(all_, i + 1), F.lit("")), F.lit(over))))))
    return strings.select("candidate", F.posexplode(pieces).alias("part", "piece"))


def pair_likelihood(strings: DataFrame, words: DataFrame) -> DataFrame:
    """(candidate, pair_likelihood): mean log2 probability of a character after the one before, as in the words; pairs of other characters count as never seen."""
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    seen = words.select("n", F.explode(pairs(F.col("word"))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    first = seen.groupBy(F.left("pair", F.lit(1)).alias("first")).agg(F.sum("n").alias("of"))
    # At most 26 x 26 pairs.
    table = seen.join(F.broadcast(first), F.left("pair", F.lit(1)) == F.col("first")).select("pair", F.log2(F.col("n") / F.col("of")).alias("bits"))
    mine = _segments(strings, SEGMENT, 1).filter(F.length("piece") > 1).select("candidate", F.explode(pairs(F.col("piece"))).alias("pair"))
    return mine.join(F.broadcast(table), "pair", "left").groupBy("candidate").agg(F.avg(F.greatest(F.lit(-12.0), F.coalesce("bits", F.lit(-12.0)))).alias("pair_likelihood"))


def coverage(strings: DataFrame, words: DataFrame) -> DataFrame:
    """(candidate, coverage): the share of characters inside a dictionary word, of whatever length. Candidates without any are left out."""
    # As many lengths as the dictionary has words at most, some dozen in texts of words.
    lengths = sorted(r.n for r in words.select(F.length("word").alias("n")).distinct().collect())
    if not lengths:
        return strings.select("candidate", F.lit(0.0).alias("coverage")).limit(0)
    size = max(SEGMENT, lengths[-1])
    inside = lambda x: F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length(x)),
            lambda i: F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(x) - i + 1), lambda n: F.struct(i.alias("at"), F.substring(x, i, n).alias("word"))),
        )
    )
    spans = _segments(strings, size, lengths[-1] - 1).select("candidate", "part", F.explode(inside(F.col("piece"))).alias("span")).select("candidate", "part", "span.*")
    # The dictionary has a fixed number of words.
    covered = spans.join(F.broadcast(words.select("word")), "word").select("candidate", F.explode(F.sequence(F.col("at"), F.col("at") + F.length("word") - 1)).alias("at"), "part")
    covered = covered.select("candidate", (F.col("part") * size + F.col("at")).alias("at")).distinct()
    return covered.groupBy("candidate").agg(F.count(F.lit(1)).alias("covered")).select("candidate", (F.col("covered") / F.length("candidate")).alias("coverage"))


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the numbers the forest looks at."""
    c, before, after, path = F.col("candidate"), F.col("before"), F.col("after"), F.col("path")
    size = F.length(c)
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    near = F.regexp_extract(before, r"([^\n]{0,48})$", 1)
    changes = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    # Counted once for each distinct string and written, so that many copies of one secret are a plain join, which Spark can split.
    strings = stored(found.select("candidate").distinct())
    counted = stored(strings.join(pair_likelihood(strings, words), "candidate", "left").join(coverage(strings, words), "candidate", "left"))
    rich = found.join(counted, "candidate", "left")
    return rich.withColumns(
        {
            "length": F.log2(size), "digits": count("[0-9]") / size, "upper": count("[A-Z]") / size,
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / size, "class_changes": count(changes) / size,
            "pair_likelihood": F.coalesce("pair_likelihood", F.lit(-12.0)), "coverage": F.coalesce("coverage", F.lit(0.0)),
            "test_path": flag(F.rlike(path, F.lit(TEST_PATH))), "secret_path": flag(F.rlike(path, F.lit(SECRET_PATH))),
            "secret_word": flag(F.rlike(near, F.lit(SECRET_NAME))), "public_word": flag(F.rlike(near, F.lit(PUBLIC_NAME))),
            "example_word": flag(F.rlike(F.concat(near, c, after), F.lit(EXAMPLE))),
            "assigned": flag(F.rlike(near, F.lit(r"""[=:]\s*["'`]?$"""))), "quoted": flag(F.rlike(before, F.lit("""["'`]$""")) & F.rlike(after, F.lit("""^["'`]"""))),
            "in_address": flag(F.rlike(before, F.lit(r"[@/.]$")) | F.rlike(after, F.lit(r"^(\.[A-Za-z]{2,}|@)"))),
        }
    )


def findings_label(rich: DataFrame) -> Column:
    """Label of a finding that is clear from its surroundings, else null.

    1: letters and digits, assigned to the name of a secret, and no example. 0: without digits and not
    assigned, digits alone, part of an address, beside the name of a public hash, or an example.
    """
    mixed = (F.col("digits") > 0) & (F.col("digits") < 1)
    secret = mixed & (F.col("secret_word") + F.col("assigned") == 2) & (F.col("example_word") + F.col("public_word") + F.col("in_address") == 0)
    harmless = ((F.col("digits") == 0) & (F.col("assigned") == 0)) | (F.col("digits") == 1) | (F.col("in_address") + F.col("public_word") + F.col("example_word") > 0)
    return F.when(secret, 1).when(harmless, 0)


def scored_findings(rich: DataFrame, labelled: DataFrame, most: int = 4000, trees: int = 24, depth: int = 6, seed: int = 7) -> DataFrame:
    """``rich`` with ``score``, the forest's probability of a secret.

    The forest is trained on at most ``most`` findings of each label (0 and 1 in ``label``), those of the smallest hashes of
    candidate and context. With one label only, or none, the score is that label's smoothed share.
    """
    drawn = lambda label: labelled.filter(F.col("label") == label).select(*FEATURES, F.lit(float(label)).alias("label"), F.xxhash64("candidate", "before", "after").alias("_order")).dropDuplicates(["_order"]).orderBy("_order").limit(most)
    sample = stored(drawn(0).union(drawn(1)).coalesce(1))
    counts = {int(r.label): r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return rich.withColumn("score", F.lit(share))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="_features", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_class", numTrees=trees, maxDepth=depth, seed=seed)
    model = forest.fit(vectors.transform(sample))
    return model.transform(vectors.transform(rich)).withColumn("score", vector_to_array("_probability")[1]).drop("_features", "_raw", "_probability", "_class")


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", labelled: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """Every candidate with its place, features, ``label``, ``score`` and ``secret`` (score of ``least`` or more).

    ``labelled`` holds reviewed findings: ``candidates`` with a ``label``. Without it, findings whose
    surroundings leave no doubt are the labelled ones. The dictionary is that of ``df``. An empty table gives no rows.
    """
    words = stored(dictionary(df, text_col))
    rich = with_features(stored(candidates(df, id_col, text_col, path_col)), words)
    rich = stored(rich.withColumn("label", findings_label(rich)))
    known = rich if labelled is None else with_features(labelled, words)
    return scored_findings(rich, known).withColumn("secret", F.col("score") >= least)


def redacted(df: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with each secret of ``findings`` replaced by ``mark`` in ``text_col``; other rows and columns stay as they are."""
    names = df.columns
    at_id, at_text = (f"_{names.index(c)}" for c in (id_col, text_col))
    raw = utf8(F.col(at_text))
    plain = df.toDF(*[f"_{i}" for i in range(len(names))]).withColumns({"_hash": F.xxhash64(raw), "_bytes": F.octet_length(raw)})
    # The secrets of one text.
    marked = findings.filter("secret").groupBy(*KEY).agg(F.collect_set("position").alias("_at"))
    same = F.col(at_id).eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash")) & (F.col("_bytes") == F.col("bytes"))
    joined = plain.join(marked, same, "left").withColumns({"_found": F.when(F.col("_at").isNotNull(), F.regexp_extract_all(at_text, F.lit(f"({CANDIDATE})"), 1)), "_gaps": F.when(F.col("_at").isNotNull(), F.split(at_text, CANDIDATE, -1))})
    parts = F.transform("_gaps", lambda gap, i: F.concat(gap, F.when(F.array_contains("_at", i), F.lit(mark)).otherwise(F.coalesce(F.get("_found", i), F.lit("")))))
    text = F.when(F.col("_at").isNull(), F.col(at_text)).otherwise(F.array_join(parts, ""))
    return joined.withColumn(at_text, text).select(*[F.col(f"_{i}") for i in range(len(names))]).toDF(*names)
