"""One registered query per operator, on its whole table with production parameters, and SQL where SQL can say it."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfrank.llm import (
    bond_scan, byte_cnn, compression_bands, host_reputation, html_blocks, kd_shards, length_buckets, license_scan, piece_offsets, prefix_trie, secret_scan, segment_search, simhash_index,
)

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SHARDS = 16
# Labelled documents the classifier is trained on, at most.
LABELLED = 6000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_bands(spark, sf_dir):
    judged = compression_bands.quality_rules(_table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_share")


def op2_host_reputation(spark, sf_dir):
    return host_reputation.host_verdicts(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"), RULES).withColumnRenamed("id", "page_id")


def op3_length_buckets(spark, sf_dir):
    return length_buckets.length_buckets(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_kd_shards(spark, sf_dir):
    rows, _ = kd_shards.kd_shards(_table(spark, sf_dir, "documents"), shards=SHARDS)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def quality_network(docs: DataFrame, labels: DataFrame) -> byte_cnn.ByteCNN:
    """The network trained on labelled documents that are not held out."""
    return byte_cnn.fit(byte_cnn.labelled_sample(docs, labels, ~_held_out(F.col("id")), LABELLED))


def op5_byte_cnn(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    scores = byte_cnn.scored(docs, quality_network(docs, _table(spark, sf_dir, "labels")))
    return scores.select(F.col("id").alias("doc_id"), _held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_secret_scan(spark, sf_dir):
    found = secret_scan.secret_scan(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "position", "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), "label", "score", "secret")


def op7_segment_search(spark, sf_dir):
    found = segment_search.exact_topk(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_piece_offsets(spark, sf_dir, path=None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        model = file.read()
    pieces = piece_offsets.encoded(_table(spark, sf_dir, "documents"), model, decode=True)
    return pieces.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(piece_offsets.joined_ids(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_license_scan(spark, sf_dir):
    return license_scan.license_scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_simhash_index(spark, sf_dir):
    rows = simhash_index.near_groups(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_html_blocks(spark, sf_dir):
    return html_blocks.extracted(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op12_prefix_trie(spark, sf_dir):
    conv = F.col("conv_id")
    turns = prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_starts(turns, conv - conv % 20, F.crc32(conv.cast("string")) % 4))


def op13_bond_scan(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond_scan.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 100 == 0)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_compression_bands, op2_host_reputation, op3_length_buckets, op4_kd_shards, op5_byte_cnn, op6_secret_scan,
    op7_segment_search, op8_piece_offsets, op9_license_scan, op10_simhash_index, op11_html_blocks, op12_prefix_trie, op13_bond_scan, pipeline,
)}


def _rule_sql() -> str:
    cases = []
    for action, pattern in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        name, slash, tail = pattern.partition("/")
        cases.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + tail}')", pattern, action))
    case = lambda at: "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[at]}'" for c in cases) + " END"
    return f"{case(1)} AS rule, {case(2)} AS action"


def _weight_sql(groups: str) -> str:
    low, high = host_reputation.LEAST_WEIGHT, host_reputation.MOST_WEIGHT
    return f"""(SELECT least({high}::double, greatest({low}::double, CASE WHEN pages IS NULL THEN {low}::double WHEN share > 0 THEN (1 - share) / share ELSE {high}::double END)) FROM (
  SELECT pages, CASE WHEN p * (1 - p) > 0 AND pages - squares / pages - (k - 1) > 0 THEN round(((spread - p * good) / (p * (1 - p)) - (k - 1)) / (pages - squares / pages - (k - 1)), 6) END AS share FROM (
   SELECT *, good / pages AS p FROM (SELECT sum(n)::double AS pages, sum(good)::double AS good, count(*)::double AS k, sum(n * n)::double AS squares, sum((good * good)::double / n) AS spread FROM {groups} WHERE n > 0))))"""


_SUFFIXES = ", ".join(f"'{s}'" for s in host_reputation.TWO_LABEL_SUFFIXES)
OP2_SQL = rf"""
WITH urls AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{host_reputation.UPPER}', '{host_reputation.LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, {_rule_sql()} FROM urls),
cut AS (SELECT *, regexp_extract(name, '([^.]+\.[^.]+)$', 1) AS two, regexp_extract(name, '([^.]+\.[^.]+\.[^.]+)$', 1) AS three, regexp_extract(name, '([^.]*)$', 1) AS one FROM named),
levels AS (SELECT *, CASE WHEN two IN ({_SUFFIXES}) THEN two ELSE one END AS suffix,
  CASE WHEN two IN ({_SUFFIXES}) AND three <> '' THEN three WHEN two NOT IN ({_SUFFIXES}) AND two <> '' THEN two ELSE name END AS domain FROM cut),
outcomes AS (SELECT doc_id, min(quality)::bigint AS outcome FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY 1),
hosts AS (SELECT name, domain, suffix, coalesce(sum(outcome), 0)::bigint AS good, count(outcome) AS n FROM levels LEFT JOIN outcomes ON page_id = doc_id GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(good)::bigint AS good, sum(n)::bigint AS n FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(good)::bigint AS good, sum(n)::bigint AS n FROM hosts GROUP BY ALL),
w AS (SELECT {_weight_sql('hosts')} AS host_w, {_weight_sql('domains')} AS domain_w, {_weight_sql('suffixes')} AS suffix_w,
  (SELECT (coalesce(sum(good), 0) + 0.5::double) / (coalesce(sum(n), 0) + 1) FROM hosts) AS whole),
s AS (SELECT suffix, (good + suffix_w * whole) / (n + suffix_w) AS m FROM suffixes, w),
d AS (SELECT domain, suffix, (good + domain_w * m) / (n + domain_w) AS m FROM domains JOIN s USING (suffix), w),
h AS (SELECT name, n, good, (good + host_w * m) / (n + host_w) AS mean, n + host_w AS weight FROM hosts JOIN d USING (domain, suffix), w)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN bound < 0.7 THEN 'block' ELSE 'allow' END) AS verdict, n AS n_labelled, good AS n_good, round(mean, 4) AS posterior_mean, round(bound, 4) AS upper_bound
FROM (SELECT *, mean + 1.645::double * sqrt(mean * (1 - mean) / (weight + 1)) AS bound FROM h) JOIN levels USING (name)"""


def _templates_sql() -> str:
    rows = []
    for name, text in license_scan.TEMPLATES.items():
        grams = license_scan.bigrams_of(text)
        rows.append(f"('{name}', [{', '.join(repr(g) for g in grams)}])")
    return ", ".join(rows)


_ANCHORS = ", ".join(f"'{a}'" for a in license_scan.anchors_of(license_scan.TEMPLATES, license_scan.THRESHOLD))
OP9_SQL = rf"""
WITH templates(license, theirs) AS (VALUES {_templates_sql()}),
lines AS (SELECT doc_id, 'line' AS kind, unnest(string_split(text, E'\n')) AS body, generate_subscripts(string_split(text, E'\n'), 1) AS number FROM documents),
blocks AS (SELECT doc_id, 'block' AS kind, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS body, generate_subscripts(regexp_split_to_array(text, '\n[ \t\r]*\n'), 1) AS number FROM documents),
units AS (SELECT * FROM lines UNION ALL SELECT * FROM blocks WHERE contains(body, E'\n') UNION ALL
  SELECT doc_id, 'text', text, 1 FROM documents WHERE len(regexp_split_to_array(text, '\n[ \t\r]*\n')) > 1),
words AS (SELECT doc_id, kind, number, string_split(trim(regexp_replace(translate(body, '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
pairs AS (SELECT doc_id, kind, number, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS mine FROM words WHERE len(w) > 1),
met AS (SELECT doc_id, kind, number, license, len(list_intersect(mine, theirs)) AS shared, len(mine) AS a, len(theirs) AS b FROM pairs, templates),
best AS (SELECT *, 2 * shared::double / (a + b) AS score, row_number() OVER (PARTITION BY doc_id, kind, number ORDER BY 2 * shared::double / (a + b) DESC, license) AS r FROM met),
numbered AS (SELECT doc_id, number, list_filter(regexp_split_to_array(translate(body, '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM lines),
marked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY number) AS place FROM (
  SELECT *, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY number) AS upto FROM numbered) WHERE list_has_any(w, [{_ANCHORS}])),
spans AS (SELECT f.doc_id, f.number, f.place, l.number AS last, (SELECT list(x ORDER BY n.number, x_at) FROM (SELECT number, unnest(w) AS x, generate_subscripts(w, 1) AS x_at FROM numbered i WHERE i.doc_id = f.doc_id AND i.number BETWEEN f.number AND l.number) n) AS w
  FROM marked f JOIN marked l ON f.doc_id = l.doc_id AND l.place > f.place AND l.upto - f.upto + len(f.w) <= {license_scan.longest_run(license_scan.TEMPLATES, license_scan.THRESHOLD)}),
run_pairs AS (SELECT doc_id, number, place, last, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS mine FROM spans),
run_met AS (SELECT doc_id, number, place, last, license, len(list_intersect(mine, theirs)) AS shared, len(mine) AS a, len(theirs) AS b FROM run_pairs, templates),
run_best AS (SELECT *, 2 * shared::double / (a + b) AS score FROM run_met WHERE 2 * shared::double / (a + b) >= {license_scan.THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY 2 * shared::double / (a + b) DESC, last, license) = 1),
run_kept AS (SELECT r.* FROM run_best r LEFT JOIN run_best p ON p.doc_id = r.doc_id AND p.place = r.place - 1 AND p.last = r.last AND p.score >= r.score
  LEFT JOIN run_best n ON n.doc_id = r.doc_id AND n.place = r.place + 1 AND n.last = r.last AND n.score > r.score WHERE p.doc_id IS NULL AND n.doc_id IS NULL)
SELECT doc_id, kind, number::int AS number, NULL::int AS last, license, shared::int AS shared, a::int AS unit_bigrams, round(score, 6) AS dice FROM best WHERE r = 1 AND score >= {license_scan.THRESHOLD}
UNION ALL SELECT doc_id, 'run', number::int, last::int, license, shared::int, a::int, round(score, 6) FROM run_kept"""

OP7_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::int AS rank, vec_id, score FROM r WHERE rank <= 5"""

OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::bigint AS label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS (SELECT vec_id, label, e FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label, e) AS r FROM v) WHERE r = 1),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])), 0)::bigint AS score FROM one a JOIN one c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

ORACLES = {"op2_host_reputation": OP2_SQL, "op7_segment_search": OP7_SQL, "op9_license_scan": OP9_SQL, "op13_bond_scan": OP13_SQL}
