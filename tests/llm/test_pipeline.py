"""Every stage on the rows its predecessor kept, and on odd tables."""

import os
import subprocess
import sys

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline as cp
from shelfrank.llm import compression_bands as cb, length_buckets as lb, queries, simhash_index as si

SF = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.abspath(cp.__file__))


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives, by name."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        made = stage(spark, docs, SF).persist()
        out[name] = docs, made
        docs = made
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["quality rules", "quality classifier", "SimHash near-dedup", "secret scans", "packing"]
    assert all(stages[n][1].columns == list(cp.COLUMNS) for n, _ in cp.STAGES[:-1])


def test_rules_stage(stages):
    before, after = stages["quality rules"]
    pack = zstandard.ZstdCompressor(level=3, write_content_size=False).compress

    def keeps(text):
        raw = (text or "").encode()
        made = cb.counts(raw)
        return made[0] >= 50 and 2 * made[4] <= made[0] and cb.band_verdict(raw, pack)[3]

    assert ids(after) == sorted(r.doc_id for r in before.collect() if keeps(r.text))


def test_classifier_stage(spark, stages):
    before, after = stages["quality classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(after))
    known = {i: labels[i] for i in ids(before) if i in labels}
    for label in (0, 1):
        mine = [i for i, y in known.items() if y == label]
        assert sum((i in kept) == bool(label) for i in mine) >= 0.85 * len(mine)


def test_duplicates_stage(stages):
    before, after = stages["SimHash near-dedup"]
    groups = si.near_groups(before).collect()
    assert ids(after) == sorted({r.component_id for r in groups})
    whole = {r.doc_id: r for r in before.collect()}
    assert all(whole[r.doc_id] == r for r in after.collect())


def test_secrets_stage(stages):
    before, after = stages["secret scans"]
    old, new = ({r.doc_id: r for r in df.collect()} for df in (before, after))
    assert old.keys() == new.keys()
    changed = [i for i in old if old[i].text != new[i].text]
    assert changed and all("[SECRET]" in new[i].text for i in changed)
    assert all(r.n_chars == len(r.text) for r in new.values()) and all(old[i] == new[i] for i in old if i not in changed)
    assert not any('token = "' + c in r.text for r in new.values() for c in "0123456789abcdef")


def test_packing_stage(stages):
    before, after = stages["packing"]
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(ids(before))
    tokens = {r.doc_id: len(r.text.encode().split()) for r in before.collect()}
    assert sum(r.tokens for r in rows) == sum(tokens.values()) and all(r.tokens <= lb.WINDOW for r in rows)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(queries.pipeline(spark, SF).collect(), key=str) == sorted(stages["packing"][1].collect(), key=str)


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_odd_tables(spark, name):
    stage = dict(cp.STAGES)[name]
    good = " ".join(f"word{i} and{i % 7}" for i in range(80))
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (2, good, None, None, None, 1), (2, good, None, None, None, 1), (None, good + " more", "en", "s", 1, 1), (3, good * 300, "en", "s", 1, 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id int")
    made = stage(spark, frame, SF)
    assert made.count() <= len(rows) * 40
    assert name == "packing" or made.columns == list(cp.COLUMNS)
    assert stage(spark, frame.filter(F.lit(False)), SF).count() == 0


def test_entry_works_without_the_folder(tmp_path):
    """The entry file imports and keeps its other queries where the folder and the pipeline are gone."""
    for name in ("shelfrank", "checks"):
        for folder, _, files in os.walk(os.path.join(ROOT, name)):
            if "llm" in folder.split(os.sep) or "__pycache__" in folder:
                continue
            to = tmp_path / os.path.relpath(folder, ROOT)
            to.mkdir(parents=True, exist_ok=True)
            for f in files:
                (to / f).write_bytes(open(os.path.join(folder, f), "rb").read())
    (tmp_path / "__spark_entry__.py").write_bytes(open(os.path.join(ROOT, "__spark_entry__.py"), "rb").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'eval_systems' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
