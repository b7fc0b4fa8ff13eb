"""Host reputation, secret scans and licence scans: SQL, brute force and odd rows; no Python on their plans."""

import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from shelfrank.llm import host_reputation as hr, license_scan as ls, queries, secret_scan as sc
from tools.verify import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_host_reputation", "op9_license_scan"])
def test_query_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["op2_host_reputation", "op6_secret_scan", "op9_license_scan"])
def test_no_python_on_the_plan(spark, name):
    text = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", text)


# Hosts


def test_host_path_and_rules(spark):
    urls = {
        "http://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/"),
        "https://example.net/en": ("example.net", "/en", "net/"),
        "http://net": ("net", "", None),
        "http://b.net?x=/a": ("b.net", "", None),
        "ftp://x.org/fr/": ("x.org", "/fr/", "org/fr/"),
        "http://xorg/fr/": ("xorg", "/fr/", None),
        "http://badexample.com/de/": ("badexample.com", "/de/", None),
        "http://c.example.com/de/1": ("c.example.com", "/de/1", "example.com/de/"),
        "a://b://c/d": ("b:", "//c/d", None),
        "no scheme": ("", "", None), None: ("", "", None), "://": ("", "", None), "x://É.COM/ü#": ("É.com", "/ü", None),
    }
    frame = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = hr.host_verdicts(frame, labels, queries.RULES).collect()
    assert {r.id: (r.host, r.path, r.rule) for r in got} == dict(enumerate(urls.values()))
    actions = {p: a for a, p in queries.RULES}
    assert all(r.verdict == actions.get(r.rule, "allow") and r.n_labelled == 0 for r in got)


def test_levels(spark):
    hosts = {"a.b.co.uk": ("a.b.co.uk", "b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk", "co.uk"), "x.y.com:80": ("x.y.com", "y.com", "com"), "u:p@y.com": ("y.com", "y.com", "com"), "local": ("local", "local", "local"), "": ("", "", "")}
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r[0]: tuple(r[1:]) for r in frame.select("host", *hr.levels_of(F.col("host"))).collect()} == hosts


def test_bad_hosts_are_blocked_and_strangers_follow_their_domain(spark):
    draw = random.Random(1)
    pages, labels = [], []
    for h in range(30):
        for p in range(40):
            i = len(pages)
            bad_domain = h >= 20
            pages.append((i, f"http://h{h}.{'spam' if bad_domain else 'fine'}.com/{p}"))
            good = draw.random() < (0.05 if bad_domain or h == 0 else 0.95)
            labels.append((i, int(good)))
    pages += [(9001, "http://new.spam.com/"), (9002, "http://new.fine.com/"), (9003, "http://once.fine.com/"), (None, "http://h0.fine.com/"), (9004, None)]
    labels += [(9003, 0), (None, 0), (9002, None), (9001, 7)]
    got = {r.id: r for r in hr.host_verdicts(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert got[0].verdict == "block" and got[45].verdict == "allow" and got[30 * 40 - 1].verdict == "block" and got[None].verdict == "block"
    assert got[9001].verdict == "block" and got[9002].verdict == "allow" and got[9003].verdict == "allow"
    assert got[9001].posterior_mean < got[9003].posterior_mean < got[9002].posterior_mean


def test_hosts_on_empty_tables(spark):
    pages, labels = spark.createDataFrame([], "page_id bigint, url string"), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert hr.host_verdicts(pages, labels).count() == 0


# Licences


def test_anchors_stand_in_every_match():
    for threshold in (0.6, 0.8, 0.95):
        anchors = set(ls.anchors_of(ls.TEMPLATES, threshold))
        for text in ls.TEMPLATES.values():
            grams = ls.bigrams_of(text)
            assert sum(not set(g.split()) & anchors for g in grams) < ls.bounds_of(len(grams), threshold)[0]


def test_licences_in_texts(spark):
    mit = ls.TEMPLATES["MIT"]
    wrapped = re.sub(r"((?:\S+ ){9}\S+) ", r"\1\n", ls.TEMPLATES["Apache-2.0 notice"].split("\n\n")[0] + " " + ls.TEMPLATES["Apache-2.0 notice"].split("\n\n")[1])
    texts = [
        (1, mit, "x"), (2, f"Some prose here.\n\n{wrapped}\n\nMore prose.", "x"), (3, "Intro\nRELEASED under the   M.I.T license!\nReleased under the MIT License", "x"),
        (4, None, "x"), (None, "", "x"), (5, "the license of this work is not known " * 30, "x"), (6, mit.replace("Software", "Program", 2), "x"), (6, mit.replace("Software", "Program", 2), "x"),
        (7, " ".join(f"prose{i}" for i in range(100000)) + "\nLicensed under CC BY-NC 4.0.", "x"),
    ]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string, kind string")
    got = sorted(((r.id, r.kind, r.number, r.license) for r in ls.license_scan(frame).collect()), key=str)
    assert got == sorted([(1, "text", 1, "MIT"), (2, "line", 3, "Apache-2.0 line"), (2, "block", 2, "Apache-2.0 notice"), (2, "text", 1, "Apache-2.0 notice"), (3, "line", 3, "MIT line"), (6, "text", 1, "MIT"), (6, "text", 1, "MIT"), (7, "line", 2, "CC-BY-NC-4.0 line")] + [(1, "run", 1, "MIT"), (2, "run", 3, "Apache-2.0 notice"), (6, "run", 1, "MIT"), (6, "run", 1, "MIT")], key=str)
    assert ls.license_scan(frame.filter(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        ls.license_scan(frame, templates={"x": "one"})


def test_every_template_inside_a_long_text_is_a_run(spark):
    """Also wrapped, with blank lines between its own, without blank lines around it, and twice in a row."""
    prose = "\n".join(" ".join(f"prose{i}x{j}" for j in range(20)) for i in range(30))
    shapes = {"plain": lambda t: t, "wrapped": lambda t: "\n".join(textwrap.fill(b, 60) for b in t.split("\n")), "wide": lambda t: t.replace("\n", "\n\n\n"), "twice": lambda t: t + "\n\n" + t}
    names = [n for n, t in ls.TEMPLATES.items() if "\n" in t]
    rows, wanted = [], {}
    for i, (name, shape) in enumerate((n, s) for n in names for s in shapes):
        body = shapes[shape](ls.TEMPLATES[name])
        gap = "\n" if i % 2 else "\n\n"
        rows.append((i, prose + gap + body + gap + prose, "x"))
        one = shapes["plain" if shape == "twice" else shape](ls.TEMPLATES[name]).count("\n")
        first = 30 + len(gap)
        wanted[i] = [(name, first, first + one)] + ([(name, first + one + 2, first + 2 * one + 2)] if shape == "twice" else [])
    got = ls.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string, kind string")).filter("kind = 'run'").collect()
    for i, places in wanted.items():
        mine = [r for r in got if r.id == i]
        for name, first, last in places:
            # A last line of one word may hold no anchor, or no bigram that is not there already.
            assert any(r.license == name and r.number == first and last - 1 <= r.last <= last and r.dice > 0.98 for r in mine), (i, name, mine)


def test_runs_do_not_depend_on_how_lines_are_grouped(spark, monkeypatch):
    draw = random.Random(9)
    pieces = [b for t in ls.TEMPLATES.values() for b in textwrap.wrap(t, 50)] + ["", "a plain line", "the source of this version"]
    rows = []
    for i in range(30):
        start = draw.randrange(len(pieces) - 40)
        rows.append((i, "\n".join(p for p in pieces[start : start + 40] if draw.random() < 0.95)))
    rows.append((30, "license\n" * 700 + "under the terms"))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(tuple, ls.license_scan(frame).collect()), key=str)
    monkeypatch.setattr(ls, "LINES_TOGETHER", 3)
    assert sorted(map(tuple, ls.license_scan(frame).collect()), key=str) == want and any(r[1] == "run" for r in want)
    con = connect(SF)
    con.register("made", frame.filter("doc_id < 30").toPandas())
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT doc_id::bigint AS doc_id, text FROM made")
    assert compare(ls.license_scan(frame.filter("doc_id < 30")).withColumnRenamed("id", "doc_id"), con, queries.OP9_SQL) == ""


def test_scan_matches_sql_on_odd_documents(spark):
    con = connect(SF)
    lines = [t.split("\n")[0] for t in ls.TEMPLATES.values()] + ["", " ", "all rights reserved", "Released under the MIT License, and more", "licensed under the apache license version 2", "é ü"]
    draw = random.Random(4)
    data = [(i, "\n".join(draw.choice(lines) for _ in range(draw.randint(0, 6)))) for i in range(120)]
    frame = spark.createDataFrame(data, "doc_id bigint, text string")
    con.register("made", frame.toPandas())
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT doc_id::bigint AS doc_id, text FROM made")
    assert compare(ls.license_scan(frame).withColumnRenamed("id", "doc_id"), con, queries.OP9_SQL) == ""


# Secrets


def test_candidates_have_their_place(spark):
    text = "é token = \"" + "a1" * 12 + "\" then\nme@averylonghostname01.example.com and 1234567890123456!"
    frame = spark.createDataFrame([(1, text, "cfg"), (1, text, "cfg"), (2, None, "s"), (None, "", None), (3, "Z9" * 40000, None)], "doc_id bigint, text string, source string")
    got = sc.candidates(frame).collect()
    mine = sorted((r for r in got if r.id == 1), key=lambda r: r.position)
    assert [text[r.start : r.end] for r in mine] == [r.candidate for r in mine] == ["a1" * 12, "averylonghostname01", "1234567890123456"]
    assert [r.position for r in mine] == [0, 1, 2] and mine[0].before.endswith('token = "') and mine[0].after.startswith('" then')
    assert [(r.start, r.end) for r in got if r.id == 3] == [(0, 80000)] and len(got) == 4


def made_documents():
    draw = random.Random(6)
    words = ["configuration", "the", "service", "international", "runs", "and", "reads", "characterization", "misunderstandings"]
    key = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    rows, secrets = [], {}
    for i in range(300):
        body = " ".join(draw.choice(words) for _ in range(60))
        if i % 3 == 0:
            secrets[i] = key(32)
            body += f' {draw.choice(["token", "api_key", "password"])} = "{secrets[i]}" ' + body
        if i % 3 == 1:
            body += f" order {draw.randrange(10**15, 10**16)} from mail.averylonghostname{i}.example.com commit {draw.randbytes(20).hex()}"
        rows.append((i, body, "en", "app.env" if i % 2 else "notes.txt", len(body)))
    return rows, secrets


def test_secrets_are_found_and_nothing_else(spark):
    rows, secrets = made_documents()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    findings = sc.secret_scan(frame)
    got = findings.filter("secret").collect()
    assert {r.id: r.candidate for r in got} == secrets and len(got) == len(secrets)
    clean = {r.doc_id: r.text for r in sc.redacted(frame, findings).collect()}
    assert clean == {r[0]: r[1].replace(secrets[r[0]], "[SECRET]") if r[0] in secrets else r[1] for r in rows}


def test_forest_judges_findings_without_clear_surroundings(spark):
    """Quoted strings without a telling name: a random one is more likely a secret than words joined by dashes."""
    rows, _ = made_documents()
    draw = random.Random(8)
    rows += [(1000, f'it says "{draw.randbytes(20).hex()}" there', "en", "x", 1), (1001, 'it says "configuration-and-the-service" there', "en", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.id: r.score for r in sc.secret_scan(frame).filter("id >= 1000").collect()}
    assert got[1000] > got[1001]


def test_reviewed_findings_train_the_forest(spark):
    rows, secrets = made_documents()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    reviewed = sc.candidates(frame).withColumn("label", F.rlike("candidate", F.lit("^[0-9]{16}$")).cast("int"))
    got = sc.secret_scan(frame, labelled=reviewed).filter("secret").collect()
    assert got and all(re.fullmatch("[0-9]{16}", r.candidate) for r in got)


def test_secrets_on_odd_tables(spark):
    frame = spark.createDataFrame([(None, None, None, 1), (1, "", "s", 1), (2, "plain words only", "s", 1)], "doc_id bigint, text string, source string, score int")
    found = sc.secret_scan(frame)
    assert found.count() == 0 and sorted(sc.redacted(frame, found).collect(), key=str) == sorted(frame.collect(), key=str)
    one = spark.createDataFrame([(1, 'password: "abcdefgh12345678XY"', "s", 1)] * 2, "doc_id bigint, text string, source string, score int")
    found = sc.secret_scan(one)
    assert [(r.position, r.label, r.secret) for r in found.collect()] == [(0, 1, True)]
    assert [r.text for r in sc.redacted(one, found).collect()] == ['password: "[SECRET]"'] * 2
    assert sc.secret_scan(one.filter(F.lit(False))).count() == 0


def test_forms_of_secrets(spark):
    """Short values, the form of .env files, dotted tokens; every form is redacted from its text."""
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    forms = [
        ('password = "%s"', "Tr0ub4dor&3x"), ('pwd: "%s"', "s3cr3t-P4ss"), ("API_KEY=%s", "9f86d081884c7d659a2feaa0c55ad015"), ('token = "%s"', jwt),
        ("AWS_SECRET_ACCESS_KEY=%s\n", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYzzKEY1"), ('{"api_key":"%s"}', "k3y!k3y!9"), ("password: %s then", "hunter2hunter"), ("secret = '%s'", 'a"b8c$d9e'),
    ]
    rows, secrets = made_documents()
    rows += [(1000 + i, form % value, "en", "x", 1) for i, (form, value) in enumerate(forms)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    findings = sc.secret_scan(frame)
    got = {r.id: (r.candidate, r.label, r.secret) for r in findings.filter("id >= 1000").collect()}
    assert got == {1000 + i: (value, 1, True) for i, (_, value) in enumerate(forms)}
    clean = {r.doc_id: r.text for r in sc.redacted(frame, findings).filter("doc_id >= 1000").collect()}
    assert clean == {1000 + i: form % "[SECRET]" for i, (form, _) in enumerate(forms)}
