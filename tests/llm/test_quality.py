import re
from collections import Counter

import duckdb

from cohera.llm import quality

SPACE = "[ \t\n\x0b\x0c\r]+"


def brute(text):
    words = [w for w in re.split(SPACE, text or "") if w]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.sub(SPACE, "", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_features(spark, odd_docs, no_docs):
    more = [(20, "a b c a b c"), (21, "a a a a"), (22, "x\ny\nx\n \n\nx"), (23, "#*$%&|<> #"), (24, "a b c d"), (25, "a b c b c a b c")]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + more
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = sorted(map(repr, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(docs).collect())))
    assert got == sorted(repr((i, *brute(t))) for i, t in rows)
    assert quality.judge(no_docs).count() == 0
    assert quality.keep_good(no_docs).columns == no_docs.columns


def test_hosts_shrink_towards_the_corpus(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, good, "fine") for i in range(200)] + [(i, bad, "junk") for i in range(200, 260)] + [(300, good, "junk"), (301, bad, "new"), (302, good, "new"), (303, good, None), (304, bad, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert kept == {*range(200), 302, 303}  # the one good document of the junk host goes, the new host's stays
    hosts = {r["source"]: r for r in quality.host_verdicts(quality.text_features(docs)).filter("rule = 'base'").collect()}
    assert hosts["junk"]["shrunk_rate"] < 60 / 61 and 0 < hosts["fine"]["shrunk_rate"] < 0.05
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept


def test_each_rule_is_added_up_by_host(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "fine") for i in range(100)] + [(i, good + " | | | | | | | |", "tables") for i in range(100, 140)] + [(i, f"{good}\nmenu\nmenu\nmenu", "menus") for i in range(200, 240)]
    rows += [(300, good, "tables"), (301, good + " | | | | | | | |", "fine"), (302, good, "menus")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bad = {(r["source"], r["rule"]): (r["n_failed"], r["n_docs"]) for r in quality.host_verdicts(quality.text_features(docs)).filter("host_rejected").collect()}
    assert bad == {("tables", "symbols"): (40, 41), ("menus", "lines"): (40, 41)}
    assert {r.doc_id for r in quality.judge(docs).filter("kept").collect()} == {*range(100), 301}


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(quality.OP2_SQL).fetchall())
    assert sorted(tuple(r) for r in quality.op2_quality_rules(spark, sf_dir).collect()) == want


def test_no_python_in_the_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (quality.text_features(docs), quality.host_verdicts(quality.text_features(docs)), quality.judge(docs), quality.keep_good(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
