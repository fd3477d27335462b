from cohera import cli
from cohera.operators import prompts
from cohera.sources import bundle


def test_examples_prompts_and_answers(spark):
    e = spark.createDataFrame([(i, i.upper()) for i in "abcd"], "id string, title string")
    k = spark.createDataFrame([("x", "a", "b"), ("x", "b", "c"), ("x", "c", "d"), ("y", "a", "d")], "link_type string, source_id string, target_id string")
    s = spark.createDataFrame([("c", "What It Claims", "c1"), ("d", "What It Claims", "d1")], "entry_id string, section_name string, content string")
    x = prompts.few_shot_examples(e, k, s).orderBy("link_type", "rank").collect()
    assert [(r.link_type, r.rank, r.source_title) for r in x] == [("x", 1, "C"), ("x", 2, "A"), ("y", 1, "A")] and x[0].target_0 == "d1"
    c = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("b", "d", 0.7)], "id string, other string, similarity double")
    t = prompts.triage_prompts(c, e, size=2).orderBy("chunk").collect()
    assert len(t) == 2 and "0. A | B (similarity 0.9000)" in t[0].prompt and len(t[1].pairs) == 1
    answer = '```json\n[{"pair": 0, "link_type": "couples to", "confidence": 0.7}, {"pair": 1, "link_type": "odd", "confidence": 0.9}, {"pair": 7, "link_type": "tests"}]\n```'
    got = prompts.read_answers(spark.createDataFrame([(t[0].pairs, answer), (t[0].pairs, "no json")], "pairs array<struct<id:string,other:string>>, answer string"))
    kinds = sorted((r.source_id, r.target_id, r.link_type) for r in got.collect())
    assert kinds == [("a", "b", "couples to"), ("a", "b", "no link"), ("a", "c", "no link"), ("a", "c", "no link")]  # the unread answer counts for both pairs
    assert prompts.review_queue(got).count() == 1
    h = prompts.hypothesis_prompts(spark.createDataFrame([("a", "b", "law", "reference_law"), ("c", "d", "q", "z")], "id string, other string, t1 string, t2 string"), e).collect()
    assert len(h) == 12 and any(r.prompt == "Is A a special case of B?" for r in h)


def test_command_line(spark, tmp_path, capsys):
    path = f"{tmp_path}/b"
    bundle.create_bundle(spark, path, "n", "s", "f")
    bundle.insert_or_ignore(spark, path, "entries", spark.createDataFrame([(i, i) for i in "abc"], "id string, title string"))
    bundle.insert_or_ignore(spark, path, "links", spark.createDataFrame([("x", "a", "b"), ("x", "b", "c"), ("x", "c", "a")], "link_type string, source_id string, target_id string"))
    cli.main(["internal", path, "--format", "json"])
    assert '"n_analyzed":3' in capsys.readouterr().out
    cli.main(["report", path, path])
    assert "tier1_verdict" in capsys.readouterr().out
