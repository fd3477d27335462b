"""Prompts for link triage and hypotheses, and the reading of a model's answers; the model itself is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINK_TYPES = ("derives from", "generalizes", "analogous to", "couples to", "tensions with", "predicts for", "constrains", "implements", "tests")
NO_LINK = "no link"
ANSWER = "array<struct<pair:int,link_type:string,confidence:double,reason:string>>"
#: Hypothesis templates by sorted type pair; {a} and {b} are the titles. Pairs without one take the base templates.
BASE = (
    "What common structure makes {a} and {b} alike?", "Does a limit of {a} reproduce {b}?", "Which measurement would tell {a} and {b} apart?",
    "Is there a variable that both {a} and {b} depend on?", "Would a counterexample to {a} also break {b}?", "Which scale links {a} and {b}?",
)
BY_PAIR = {
    ("law", "reference_law"): ("Is {a} a special case of {b}?", "Which assumption of {b} does {a} drop?"),
    ("open_question", "reference_law"): ("Would {b} answer {a} if it held beyond its domain?", "Which prediction of {b} bears on {a}?"),
    ("method", "reference_law"): ("Can {a} measure what {b} predicts?",),
    ("mechanism", "reference_law"): ("Does {a} explain why {b} holds?",),
}


def few_shot_examples(entries: DataFrame, links: DataFrame, sections: DataFrame, most: int = 2, names: tuple[str, str] = ("What It Claims", "Mathematical Form")) -> DataFrame:
    """(link_type, rank, source_title, target_title, texts): at most two known links a type, those with texts first.

    Four outer joins bring the two ends' first and second section; the section's name is part of each joined side.
    """
    e = lambda p: entries.select(F.col("id").alias(f"{p}_id"), F.col("title").alias(f"{p}_title"))
    out = links.join(e("source"), "source_id").join(e("target"), "target_id")
    for p in ("source", "target"):
        for k, name in enumerate(names):
            side = sections.filter(F.col("section_name") == name).select(F.col("entry_id").alias(f"{p}_id"), F.col("content").alias(f"{p}_{k}"))
            out = out.join(side, f"{p}_id", "left")
    full = (F.col("source_0").isNotNull() & F.col("target_0").isNotNull()).cast("int")
    more = (F.col("source_1").isNotNull() & F.col("target_1").isNotNull()).cast("int")
    rank = F.row_number().over(Window.partitionBy("link_type").orderBy(full.desc(), more.desc(), "source_id", "target_id"))
    out = out.withColumn("rank", rank).filter(F.col("rank") <= most)
    return out.select("link_type", "rank", "source_title", "target_title", "source_0", "target_0", "source_1", "target_1")


def hypothesis_prompts(pairs: DataFrame, titles: DataFrame, most: int = 6) -> DataFrame:
    """(id, other, number, prompt): for pairs (id, other, t1, t2) the templates of their types, filled up with base ones."""
    rows = [(a, b, k, t) for (a, b), own in BY_PAIR.items() for k, t in enumerate([*own, *BASE][:most])]
    table = pairs.sparkSession.createDataFrame(rows, "t1 string, t2 string, number int, template string")
    base = F.array(*[F.struct(F.lit(k).alias("number"), F.lit(t).alias("template")) for k, t in enumerate(BASE[:most])])
    own = table.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("number", "template"))).alias("own"))
    j = pairs.join(own, ["t1", "t2"], "left").withColumn("x", F.explode(F.coalesce("own", base)))
    name = lambda c, p: titles.select(F.col("id").alias(c), F.col("title").alias(p))
    j = j.join(name("id", "ta"), "id", "left").join(name("other", "tb"), "other", "left")
    text = F.replace(F.replace("x.template", F.lit("{a}"), F.coalesce("ta", F.col("id").cast("string"))), F.lit("{b}"), F.coalesce("tb", F.col("other").cast("string")))
    return j.select("id", "other", F.col("x.number").alias("number"), text.alias("prompt"))


def triage_prompts(candidates: DataFrame, titles: DataFrame, size: int = 20) -> DataFrame:
    """(chunk, prompt, pairs): candidates (id, other, similarity), most alike first, in prompts of 20 pairs each.

    Candidates are a bounded top list (100 by default), so one window over them numbers the pairs.
    """
    name = lambda c, p: titles.select(F.col("id").alias(c), F.col("title").alias(p))
    j = candidates.join(name("id", "ta"), "id", "left").join(name("other", "tb"), "other", "left")
    n = F.row_number().over(Window.orderBy(F.desc("similarity"), "id", "other")) - 1
    j = j.withColumn("n", n).withColumns({"chunk": F.floor(F.col("n") / size), "pair": (F.col("n") % size).cast("int")})
    line = F.format_string("%d. %s | %s (similarity %.4f)", "pair", F.coalesce("ta", F.lit("?")), F.coalesce("tb", F.lit("?")), "similarity")
    ordered = F.array_sort(F.collect_list(F.struct("pair", line.alias("line"), F.struct("id", "other").alias("ends"))))
    out = j.groupBy("chunk").agg(ordered.alias("x"))
    head = f"Name for each pair one of: {', '.join(LINK_TYPES)}, {NO_LINK}. Answer with a JSON list of pair, link_type, confidence, reason.\n"
    return out.select("chunk", F.concat(F.lit(head), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("prompt"), F.transform("x", lambda r: r["ends"]).alias("pairs"))


def read_answers(answers: DataFrame) -> DataFrame:
    """(source_id, target_id, link_type, confidence, reason) of answers (chunk, pairs, answer): code fences are stripped;
    a type that isn't known, a pair that the answer leaves out, and an answer that isn't JSON, are no link of confidence 0.

    Every pair asked for comes back once; of several answers to one pair the first counts."""
    bare = F.regexp_replace(F.regexp_replace(F.trim("answer"), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    each = answers.withColumn("found", F.from_json(bare, ANSWER)).select("found", F.posexplode("pairs").alias("pair", "ends"))
    got = each.withColumn("a", F.get(F.filter("found", lambda x: x["pair"] == F.col("pair")), F.lit(0)))
    ends, known = F.col("ends"), F.col("a.link_type").isin(*LINK_TYPES)
    kind = F.when(known, F.col("a.link_type")).otherwise(NO_LINK)
    return got.select(ends["id"].alias("source_id"), ends["other"].alias("target_id"), kind.alias("link_type"), F.coalesce("a.confidence", F.lit(0.0)).alias("confidence"), F.col("a.reason").alias("reason"))


def review_queue(classified: DataFrame, least: float = 0.5, sure: float = 0.8) -> DataFrame:
    """Links that are probable but not sure, most probable first."""
    c = F.col("confidence")
    return classified.filter((F.col("link_type") != NO_LINK) & (c >= least) & (c < sure)).orderBy(F.desc("confidence"), "source_id", "target_id")
