"""Host-level quality rules, in DataFrame functions only.

Each document is judged by its own words, rule by rule; the failures of each rule are added up by host (the column
`source`), each host's failure rate is shrunk towards the corpus's by a beta prior that is estimated for the rule from
all hosts (method of moments), and a host whose shrunk rate passes a limit in any rule loses all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohera.plans.shared import cut, placed, salted_lookup, written

SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\f\r"
#: Largest and smallest strength (in documents) that the prior may have.
STRENGTH = (1.0, 10_000.0)
#: What a document of a host fails by: the base rules together, over a symbol to ten words, over 30 % repeated lines.
RULES = {
    "base": "base_failed",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
}


def _let(value: Column, body) -> Column:
    """Bind a value once for use inside a higher-order function."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more.

    Windows are compared by a 64-bit hash of their words (two different windows of an n-word text meet with a chance
    of n^2 / 2^65), sorted with their positions; covered words are summed over the repeated positions in order.
    """
    hashes = lambda w: F.transform(
        F.slice(w, 1, F.size(w) - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    )
    twice = lambda s: F.filter(
        F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()
    )
    covered = lambda p: F.aggregate(
        p, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    found = _let(words, lambda w: _let(F.sort_array(hashes(w)), lambda s: _let(F.sort_array(twice(s)), covered)))
    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(found)


def text_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without the text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed.

    Words are runs of characters other than space and \\t \\n \\v \\f \\r; a null text has none. Whole texts.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = [f"`{c}`" for c in docs.columns if c not in {text_col, *made}]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    body = F.trim(text, F.lit(SPACES))
    split = docs.select(*kept, text.alias("_t"), F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"[{SPACE}]+")).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    n = F.size("_w").cast("long")
    out = split.select(
        *kept, n.alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_l"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
    ).withColumns({"n_lines": F.col("_l.n"), "n_dup_lines": F.col("_l.dup")}).drop("_l")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_verdicts(judged: DataFrame, host_col: str = "source", limit: float = 0.5, rules: dict[str, str] | None = None) -> DataFrame:
    """Per host (a null host is none) and rule: n_docs, n_failed, shrunk_rate, and host_rejected (shrunk_rate > limit).

    Prior of a rule: mean m is the corpus's failure rate; the variance between hosts is the weighted variance of their
    rates less what binomial noise explains; the strength s = m (1 - m) / variance - 1 is held within STRENGTH. A
    host's rate is (failed + m s) / (docs + s). One row a host, summed map-side; of the priors one row a rule is
    joined back.
    """
    rules = rules or RULES
    failed = [F.coalesce(F.sum(F.expr(test).cast("long")), F.lit(0)).alias(f"_f{k}") for k, test in enumerate(rules.values())]
    hosts = judged.filter(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("_host")).agg(F.count(F.lit(1)).alias("n_docs"), *failed)
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"_f{k}").alias("n_failed")) for k, rule in enumerate(rules)])
    by_rule = cut(hosts.select("_host", "n_docs", F.inline(each)))
    n, rate = F.sum("n_docs").cast("double"), F.col("n_failed") / F.col("n_docs")
    sums = by_rule.groupBy("rule").agg((F.sum("n_failed") / n).alias("m"), (F.count(F.lit(1)) / n).alias("q"), (F.sum(F.col("n_failed") * rate) / n).alias("e"))
    m = F.col("m")
    between = sums.select("rule", "m", (F.col("e") - m * m - m * (1 - m) * F.col("q")).alias("v"))
    strength = F.when(F.col("v") > 0, F.least(F.greatest(m * (1 - m) / F.col("v") - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).otherwise(STRENGTH[1])
    shrunk = (F.col("n_failed") + m * F.col("s")) / (F.col("n_docs") + F.col("s"))
    out = by_rule.join(between.select("rule", "m", strength.alias("s")), "rule").withColumn("shrunk_rate", shrunk)
    return out.select(F.col("_host").alias(host_col), "rule", "n_docs", "n_failed", "shrunk_rate", (F.col("shrunk_rate") > limit).alias("host_rejected"))


def _rejected(judged: DataFrame, host_col: str, limit: float) -> DataFrame:
    """The rejected hosts (_host), each once."""
    return host_verdicts(judged, host_col, limit).filter("host_rejected").select(F.col(host_col).alias("_host"), "host_rejected").distinct()


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = 0.5) -> DataFrame:
    """Features of every row with base_failed and kept: false if base_failed or if the row's host is rejected.

    A document of a null host is judged by itself alone. Repeated rows are judged, and counted for their host, each.
    An empty table gives an empty one. The features are worked out once and cut off as narrow rows; the host table is
    joined back salted, so a host with a third of all documents is dealt over many tasks.
    """
    own = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{host_col}`").alias("host")).alias("_own"), F.col(f"`{text_col}`").alias("_text"))
    judged = cut(text_features(own, "_text").withColumn("_host", F.col("_own.host")))
    out = salted_lookup(judged, cut(_rejected(judged, "_host", limit)), "_host", "_own")
    names = [c for c in judged.columns if c not in ("_own", "_host")]
    kept = ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))
    keys = [F.col(f"_own.{k}").alias(c) for k, c in (("id", id_col), ("host", host_col)) if c not in (*names, "kept")]
    return out.select(*keys, *names, kept.alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: float = 0.5) -> DataFrame:
    """The rows of `docs` that `judge` would keep, with all their columns. Hosts are judged over all of `docs`.

    Rows are told apart by place. Texts are read for the features once and not shuffled for the hosts' sake: verdicts
    are joined to narrow rows, and only the places of lost rows come back.
    """
    rows = placed(docs)
    narrow = text_features(rows.select("_at", F.col(f"`{text_col}`").alias("_text"), F.col(f"`{host_col}`").alias("_host")), "_text")
    narrow = written(narrow.select("_at", "_host", "n_words", "n_symbols", "n_lines", "n_dup_lines", "base_failed"), "judged")
    hosts = written(_rejected(narrow, "_host", limit), "hosts")
    lost = salted_lookup(narrow, hosts, "_host", "_at").filter(F.col("base_failed") | F.coalesce("host_rejected", F.lit(False)))
    return rows.join(written(lost.select("_at"), "lost"), "_at", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: DuckDB SQL for the rows of op2_quality_rules.
OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (
          SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
f AS (
  SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d) d LEFT JOIN rep USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
x AS (
  SELECT source, 'base' AS rule, base_failed AS failed FROM j UNION ALL SELECT source, 'symbols', 10 * n_symbols > n_words FROM j
  UNION ALL SELECT source, 'lines', 100 * n_dup_lines > 30 * n_lines FROM j),
h AS (SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(failed AS INT)) AS DOUBLE) AS k FROM x WHERE source IS NOT NULL GROUP BY ALL),
p AS (SELECT rule, sum(k) / sum(n) AS m, count(*) / sum(n) AS q, sum(k * k / n) / sum(n) AS e FROM h GROUP BY rule),
v AS (SELECT rule, m, greatest(e - m * m - m * (1 - m) * q, 0) AS v FROM p),
s AS (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 10000) ELSE 10000 END AS s FROM v),
bad AS (SELECT source FROM h JOIN s USING (rule) WHERE (k + m * s) / (n + s) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM j
"""
