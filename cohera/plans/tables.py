"""The driver's tables seen as entries, links, properties, vectors and bridges; each with the DuckDB SQL for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, entry_type, source_type, domain): one entry a row of region, nation, supplier, customer and part."""
    t = lambda n: read(spark, sf_dir, n)
    region = t("region")
    nation = t("nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))

    def made(df: DataFrame, kind: str, key: str, title: str, source: str, domain) -> DataFrame:
        return df.select(_id(kind, key).alias("id"), F.col(title).alias("title"), F.lit(kind).alias("entry_type"), F.lit(source).alias("source_type"), domain.alias("domain"))

    supplier = t("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    parts = [
        made(region, "region", "r_regionkey", "r_name", "place", F.col("r_name")),
        made(nation, "nation", "n_nationkey", "n_name", "place", F.col("r_name")),
        made(supplier, "supplier", "s_suppkey", "s_name", "party", F.col("r_name")),
        made(t("customer"), "customer", "c_custkey", "c_name", "party", F.col("c_mktsegment")),
        made(t("part"), "part", "p_partkey", "p_name", "item", F.col("p_brand")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ENTRIES_SQL = """entries AS (
  SELECT 'region_' || r_regionkey AS id, r_name AS title, 'region' AS entry_type, 'place' AS source_type, r_name AS domain FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, n_name, 'nation', 'place', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'supplier_' || s_suppkey, s_name, 'supplier', 'party', r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer_' || c_custkey, c_name, 'customer', 'party', c_mktsegment FROM customer
  UNION ALL SELECT 'part_' || p_partkey, p_name, 'part', 'item', p_brand FROM part)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(link_type, source_id, target_id, confidence_tier): nation to region, supplier and (of some balance) customer to nation."""
    t = lambda n: read(spark, sf_dir, n)

    def made(df: DataFrame, kind: str, src, dst, tier) -> DataFrame:
        return df.select(F.lit(kind).alias("link_type"), src.alias("source_id"), dst.alias("target_id"), tier.cast("string").alias("confidence_tier"))

    n = made(t("nation"), "derives from", _id("nation", "n_nationkey"), _id("region", "n_regionkey"), F.lit("1"))
    s = made(t("supplier"), "couples to", _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), F.lit("1.5"))
    c = made(t("customer").filter("c_acctbal >= 1000"), "analogous to", _id("customer", "c_custkey"), _id("nation", "c_nationkey"), F.when(F.col("c_acctbal") >= 5000, "2"))
    return n.unionByName(s).unionByName(c)


LINKS_SQL = """links AS (
  SELECT 'derives from' AS link_type, 'nation_' || n_nationkey AS source_id, 'region_' || n_regionkey AS target_id, '1' AS confidence_tier FROM nation
  UNION ALL SELECT 'couples to', 'supplier_' || s_suppkey, 'nation_' || s_nationkey, '1.5' FROM supplier
  UNION ALL SELECT 'analogous to', 'customer_' || c_custkey, 'nation_' || c_nationkey, CASE WHEN c_acctbal >= 5000 THEN '2' END FROM customer WHERE c_acctbal >= 1000)"""


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, property_name, property_value): attributes of parts, customers and suppliers, some left out or empty."""
    t = lambda n: read(spark, sf_dir, n)
    part = t("part").select(_id("part", "p_partkey").alias("entry_id"), F.expr(
        "stack(3, 'mathematical_archetype', p_type, 'dimensional_sensitivity', CASE WHEN p_size % 3 = 0 THEN 'Yes' WHEN p_size % 3 = 1 THEN 'no' ELSE '' END,"
        " 'concept_tags', CASE WHEN p_size < 40 THEN CAST(p_size AS STRING) END) AS (property_name, property_value)"
    ))
    customer = t("customer").filter("c_acctbal < 8000").select(_id("customer", "c_custkey").alias("entry_id"), F.lit("mathematical_archetype").alias("property_name"), F.col("c_mktsegment").alias("property_value"))
    supplier = t("supplier").filter("s_acctbal < 2500").select(_id("supplier", "s_suppkey").alias("entry_id"), F.lit("concept_tags").alias("property_name"), F.col("s_nationkey").cast("string").alias("property_value"))
    return part.unionByName(customer).unionByName(supplier)


PROPERTIES_SQL = """props AS (
  SELECT 'part_' || p_partkey AS entry_id, 'mathematical_archetype' AS property_name, p_type AS property_value FROM part
  UNION ALL SELECT 'part_' || p_partkey, 'dimensional_sensitivity', CASE WHEN p_size % 3 = 0 THEN 'Yes' WHEN p_size % 3 = 1 THEN 'no' ELSE '' END FROM part
  UNION ALL SELECT 'part_' || p_partkey, 'concept_tags', CASE WHEN p_size < 40 THEN CAST(p_size AS VARCHAR) END FROM part
  UNION ALL SELECT 'customer_' || c_custkey, 'mathematical_archetype', c_mktsegment FROM customer WHERE c_acctbal < 8000
  UNION ALL SELECT 'supplier_' || s_suppkey, 'concept_tags', CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_acctbal < 2500)"""


def trade_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, target_id, confidence_tier): each supplier nation's three largest customer nations by revenue.

    lineitem meets orders on the order key, the one large shuffle; the nation lookups are small. Revenue is summed
    before the nations are ranked.
    """
    t = lambda n: read(spark, sf_dir, n)
    line = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    line = line.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    buyer = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    flow = line.join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).filter("s_nationkey <> c_nationkey")
    flow = flow.groupBy("s_nationkey", "c_nationkey").agg(F.sum("rev").alias("rev"))
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("rev"), "c_nationkey"))
    top = flow.withColumn("r", rank).filter("r <= 3")
    tier = F.element_at(F.array(F.lit("1"), F.lit("1.5"), F.lit("2")), F.col("r"))
    return top.select(_id("nation", "s_nationkey").alias("source_id"), _id("nation", "c_nationkey").alias("target_id"), tier.alias("confidence_tier"))


TRADE_SQL = """flow AS (
  SELECT s_nationkey, c_nationkey, sum(l_extendedprice * (1 - l_discount)) AS rev
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
trade AS (
  SELECT 'nation_' || s_nationkey AS source_id, 'nation_' || c_nationkey AS target_id, CASE r WHEN 1 THEN '1' WHEN 2 THEN '1.5' ELSE '2' END AS confidence_tier
  FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY rev DESC, c_nationkey) AS r FROM flow) WHERE r <= 3),
nodes AS (SELECT 'nation_' || n_nationkey AS id, n_name AS title FROM nation),
edges AS (
  SELECT a, b, min(w) AS weight FROM (
    SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b,
           CASE confidence_tier WHEN '1' THEN 1.0 WHEN '1.5' THEN 1.5 WHEN '2' THEN 2.0 ELSE 3.0 END::DOUBLE AS w
    FROM trade WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)) GROUP BY 1, 2)"""


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(_id("nation", "n_nationkey").alias("id"), F.col("n_name").alias("title"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec, label) of the embeddings table."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
