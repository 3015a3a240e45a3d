"""Record sources: the derived three-source business-records fixture, truth,
TSV readers/writers for the id-list files, and id-prefix helpers.

The fixture turns the driver's ``customer`` (S1) and ``orders`` (noisy S2/S3
copies) tables into records of the reference's shape. Its SQL is portable, so
Spark and the DuckDB oracle start from byte-identical inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType([
    T.StructField("entity_id", T.StringType()),
    T.StructField("business_name", T.StringType()),
    T.StructField("business_address", T.StringType()),
    T.StructField("country", T.StringType()),
])

TRUTH_SCHEMA = T.StructType([
    T.StructField("source1_entity_id", T.StringType()),
    T.StructField("matched_entity_ids", T.StringType()),
])

# Portable fixture body (Spark SQL and DuckDB). ``{customer}``/``{orders}``
# are table references filled in by each engine.
RECORDS_SQL = """
WITH base AS (
  SELECT c_custkey,
    split_part('maure,dahlia,payne,raj,ness,olive,harbor,cedar,summit,delta,nova,orchid,lotus,banyan,ganga,kaveri,lumiere,soleil,verre,chene,atlas,bright,copper,dover,ember,falcon,granite,hazel,indigo,juniper,karma,linden,mango,nectar,opal,prairie,quartz,river,sage,tulip', ',', CAST(c_custkey % 40 AS INT) + 1) AS w1,
    split_part('williams,power,food,mgmt,tech,dairy,steel,paper,travel,auto,textile,garden,media,med,marine,energy,cargo,toys,books,optics,audio,solar,timber,glass,grain,pharma,dental,legal,design,print,farm,fish,rubber,wool,silk,tea,spice', ',', CAST((c_custkey * 7) % 37 AS INT) + 1) AS w2,
    split_part('colombier,reliable,scientific,traders,works,mart,house,depot,agency,studio,bazaar,corner,gallery,labs,mills,point,union,valley,world,yard,zone,bridge,court,field,gate,hill,lake,park,view', ',', CAST((c_custkey * 11) % 29 AS INT) + 1) AS w3,
    split_part(' Inc, LLC, Pvt Ltd, LLP,, Services Pvt. Ltd., & Sons', ',', CAST(c_custkey % 7 AS INT) + 1) AS sfx,
    split_part('Wayne Avenue,45th Terrace,Fremont Street,Main Road Mylapore,Rue Victor,Lake View Marg', ',', CAST(c_custkey % 6 AS INT) + 1) AS street,
    split_part('Ticonderoga,Kansas City,Peoria,Chennai,Ghaziabad,Lyon,Nantes', ',', CAST((c_custkey * 3) % 7 AS INT) + 1) AS city,
    split_part('US,India,France', ',', CAST(c_custkey % 3 AS INT) + 1) AS country,
    CASE WHEN c_custkey % 13 = 0 THEN concat(', ', CAST(10000 + (c_custkey * 37) % 80000 AS STRING))
         WHEN c_custkey % 17 = 0 THEN concat(', ', CAST(400000 + c_custkey % 9999 AS STRING))
         WHEN c_custkey % 19 = 0 THEN ', Ph. 989, 9487203' ELSE '' END AS post
  FROM {customer}),
s1 AS (
  SELECT c_custkey, concat('S1-', CAST(c_custkey AS STRING)) AS entity_id,
    concat(upper(substr(w1, 1, 1)), substr(w1, 2), ' ', w2, ' ', w3, sfx) AS business_name,
    concat(CAST(100 + c_custkey % 899 AS STRING), ' ', street, ', ', city, post) AS business_address, country,
    w1, w2, w3, street, city, post
  FROM base),
t AS (
  SELECT concat('S', CAST(2 + o_orderkey % 2 AS STRING), '-', CAST(o_orderkey AS STRING)) AS entity_id,
    CASE o_orderkey % 8 WHEN 1 THEN concat(w1, ' ', w2, ' ', w3) WHEN 2 THEN upper(business_name)
      WHEN 3 THEN replace(business_name, w2, concat('x', w2)) WHEN 5 THEN replace(replace(business_name, 'e', 'é'), 'a', 'à')
      WHEN 6 THEN concat(w3, ' ', w2, ' ', w1) WHEN 7 THEN concat(w1, ' ', w2) ELSE business_name END AS business_name,
    CASE o_orderkey % 8 WHEN 2 THEN replace(upper(business_address), 'STREET', 'ST') WHEN 4 THEN CAST(NULL AS STRING)
      WHEN 6 THEN concat(city, ', ', street, ', null') ELSE business_address END AS business_address,
    country, c_custkey
  FROM {orders} JOIN s1 ON o_custkey = c_custkey
  WHERE o_custkey % 18 <> 5)
SELECT entity_id, 1 AS src, business_name, business_address, country, c_custkey AS truth_key FROM s1
UNION ALL
SELECT entity_id, CAST(substr(entity_id, 2, 1) AS INT) AS src, business_name, business_address, country, c_custkey FROM t
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records: ``entity_id, src, business_name, business_address, country, truth_key``.

    ``truth_key`` is the hidden link used only to build the ground truth; it
    never feeds blocking or features.
    """
    cust = table(spark, sf_dir, "customer").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return spark.sql(RECORDS_SQL, customer=cust, orders=orders)


def source1(recs: DataFrame) -> DataFrame:
    return recs.where(F.col("src") == 1)


def targets(recs: DataFrame) -> DataFrame:
    """S2 UNION ALL S3 (U01): the index side of blocking."""
    s2 = recs.where(F.col("src") == 2)
    s3 = recs.where(F.col("src") == 3)
    return s2.unionByName(s3)


def truth_long(recs: DataFrame) -> DataFrame:
    """True pairs ``(s1_id, cand_id)``: S1 joined to S2/S3 on the hidden link."""
    s1 = source1(recs).select(F.col("entity_id").alias("s1_id"), "truth_key")
    t = recs.where(F.col("src") != 1).select(F.col("entity_id").alias("cand_id"), "truth_key")
    return s1.join(t, "truth_key").select("s1_id", "cand_id")


def truth_wide(recs: DataFrame) -> DataFrame:
    """Ground-truth file shape: one row per S1, comma list or null for singletons.

    The per-S1 list is bounded by the number of true matches of one entity.
    """
    s1 = source1(recs).select(F.col("entity_id").alias("source1_entity_id"))
    lists = (truth_long(recs)
             .groupBy(F.col("s1_id").alias("source1_entity_id"))
             .agg(F.array_join(F.sort_array(F.collect_list("cand_id")), ",")
                  .alias("matched_entity_ids")))
    return s1.join(lists, "source1_entity_id", "left")


def parse_truth(wide: DataFrame) -> DataFrame:
    """Wide truth -> long ``(s1_id, cand_id)`` with set semantics."""
    from matchbook.functions.text import parse_id_list
    return (wide.select(F.trim("source1_entity_id").alias("s1_id"),
                        F.explode(parse_id_list(F.col("matched_entity_ids"))).alias("cand_id")))


def source_of(c: Column) -> Column:
    """``S1``/``S2``/``S3`` from the id prefix, null otherwise."""
    s = F.regexp_extract(c, r"^(S[123])-", 1)
    return F.when(s != "", s)


# ---------------------------------------------------------------------------
# TSV files of the reference's shape
# ---------------------------------------------------------------------------

def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header, tab, all strings, no quoting (a stray quote must not swallow tabs)."""
    return (spark.read.schema(schema).option("sep", "\t").option("header", True)
            .option("quote", "").option("mode", "PERMISSIVE").csv(path))


def write_id_lists(df: DataFrame, path: str, id_col: str, list_col: str) -> None:
    """Write an id-list table: bare tabs, empty list as an empty field."""
    (df.select(id_col, F.coalesce(F.col(list_col), F.lit("")).alias(list_col))
       .write.mode("overwrite").option("sep", "\t").option("header", True)
       .option("quote", "").option("emptyValue", "").option("nullValue", "")
       .csv(path))
