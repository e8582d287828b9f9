"""Posting tables derived from the driver's star schema.

Orders stand in for postings, customers for posting urls and saved searches, nations
and regions for neighborhoods and boroughs. The DuckDB text of each view is kept next
to its DataFrame so that both sides compute the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The registry "knows" postings seen before this day; later ones arrive in the run.
SPLIT_DAY = "1998-05-01"
# "Now" of freshness and change records.
AS_OF = "2001-08-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def postings_view(spark: SparkSession, sf_dir: str, place: bool = True) -> DataFrame:
    """Orders as postings; without ``place`` there is no join, and borough and neighborhood are null."""
    orders = table(spark, sf_dir, "orders")
    if not place:
        return _posting_columns(
            orders.withColumns({"neighborhood": F.lit(None).cast("string"), "borough": F.lit(None).cast("string")})
        )
    places = (
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("n_name").alias("neighborhood"), F.col("r_name").alias("borough"))
    )
    return _posting_columns(orders.join(places, F.col("o_custkey") == F.col("c_custkey"), "left"))


def _posting_columns(orders: DataFrame) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    listing_id = F.lpad(key.cast("string"), 20, "0")
    image = lambda n: F.concat(F.lit("img/"), (cust % n).cast("string"), F.lit(".jpg"))
    return orders.select(
        listing_id.alias("listing_id"),
        F.col("o_orderpriority").alias("source"),
        F.concat(F.lit("u/"), cust.cast("string")).alias("source_url"),
        F.concat(F.lit("Posting "), key.cast("string")).alias("title"),
        F.concat(
            (cust % 97).cast("string"), F.lit(" West "), (1 + cust % 40).cast("string"), F.lit(" Street")
        ).alias("address"),
        F.when(
            key % 5 != 0,
            F.concat((1 + cust % 30).cast("string"), F.substring(F.lit("ABCDEF"), (1 + cust % 6).cast("int"), F.lit(1))),
        ).alias("unit"),
        "neighborhood",
        "borough",
        F.when(key % 7 != 0, F.lit(40.6) + (cust % 400) * F.lit(0.0005) + (key % 3) * F.lit(0.0002)).alias("lat"),
        F.when(key % 7 != 0, F.lit(-73.8) - (cust % 300) * F.lit(0.0005)).alias("lng"),
        F.floor(F.col("o_totalprice") / 100).cast("int").alias("rent_gross"),
        F.when(key % 4 != 0, F.floor(F.col("o_totalprice") / 110).cast("int")).alias("rent_net"),
        (cust % 4).cast("double").alias("bedrooms"),
        (1 + cust % 2).cast("double").alias("bathrooms"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("broker_fee"),
        F.array(image(50), image(7), F.concat(F.lit("img/o"), (key % 20).cast("string"), F.lit(".jpg"))).alias("images"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("last_seen_at"),
        cust.alias("custkey"),
        key.alias("orderkey"),
    )


POSTINGS_SQL = """
SELECT lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS listing_id,
       o_orderpriority AS source,
       'u/' || CAST(o_custkey AS VARCHAR) AS source_url,
       'Posting ' || CAST(o_orderkey AS VARCHAR) AS title,
       CAST(o_custkey % 97 AS VARCHAR) || ' West ' || CAST(1 + o_custkey % 40 AS VARCHAR) || ' Street' AS address,
       CASE WHEN o_orderkey % 5 <> 0 THEN CAST(1 + o_custkey % 30 AS VARCHAR)
            || substr('ABCDEF', CAST(1 + o_custkey % 6 AS INTEGER), 1) END AS unit,
       n_name AS neighborhood,
       r_name AS borough,
       CASE WHEN o_orderkey % 7 <> 0 THEN CAST(40.6 AS DOUBLE) + (o_custkey % 400) * CAST(0.0005 AS DOUBLE)
            + (o_orderkey % 3) * CAST(0.0002 AS DOUBLE) END AS lat,
       CASE WHEN o_orderkey % 7 <> 0 THEN CAST(-73.8 AS DOUBLE) - (o_custkey % 300) * CAST(0.0005 AS DOUBLE) END AS lng,
       CAST(floor(o_totalprice / 100) AS INTEGER) AS rent_gross,
       CASE WHEN o_orderkey % 4 <> 0 THEN CAST(floor(o_totalprice / 110) AS INTEGER) END AS rent_net,
       CAST(o_custkey % 4 AS DOUBLE) AS bedrooms,
       CAST(1 + o_custkey % 2 AS DOUBLE) AS bathrooms,
       CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS broker_fee,
       ['img/' || CAST(o_custkey % 50 AS VARCHAR) || '.jpg', 'img/' || CAST(o_custkey % 7 AS VARCHAR) || '.jpg',
        'img/o' || CAST(o_orderkey % 20 AS VARCHAR) || '.jpg'] AS images,
       o_orderdate AS last_seen_at,
       o_custkey AS custkey,
       o_orderkey AS orderkey
FROM orders
LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey
"""
