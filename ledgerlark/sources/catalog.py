"""The catalogue's tables as views of the test tables, and appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.derive import season_of
from ..schemas import term_rank
from .commits import read_table, replace_table, versions

__all__ = ["TODAY", "Catalog", "append_rows", "read_table", "replace_table", "versions"]

TODAY = "1998-06-01"


class Catalog:
    """Lazy DataFrames of one data folder; each query reads only the columns it uses."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def listing(self) -> DataFrame:
        """Orders as listings of the customer's course."""
        key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
        base = self.table("orders").select(
            key.alias("id"),
            F.col("o_custkey").alias("course_id"),
            day.alias("starts_on"),
            F.year(day).alias("term_year"),
            season_of(F.month(day)).alias("term_season"),
            F.when(key % 5 != 0, F.date_sub(day, (key % 20).cast("int"))).alias("registration_deadline"),
            F.when(key % 3 == 1, True).when(key % 3 == 2, False).alias("is_evening"),
            F.element_at(F.array(*map(F.lit, ("in_person", "online_sync", "online_async", "hybrid", "unknown"))), (key % 5 + 1).cast("int")).alias("delivery_mode"),
            F.element_at(F.array(*map(F.lit, ("New Brunswick", "Newark", "Camden", "Online", "Other", "unknown"))), (key % 6 + 1).cast("int")).alias("campus"),
            F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "full").otherwise("waitlist").alias("status"),
            F.floor(F.col("o_totalprice") * 100 + F.lit(0.5)).alias("total_fee_cents"),
            (key % 7 == 0).alias("is_gone"),
        )
        return base.withColumn("term", F.concat_ws(" ", "term_season", F.col("term_year").cast("string"))).withColumn("term_rank", term_rank(F.col("term_year"), F.col("term_season")))

    @property
    def course(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("id"), F.col("c_nationkey").alias("unit_id"), F.col("c_name").alias("course_title"), F.col("c_mktsegment").alias("program"), F.when(key % 10 != 0, (key % 60).cast("double")).alias("contact_hours")
        )

    @property
    def unit(self) -> DataFrame:
        region = self.table("region").select("r_regionkey", F.col("r_name").alias("campus_name"))
        return self.table("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "campus_name")

    @property
    def listing_fee(self) -> DataFrame:
        """Line items as fee lines, numbered from 0 in the order of all their columns; the dearest of an order is its total."""
        line = self.table("lineitem")
        order = ["l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        number = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)) - 1
        return line.select(F.col("l_orderkey").alias("listing_id"), number.alias("ord"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("label"), F.floor(F.col("l_extendedprice") * 100 + F.lit(0.5)).alias("amount_cents"))

    @property
    def chunk(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("course_id"), "text", "lang", "source")

    @property
    def chunk_embedding(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("course_id"), "embedding")

    @property
    def page(self) -> DataFrame:
        return self.table("pages")

    @property
    def observation(self) -> DataFrame:
        """Events as observed values: event_id orders them, user and type name the field, value is what was seen."""
        return self.table("events").select(F.col("user_id").alias("listing_id"), F.col("event_type").alias("field"), F.col("event_id"), "ts", F.col("value"))

    @property
    def message(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("prose"))

    @property
    def relation(self) -> DataFrame:
        """A cyclic edge table: nation k requires nation (7 k + 3) mod 25."""
        return self.table("nation").select(F.col("n_nationkey").alias("course_id"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("requires_id"))


def append_rows(df: DataFrame, path: str) -> None:
    """Append-only sink: runs, provenance, results, transcripts and feedback."""
    df.write.mode("append").parquet(path)
