"""The listing row, the tenures and the small tables that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTING = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("external_id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("url", T.StringType()),
        T.StructField("commune", T.StringType()),
        T.StructField("postcode", T.StringType()),
        T.StructField("rent_cc", T.IntegerType()),
        T.StructField("rent_hc", T.IntegerType()),
        T.StructField("charges", T.IntegerType()),
        T.StructField("rooms", T.IntegerType()),
        T.StructField("bedrooms", T.IntegerType()),
        T.StructField("floor", T.IntegerType()),
        T.StructField("surface_m2", T.DoubleType()),
        T.StructField("has_elevator", T.BooleanType()),
    ]
)

# Tenures, in order; the excluded ones; those that may be let to anyone.
TENURES = ["LLI", "LIBRE", "PLS", "PLUS", "PLAI", "ANRU", "ANAH", "CONVENTIONNE", "SOCIAL", "UNKNOWN"]
EXCLUDED = ["PLS", "PLUS", "PLAI", "ANRU", "ANAH", "CONVENTIONNE", "SOCIAL"]
ELIGIBLE = ["LLI", "LIBRE"]


def tenure_dimension(spark: SparkSession) -> DataFrame:
    rows = [(t, t in EXCLUDED, t in ELIGIBLE) for t in TENURES]
    return spark.createDataFrame(rows, "tenure string, is_excluded boolean, is_eligible boolean")


def effective_rent(rent_cc: Column, rent_hc: Column, charges: Column) -> Column:
    """The rent with charges: as given, else both parts if both are known, else null."""
    return F.coalesce(rent_cc, rent_hc + charges)


def listing_text(title: Column, description: Column, fields: Column) -> Column:
    """Title, description and the page's own text, a line each."""
    page = F.try_element_at(fields, F.lit("_text"))
    return F.btrim(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), F.nullif(page, F.lit(""))), F.lit(" \t\n\r\0\x0b"))


def merged_with(base: DataFrame, detail: DataFrame, key: list[str]) -> DataFrame:
    """Listings whose detail page wins where it says something; maps are joined with the detail on top."""
    strings = {"title", "description"}
    d = detail.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], *[F.col(f.name).alias(f"__d_{f.name}") for f in LISTING if f.name in detail.columns and f.name not in ("source", "external_id")])
    on = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(key)]
    out = base.join(d, on, "left")
    for f in LISTING:
        own = f"__d_{f.name}"
        if own not in out.columns:
            continue
        if f.name == "fields":
            below = F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(F.coalesce(own, F.create_map().cast("map<string,string>")), k))
            out = out.withColumn("fields", F.map_concat(below, F.coalesce(own, F.create_map().cast("map<string,string>"))))
        elif f.name in strings:
            out = out.withColumn(f.name, F.coalesce(F.nullif(F.col(own), F.lit("")), F.col(f.name)))
        else:
            out = out.withColumn(f.name, F.coalesce(F.col(own), F.col(f.name)))
    return out.select(*base.columns)
