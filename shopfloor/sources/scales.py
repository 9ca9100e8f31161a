"""Rating scales: what each score of a factor means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.functions import fixed

FACTORS = ("severity", "occurrence", "detection")

# Meanings of the default scales by factor and score.
DEFAULT_SCALES = [
    ("severity", 10, "Safety hazard — no warning"),
    ("severity", 9, "Safety hazard — with warning"),
    ("severity", 8, "Loss of primary function"),
    ("severity", 7, "Reduced primary function"),
    ("severity", 6, "Loss of secondary function"),
    ("severity", 5, "Reduced secondary function"),
    ("severity", 4, "Cosmetic defect — noticed by most customers"),
    ("severity", 3, "Cosmetic defect — noticed by some customers"),
    ("severity", 2, "Minor defect — noticed by discriminating customers"),
    ("severity", 1, "No effect"),
    ("occurrence", 10, "Almost certain — ≥ 1 in 2"),
    ("occurrence", 9, "Very high — 1 in 8"),
    ("occurrence", 8, "High — 1 in 20"),
    ("occurrence", 7, "Moderately high — 1 in 80"),
    ("occurrence", 6, "Moderate — 1 in 400"),
    ("occurrence", 5, "Low — 1 in 2,000"),
    ("occurrence", 4, "Slight — 1 in 15,000"),
    ("occurrence", 3, "Very slight — 1 in 150,000"),
    ("occurrence", 2, "Remote — 1 in 1,500,000"),
    ("occurrence", 1, "Almost impossible — < 1 in 1,500,000"),
    ("detection", 10, "No detection control exists"),
    ("detection", 9, "Very remote chance of detection"),
    ("detection", 8, "Remote chance of detection"),
    ("detection", 7, "Very low chance of detection"),
    ("detection", 6, "Low chance of detection"),
    ("detection", 5, "Moderate chance of detection"),
    ("detection", 4, "Moderately high chance of detection"),
    ("detection", 3, "High chance of detection"),
    ("detection", 2, "Very high chance of detection"),
    ("detection", 1, "Almost certain detection"),
]


def default_scales(spark: SparkSession) -> DataFrame:
    return fixed.lookup_table(spark, "factor, score, meaning", DEFAULT_SCALES)


def parse_scales(documents: DataFrame, json_column: str = "value") -> DataFrame:
    """Scale entries (factor, raw_key, score, meaning) of JSON documents, unchecked."""
    maps = ", ".join(f"{f} map<string,string>" for f in FACTORS)
    parsed = documents.select(F.from_json(json_column, f"name string, source string, {maps}").alias("d"))
    entries = F.array(
        *[F.struct(F.lit(f).alias("factor"), F.coalesce(f"d.{f}", F.create_map().cast("map<string,string>")).alias("m")) for f in FACTORS]
    )
    rows = parsed.select(F.explode(entries).alias("e")).select("e.factor", F.explode("e.m").alias("raw_key", "meaning"))
    number = F.col("raw_key").try_cast("double")
    return rows.withColumn("score", F.when(number == F.floor(number), number).try_cast("int"))


def scale_errors(entries: DataFrame) -> DataFrame:
    """What keeps a scale set from being complete: (factor, message) rows."""
    spark = entries.sparkSession
    wanted = fixed.lookup_table(spark, "factor", [(f,) for f in FACTORS]).withColumn(
        "score", F.explode(F.sequence(F.lit(fixed.RATING_MIN), F.lit(fixed.RATING_MAX)))
    )
    number = F.col("raw_key").try_cast("double").try_cast("int")
    collide = (
        entries.where(number.isNotNull())
        .groupBy("factor", number.alias("k"))
        .agg(F.count(F.lit(1)).alias("c"))
        .where("c > 1")
        .select("factor", F.concat(F.lit("duplicate ratings collide on rating "), F.col("k").cast("string")).alias("message"))
    )
    absent = wanted.join(entries, ["factor", "score"], "left_anti").select(
        "factor", F.concat(F.lit("missing rating "), F.col("score").cast("string")).alias("message")
    )
    extra = entries.where(F.col("score").isNull() | ~F.col("score").between(fixed.RATING_MIN, fixed.RATING_MAX)).select(
        "factor", F.concat(F.lit("unexpected rating "), F.col("raw_key")).alias("message")
    )
    blank = entries.where(F.coalesce(F.trim("meaning"), F.lit("")) == "").select(
        "factor", F.concat(F.lit("blank description for rating "), F.col("raw_key")).alias("message")
    )
    return collide.unionByName(absent).unionByName(extra).unionByName(blank)


def load_scales(spark: SparkSession, path: str) -> DataFrame:
    """Read a scale document and require it to define ratings 1-10 of all factors exactly once."""
    text = spark.read.text(path, wholetext=True)
    if text.where(F.try_parse_json("value").isNull()).take(1):
        raise ValueError("Could not parse rating-scale JSON")
    entries = parse_scales(text)
    bad = scale_errors(entries).orderBy("factor", "message").take(1)
    if bad:
        raise ValueError(f"Invalid rating scale ({bad[0]['factor']}): {bad[0]['message']}")
    return entries.select("factor", "score", F.trim("meaning").alias("meaning"))


def scale_table(scales: DataFrame, factor: str) -> DataFrame:
    """One factor's scale from 10 down to 1, ready to show."""
    return (
        scales.where(F.col("factor") == factor)
        .select(F.col("score").alias("Score"), F.col("meaning").alias("Meaning"))
        .orderBy(F.col("Score").desc())
    )


def label_ratings(df: DataFrame, scales: DataFrame) -> DataFrame:
    """Add the meaning of each rating; the planner broadcasts a scale of ten rows."""
    for factor in FACTORS:
        column = factor.capitalize()
        named = scales.where(F.col("factor") == factor).select(
            F.col("score").alias(column), F.col("meaning").alias(f"{column}_Meaning")
        )
        df = df.join(named, column, "left")
    return df
