"""Readers and writers of the JSON-lines and table formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import fixed
from parley.functions import text as tx


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per non-blank line, column `value`."""
    return spark.read.text(path).filter(F.btrim("value") != "")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _number_text(v: Column, path: str) -> Column:
    """A number as text: integers as written, other numbers with a decimal point."""
    x = F.try_variant_get(v, path, "variant")
    whole = F.schema_of_variant(x) == "BIGINT"
    plain = whole | (F.schema_of_variant(x) == "STRING")
    return F.when(plain, _text(v, path)).otherwise(F.try_variant_get(v, path, "double").cast("string"))


FLAT_FIELDS = ("features", "description", "categories", "details")


def _has_id(v: Column, id_field: str) -> Column:
    return F.coalesce(_text(v, f"$.{id_field}").isNotNull(), F.lit(False))


def rejected_lines(raw: DataFrame, id_field: str = "parent_asin") -> DataFrame:
    """The lines (column `value`) that are no JSON object with an id."""
    return raw.filter((F.btrim("value") != "") & ~_has_id(F.try_parse_json("value"), id_field))


def _checked(rows: DataFrame, id_field: str, what: str, on_error: str) -> DataFrame:
    """Rows with parsed column `v`: malformed ones fail the query when they are read, or are dropped on request."""
    if on_error == "drop":
        return rows.filter(_has_id(F.col("v"), id_field))
    if on_error != "fail":
        raise ValueError("on_error is 'fail' or 'drop'")
    return rows.filter(F.when(_has_id(F.col("v"), id_field), True).otherwise(
        F.raise_error(F.concat(F.lit(f"malformed {what} line: "), F.left("value", F.lit(200)))).cast("boolean")))


def catalogue_from_lines(raw: DataFrame, id_field: str = "parent_asin", on_error: str = "fail") -> DataFrame:
    """Catalogue table from a `value` column of JSON objects.

    Text fields may be null, string, list or object in any row. VARIANT tells which; objects are read
    from their source text, because their key order decides the order of values. Every such field
    becomes a list of (key, value). A line that is no object with an id fails the query; with `on_error="drop"` it is
    left out, and `rejected_lines` gives it.
    """
    texts = F.from_json("value", ", ".join(f"{f} string" for f in FLAT_FIELDS))
    rows = _checked(raw.filter(F.btrim("value") != "").select("value", F.try_parse_json("value").alias("v"), texts.alias("t")), id_field, "catalogue", on_error)

    def flat(name):
        v = F.try_variant_get("v", f"$.{name}", "variant")
        keyed = F.from_json(F.col(f"t.{name}"), "map<string,string>")
        return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.transform(
            F.map_entries(keyed), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
        ).otherwise(tx.variant_entries(v)).cast(tx.ENTRY)

    return rows.select(
        _text(F.col("v"), f"$.{id_field}").alias("item_id"), _text(F.col("v"), "$.title").alias("title"),
        *[flat(f).alias(f) for f in FLAT_FIELDS],
        _text(F.col("v"), "$.store").alias("store"),
        F.try_variant_get("v", "$.average_rating", "double").alias("average_rating"),
        _text(F.col("v"), "$.rating_number").alias("rating_number"),
        _number_text(F.col("v"), "$.price").alias("price"))


def read_catalogue(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    return catalogue_from_lines(lines(spark, path), on_error=on_error)


SESSION_SCHEMA = (
    "sample_id string, scenario_type string, user_profile struct<purchase_frequency:string,"
    "average_prior_rating:double,rating_style:string,preference_tags:array<string>,summary:string>,"
    "ground_truth struct<parent_asin:string>, intent_card struct<target_category:string,"
    "hard_constraints:array<string>,soft_preferences:array<string>>, "
    "behavior struct<scenario_type:string,override:struct<turn:int,old_value:string,new_value:string,"
    "message:string>>")


def sessions_from_lines(raw: DataFrame, on_error: str = "fail") -> DataFrame:
    """Session table from a `value` column of JSON objects; blank lines are skipped, malformed ones as in the catalogue."""
    rows = raw.filter(F.btrim("value") != "").select("value", F.try_parse_json("value").alias("v"))
    return _checked(rows, "sample_id", "session", on_error).select(
        F.from_json("value", SESSION_SCHEMA).alias("s")).select("s.*")


def read_sessions(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    return sessions_from_lines(lines(spark, path), on_error)


def lookup_session(sessions: DataFrame, sample_id, column: str = "session_id") -> DataFrame:
    """The session with this id; the query fails when there is none. The id filter reaches the scan."""
    found = sessions.filter(F.col(column) == F.lit(sample_id))
    kind = sessions.schema[column].dataType
    wanted = sessions.sparkSession.range(1).select(F.lit(sample_id).cast(kind).alias("_id"))
    unknown = F.raise_error(F.lit(f"unknown session: {sample_id}")).cast(kind)
    return wanted.join(found, F.col("_id") == F.col(column), "left").select(
        *[F.coalesce(c, unknown).alias(c) if c == column else F.col(c) for c in sessions.columns])


def read_attribute_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Attribute phrases of a dictionary file, facet names removed."""
    raw = spark.read.schema("canonical string").json(path)
    return (raw.filter("canonical is not null").select(F.col("canonical").alias("phrase"))
            .filter(~F.col("phrase").isin(*fixed.FACET_NAMES)).distinct())


def write_results(summary: DataFrame, sessions: DataFrame, path: str) -> None:
    """Result tables: summary rows and one row per session."""
    summary.write.mode("errorifexists").json(f"{path}/summary")
    sessions.write.mode("errorifexists").parquet(f"{path}/sessions")
