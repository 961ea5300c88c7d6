"""Flag-change records, one flat JSON object each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewgate.functions.exprs import PY_WHITESPACE


def _whole(token) -> F.Column:
    """A JSON number as an integer, cut towards zero as ``int()`` does."""
    n = F.try_variant_get(token, "$", "double")
    return F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("bigint")


def parse_changes(df: DataFrame, json_col: str = "change") -> DataFrame:
    """Typed columns type, id, field, clicked (text) from a JSON column, plus
    ``has_clicked``: whether the object has a "clicked" key at all (a JSON
    null and a missing key are different rejects).

    ``clicked`` may be text, a JSON number (1.0 is 1) or a JSON boolean; it
    becomes the text of the integer, while text stays as sent, so that the
    number 1.0 and the text "1.0" remain apart.  ``id`` may be a whole number
    or text of one, blanks around it ignored.  An object that names a key twice
    is not read.

    The text is parsed once per row inside a generator (``inline`` of a
    one-element array): filters on the parsed fields are not pushed below a
    generator, so the parse is never copied into a pushed-down predicate.
    """
    parsed = df.select("*", F.inline(F.array(F.struct(
        F.try_parse_json(json_col).alias("_rec")))))
    clicked = F.try_variant_get("_rec", "$.clicked", "variant")
    ident = F.try_variant_get("_rec", "$.id", "variant")
    kind = F.schema_of_variant(clicked)
    ident_text = F.btrim(F.try_variant_get("_rec", "$.id", "string"), F.lit(PY_WHITESPACE))
    return parsed.select(
        *[c for c in df.columns if c != json_col],
        F.try_variant_get("_rec", "$.type", "string").alias("type"),
        F.when(F.schema_of_variant(ident) == "STRING", ident_text.try_cast("bigint"))
         .otherwise(F.try_variant_get("_rec", "$.id", "bigint")).alias("id"),
        F.try_variant_get("_rec", "$.field", "string").alias("field"),
        F.when(kind == "STRING", F.try_variant_get("_rec", "$.clicked", "string"))
         .when(kind == "BOOLEAN", F.try_variant_get("_rec", "$.clicked", "int").cast("string"))
         .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), _whole(clicked).cast("string"))
         .alias("clicked"),
        clicked.isNotNull().alias("has_clicked"))


# One line per change: arrival order, who sent it, and the object as sent.
CHANGE_RECORD = "seq long, actor string, change string"


def read_change_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files of change records (the same files the stream reads);
    the change object stays text so that ``parse_changes`` sees it as sent."""
    return spark.read.schema(CHANGE_RECORD).json(path)
