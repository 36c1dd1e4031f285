"""Parsing and routing of review judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Confidence limits of the three outcomes, reason length, key prefix.
AUTO_LINK_CONFIDENCE = 0.9
PENDING_CONFIDENCE = 0.7
REASON_LENGTH = 500
KEY_PREFIX = "v1:gemini"

# Reasons of error judgments.
NO_ARRAY = "missing JSON array"
BAD_ARRAY = "invalid JSON array"

_NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def judgment_key(item_id: Column, catalog_id: Column) -> Column:
    return F.concat_ws(":", F.lit(KEY_PREFIX), item_id.cast("string"), catalog_id.cast("string"))


def judgment_status(confidence: Column) -> Column:
    return (
        F.when(confidence >= AUTO_LINK_CONFIDENCE, "auto_linked")
        .when(confidence >= PENDING_CONFIDENCE, "pending")
        .otherwise("rejected")
    )


def _typed(value: Column, field: str, type_pattern: str, spark_type: str) -> Column:
    """A field of a variant object, only when it was written with the asked JSON type."""
    part = F.try_variant_get(value, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(part).rlike(type_pattern), F.try_variant_get(value, f"$.{field}", spark_type))


def _array_text(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "(?s)\\[.*\\]", 0), F.lit(""))


def answer_error(text: Column) -> Column:
    """Why a response text holds no JSON array; NULL when it holds one."""
    body = _array_text(text)
    return F.when(body.isNull(), NO_ARRAY).when(F.try_parse_json(body).isNull(), BAD_ARRAY)


def parse_judgments(responses: DataFrame, text: str = "response_text") -> DataFrame:
    """One row per valid element of the JSON array held in each response text.

    The array runs from the first ``[`` to the last ``]``. Elements need a whole-number
    ``candidateIndex`` and a ``confidence`` in 0..1; other elements are dropped. Variant
    access keeps the written JSON type, so the string "0.9" is not taken for a number.
    """
    # A text from "[" to "]" parses to an array or to NULL, which has no elements. The typed fields are made as the elements are
    # cut, once each; columns that a filter reads as well would be made again for each of its uses.
    elements = F.try_variant_get(F.try_parse_json(_array_text(F.col(text))), "$", "array<variant>")
    typed = F.transform(
        elements,
        lambda v: F.struct(
            v.alias("_item"),
            _typed(v, "candidateIndex", _NUMBER, "double").alias("_index"),
            _typed(v, "machineId", _NUMBER, "double").cast("long").alias("judged_catalog_id"),
            _typed(v, "confidence", _NUMBER, "double").alias("confidence"),
        ),
    )
    items = responses.select(*responses.columns, F.posexplode(typed).alias("element", "_typed")).select(
        *responses.columns, "element", "_typed.*"
    )
    value = F.col("_item")
    terms = F.try_variant_get(value, "$.matchedTerms", "array<variant>")
    strings = F.transform(
        F.filter(F.coalesce(terms, F.array().cast("array<variant>")), lambda t: F.schema_of_variant(t) == "STRING"),
        lambda t: F.try_variant_get(t, "$", "string"),
    )
    parsed = items.select(
        "*",
        F.coalesce(
            F.substring(_typed(value, "reason", "^STRING$", "string"), 1, REASON_LENGTH), F.lit("")
        ).alias("reason"),
        strings.alias("matched_terms"),
    )
    return (
        parsed.where((F.col("_index") == F.floor("_index")) & F.col("confidence").between(0, 1))
        .withColumn("candidate_index", F.col("_index").cast("long"))
        .drop("_item", "_index")
    )
