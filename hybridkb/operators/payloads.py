"""Cleaning of recorded model payloads: JSON text to typed records, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridkb.functions.text import clamp_confidence, coerce_scalar, coerce_str_list, first_json_object, strip_fences
from hybridkb.operators.records import normalise_category, normalise_system

MAINTENANCE = ("date", "system", "system_detail", "vendor", "cost_currency")
DEVIATION = ("component", "factory_spec", "as_built", "reason", "date_noted", "notes")


def payload_json(raw: Column) -> Column:
    """The JSON object of a model's answer, or NULL."""
    text = first_json_object(strip_fences(raw))
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)


def _json_value(json: Column, field: str) -> Column:
    """A field as JSON text, with the quotes that a string has there."""
    return F.to_json(F.try_variant_get(F.try_parse_json(json), f"$.{field}", "variant"))


def sanitise_maintenance(json: Column) -> Column:
    """A record of any JSON object: bad parts are empty, a bad cost NULL, non-text fields NULL, the system known."""
    fields = [coerce_scalar(F.get_json_object(json, f"$.{f}")).alias(f) for f in MAINTENANCE if f != "system"]
    cost = F.get_json_object(json, "$.cost_amount").try_cast("double").alias("cost_amount")
    parts = coerce_str_list(_json_value(json, "parts")).alias("parts")
    return F.struct(normalise_system(coerce_scalar(F.get_json_object(json, "$.system"))).alias("system"), *fields, cost, parts)


def sanitise_deviation(json: Column) -> Column:
    fields = {f: coerce_scalar(F.get_json_object(json, f"$.{f}")) for f in DEVIATION}
    fields["component"] = F.coalesce(fields["component"], F.lit("other"))
    return F.struct(*[c.alias(f) for f, c in fields.items()])


def extraction_ladder(payloads: DataFrame, first: str, retry: str) -> DataFrame:
    """The payloads with ``record`` and ``rung``: the first answer if it is an object, else the retry, else the
    empty record."""
    rows = payloads.withColumns({"_first": payload_json(F.col(first)), "_retry": payload_json(F.col(retry))})
    best = F.coalesce("_first", "_retry", F.lit("{}"))
    rung = F.when(F.col("_first").isNotNull(), "first").when(F.col("_retry").isNotNull(), "retry").otherwise("default")
    return rows.withColumn("_best", best).withColumns({"record": sanitise_maintenance(F.col("_best")), "rung": rung}).drop("_first", "_retry", "_best")


LOW_CONFIDENCE = 0.7


def sanitise_zone_desc(json: Column) -> Column:
    """The description in a model's answer about a zone, '' where there is none or it is no text."""
    value = F.try_variant_get(F.try_parse_json(json), "$.vertical_desc", "string")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), "$.vertical_desc", "variant"))
    return F.coalesce(F.when(kind == "STRING", value), F.lit(""))


def normalise_detection(payloads: DataFrame, zones: DataFrame, source: Column, column: str = "payload", least: float = LOW_CONFIDENCE) -> DataFrame:
    """The payloads with the fields of a photo detection: item, brand, model, category, marine, legible,
    key_properties, other_items, suggested_zone, zone_id, zone_reasoning, confidence, low_confidence, source. Text
    that is no text is NULL, lists that are none are empty; a zone that is not known is NULL and, like a confidence
    that had to be changed, makes the confidence low."""
    json = F.col("_json")
    value = lambda f: F.get_json_object(json, f"$.{f}")
    confidence, changed = clamp_confidence(value("confidence"))
    known = zones.select(F.col("name").alias("_zone")).distinct()
    rows = payloads.withColumn("_json", payload_json(F.col(column))).withColumn("_asked", coerce_scalar(value("suggested_zone")))
    joined = rows.hint("shuffle_merge").join(known, rows["_asked"] == known["_zone"], "left")
    text = [coerce_scalar(value(f)).alias(f) for f in ("item", "brand", "model", "category", "zone_reasoning")]
    flags = [value(f).try_cast("boolean").alias(f) for f in ("marine", "legible")]
    lists = [coerce_str_list(_json_value(json, f)).alias(f) for f in ("key_properties", "other_items")]
    low = (confidence < least) | changed | F.col("_zone").isNull()
    zone = [F.col("_zone").alias("suggested_zone"), F.col("_zone").alias("zone_id")]
    return joined.select(*payloads.columns, *text, *flags, *lists, *zone, confidence.alias("confidence"), low.alias("low_confidence"), source.alias("source"))


def capture_notes(category: Column, properties: Column, reasoning: Column) -> Column:
    """What is noted with a captured item: the seen category where another one is stored, the properties, the reasoning."""
    seen = F.trim(F.coalesce(category, F.lit("")))
    stored = normalise_category(category)
    parts = [
        F.when((seen != "") & (F.lower(seen) != stored), F.concat(F.lit("Vision category: "), seen, F.lit(" (stored as "), stored, F.lit(")"))),
        F.when(F.size(F.coalesce(properties, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Properties: "), F.array_join(properties, ", "))),
        F.when(F.coalesce(reasoning, F.lit("")) != "", reasoning),
    ]
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


def capture_to_item(detections: DataFrame) -> DataFrame:
    """The detections with the row of the inventory that they become: name, stored_category, notes, and zone, brand and
    model as detected."""
    name = F.coalesce("item", F.lit("Unknown item"))
    notes = capture_notes(F.col("category"), F.col("key_properties"), F.col("zone_reasoning"))
    return detections.withColumns({"name": name, "stored_category": normalise_category(F.col("category")), "notes": notes})
