"""Redaction within JSON of any shape, as one fold over its tokens in the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import redacted

TOKEN = "\"(?:[^\"\\\\]|\\\\.)*+\"|[{}\\[\\],:]|[^\\s{}\\[\\],:\"]++"
# Fields that name things, whose values are no secrets for being long.
IDENTIFIERS = ["applicability", "category", "checks", "executionStatus", "id", "kind", "mode", "model", "scanner", "status", "type"]


def redacted_json(x: Column | str) -> Column:
    """JSON text with each string value redacted, at any depth; names of fields, numbers and literals stay.

    A value belongs to the nearest field around it, through arrays. Left as they are: a ``fingerprint`` of 64 hex
    digits, and https addresses without credentials in ``references`` and as ``url`` of ``standards``. Values of
    identifying fields with the shape of an identifier keep long runs. Null stays null; text that is no JSON is
    redacted as a whole.
    """
    text = F.col(x) if isinstance(x, str) else x
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    pairs = F.zip_with(tokens, F.concat(F.slice(tokens, F.lit(2), F.size(tokens)), F.array(F.lit(""))), lambda t, n: F.struct(t.alias("t"), F.coalesce(n, F.lit("")).alias("next")))
    kind = "struct<out:array<string>,fields:array<string>,field:string>"

    def value(token: Column, field: Column, around: Column) -> Column:
        v = F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]")
        public = v.rlike("^https://[^/?#@\\s]+(?:[/?#]\\S*)?$") & ((field == "references") | ((field == "url") & (around == "standards")))
        digest = (field == "fingerprint") & v.rlike("^[a-f0-9]{64}$")
        named = field.isin(IDENTIFIERS) & v.rlike("^[A-Za-z0-9_.:/@+ -]{1,180}$") & ((F.length(v) < 32) | v.rlike("[-.:/@+ ]"))
        clean = F.when(public | digest, v).when(named, redacted(v, runs=False)).otherwise(redacted(v))
        coded = F.to_json(F.array(clean))
        return F.substring(coded, F.lit(2), F.length(coded) - 2)

    def step(s: Column, p: Column) -> Column:
        t = p["t"]
        opens, closes, string = t.isin("{", "["), t.isin("}", "]"), t.startswith('"')
        key = string & (p["next"] == ":")
        size = F.size(s["fields"])
        fields = F.when(opens, F.concat(s["fields"], F.array(s["field"]))).when(closes, F.slice(s["fields"], F.lit(1), F.greatest(size - 1, F.lit(0)))).otherwise(s["fields"])
        field = F.when(key, F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$[0]")).when(closes, F.coalesce(F.try_element_at(s["fields"], F.lit(-1)), F.lit(""))).otherwise(s["field"])
        around = F.coalesce(F.try_element_at(s["fields"], F.lit(-1)), F.lit(""))
        shown = F.when(string & ~key, value(t, s["field"], around)).otherwise(t)
        return F.struct(F.concat(s["out"], F.array(shown)).alias("out"), fields.alias("fields"), field.alias("field")).cast(kind)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("fields"), F.lit("").alias("field")).cast(kind)
    whole = F.array_join(F.aggregate(pairs, start, step)["out"], "")
    return F.when(F.try_parse_json(text).isNotNull(), whole).otherwise(redacted(text))
