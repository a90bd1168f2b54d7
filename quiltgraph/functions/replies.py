"""Reading model replies: three JSON recovery rules and score coercion, all as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiltgraph.functions.text import strip

# The shapes in which a reply may wrap its JSON.
FENCE = r"(?isU)```(?:json)?\s*(.*?)\s*```"
FENCE_ON_LINES = r"(?sU)```(?:json)?\s*\n(\{.*?\}|\[.*?\])\n\s*```"
BRACES = r"(?s)\{.*\}"


END_MARK = "~end~"


def is_json(c: Column) -> Column:
    """True for exactly one JSON value.

    Spark's parser stops after the first value and ignores what follows, so the
    text is read as the first element of an array that must go on to its mark.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"{END_MARK}"]')))
    marked = F.try_variant_get(wrapped, "$[1]", "string") == END_MARK
    return F.coalesce(marked & F.try_variant_get(wrapped, "$[2]", "variant").isNull(), F.lit(False))


def _valid(c: Column) -> Column:
    return F.when(is_json(c), c)


def strict_json(reply: Column) -> Column:
    """Whole reply, else its fenced block, else first to last brace; null when none parses."""
    fenced = reply.contains("```") & reply.rlike(FENCE)
    inner = F.when(fenced, strip(F.regexp_extract(reply, FENCE, 1))).otherwise(reply)
    return F.coalesce(_valid(reply), _valid(inner), _valid(F.regexp_extract(inner, BRACES, 0)))


def braces_json(reply: Column) -> Column:
    """First to last brace only; null when absent or broken."""
    return _valid(F.regexp_extract(reply, BRACES, 0))


def plain_json(reply: Column) -> Column:
    return _valid(reply)


def is_object(json: Column) -> Column:
    return F.coalesce(strip(json).startswith("{"), F.lit(False))


def lenient_json(reply: Column, innermost: bool = False) -> Column:
    """An object from a fenced block on its own lines, else between braces.

    ``innermost`` starts at the last opening brace, so that an unfenced nested
    object yields only its tail; the default takes the outermost braces.
    """
    if innermost:
        n = F.length(reply)
        opened = n - F.instr(F.reverse(reply), "{") + 1
        closed = n - F.instr(F.reverse(reply), "}") + 1
        span = F.when(
            reply.contains("{") & reply.contains("}") & (opened < closed),
            F.substring(reply, opened, closed - opened + 1),
        ).otherwise(reply)
    else:
        outer = F.regexp_extract(reply, BRACES, 0)
        span = F.when(outer != "", outer).otherwise(reply)
    found = F.when(reply.contains("```") & reply.rlike(FENCE_ON_LINES), F.regexp_extract(reply, FENCE_ON_LINES, 1)).otherwise(span)
    json = _valid(found)
    return F.when(is_object(json), json)


def object_field(json: Column, schema, field: str) -> Column:
    return F.from_json(json, schema).getField(field)


def similarity_score(json: Column) -> Column:
    """Score as an integer, or null when the pair has to be dropped.

    Numbers truncate, whole-number strings count, a missing or null score and a
    missing reply are 0, and any other text drops the pair.
    """
    value = F.try_variant_get(F.try_parse_json(json), "$.score", "variant")
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(F.try_parse_json(json), "$.score", "string")
    number = F.when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0))
    number = number.when(kind == "STRING", F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("int")))
    number = number.otherwise(text.try_cast("double").cast("int"))
    return F.when(value.isNull() | (kind == "VOID"), 0).otherwise(number)
