"""Structured replies of a model: JSON held against a shape, every fault listed with its path, one repair.

A shape is ``"string"``, ``"number"`` or ``"boolean"``, a list of one shape, or a
dict of names; a name that ends with ``?`` may be missing.  Names that the shape
lacks are allowed.  All of it is built-in functions on the parsed reply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of faults and of the request to repair.
NOT_JSON = "the response was not valid JSON"
REPAIR = ("That response did not match the required shape: ", "\nReply again with ONLY valid JSON in the required shape.")
INVALID = "LLM_INVALID_RESPONSE"

_ISSUES = "array<struct<path:string,message:string>>"


def _kind(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    named = F.when(value.isNull(), "undefined").when(kind == "VOID", "null")
    for name, start in (("object", "OBJECT"), ("array", "ARRAY"), ("string", "STRING"), ("boolean", "BOOLEAN")):
        named = named.when(kind.startswith(start), name)
    return named.otherwise("number")


def _walk(value: Column, shape, path: Column) -> Column:
    wanted = "object" if isinstance(shape, dict) else "array" if isinstance(shape, list) else shape
    fault = F.array(F.struct(path.alias("path"), F.concat(F.lit(f"Invalid input: expected {wanted}, received "), _kind(value)).alias("message")))
    inside = F.array().cast(_ISSUES)
    if isinstance(shape, dict):
        for name, of in shape.items():
            field = F.try_variant_get(value, f"$['{name.rstrip('?')}']", "variant")
            found = _walk(field, of, F.concat(path, F.when(path == "", "").otherwise("."), F.lit(name.rstrip("?"))))
            inside = F.concat(inside, F.when(field.isNull(), F.array().cast(_ISSUES)).otherwise(found) if name.endswith("?") else found)
    elif isinstance(shape, list):
        each = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        dot = F.when(path == "", "").otherwise(".")
        inside = F.flatten(F.transform(each, lambda x, i: _walk(x, shape[0], F.concat(path, dot, i.cast("string")))))
    return F.when(_kind(value) == wanted, inside).otherwise(fault).cast(_ISSUES)


def _parsed(raw: Column) -> Column:
    """The reply as a variant, null if it is no JSON.

    The parser stops after the first value, so the reply is read as a list's first entry before its own hash: text after
    the value, or a list closed early, leaves another list than one of two entries that ends with the hash.
    """
    mark = F.xxhash64(raw)
    pair = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit(","), mark.cast("string"), F.lit("]"))), "$", "array<variant>")
    return F.when((F.size(pair) == 2) & (F.try_variant_get(F.get(pair, 1), "$", "bigint") == mark), F.get(pair, 0))


def issues(raw: Column, shape) -> Column:
    """Array of ``(path, message)`` of all faults of a reply, in the shape's order; empty if it is accepted.

    A path names fields and positions, joined by points.  What is no JSON has one fault with an empty path; null, empty
    text, text after the value, and replies beyond the parser's size limit are no JSON.
    """
    value = _parsed(raw)
    return F.when(value.isNull(), F.array(F.struct(F.lit("").alias("path"), F.lit(NOT_JSON).alias("message")))).otherwise(_walk(value, shape, F.lit("")))


def described(faults: Column) -> Column:
    """Faults as one text: ``path: message``, joined by semicolons; what is no JSON without a path."""
    return F.array_join(F.transform(faults, lambda x: F.when(x["message"] == NOT_JSON, NOT_JSON).otherwise(F.concat(x["path"], F.lit(": "), x["message"]))), "; ")


def structured(replies: DataFrame, shape, ask: Callable[[DataFrame], DataFrame] | None = None, key: str = "message_id") -> DataFrame:
    """``(key, reply, attempts, error, code)`` of ``replies (key, raw)``, with one repair.

    Refused replies go to ``ask`` as ``(key, raw, prompt)``, which gives ``(key, raw)``: the second replies.  reply is the
    accepted JSON, or null with code LLM_INVALID_RESPONSE; error describes the first reply's faults, or is null.  Keys
    are unique.  A reply that ``ask`` does not answer, or without ``ask``, stays refused.  An empty table gives no rows.
    """
    first = replies.select(key, "raw", issues(F.col("raw"), shape).alias("faults")).withColumn("error", F.when(F.size("faults") > 0, described(F.col("faults"))))
    if ask is None:
        again = first.select(key, F.lit(None).cast("string").alias("second")).limit(0)
    else:
        asked = first.where("error is not null").select(key, "raw", F.concat(F.lit(REPAIR[0]), "error", F.lit(REPAIR[1])).alias("prompt"))
        again = ask(asked).select(key, F.col("raw").alias("second"))
    rows = first.join(again, key, "left")
    mended = F.when(F.size(issues(F.col("second"), shape)) == 0, F.col("second"))
    reply = F.when(F.col("error").isNull(), F.col("raw")).otherwise(mended)
    attempts = F.when(F.col("error").isNull() | F.lit(ask is None), 1).otherwise(2)
    return rows.select(key, reply.alias("reply"), attempts.alias("attempts"), "error", F.when(reply.isNull(), INVALID).alias("code"))
