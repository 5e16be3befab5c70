"""Validation of recommended plans: every broken rule is reported, none stops the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S

#: Permitted methods. A JSON null chooses the compiler's default.
LAYOUT_METHODS = ("trivial", "dense", "sabre")
ROUTING_METHODS = ("basic", "lookahead", "stochastic", "sabre", "none")
MAX_SEED, MAX_LEVEL = 2**32 - 1, 3
#: What :func:`validate` reports, in its order; a prompt lists the same.
MESSAGES = {
    "object": "response must be a JSON object", "device": "selected_device is not an available device", "merit": "figure_of_merit differs from the request",
    "compiler": "compiler must be qiskit", "plan": "qiskit_plan must be an object", "level": f"optimization_level must be an integer from 0 to {MAX_LEVEL}",
    "seed": "seed_transpiler must be an unsigned 32-bit integer", "layout": "layout_method is not permitted", "routing": "routing_method is not permitted",
    "limit": "optimization_level exceeds the constraint", "explanation": "explanation must be a non-blank string",
    "evidence": "evidence must be a list of non-blank strings", "warnings": "warnings must be a list of non-blank strings"}


#: The fields that are looked at, taken out of the response and of its plan in one pass each; null where one is missing.
_RESPONSE = ("selected_device", "figure_of_merit", "compiler", "qiskit_plan", "explanation", "evidence", "warnings")
_PLAN = ("optimization_level", "seed_transpiler", "layout_method", "routing_method")


def _fields(v: Column, names: tuple[str, ...]) -> Column:
    """The named fields of an object as variants; null for what is no object."""
    return F.try_variant_get(v, "$", f"struct<{', '.join(f'{n}:variant' for n in names)}>")


def _one_of(v: Column, allowed: tuple[str, ...]) -> Column:
    """A permitted string, a JSON null or nothing. A list or number is an error, not a crash."""
    return v.isNull() | F.coalesce(S.kind(v) == "VOID", F.lit(False)) | F.coalesce(S.text_value(v).isin(*allowed), F.lit(False))


def _strings(v: Column) -> Column:
    """The trimmed strings of a list, or null where it is no list of non-blank strings."""
    items = F.try_variant_get(v, "$", "array<variant>")
    texts = F.transform(items, lambda x: S.strip(S.text_value(x)))
    return F.when(F.forall(texts, lambda x: F.coalesce(x != "", F.lit(False))), texts)


def validate(responses: DataFrame, response: str = "response") -> DataFrame:
    """``responses`` and errors, is_valid, recommendation.

    Needs the text column ``response`` and available (device ids), figure_of_merit and constraints (JSON text). Text that is no
    JSON object has that one error. Integers are strict: neither booleans nor fractions. ``recommendation`` is the typed plan, null
    unless valid.
    """
    v, p = F.col("__v"), F.col("__p")
    names = set(responses.columns)
    # Each field is taken out once, step by step: one expression over all of them would be too large to compile
    read = (responses.withColumn("__v", _fields(F.try_parse_json(response), _RESPONSE)).withColumn("__p", _fields(v["qiskit_plan"], _PLAN))
            .withColumns({"__device": S.text_value(v["selected_device"]), "__merit": S.text_value(v["figure_of_merit"]), "__compiler": S.text_value(v["compiler"]),
                          "__explanation": S.strip(S.text_value(v["explanation"])), "__evidence": _strings(v["evidence"]),
                          "__warnings": F.when(v["warnings"].isNotNull(), _strings(v["warnings"])).otherwise(F.array().cast("array<string>")),
                          "__level": S.int_value(p["optimization_level"]), "__seed": S.int_value(p["seed_transpiler"]),
                          "__layout": _one_of(p["layout_method"], LAYOUT_METHODS), "__routing": _one_of(p["routing_method"], ROUTING_METHODS),
                          "__limit": S.int_field(F.try_parse_json(F.coalesce("constraints", F.lit("{}"))), "$.max_optimization_level", bool_as_int=True)}))
    broken = lambda ok, message: F.when(~F.coalesce(ok, F.lit(False)), F.lit(MESSAGES[message]))
    rules = F.array_compact(F.array(
        broken(F.array_contains("available", F.col("__device")), "device"),
        broken(F.col("__merit") == F.col("figure_of_merit"), "merit"),
        broken(F.col("__compiler") == "qiskit", "compiler"),
        broken(p.isNotNull(), "plan"),
        broken(F.col("__level").between(0, MAX_LEVEL), "level"),
        broken(F.col("__seed").between(0, MAX_SEED), "seed"),
        broken(F.col("__layout"), "layout"),
        broken(F.col("__routing"), "routing"),
        broken(~F.coalesce(F.col("__level") > F.col("__limit"), F.lit(False)), "limit"),
        broken(F.col("__explanation") != "", "explanation"),
        broken(F.col("__evidence").isNotNull(), "evidence"),
        broken(F.col("__warnings").isNotNull(), "warnings")))
    typed = F.struct(
        F.col("__device").alias("selected_device"), F.col("__merit").alias("figure_of_merit"),
        F.struct(F.col("__level").alias("optimization_level"), F.col("__seed").alias("seed_transpiler"),
                 S.text_value(p["layout_method"]).alias("layout_method"), S.text_value(p["routing_method"]).alias("routing_method")).alias("plan"),
        F.col("__explanation").alias("explanation"), F.col("__evidence").alias("evidence"), F.col("__warnings").alias("warnings"))
    judged = (read.withColumn("errors", F.when(v.isNotNull(), rules).otherwise(F.array(F.lit(MESSAGES["object"]))))
              .withColumn("is_valid", F.size("errors") == 0).withColumn("recommendation", F.when(F.col("is_valid"), typed)))
    return judged.drop(*[c for c in judged.columns if c.startswith("__") and c not in names])
