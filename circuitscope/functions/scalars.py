"""Column functions: hashes, ids, guarded numbers, strings and dynamic JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Scores of failed cells, and where a valid score begins.
WORST_SCORE = -1.0


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def record_id(metric: Column, name: Column, qasm: Column) -> Column:
    """First 24 hex digits of the hash of metric, name and the circuit's hash."""
    return F.substring(F.sha2(F.concat_ws(":", metric, name, F.sha2(qasm, 256)), 256), 1, 24)


def stable_key(seed: int, identity: Column) -> Column:
    """A seeded, reproducible order over ids."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), identity.cast("string")), 256)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_null(x: Column) -> Column:
    """The number, or null where it is NaN, infinite or null. A non-number raises, as a cast does."""
    x = x.cast("double")
    return F.when(is_finite(x), x)


def valid_score(x: Column) -> Column:
    """Finite and above the score of a failure. NaN would win any max, so guard first."""
    return is_finite(x) & (x > WORST_SCORE)


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / (1 + F.greatest(F.abs(a), F.abs(b)))


def is_close(a: Column, b: Column, rel: float = 1e-8, absolute: float = 1e-10) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def class_cap(smallest: Column, ratio: float) -> Column:
    """How many rows of a class may stay, given the smallest class."""
    return F.greatest(F.lit(1), F.floor(smallest * F.lit(float(ratio)))).cast("long")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def job_key(circuit: Column, device: Column) -> Column:
    return F.concat_ws("|", circuit, device)


def compiled_name(circuit: Column, metric: Column, device: Column) -> Column:
    return F.concat(circuit, F.lit("_"), metric, F.lit("-"), device, F.lit(".qasm"))


def truncated_int(text: Column) -> Column:
    """int(float(x))."""
    return text.cast("double").cast("int")


def last_chars(text: Column, n: int = 8000) -> Column:
    return F.right(text, F.lit(n))


def round3(x: Column) -> Column:
    """To three decimals by the exact binary value, ties to even: 1.0005, which is stored as a little less, becomes 1.0.

    2000 x is split into two exact products, so it is known on which side of a tie x lies.
    """
    whole = F.when(F.abs(x) < 2.0**42, F.lit(0.0)).otherwise(F.floor(x).cast("double"))  # beyond, doubles have no more than three decimals
    part = x - whole
    spread = part * 134217729.0
    high = spread - (spread - part)
    halves = F.rint(part * 2000)
    beyond = (high * 2000 - halves) + (part - high) * 2000
    tie = F.when(beyond > 0, halves + 1).when(beyond < 0, halves - 1).otherwise(4 * F.rint(halves / 4))
    return whole + F.when(F.pmod(halves, F.lit(2.0)) == 1, tie).otherwise(halves) / 2 / 1000


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with offset; pass current_timestamp() or, for reproducible runs, a fixed time."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def portable_path(path: Column, root: str) -> Column:
    """The path relative to ``root`` where it lies below it, else unchanged."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


# -- dynamic JSON (VARIANT)


def kind(value: Column) -> Column:
    """The kind of a variant, e.g. STRING, BIGINT, BOOLEAN, VOID; null where it is missing."""
    return F.schema_of_variant(value)


def field(value: Column, path: str) -> Column:
    """The variant under a path; null where it is missing, and no error where the shape differs."""
    return F.try_variant_get(value, path, "variant")


def text_value(value: Column) -> Column:
    """A variant's string, or null where it is anything else."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def text_field(value: Column, path: str) -> Column:
    """A string, or null where the field is missing or anything but a string."""
    return text_value(field(value, path))


def int_value(value: Column, bool_as_int: bool = False) -> Column:
    """A variant's integer; booleans and fractions are null unless ``bool_as_int`` lets booleans be 1 and 0."""
    found = F.when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    if bool_as_int:
        found = F.coalesce(found, F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint")))
    return found


def int_field(value: Column, path: str, bool_as_int: bool = False) -> Column:
    """As :func:`int_value`, of the field under a path; null where it is missing."""
    return int_value(field(value, path), bool_as_int)


def has_key(value: Column, path: str) -> Column:
    """True for any value under the path, a JSON null included."""
    return F.coalesce(field(value, path).isNotNull(), F.lit(False))


def is_object(value: Column) -> Column:
    """True for a variant that is an object; its values are not walked."""
    return F.try_variant_get(value, "$", "struct<_:variant>").isNotNull()


# -- arrays and maps


def sorted_difference(have: Column, allowed: Column) -> Column:
    """Sorted distinct elements of ``have`` that ``allowed`` lacks."""
    return F.array_sort(F.array_except(have, allowed))


def same_elements(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def share_element(a: Column, b: Column) -> Column:
    """True if an element is in both; a null element is no match and no null."""
    return F.coalesce(F.arrays_overlap(F.array_compact(a), F.array_compact(b)), F.lit(False))


def feature_map(names: Column, values: Column) -> Column:
    """Name to value; lists of different lengths are an error."""
    return F.map_from_arrays(names, values)


def feature_distance(query: Column, candidate: Column) -> Column:
    """Mean relative difference over the query's features; null if the candidate lacks one or has it not finite.

    Features that only the candidate has do not count. An empty query is at distance 0.
    """
    names = F.map_keys(query)
    value = lambda m, n: F.try_element_at(m, n).cast("double")
    usable = F.forall(names, lambda n: F.coalesce(is_finite(value(candidate, n)), F.lit(False)))
    total = F.aggregate(F.array_sort(names), F.lit(0.0), lambda acc, n: acc + relative_difference(value(query, n), value(candidate, n)))
    return F.when(F.size(names) == 0, F.lit(0.0)).when(usable, total / F.size(names))


def sorted_product(factors: Column) -> Column:
    """The product in ascending order of factors, so that no partitioning changes its last bits."""
    return F.aggregate(F.array_sort(factors), F.lit(1.0), lambda acc, x: acc * x)
