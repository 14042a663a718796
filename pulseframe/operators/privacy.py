"""Schema-driven de-identification of whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe import constants as C
from pulseframe.functions import privacy as P
from pulseframe.functions.binding import let


def _is_id(name: str, extra: set[str], never: set[str]) -> bool:
    low = name.lower().strip()
    if low in never:
        return False
    return low in extra or ("id" in low and low not in C.ID_KEY_EXCEPTIONS)


def patient_pseudonym(df: DataFrame, salt: str) -> Column:
    """Pseudonym from the first usable patient key of a table."""
    present = {c: c for c in df.columns}
    keys = [F.nullif(F.col(present[k]).cast("string"), F.lit("")) for k in C.PATIENT_ID_KEYS if k in present]
    return P.pseudonym(F.coalesce(*keys, F.lit(C.UNKNOWN_PATIENT)), salt)


def sanitize(
    df: DataFrame, salt: str, id_columns: set[str] = frozenset(), not_id_columns: set[str] = frozenset(), strict: bool = False
) -> DataFrame:
    """Drop direct identifiers, pseudonymise ids, scrub text, shift timestamps and dates, keep the rest.

    Structs follow the same policy field by field, arrays element by element, and
    MAP<STRING, STRING> entry by entry.
    """
    df = df.withColumn("patient_pseudonym", patient_pseudonym(df, salt))
    who = F.col("patient_pseudonym")

    def clean(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return P.scrub(col, strict)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return P.shift_timestamp(col.cast("timestamp"), who)
        if isinstance(kind, T.DateType):
            return P.shift_timestamp(col.cast("timestamp"), who).cast("date")
        if kind == T.MapType(T.StringType(), T.StringType()):
            return sanitize_map(col, salt, strict)
        if isinstance(kind, T.MapType):
            return F.transform_values(col, lambda _, v: clean(v, kind.valueType))
        if isinstance(kind, T.ArrayType):
            return F.transform(col, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(col.isNotNull(), F.struct(*fields(kind, lambda n: col[n])))
        return col

    def fields(kind: T.StructType, get: Callable[[str], Column]) -> list[Column]:
        out = []
        for f in kind.fields:
            if f.name.lower().strip() in C.FORBIDDEN_KEYS or f.name == "patient_pseudonym":
                continue
            if _is_id(f.name, id_columns, not_id_columns):
                out.append(P.pseudonym(get(f.name), salt).alias(f"{f.name}_pseudonym"))
            else:
                out.append(clean(get(f.name), f.dataType).alias(f.name))
        return out

    return df.select(who, *fields(df.schema, lambda n: F.col(f"`{n}`")))


def sanitize_map(entries: Column, salt: str, strict: bool = False) -> Column:
    """The same policy for free-form metadata held in a map."""
    def low(k: Column) -> Column:
        return F.lower(F.trim(k))

    def is_id(k: Column) -> Column:
        return low(k).contains("id") & ~low(k).isin(*C.ID_KEY_EXCEPTIONS)

    kept = F.map_filter(entries, lambda k, _: ~low(k).isin(*C.FORBIDDEN_KEYS))
    valued = F.transform_values(kept, lambda k, v: F.when(is_id(k), P.pseudonym(v, salt)).otherwise(P.scrub(v, strict)))
    return F.transform_keys(valued, lambda k, _: F.when(is_id(k), F.concat(k, F.lit("_pseudonym"))).otherwise(k))


def phi_audit(df: DataFrame, text: str) -> DataFrame:
    """Rows with residual hits per pattern, before and after scrubbing: one row per pattern."""

    def hits(clean: Column) -> Column:
        return F.array(*[
            F.struct(F.lit(name).alias("pattern"), F.col(text).rlike(p).alias("raw"), clean.rlike(p).alias("left"))
            for name, p, _ in C.SCRUB_PATTERNS
        ])

    found = df.select(F.inline(let(P.scrub(F.col(text)), hits)))
    return found.groupBy("pattern").agg(F.count_if("raw").alias("before"), F.count_if("left").alias("after"))
