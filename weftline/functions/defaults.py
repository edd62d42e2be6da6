"""Standard values of operational columns that a mapping has no source for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.naming import inlined
from weftline.operators.relational import quoted


@dataclass(frozen=True)
class Field:
    """A column's value as Spark SQL: in general, by a project variable, for new rows, for changed rows; and source columns to take instead."""

    name: str
    value: str
    variable: str | None = None
    on_insert: str | None = None
    on_update: str | None = None
    sources: tuple[str, ...] = ()


#: The operational columns, their defaults, and the source columns that may stand for them, in the order tried.
FIELDS = (
    Field("ETLJobDtlID", "-1", "etl_job_dtl_id"),
    Field("ETLJobID", "-1", "etl_job_id"),
    Field("SiteID", "$$site_id", sources=("PtyLocNum", "SiteID", "Site_ID", "LocationID")),
    Field("SctyCde", "0", sources=("SctyCde", "SecurityCode", "SecCde")),
    Field("PtyLocNum", "$$site_id"),
    Field("CurrentFlg", "'Y'", on_insert="'Y'", on_update="CASE WHEN EffEndDate IS NULL THEN 'Y' ELSE 'N' END"),
    Field("EffStartDate", "current_date()", sources=("TransactionDate", "EffectiveDate", "StartDate", "TxnDate")),
    Field("EffEndDate", "NULL"),
    Field("InsertDtTm", "current_timestamp()"),
    Field("UpdateDtTm", "current_timestamp()"),
    Field("InsertUserId", "'ETL_PROCESS'"),
    Field("UpdateUserId", "'ETL_PROCESS'"),
    Field("ActiveFlg", "'Y'"),
    Field("DeletedFlg", "'N'"),
    Field("ProcessedFlg", "'N'"),
    Field("RowVersion", "1"),
    Field("RecordCount", "1"),
    Field("RejectFlg", "0"),
    Field("AlertFlg", "0"),
    Field("ValidCode", "0"),
    Field("ValidCodeDesc", "'Valid'"),
)


def field_of(name: str, fields: Sequence[Field] = FIELDS) -> Field | None:
    """The field of that name, else the first one whose name is a part of it; case doesn't matter."""
    low = name.lower()
    return next((f for f in fields if f.name.lower() == low), None) or next((f for f in fields if f.name.lower() in low), None)


def value_of(name: str, columns: Sequence[str] = (), change: str | None = None, variables: Mapping[str, object] | None = None) -> str | None:
    """The value of a column as Spark SQL, or None.

    A source column whose name holds one of the field's candidates comes first,
    then the value for ``change`` (insert or update), then the field's variable
    if the project has it, then the default.
    """
    field, known = field_of(name), variables or {}
    if field is None:
        return None
    for candidate in field.sources:
        found = next((c for c in columns if candidate.lower() in c.lower()), None)
        if found:
            return quoted(found)
    special = {"insert": field.on_insert, "update": field.on_update}.get(change or "")
    if special:
        return special
    if field.variable and field.variable in known:
        return inlined(f"$${field.variable}", known)
    return inlined(field.value, known)


def with_fields(df: DataFrame, names: Mapping[str, str], change: str | None = None, variables: Mapping[str, object] | None = None) -> DataFrame:
    """``df`` with the columns ``names`` (name to type): those it lacks get their standard value, nulls of those it has are filled with it.

    A column without a standard value that ``df`` lacks is an error. Values of
    one column may read others, also those that are added here.
    """
    have = {c.lower(): c for c in df.columns}
    out, kinds = df, dict(df.dtypes)
    reading = []
    for name, kind in names.items():
        others = [c for c in df.columns if c.lower() != name.lower()]
        value = value_of(name, others, change, variables)
        if value is None and name.lower() not in have:
            raise KeyError(f"column {name} has neither a source nor a standard value")
        if value is not None:
            reading.append((name, kind, value))
    for name, kind, value in sorted(reading, key=lambda r: r[2].startswith("CASE")):  # those that read others last
        own = have.get(name.lower())
        made = F.expr(value).cast(kinds[own] if own else kind)
        out = out.withColumn(own or name, F.coalesce(F.col(quoted(own)), made) if own and change != "update" else made)
    return out
