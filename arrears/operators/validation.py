"""Request contract (P1-P7): one readable message per failing field.

Checks are plain Column expressions collected into an ``errors`` array, so a
portfolio is validated in one projection; nothing is raised per row. Valid
rows have an empty array, the rest go to quarantine with their reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears import schema as S

# field -> (kind, rule); kinds drive the type-error text, rules the check
_RULES = {
    "dossier_id": ("string", None),
    "procedure_id": ("string", None),
    "client_segment": ("string", "segment"),
    "revenu_estime": ("number", "gt0"),
    "historique_incidents": ("integer", "ge0"),
    "montant_impaye": ("number", "gt0"),
    "anciennete_impaye_jours": ("integer", "ge0"),
    "nombre_echeances_impayees": ("integer", "ge0"),
    "date_ouverture": ("date", None),
    "date_mise_a_jour": ("date", "after_opening"),
}

_TYPE_TEXT = {"string": S.MSG_NOT_STRING, "number": S.MSG_NOT_NUMBER,
              "integer": S.MSG_NOT_INTEGER, "date": S.MSG_NOT_DATE}


def _message(field: str, text: str) -> Column:
    return F.lit(S.MSG_FIELD.format(field=field, message=text))


def _choices(text: str) -> str:
    # the "Input should be" wording is rewritten to list the choices
    return f"{S.MSG_CHOICES_PREFIX} {text}"


def _rule(field: str, rule: str | None, typed: Column) -> tuple[Column, str] | None:
    """(what a present, typed value must fulfil, message if it does not)."""
    if rule == "segment":
        return typed.isin(*S.SEGMENTS), _choices(S.MSG_SEGMENT_CHOICES)
    if rule == "gt0":
        # NaN sorts above every number: it and infinity fail the upper bound
        return (typed > 0) & (typed < float("inf")), S.MSG_POSITIVE
    if rule == "ge0":
        # the ">= 0" wording also contains "greater than": same text
        return typed >= 0, S.MSG_POSITIVE
    if rule == "after_opening":
        return typed >= F.col("date_ouverture"), S.MSG_DATE_ORDER
    return None


def valid() -> Column:
    """Whether all fields are there and fulfil their rules: a plain
    conjunction of comparisons, which Spark can push below joins."""
    out = None
    for field, (_, rule) in _RULES.items():
        ok = F.col(field).isNotNull()
        checked = _rule(field, rule, F.col(field))
        if checked is not None:
            ok = ok & checked[0]
        out = ok if out is None else out & ok
    return out


def request_errors(df: DataFrame, raw: dict[str, Column] | None = None) -> Column:
    """array<string> of messages, in field order.

    ``raw`` maps a field to its presence in the record when the typed column
    came from a cast; a present field with a null typed value is then a type
    error.
    """
    checks = []
    for field, (kind, rule) in _RULES.items():
        typed = F.col(field)
        if raw is not None and field in raw:
            expr = F.when(~raw[field], _message(field, S.MSG_REQUIRED)) \
                    .when(typed.isNull(), _message(field, _choices(_TYPE_TEXT[kind])))
        else:
            expr = F.when(typed.isNull(), _message(field, S.MSG_REQUIRED))
        checked = _rule(field, rule, typed)
        if checked is not None:
            # only evaluated when the opening date itself parsed
            expr = expr.when(~checked[0], _message(field, checked[1]))
        checks.append(expr)
    return F.array_compact(F.array(*checks))


def validate(df: DataFrame, raw: dict[str, Column] | None = None) -> DataFrame:
    """``errors`` and ``is_valid``. The messages are made for rows that have
    some: with all fields there and right, no rule has one."""
    none = F.array_compact(F.array(F.lit(None).cast("string")))
    return (df.withColumn("is_valid", F.coalesce(valid(), F.lit(False)))
              .withColumn("errors", F.when(F.col("is_valid"), none).otherwise(request_errors(df, raw)))
              .select(*df.columns, "errors", "is_valid"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their ``errors``)."""
    valid = validated.filter(F.col("is_valid")).drop("errors", "is_valid")
    quarantine = validated.filter(~F.col("is_valid")).drop("is_valid")
    return valid, quarantine


def oversize(raw_record: Column | str, limit: int = S.MAX_RECORD_BYTES) -> Column:
    """A record strictly larger than the limit (in UTF-8 bytes)."""
    c = F.col(raw_record) if isinstance(raw_record, str) else raw_record
    return F.octet_length(c) > limit
