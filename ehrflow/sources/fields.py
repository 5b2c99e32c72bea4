"""Typed values from JSON objects, by the rules of the request models.

Text fields take JSON strings only (a number or an object is an error, not a
text); whole numbers also take text such as ``"12"``, decimals without a
fraction and booleans; dates take ISO dates, ISO times at midnight, and whole
days as seconds (or milliseconds) since 1970. Unknown keys are ignored; of a
repeated key the last value counts, as in Python's parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Reasons.
NO_OBJECT = "json"
BAD_TYPE = "tipo_invalido"
TOO_LONG = "longitud"

_BROKEN = "_roto"
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]00:00(:00(\.0+)?)?(Z|[+-]00:?00)?)?$"
_WHOLE = r"^\s*[+-]?\d+(\.0*)?\s*$"


# The rules are SQL text, one expression for each known key: as many calls of
# the Column API would take seconds to build on the driver.
_WHOLES = "('TINYINT', 'SMALLINT', 'INT', 'BIGINT')"


def _get(v: str, kind: str = "string") -> str:
    return f"try_variant_get({v}, '$', '{kind}')"


def _whole(v: str, kind: str) -> str:
    return f"""CASE WHEN {kind} IN {_WHOLES} THEN {_get(v, "bigint")}
        WHEN {kind} = 'BOOLEAN' THEN CAST({_get(v)} = 'true' AS BIGINT)
        WHEN {kind} IN ('DECIMAL', 'DOUBLE', 'FLOAT') AND {_get(v, "double")} = floor({_get(v, "double")}) THEN try_cast({_get(v, "double")} AS BIGINT)
        WHEN {kind} = 'STRING' AND regexp_like({_get(v)}, r'{_WHOLE}') THEN try_cast(regexp_extract({_get(v)}, r'([+-]?[0-9]+)', 1) AS BIGINT) END"""


def _date(v: str, kind: str) -> str:
    seconds = f"CASE WHEN abs({_get(v, 'bigint')}) > 20000000000 THEN floor({_get(v, 'bigint')} / 1000) ELSE {_get(v, 'bigint')} END"
    return f"""CASE WHEN {kind} = 'STRING' AND regexp_like({_get(v)}, r'{_ISO_DATE}') THEN try_cast(left({_get(v)}, 10) AS DATE)
        WHEN {kind} IN {_WHOLES} AND pmod({seconds}, 86400) = 0 THEN date_from_unix_date(CAST(({seconds}) / 86400 AS INT)) END"""


def _value(v: str, kind: str, wanted: str) -> str:
    """The value as text, NULL if it does not fit ``wanted``; ``kind`` is the
    variant's type without its parameters."""
    if wanted == "int":
        whole = _whole(v, kind)
        return f"CAST(CASE WHEN {whole} BETWEEN -2147483648 AND 2147483647 THEN {whole} END AS STRING)"
    if wanted == "long":
        return f"CAST({_whole(v, kind)} AS STRING)"
    if wanted == "date":
        return f"CAST({_date(v, kind)} AS STRING)"
    if wanted == "codes":
        return f"CASE WHEN schema_of_variant({v}) IN ('ARRAY<STRING>', 'ARRAY<VOID>') THEN {_get(v)} END"
    if wanted == "any":
        return _get(v)
    return f"CASE WHEN {kind} = 'STRING' THEN {_get(v)} END"


def read(df: DataFrame, text: str, kinds: dict[str, str], limits: dict[str, int] | None = None) -> DataFrame:
    """``df`` with, for each known key, ``_v_<key>`` (the value as text, NULL
    for JSON ``null`` and for an absent key) and ``_has_<key>``, and with
    ``_why``: ``json`` if column ``text`` is no JSON object, else the reason a
    value is refused (a wrong type before a length), else NULL. ``kinds`` maps
    each known key to ``text``, ``int``, ``long``, ``date``, ``codes`` or
    ``any``.

    The text is parsed once, into a struct with a VARIANT for each known key.
    The struct goes through a generator, which no projection above is merged
    into, so the columns made from it do not parse it again; so do the results,
    so that a filter on them is not unfolded into all that they are made of."""
    keys, limits = list(kinds), limits or {}
    names = lambda prefix: ", ".join(f"{prefix}{k}" for k in keys)
    schema = ", ".join(f"`{k}` variant" for k in keys) + f", {_BROKEN} string"
    out = df.selectExpr("*", f"inline(array(from_json(`{text}`, '{schema}', map('columnNameOfCorruptRecord', '{_BROKEN}')))) AS ({names('_j_')}, {_BROKEN})")
    out = out.selectExpr("*", *(f"regexp_extract(schema_of_variant(_j_{k}), '^([A-Z]+)', 1) AS _k_{k}" for k in keys))
    some = {k: f"(_j_{k} IS NOT NULL AND _k_{k} <> 'VOID')" for k in keys}
    out = out.selectExpr("*", *(f"CASE WHEN {some[k]} THEN {_value(f'_j_{k}', f'_k_{k}', kinds[k])} END AS _v_{k}" for k in keys))
    wrong = " OR ".join(f"({some[k]} AND _v_{k} IS NULL)" for k in keys)
    long = " OR ".join(["false", *(f"coalesce(char_length(_v_{k}) > {n}, false)" for k, n in limits.items() if k in kinds)])
    why = f"""CASE WHEN NOT coalesce(regexp_like(`{text}`, r'^\\s*\\{{'), false) OR {_BROKEN} IS NOT NULL THEN '{NO_OBJECT}'
        WHEN {wrong} THEN '{BAD_TYPE}' WHEN {long} THEN '{TOO_LONG}' END"""
    made = ", ".join([why, *(f"_v_{k}" for k in keys), *(f"_j_{k} IS NOT NULL" for k in keys)])
    own = [f"`{c}`" for c in df.columns]
    return out.selectExpr(*own, f"inline(array(struct({made}))) AS (_why, {names('_v_')}, {names('_has_')})")
