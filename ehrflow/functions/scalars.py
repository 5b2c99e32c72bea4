"""Column -> Column helpers for the record rules (ages, local time, JSON
vitals, display fallbacks, names, codes).

All of them are built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that the results must reproduce.
LOCAL_ZONE = "America/Bogota"
# Python strftime patterns used for display, and their Spark equivalents:
#   %d/%m/%Y %H:%M   clinician view / print stamp
#   %Y%m%d           export file name
#   %d-%m-%Y %H:%M   encounter header in the document
#   %d de %B, %Y     encounter date in the patient view
#   %I:%M %p         encounter time in the patient view
FORMATS = {
    "stamp": "dd/MM/yyyy HH:mm",
    "compact": "yyyyMMdd",
    "header": "dd-MM-yyyy HH:mm",
    "long_date": "dd 'de' MMMM, yyyy",
    "clock": "hh:mm a",
}
# Fallback texts for the responsible professional's name.
NO_PROFESSIONAL = "No especificado"
UNKNOWN_PROFESSIONAL = "Desconocido"
STAFF_PROFESSIONAL = "Profesional de Staff"
ON_DUTY_PROFESSIONAL = "Profesional de Turno"
PENDING_SIGNATURE = "Firma Pendiente"


def _c(x) -> Column:
    if x is None:
        return F.lit(None).cast("string")
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# ---------------------------------------------------------------- dates ---

def ntz_lit(value) -> Column:
    """A fixed wall time as a TIMESTAMP_NTZ column, built from its ISO text
    so neither the Python process nor the session time zone shifts it. A
    Column is returned unchanged."""
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def as_of_date(as_of) -> Column:
    """A fixed 'today' as a DATE column. Accepts a date, a datetime (taken
    as local wall time), an ISO string or a Column."""
    if isinstance(as_of, Column):
        return as_of.cast("date")
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.date()
    if isinstance(as_of, _dt.date):
        return F.lit(as_of)
    return F.to_date(F.lit(str(as_of)))


def now_utc() -> Column:
    """The current instant as a UTC wall time (TIMESTAMP_NTZ), for callers
    that want "now" rather than a fixed ``as_of``; right in any session
    time zone."""
    return F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))


def age_years(dob, as_of) -> Column:
    """Completed years between ``dob`` and ``as_of``; null in, null out.

    Birthday not reached yet this year (month/day compared as a pair)
    takes one year off, so 2004-02-29 is 18 on 2023-02-28.
    """
    d = _c(dob)
    a = as_of_date(as_of)
    before = (F.month(a) < F.month(d)) | ((F.month(a) == F.month(d)) & (F.dayofmonth(a) < F.dayofmonth(d)))
    return (F.year(a) - F.year(d) - before.cast("int")).cast("int")


def display_age(dob, stored_age, as_of, recompute: bool = True) -> Column:
    """Age as shown: recomputed when a birth date exists, else the stored
    value. ``recompute=False`` returns the stored (possibly stale) value, as
    the admissions lookup does."""
    if not recompute:
        return _c(stored_age)
    return F.coalesce(age_years(dob, as_of), _c(stored_age))


def to_local(ts, zone: str = LOCAL_ZONE) -> Column:
    """UTC wall time (TIMESTAMP_NTZ) -> wall time in ``zone``; historic
    daylight-saving rules of the zone apply."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(ts).cast("timestamp_ntz"))


# Month names as Python prints them with no locale set.
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December"]


def _pad(x: Column, n: int = 2) -> Column:
    """At least ``n`` digits; longer numbers keep all of theirs."""
    s = x.cast("string")
    return F.lpad(s, F.greatest(F.char_length(s), F.lit(n)), F.lit("0"))


def fmt(ts, pattern: str) -> Column:
    """A timestamp as display text, by named pattern: ``stamp``
    (dd/MM/yyyy HH:mm), ``compact`` (yyyyMMdd), ``header`` (dd-MM-yyyy
    HH:mm), ``long_date`` (dd de <Month>, yyyy), ``clock`` (hh:mm AM/PM) or
    ``iso_micros`` (yyyy-MM-dd HH:mm:ss.ffffff).

    The text is assembled from the value's own fields, so a zone-less
    (TIMESTAMP_NTZ) wall time prints as stored in any session time zone;
    Spark's ``date_format`` would pass it through the session zone and move
    wall times that fall in that zone's daylight-saving gap. Any other
    pattern is handed to ``date_format`` as a Spark pattern."""
    t = _c(ts)
    day, month, year = _pad(F.dayofmonth(t)), _pad(F.month(t)), _pad(F.year(t), 4)
    hh, mi = _pad(F.hour(t)), _pad(F.minute(t))
    if pattern == "stamp":
        return F.concat(day, F.lit("/"), month, F.lit("/"), year, F.lit(" "), hh, F.lit(":"), mi)
    if pattern == "compact":
        return F.concat(year, month, day)
    if pattern == "header":
        return F.concat(day, F.lit("-"), month, F.lit("-"), year, F.lit(" "), hh, F.lit(":"), mi)
    if pattern == "long_date":
        name = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(t))
        return F.concat(day, F.lit(" de "), name, F.lit(", "), year)
    if pattern == "clock":
        h12 = _pad((F.hour(t) + 11) % 12 + 1)
        return F.concat(h12, F.lit(":"), mi, F.lit(" "), F.when(F.hour(t) < 12, "AM").otherwise("PM"))
    if pattern == "iso_micros":
        micros = (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long") % 1_000_000
        return F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), hh, F.lit(":"), mi, F.lit(":"),
                        _pad(F.second(t)), F.lit("."), _pad(micros, 6))
    return F.date_format(t, FORMATS.get(pattern, pattern))


def local_today(as_of_ts, zone: str = LOCAL_ZONE) -> Column:
    """Local calendar date of a UTC instant."""
    return F.to_date(to_local(as_of_ts, zone))


def days_before(ts, n) -> Column:
    """``ts - INTERVAL n DAYS``."""
    return _c(ts) - F.make_dt_interval(days=_lit(n))


def export_name(doc_id, as_of_local, ext: str = "pdf") -> Column:
    """``HC_{id}_{yyyymmdd}.{ext}`` with the local print date."""
    return F.concat(F.lit("HC_"), _c(doc_id).cast("string"), F.lit("_"),
                    fmt(as_of_local, "compact"), F.lit("." + ext))


def iso_date_part(c) -> Column:
    """Date part of an ISO text (text before the first ``T``)."""
    return F.split_part(_c(c), F.lit("T"), F.lit(1))


# ----------------------------------------------------------------- JSON ---

def parse_json_or_empty(c) -> Column:
    """Vitals that may arrive as text: NULL or '' -> NULL (nothing shown);
    invalid JSON -> ``{}``; valid -> the parsed variant. Of a repeated key the
    last value counts, as in the documents (:func:`vitals_struct`): the
    variant parser refuses such text, which is then read as a map and written
    anew."""
    s = _c(c)
    last = F.aggregate(F.map_entries(F.from_json(s, "map<string,variant>")), F.expr("CAST(array() AS ARRAY<STRUCT<key: STRING, value: VARIANT>>)"),
                       lambda kept, x: F.concat(F.filter(kept, lambda y: y["key"] != x["key"]), F.array(x)))
    again = F.try_parse_json(F.to_json(F.map_from_entries(last)))
    return (F.when(s.isNull() | (s == ""), F.lit(None).cast("variant"))
            .otherwise(F.coalesce(F.try_parse_json(s), again, F.parse_json(F.lit("{}")))))


def parse_vitals(c) -> Column:
    """Vitals text at rest -> VARIANT, reading a JSON *string* holding JSON
    a second time (the text-in-JSONB case). The string case is recognised
    from the raw text, which is cheaper than inspecting the variant."""
    s = _c(c)
    v = parse_json_or_empty(s)
    inner = parse_json_or_empty(F.try_variant_get(v, "$", "string"))
    return F.when(F.ltrim(s).startswith('"'), inner).otherwise(v)


def object_at_rest(c) -> Column:
    """JSON text -> the VARIANT to save: as :func:`parse_vitals`, with ``{}``
    for what is no object (a list or a bare value has no key to show). Files
    of objects only are shredded into typed columns."""
    v = parse_vitals(c)
    return F.when(v.isNull() | F.regexp_like(F.schema_of_variant(v), F.lit("^(OBJECT|VOID)")), v).otherwise(F.parse_json(F.lit("{}")))


def vitals_struct(c, keys) -> Column:
    """Vitals text at rest -> a struct with one VARIANT per key (NULL when
    the key is absent or the text is not a JSON object). One JSON pass with
    the schema known up front; a repeated key keeps its last value, as a
    Python ``json.loads`` does. A JSON string holding JSON is read again."""
    s = _c(c)
    inner = F.when(F.ltrim(s).startswith('"'), F.try_variant_get(F.try_parse_json(s), "$", "string")).otherwise(s)
    schema = "struct<" + ", ".join(f"`{k}`: variant" for k in keys) + ">"
    return F.from_json(inner, schema)


def vital(v, key: str, dtype: str = "string") -> Column:
    """One key of a vitals object; absent, empty, zero or unreadable -> NULL
    (the views only print truthy values). Numbers stored as text are read
    as numbers."""
    raw = F.try_variant_get(_c(v), f"$.{key}", dtype)
    if dtype == "string":
        return F.nullif(raw, F.lit(""))
    return F.nullif(raw, F.lit(0).cast(dtype))


def json_object(**fields) -> Column:
    """JSON object text from named columns; nulls are written as ``null``."""
    st = F.struct(*[_lit(v).alias(k) for k, v in fields.items()])
    return F.to_json(st, {"ignoreNullFields": "false"})


def json_array_of_objects(key: str, items: list[dict]) -> Column:
    """``{key: [{...}, ...]}`` as JSON text (prescription shape)."""
    arr = F.array(*[F.struct(*[_lit(v).alias(k) for k, v in it.items()]) for it in items])
    return F.to_json(F.struct(arr.alias(key)), {"ignoreNullFields": "false"})


def clean_vitals(m) -> Column:
    """Drop empty-valued entries of a string map; NULL when none is left."""
    kept = F.map_filter(_c(m), lambda k, v: v.isNotNull() & (v != ""))
    return F.when(F.size(kept) > 0, kept)


# ---------------------------------------------------------------- codes ---

# White space that a browser's ``trim`` removes (fixed values): ASCII white
# space, the Unicode space separators and line ends, and the byte order mark.
_TRIMMED = "[ \\t\\n\\x0B\\f\\r\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


def split_codes(c) -> Column:
    r"""Comma list -> array, each item trimmed of white space; empty items
    are kept (``'E11.9,'`` -> ``['E11.9', '']``). Trimming the ends and
    splitting on the comma with the space around it gives the same items as splitting and trimming
    each one, without a per-element lambda (which would leave codegen)."""
    return F.split(F.regexp_replace(_c(c), f"^{_TRIMMED}+|{_TRIMMED}+$", ""), f"{_TRIMMED}*,{_TRIMMED}*")


def join_codes(a) -> Column:
    """``', '``-joined codes, only for a non-empty array."""
    a = _c(a)
    return F.when(F.size(a) > 0, F.array_join(a, ", "))


# ------------------------------------------------------- text fallbacks ---

def blank_to_null(c) -> Column:
    """'' -> NULL."""
    return F.nullif(_c(c), F.lit(""))


def falsy_or(c, default) -> Column:
    """Template ``x or default`` for text: NULL and '' take the default."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), _lit(default))


def falsy_or_number(c, default) -> Column:
    """Numeric ``x or default`` rendered as text (age 0 shows the default)."""
    return F.coalesce(F.nullif(_c(c), F.lit(0)).cast("string"), _lit(default))


def coalesce_falsy(*cols, default="--") -> Column:
    """First non-blank text among ``cols``, else ``default``."""
    return F.coalesce(*[F.nullif(_c(x), F.lit("")) for x in cols], _lit(default))


def none_text(c) -> Column:
    """How a template prints a value: NULL -> ``None``."""
    return F.coalesce(_c(c).cast("string"), F.lit("None"))


def signature(first, last) -> Column:
    """``Dr. {first} {last}`` with ``None`` for a missing part."""
    return F.format_string("Dr. %s %s", none_text(first), none_text(last))


def full_name(n1, n2, a1, a2) -> Column:
    """``{n1} {n2 or ''} {a1} {a2 or ''}``; blank optional parts leave
    double spaces, a missing required part prints ``None``."""
    return F.concat_ws(" ", none_text(n1), F.coalesce(_c(n2), F.lit("")),
                       none_text(a1), F.coalesce(_c(a2), F.lit("")))


def capitalize(c) -> Column:
    """First character upper case, the rest lower case (whole string, not
    per word)."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.char_length(c))))


def html_escape(c) -> Column:
    """Markup escaping of ``& < > " '`` (ampersand first)."""
    c = _c(c)
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def with_unit(c, unit: str) -> Column:
    """``36.5°``, ``98%``, ``70kg``; NULL stays NULL."""
    return F.concat(_c(c).cast("string"), F.lit(unit))


def any_present(*cols) -> Column:
    """True when any of the text columns is non-blank."""
    out = F.lit(False)
    for x in cols:
        out = out | F.coalesce(_c(x) != "", F.lit(False))
    return out


def random_key() -> Column:
    """Random UUID text, as the column defaults produce."""
    return F.expr("uuid()")


def content_key(*cols) -> Column:
    """Replayable key: SHA-256 over the given columns."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(_c(x).cast("string"), F.lit("\u0000")) for x in cols]), 256)


def role_in(role, roles) -> Column:
    """Membership test; a NULL role is not a member."""
    return F.coalesce(_c(role).isin(list(roles)), F.lit(False))
