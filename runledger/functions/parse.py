"""Tolerant scalar parsing of event payloads (all built-in Column expressions, no UDFs).

Payload values arrive as JSON text; a value may be a number, a numeric string, "", null or
missing. ``get_json_object`` returns the text of any scalar, so every parser starts from text.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python float() accepts these forms; try_cast alone also accepts '5d'/'5f' suffixes and
# rejects '1_000', so the text is checked against Python's grammar first.
_FLOAT_RE = r"^\s*[+-]?((\d[\d_]*(\.[\d_]*)?|\.\d[\d_]*)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"
_INT_RE = r"^\s*[+-]?\d[\d_]*\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_text(payload, key: str) -> Column:
    """``payload->>'key'`` - the text of a scalar member, NULL when missing or JSON null."""
    return F.get_json_object(_col(payload), f"$['{key}']")


def parse_str(c) -> Column:
    """'' -> NULL, else the value's text."""
    return F.nullif(_col(c), F.lit(""))


_FLOAT_SPECIAL = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity", "nan", "+nan", "-nan")


_PLAIN_FLOAT_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_float(c) -> Column:
    """NULL, '' or junk -> NULL; Python float() grammar.

    The common decimal form is recognised by a short anchored pattern before casting (a
    failing cast is far more expensive than a failing match); inf/nan spellings and '_'
    digit separators are the rare fall-through branches. Forms Python rejects ('5d',
    hex) never reach the cast."""
    t = F.trim(_col(c))
    return (F.when(t.rlike(_PLAIN_FLOAT_RE), t.try_cast("double"))
            .when(F.lower(t).isin(*_FLOAT_SPECIAL), F.lower(t).try_cast("double"))
            .when(t.contains("_") & F.lower(t).rlike(_FLOAT_RE),
                  F.regexp_replace(t, "_", "").try_cast("double")))


def parse_int(c, default: int = 1) -> Column:
    """integer text -> int, anything else (NULL, '', '3.7', 'x') -> ``default``."""
    t = _col(c)
    parsed = F.when(t.rlike(_INT_RE), F.regexp_replace(F.trim(t), "_", "").try_cast("int"))
    return F.coalesce(parsed, F.lit(default))


def parse_tag(c) -> Column:
    """sample id from a process tag - the part before the first ':'; NULL/'' -> NULL."""
    t = F.nullif(_col(c), F.lit(""))
    return F.substring_index(t, ":", 1)


def _members(payload) -> Column:
    """A JSON object as a map of typed members; NULL for anything else."""
    return F.try_variant_get(F.try_parse_json(_col(payload)), "$", "map<string,variant>")


def json_has_key(payload, key: str) -> Column:
    """JSONB ``?`` on an object; a member that is JSON null counts. False for other JSON."""
    text = F.from_json(_col(payload), "map<string,string>")       # objects that repeat a key
    return F.when(_col(payload).isNotNull(),
                  F.coalesce(F.map_contains_key(_members(payload), key), F.map_contains_key(text, key), F.lit(False)))


def json_drop_key(payload, key: str) -> Column:
    """JSONB ``-`` on an object; returns JSON text.

    The other members keep their types, nesting and order (members of nested objects come by
    name). Of a key that an object repeats the last value counts, and its members are read as
    text. What is no object stays as it is."""
    p = _col(payload)
    keys = F.filter(F.array_distinct(F.json_object_keys(p)), lambda k: k != F.lit(key))
    typed, text = _members(p), F.from_json(p, "map<string,string>")

    def last(k):
        return F.element_at(F.map_values(F.map_filter(text, lambda name, _: name == k)), -1)

    whole = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(typed, k)))
    return F.coalesce(F.when(typed.isNotNull(), F.to_json(whole)),
                      F.to_json(F.map_from_arrays(keys, F.transform(keys, last))), p)


def variant_text(payload, key: str) -> Column:
    """The text of a member of a VARIANT payload; NULL when missing or JSON null."""
    return F.try_variant_get(_col(payload), f"$['{key}']", "string")


def row_to_json_except(df_columns, exclude: str) -> Column:
    """F8: every column but ``exclude`` as one JSON object of strings."""
    cols = [F.col(c).cast("string").alias(c) for c in df_columns if c != exclude]
    return F.to_json(F.struct(*cols))


# Columns of the flat task fact and the trace key each one is read from (fixed values).
TRACE_FIELDS_FLOAT = [
    ("realtime_ms", "realtime"),
    ("requested_cpus", "cpus"),
    ("requested_memory_bytes", "memory"),
    ("requested_time_ms", "time"),
    ("pct_cpu", "%cpu"),
    ("pct_mem", "%mem"),
    ("peak_rss", "peak_rss"),
    ("read_bytes", "read_bytes"),
    ("write_bytes", "write_bytes"),
    ("rchar", "rchar"),
    ("wchar", "wchar"),
]


TRACE_KEYS = ["task_id", "hash", "process", "name", "status", "attempt", "exit", "error_action",
              *[key for _, key in TRACE_FIELDS_FLOAT]]


def trace_members(trace="trace") -> Column:
    """All members of a trace that the task fact reads, as text, from one parse of the JSON text.
    Select it into a column before reading several members."""
    return F.from_json(_col(trace), "struct<" + ",".join(f"`{k}`:string" for k in TRACE_KEYS) + ">")


def task_fact_columns(trace="trace", strict: bool = False, read=None) -> list[Column]:
    """typed columns of one completed task. ``read(payload, key)`` gives the text of a member:
    by default of JSON text, ``variant_text`` for VARIANT, ``Column.getField`` for
    ``trace_members``.

    ``strict=True`` (U17, the backfill from stored events) casts with ANSI semantics, so
    junk numbers fail the job instead of becoming NULL or the default."""
    tr, member = _col(trace), read or json_text
    if strict:
        return ([F.coalesce(member(tr, "task_id"), F.lit("")).alias("task_id")]
                + [parse_str(member(tr, k)).alias(n) for n, k in
                   (("task_hash", "hash"), ("process", "process"), ("name", "name"),
                    ("status", "status"))]
                + [F.coalesce(parse_str(member(tr, "attempt")), F.lit("1")).cast("int").alias("attempt")]
                + [parse_str(member(tr, k)).alias(n) for n, k in
                   (("exit_code", "exit"), ("error_action", "error_action"))]
                + [parse_str(member(tr, key)).cast("double").alias(name)
                   for name, key in TRACE_FIELDS_FLOAT])
    out = [
        F.coalesce(member(tr, "task_id"), F.lit("")).alias("task_id"),
        parse_str(member(tr, "hash")).alias("task_hash"),
        parse_str(member(tr, "process")).alias("process"),
        parse_str(member(tr, "name")).alias("name"),
        parse_str(member(tr, "status")).alias("status"),
        parse_int(member(tr, "attempt")).alias("attempt"),
        parse_str(member(tr, "exit")).alias("exit_code"),
        parse_str(member(tr, "error_action")).alias("error_action"),
    ]
    out += [parse_float(member(tr, key)).alias(name) for name, key in TRACE_FIELDS_FLOAT]
    return out
