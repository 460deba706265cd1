"""Queries as SQL that Spark and DuckDB share, with macros where they differ.

A macro is @name(args); its arguments may hold further macros. Tables stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load
from .catalogue import register

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name -> (Spark, DuckDB); {0}, {1} are the arguments.
MACROS = {
    "us": ("unix_micros(cast({0} as timestamp))", "epoch_us({0})"),
    "day": ("date_format({0}, 'yyyy-MM-dd')", "strftime({0}, '%Y-%m-%d')"),
    "hour": ("hour({0})", "hour({0})"),
    "json": ("get_json_object({0}, '$.{1}')", "json_extract_string({0}, '$.{1}')"),
    "is_json": ("try_parse_json({0}) is not null", "json_valid({0})"),
    "list": ("sort_array(collect_list({0}))", "list_sort(list({0}))"),
    "set": ("sort_array(collect_set({0}))", "list_sort(list(distinct {0}))"),
    "len": ("size({0})", "len({0})"),
    "at": ("element_at({0}, cast({1} as int))", "{0}[cast({1} as bigint)]"),
    "join": ("array_join({0}, {1})", "array_to_string({0}, {1})"),
    "bytes": ("octet_length({0})", "strlen({0})"),
    "count_re": ("regexp_count({0}, {1})", "len(regexp_extract_all({0}, {1}))"),
    "first_re": ("regexp_extract({0}, {1}, {2})", "regexp_extract({0}, {1}, {2})"),
    "sub_re": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "like_re": ("({0} rlike {1})", "regexp_matches({0}, {1})"),
    "split": ("split({0}, {1})", "string_split({0}, {1})"),
    "common": ("array_intersect({0}, {1})", "list_intersect({0}, {1})"),
    "either": ("array_union({0}, {1})", "list_distinct(list_concat({0}, {1}))"),
    "minus": ("array_except({0}, {1})", "list_filter({0}, lambda x: not list_contains({1}, x))"),
    "first_by": ("min_by({0}, {1})", "arg_min({0}, {1})"),
    "last_by": ("max_by({0}, {1})", "arg_max({0}, {1})"),
    "any": ("bool_or({0})", "bool_or({0})"),
    "div": ("({0} div {1})", "({0} // {1})"),
    "week": ("concat(extract(yearofweek from {0}), '-W', lpad(cast(weekofyear({0}) as string), 2, '0'))", "strftime({0}, '%G-W%V')"),
    "ym": ("date_format({0}, 'yyyy-MM')", "strftime({0}, '%Y-%m')"),
    "text": ("cast({0} as string)", "cast({0} as varchar)"),
    "md5": ("md5({0})", "md5({0})"),
    "pow": ("power({0}, {1})", "pow({0}, {1})"),
    "in": ("array_contains({0}, {1})", "list_contains({0}, {1})"),
}


def _arguments(sql: str, start: int) -> tuple[list[str], int]:
    """The arguments of the call whose parenthesis opens before start, and where it ends."""
    out, depth, quoted, at = [], 0, False, start
    for i in range(start, len(sql)):
        c = sql[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]" and depth:
            depth -= 1
        elif c == ")":
            return [*out, sql[at:i].strip()], i + 1
        elif c == "," and not depth:
            out.append(sql[at:i].strip())
            at = i + 1
    raise ValueError(sql[start : start + 60])


def expand(sql: str, side: int) -> str:
    """sql for Spark (0) or DuckDB (1)."""
    while m := re.search(r"@(\w+)\(", sql):
        args, end = _arguments(sql, m.end())
        text = MACROS[m[1]][side]
        for i, a in enumerate(args):
            text = text.replace(f"{{{i}}}", a)
        sql = sql[: m.start()] + text + sql[end:]
    if side == 0:
        return sql.replace("\\", "\\\\")  # Spark's literals take a backslash as an escape
    return re.sub(r"\{(" + "|".join(TABLES) + r")\}", r"\1", sql)


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a query in Spark."""
    text = expand(sql, 0)
    used = sorted(set(re.findall(r"\{(" + "|".join(TABLES) + r")\}", text)))
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in used})


def both(name: str, sql: str, duck: str | None = None) -> None:
    """Registers a query; duck is its DuckDB text where macros don't do."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frame(spark, sf_dir, sql)

    run.__name__, run.__doc__ = name, sql
    register(name, expand(duck or sql, 1))(run)
