"""Queries by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def listed(values) -> str:
    """A SQL list of strings."""
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


#: SQL of the phrase normaliser on an expression.
def sql_normalise(x: str) -> str:
    from plumbline.functions.text import BOILERPLATE

    entities = f"replace(replace(replace(replace(replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
    s = f"trim(regexp_replace(regexp_replace(regexp_replace(lower({entities}), '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g'), '-{{2,}}', '-', 'g'), '\\s+', ' ', 'g'))"
    return f"array_to_string(list_filter(list_transform(string_split({s}, ' '), lambda t: regexp_replace(t, '^[-_]+|[-_]+$', '', 'g')), lambda t: t <> '' AND NOT list_contains({listed(BOILERPLATE)}, t)), ' ')"


#: The catalog of the star schema: parts, with counts and mean quantities of their line items as ratings.
CATALOG = """catalog AS (SELECT p.p_partkey AS doc, p.p_name AS title, p.p_brand AS store, p.p_type AS bucket, p.p_size AS size, p.p_retailprice AS price,
    coalesce(l.n, 0) AS cnt, coalesce(l.stars, 0) AS stars FROM part p
    LEFT JOIN (SELECT l_partkey, count(*) AS n, round(avg(l_quantity), 6) AS stars FROM lineitem GROUP BY 1) l ON l.l_partkey = p.p_partkey)"""
