"""Partition columns out of ``CREATE TABLE`` text, as Spark SQL expressions.

String literals (comments, table properties) are removed first, so text
inside them can neither pose as the clause nor close it.  The text after
``PARTITIONED BY`` is then cut into tokens by one regular expression --
back-ticked names, brackets, commas and runs of anything else -- so a ``)``
or ``,`` inside a quoted name is part of a single token and never counts.  The built-in higher-order
function ``aggregate`` then folds the tokens, tracking parenthesis depth and
angle-bracket depth (``struct<a:int,b:int>``) and splitting on top-level
commas.  No UDF: the fold runs inside the executor JVM and scales with the
number of DDL rows like any projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the clause that lists partition columns (case-insensitive).
CLAUSE_PREFIX = r"(?i)(PARTITIONED\s+BY\s*)\("

# One token: a single- or double-quoted string (backslash escapes), a
# back-ticked name (doubled back-ticks inside), a bracket or comma, a run of
# other characters, or any single leftover character (an unclosed quote).
TOKEN = (
    r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
    r"|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\""
    r"|`[^`]*+(?:``[^`]*+)*+`"
    r"|[()<>,]"
    r"|[^'\"`()<>,]++"
    r"|(?s)."
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A back-ticked name (kept, group 1) or a quoted string literal (dropped).
_NAME_OR_STRING = (
    r"(`[^`]*+(?:``[^`]*+)*+`)"
    r"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"
    r"|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\""
)


def _without_strings(ddl: Column) -> Column:
    """The DDL with its string literals (comments, properties) removed, so
    that text inside them can neither look like the clause nor end it."""
    return F.regexp_replace(ddl, _NAME_OR_STRING, "$1")


def _clause_tail(ddl: Column) -> Column:
    """Text from the clause's opening parenthesis to the end, NULL if absent."""
    text = _without_strings(ddl)
    start = F.regexp_instr(text, F.lit(CLAUSE_PREFIX))
    prefix_len = F.length(F.regexp_extract(text, CLAUSE_PREFIX, 1))
    return F.when(start > 0, F.substr(text, start + prefix_len))


def _fold(tail: Column, finish) -> Column:
    init = F.struct(
        F.lit(0).alias("d"),
        F.lit(0).alias("a"),
        F.lit("").alias("buf"),
        F.array().cast("array<string>").alias("out"),
        F.lit(False).alias("done"),
    )

    def step(acc: Column, tok: Column) -> Column:
        d, a, buf, out = acc["d"], acc["a"], acc["buf"], acc["out"]
        done = acc["done"]
        closes = (tok == ")") & (d == 1)
        splits = (tok == ",") & (d == 1) & (a == 0)
        cut = closes | splits
        keep = (tok != "(") | (d > 0)
        return F.when(done, acc).otherwise(
            F.struct(
                (d + F.when(tok == "(", 1).when(tok == ")", -1).otherwise(0)).alias("d"),
                F.greatest(a + F.when(tok == "<", 1).when(tok == ">", -1).otherwise(0), F.lit(0)).alias("a"),
                F.when(cut, F.lit("")).when(keep, F.concat(buf, tok)).otherwise(buf).alias("buf"),
                F.when(cut, F.concat(out, F.array(buf))).otherwise(out).alias("out"),
                closes.alias("done"),
            )
        )

    tokens = F.regexp_extract_all(tail, F.lit(TOKEN), 0)
    return F.aggregate(tokens, init, step, finish)


def partitioned_by_clause(ddl: Column | str) -> Column:
    """Text inside ``PARTITIONED BY ( ... )`` with balanced brackets (string
    literals such as comments left out); NULL when there is no clause or it
    is never closed."""
    tail = _clause_tail(_col(ddl))

    def finish(acc: Column) -> Column:
        return F.when(acc["done"], F.array_join(acc["out"], ","))

    return F.when(tail.isNotNull(), _fold(tail, finish))


def _piece_name(piece: Column) -> Column:
    p = F.trim(piece)
    quoted = F.replace(F.regexp_extract(p, "^`((?:[^`]|``)*+)`", 1), F.lit("``"), F.lit("`"))
    bare = F.regexp_extract(p, r"^(\S+)", 1)
    return F.when(p.startswith("`"), quoted).otherwise(bare)


def ddl_partition_columns(ddl: Column | str) -> Column:
    """Ordered ``array<string>`` of partition column names declared in a DDL
    text; empty when there is no clause or it is unbalanced.

    Each top-level piece contributes its first token: a back-ticked name is
    read whole (spaces and doubled back-ticks included), otherwise the first
    run of non-blank characters.
    """
    tail = _clause_tail(_col(ddl))

    def finish(acc: Column) -> Column:
        return F.when(acc["done"], acc["out"]).otherwise(F.array().cast("array<string>"))

    names = F.filter(F.transform(_fold(tail, finish), _piece_name), lambda n: n != "")
    return F.when(tail.isNotNull(), names).otherwise(F.array().cast("array<string>"))
