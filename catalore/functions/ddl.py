"""Text of the statements that write comments into the catalog, and that take them back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalore.functions.names import quote_identifier


def escape_literal(c: Column) -> Column:
    """Body of a quoted SQL literal; a missing text becomes the word NULL.

    The backslash is an escape character in Spark SQL literals, so it is doubled too.
    """
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.coalesce(F.replace(doubled, F.lit("'"), F.lit("''")), F.lit("NULL"))


def _table() -> Column:
    names = ["catalog_name", "schema_name", "table_name"]
    return F.concat_ws(".", *[quote_identifier(F.col(name)) for name in names])


def column_comment_statement(text: Column) -> Column:
    return F.concat(
        F.lit("ALTER TABLE "),
        _table(),
        F.lit(" \nALTER COLUMN "),
        quote_identifier(F.col("column_name")),
        F.lit(" \nCOMMENT '"),
        escape_literal(text),
        F.lit("';"),
    )


def table_comment_statement(text: Column) -> Column:
    return F.concat(
        F.lit("ALTER TABLE "),
        _table(),
        F.lit(" \nSET TBLPROPERTIES ('comment' = '"),
        escape_literal(text),
        F.lit("');"),
    )


def column_restore_statement(original: Column) -> Column:
    """Back to the original column comment, or to an empty one."""
    return column_comment_statement(F.coalesce(original, F.lit("")))


def table_restore_statement(original: Column) -> Column:
    """Back to the original table comment, or to none."""
    unset = F.concat(F.lit("ALTER TABLE "), _table(), F.lit(" \nUNSET TBLPROPERTIES ('comment');"))
    return F.when(original.isNull(), unset).otherwise(table_comment_statement(original))
