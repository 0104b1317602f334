"""Plain numbers as people type them into price files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A plain non-negative number: outer blanks, one leading $, thousands commas in threes, a decimal part.
PLAIN_NUMBER = r"^\s*\$?\s*([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?\s*$"


def plain_number(text: Column) -> Column:
    """The value of a plain non-negative number, null for any other text and for null."""
    return F.when(text.rlike(PLAIN_NUMBER), F.regexp_replace(text, r"[\s$,]", "").try_cast("double"))
