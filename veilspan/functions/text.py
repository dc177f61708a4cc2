"""Column expressions on a text: invisible characters and blankness."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.patterns import INVISIBLE_CHAR, NOT_BLANK


def stripped(text: Column) -> Column:
    """Every invisible character is outside ASCII, so pure ASCII texts skip the scan."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(
        F.regexp_replace(text, INVISIBLE_CHAR, "")
    )


def not_blank(text: Column) -> Column:
    return text.rlike(NOT_BLANK)
