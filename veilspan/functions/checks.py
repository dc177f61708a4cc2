"""Checks that a matched value must pass to count as a card number or an IPv4 address.

Neither takes the value apart: a lambda over single digits costs more than finding the value.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.arrays import let

# What a card number may hold besides digits, as plain characters.
_BETWEEN = "-\t\n\x0b\f\r   " + "".join(map(chr, range(0x2000, 0x200B))) + (
    "    　﻿"
)

# Luhn sum of two digits, the left one doubled, by their number.
_PAIRS = ", ".join(str(sum(divmod(n // 10 * 2, 10)) + n % 10) for n in range(100))
_HALF = 10


def is_card(value: Column) -> Column:
    """13 to 19 digits after dashes and blanks are dropped, and a Luhn sum ending in zero."""
    pairs = F.expr(f"array({_PAIRS})")

    def luhn(number: Column) -> Column:
        total = F.lit(0)
        for i in range(_HALF // 2):
            pair = F.call_function("div", number, F.lit(100**i)) % 100
            total = total + F.get(pairs, pair.cast("int"))
        return total

    def check(digits: Column) -> Column:
        # Nineteen digits are more than a bigint holds, so the number is taken in two.
        low = F.right(digits, F.lit(_HALF)).cast("bigint")
        high = F.left(digits, F.length(digits) - _HALF).cast("bigint")
        total = let(low, luhn) + let(high, luhn)
        return F.when(digits.rlike(r"^[0-9]{13,19}\z"), total % 10 == 0).otherwise(
            F.when(digits.isNotNull(), False)
        )

    return let(F.translate(value, _BETWEEN, ""), check)


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def is_ipv4(value: Column) -> Column:
    """Four dotted parts, each between 0 and 255; leading zeros are allowed."""
    return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z")
