"""Array helpers that stay linear in the size of one row's array or text."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256
_BLOCK_BITS = 11
_BLOCK = 1 << _BLOCK_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


@lru_cache
def _map(sql: str) -> Column:
    return F.expr(sql)


def map_literal(values: dict[str, str] | dict[str, int]) -> Column:
    """A constant map of plain words, as one SQL expression."""
    return _map("map(" + ", ".join(f"{k!r}, {v!r}" for k, v in values.items()) + ")")


def ranks(names: Iterable[str]) -> Column:
    return map_literal({name: i for i, name in enumerate(names)})


def lookup(values: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(map_literal(values), key), default)


def running(
    values: Column, step: Callable[[Column, Column], Column], zero: int | Column = 0
) -> Column:
    """Exclusive running total of an array: ``[zero, step(zero, v1), ...]``.

    The result is one longer than the input, its last element the total. Appending to an
    array copies it, so the fold runs over chunks of 256 and then over the chunk totals.
    ``step`` must be associative with ``zero`` as its identity.
    """

    def fold(arr: Column) -> Column:
        return F.aggregate(
            arr,
            F.array(F.lit(zero)),
            lambda acc, v: F.array_append(acc, step(F.element_at(acc, -1), v)),
        )

    def chunked(arr: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.shiftright(F.size(arr) - 1, 8)),
            lambda i: fold(F.slice(arr, i * _CHUNK + 1, F.lit(_CHUNK))),
        )

        def join(done: Column) -> Column:
            base = fold(F.transform(done, lambda p: F.element_at(p, -1)))
            shifted = F.flatten(
                F.zip_with(
                    done,
                    F.slice(base, F.lit(1), F.size(done)),
                    lambda p, b: F.transform(
                        F.slice(p, F.lit(1), F.size(p) - 1), lambda v: step(b, v)
                    ),
                )
            )
            return F.array_append(shifted, F.element_at(base, -1))

        return let(parts, join)

    return let(
        values,
        lambda arr: F.when(F.size(arr) <= _CHUNK, fold(arr)).otherwise(chunked(arr)),
    )


def blocks(text: Column) -> Column:
    """The text cut into pieces of 2048 code points, so that ``piece`` need not rescan it."""
    return F.when(F.length(text) <= _BLOCK, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    )


def piece(cut: Column, start: Column, end: Column) -> Column:
    """Characters ``[start, end)`` of a text given as ``blocks``."""
    first = F.shiftright(start, _BLOCK_BITS)
    last = F.shiftright(end - 1, _BLOCK_BITS)
    return (
        F.when(end <= start, F.lit(""))
        .when(F.size(cut) == 1, F.substring(cut[0], start + 1, end - start))
        .when(
            first == last,
            F.substring(F.get(cut, first), start - first * _BLOCK + 1, end - start),
        )
        .otherwise(
            F.concat(
                F.substring(F.get(cut, first), start - first * _BLOCK + 1, F.lit(_BLOCK)),
                F.array_join(F.slice(cut, first + 2, last - first - 1), ""),
                F.substring(F.get(cut, last), F.lit(1), end - last * _BLOCK),
            )
        )
    )
