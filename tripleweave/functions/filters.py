"""Filter expressions over pattern variables.

Variables are written ``"?x"``. Python numbers compare as numbers, quoted text
(``'"x"'``) as literals, everything else as terms. All functions return a Column, so
``&``, ``|`` and ``~`` combine them and any other Spark expression can join in.
"""

from __future__ import annotations

import operator

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleweave.functions import terms

_OPS = {
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
    "=": operator.eq,
    "!=": operator.ne,
}


# Digits that a double tells apart in any number.
DOUBLE_DIGITS = 15


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def var(x) -> Column:
    """A variable, or the Column itself."""
    if isinstance(x, Column):
        return x
    return F.col(x.removeprefix("?"))


def term(x) -> Column:
    """A variable, a Column, or a constant term, spelled as in a pattern."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str) and x.startswith("?"):
        return var(x)
    return F.lit(x)


def number(x) -> Column:
    return F.lit(float(x)) if _is_number(x) else terms.numeric(term(x))


def compare(left, op: str, right) -> Column:
    """Numbers by value, other terms by text; two variables by value when both are numbers."""
    fn = _OPS[op]
    if _is_number(left) or _is_number(right):
        return _by_value(fn, left, right)
    a, b = term(left), term(right)
    constants = [x for x in (left, right) if isinstance(x, str) and not x.startswith("?")]
    if constants and op in ("=", "!="):
        return fn(a, b)  # plain equality on the term, which Parquet can prune on
    by_text = fn(a, b) if op in ("=", "!=") else fn(terms.lexical(a), terms.lexical(b))
    if constants:
        return by_text
    return F.coalesce(_by_value(fn, a, b), by_text)


def _by_value(fn, left, right) -> Column:
    """Compare as doubles, or as decimals where both are spelled with more digits than a double holds."""
    doubles = fn(number(left), number(right))
    sides = [x for x in (left, right) if not _is_number(x)]
    if any(isinstance(x, float) for x in (left, right)):
        return doubles
    long = [F.length(terms.lexical(term(x))) > DOUBLE_DIGITS for x in sides]
    long += [F.lit(len(str(abs(x))) > DOUBLE_DIGITS) for x in (left, right) if _is_number(x)]
    exact = fn(_decimal(left), _decimal(right))
    return F.when(reduce(lambda a, b: a | b, long), F.coalesce(exact, doubles)).otherwise(doubles)


def _decimal(x) -> Column:
    if _is_number(x):
        return F.lit(str(x)).try_cast("decimal(38,12)")
    text = terms.lexical(term(x))
    return F.when(text.rlike(r"^[+-]?\d{1,26}(?:\.\d{1,12})?$"), text.try_cast("decimal(38,12)"))


def bound(x) -> Column:
    return var(x).isNotNull()


def not_bound(x) -> Column:
    return var(x).isNull()


def add(left, right) -> Column:
    return number(left) + number(right)


def subtract(left, right) -> Column:
    return number(left) - number(right)


def str_(x) -> Column:
    return terms.lexical(term(x))


def lang(x) -> Column:
    return terms.lang(term(x))


def lang_matches(x, range_: str) -> Column:
    """Basic language-range matching; ``*`` accepts any tag."""
    tag = F.lower(lang(x))
    if range_ == "*":
        return tag != ""
    want = range_.lower()
    return (tag == want) | tag.startswith(want + "-")


def regex(x, pattern: str, flags: str = "") -> Column:
    """Search ``pattern`` in the lexical form; flags as in SPARQL (``i``, ``s``, ``m``, ``x``)."""
    return str_(x).rlike(f"(?{flags}){pattern}" if flags else pattern)
