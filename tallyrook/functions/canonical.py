"""JSON texts in one canonical form, so that equal material has one digest however it was written."""

from __future__ import annotations

import json
from decimal import Decimal
from functools import lru_cache
from json.encoder import encode_basestring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of objects and arrays at most.
DEPTH = 128
#: Numbers below 10^21 and from 10^-6 on are written out, others with an exponent.
LEAST_POINT, MOST_POINT = -6, 21
#: Characters of a short text, and how many of these a worker keeps with their forms.
SHORT, KEPT = 256, 32_768


class _Number(str):
    """A number's canonical text."""


class Refused(ValueError):
    """What a text is not in canonical form for: a code."""


def _whole(text: str) -> _Number:
    """A whole number as JSON spells it; what is not below 10^21 by its length takes the longer way."""
    return _Number(text) if len(text) < MOST_POINT and text != "-0" else _Number(number(text))


@lru_cache(4096)
def _real(text: str) -> _Number:
    return _Number(number(text))


def number(text: str) -> str:
    """A JSON number with neither sign of zero, needless zeros nor rounding: 1, 1.0 and 10e-1 are one."""
    try:
        sign, digits, exponent = Decimal(text).as_tuple()
    except ArithmeticError as error:
        raise Refused("number") from error
    if not isinstance(exponent, int):
        raise Refused("number")
    whole = "".join(map(str, digits))
    bare = whole.rstrip("0")
    exponent += len(whole) - len(bare)
    point = len(bare) + exponent
    if not bare:
        return "0"
    if not LEAST_POINT < point <= MOST_POINT:
        shown = f"{bare[0]}{'.' if bare[1:] else ''}{bare[1:]}e{point - 1}"
    elif exponent >= 0:
        shown = bare + "0" * exponent
    else:
        shown = f"{bare[:point]}.{bare[point:]}" if point > 0 else f"0.{'0' * -point}{bare}"
    return "-" * sign + shown


def _object(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise Refused("repeated_key")
    return found


def _constant(name: str) -> None:
    raise Refused("number")


def _shown(x: object, unordered: frozenset[str], left: int, key: str | None = None) -> str:
    if isinstance(x, _Number):
        return x
    if isinstance(x, str):
        return encode_basestring(x)
    if x is None or x is True or x is False:
        return "null" if x is None else "true" if x else "false"
    if not left:
        raise Refused("too_deep")
    if isinstance(x, dict):
        return "{" + ",".join(f"{encode_basestring(k)}:{_shown(x[k], unordered, left - 1, k)}" for k in sorted(x)) + "}"
    items = [_shown(y, unordered, left - 1) for y in x]
    return "[" + ",".join(sorted(items) if key in unordered else items) + "]"


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_int=_whole, parse_float=_real, parse_constant=_constant)


def canonical_text(text: str, unordered: frozenset[str] = frozenset()) -> str:
    """The canonical form of a JSON text; Refused where it is none."""
    try:
        told = _DECODER.decode(text)
        shown = _shown(told, unordered, DEPTH)
        shown.encode()
    except Refused:
        raise
    except RecursionError as error:
        raise Refused("too_deep") from error
    except UnicodeEncodeError as error:
        raise Refused("surrogate") from error
    except ValueError as error:
        raise Refused("not_json") from error
    return shown


def _told(text: str, unordered: frozenset[str]) -> tuple[str | None, str | None]:
    try:
        return canonical_text(text, unordered), None
    except Refused as code:
        return None, str(code)


@lru_cache(KEPT)
def _told_lately(text: str, unordered: frozenset[str]) -> tuple[str | None, str | None]:
    return _told(text, unordered)


def canonical(text: Column, unordered: tuple[str, ...] = ()) -> Column:
    """json and reject of JSON texts: keys sorted at every depth by code point, numbers and escapes in one spelling, no space; arrays that
    stand under a key of `unordered` are sorted. reject is null or not_json, repeated_key, number, too_deep or surrogate; null
    texts have neither. A text is read whole, in memory; of short ones a worker keeps the last that it has read."""
    free = frozenset(unordered)

    @F.pandas_udf("json string, reject string")
    def run(texts: pd.Series) -> pd.DataFrame:
        told = [(None, None) if x is None else _told_lately(x, free) if len(x) <= SHORT else _told(x, free) for x in texts]
        return pd.DataFrame(told, columns=["json", "reject"])

    return run(text)
