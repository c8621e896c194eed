"""One spelling for equal JSON texts: keys sorted at all depths, no blanks, numbers and escapes in one form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings, numbers, blanks, and what is left of a JSON text. Possessive, so that long texts need no stack.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[ \t\r\n]++|[^"0-9 \t\r\n-]++|-'
# Stands before a number that is kept as a string while keys are sorted; JSON strings can't hold it bare.
_MARK = "#\\u0001"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value that is computed once, however often `f` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def canonical_number(text: Column) -> Column:
    """A JSON number: integers as written (-0 is 0), others as the shortest text of their double, with a point, and with an exponent below 1e-4 and from 1e16 on."""

    def power(s: Column, mantissa: Column, e: Column) -> Column:
        sign = F.when(s.startswith("-"), "-").otherwise("")
        digits = F.replace(mantissa, F.lit("."), F.lit(""))
        n = F.length(digits)
        large = F.when(n > e + 1, F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2))).otherwise(F.concat(F.rpad(digits, e + 1, F.lit("0")), F.lit(".0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        power = F.concat(mantissa, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        return F.concat(sign, F.when(e.between(0, 15), large).when(e.between(-4, -1), small).otherwise(power))

    def spelled(s: Column) -> Column:
        parts = F.struct(F.regexp_replace(F.regexp_extract(s, r"^-?([0-9.]+)", 1), r"\.0$", "").alias("mantissa"), F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int").alias("e"))
        return F.when(s.contains("E"), _let(parts, lambda x: power(s, x["mantissa"], x["e"]))).otherwise(s)

    return F.when(text.rlike(r"^-?[0-9]+$"), F.when(text == "-0", "0").otherwise(text)).otherwise(_let(text.try_cast("double").cast("string"), spelled))


def _ascii(text: Column) -> Column:
    """Characters beyond ASCII as \\uXXXX, in small letters, two of them beyond U+FFFF; escapes of control characters in small letters, too."""
    escape = lambda run: F.when(run.rlike(r"^[\x00-\x7E]"), run).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(.{4})", r"\\u$1"))
    runs = lambda t: F.regexp_extract_all(t, F.lit(r"[\x00-\x7E]++|[^\x00-\x7E]++"), F.lit(0))

    def lowered(wide: Column) -> Column:
        low = wide
        for letter in "ABCDEF":
            low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*+\\u00[01]){letter}", f"$1{letter.lower()}")
        return F.when(wide.rlike(r"\\u00[01][A-F]"), low).otherwise(wide)

    return _let(_let(text, lambda t: F.when(t.rlike(r"[^\x00-\x7E]"), F.array_join(F.transform(runs(t), escape), "")).otherwise(t)), lowered)


def canonical_json(text: Column) -> Column:
    """The canonical form of a JSON text: equal values have equal forms, however keys are ordered and blanks, numbers and escapes are written; nulls are kept, arrays keep their order. NULL for a text that isn't JSON or repeats a key.

    Built-in expressions only: numbers are marked as strings, VARIANT sorts the keys of objects, the marks go.
    """

    def form(text: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
        marked = F.transform(tokens, lambda t: F.when(t.rlike("^[-0-9]"), F.concat(F.lit(f'"{_MARK}'), canonical_number(t), F.lit('"'))).otherwise(t))
        numbers = text.rlike(r"^(?:[^\"\\0-9-]|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?(?![0-9.eE+-]))*+$")
        sorted_ = F.to_json(F.try_parse_json(F.array_join(marked, "")))
        bare = F.regexp_replace(sorted_, r'"#\\u0001(-?[0-9][^"]*+)"', "$1")
        return F.when(numbers & F.try_parse_json(text).isNotNull(), _ascii(bare))

    return _let(text, form)
