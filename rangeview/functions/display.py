"""Display text of typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIX = "... [truncated]"


def _let(value: Column, then) -> Column:
    """``then`` of a name for ``value``, so that a long expression holds it once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _floats(c: Column) -> Column:
    """Shortest positional text of a double: no exponent, 1 for 1.0, -0, NaN, Infinity; digits of an exponent are shifted.

    The cast gives the shortest digits but for some numbers of 17 or more of them, for which fewer are tried. NaN and the
    infinities are shown as the cast gives them.
    """
    text = c.cast("double").cast("string")
    plain = F.when(text.endswith(".0"), F.substring_index(text, ".", 1)).otherwise(text)
    return F.when(text.contains("E") | (F.length(text) > 17), _let(text, lambda t: _let(_shortest(t), _shifted))).otherwise(plain)


def _shortest(text: Column) -> Column:
    d = text.cast("double")
    tried = [F.format_string(f"%.{n}e", d) for n in (15, 16)]
    long = F.length(F.translate(F.substring_index(text, "E", 1), "-.", "")) > 16
    return F.lower(F.when(long, F.coalesce(*[F.when(x.cast("double") == d, x) for x in tried], text)).otherwise(text))


def _shifted(text: Column) -> Column:
    """A number like -1.25e-7 without its exponent: its digits after zeros, between or before them. One without an
    exponent has its point where it is."""
    number = F.translate(F.substring_index(text, "e", 1), "-", "")
    place = F.when(text.contains("e"), F.substring_index(text, "e", -1).cast("int")).otherwise(F.length(F.substring_index(number, ".", 1)) - 1)
    raw = F.translate(number, ".", "")
    digits = F.when(text.contains("e"), F.coalesce(F.nullif(F.rtrim(raw, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(raw)

    def joined(x: Column) -> Column:
        e, known = x.e, x.digits
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), F.when(e > -322, known).otherwise(_one_digit(x.number, e, known)))
        large = F.rpad(known, F.greatest(e + 1, F.length(known)), F.lit("0"))
        whole = F.regexp_replace(F.concat(F.substr(large, F.lit(1), e + 1), F.lit("."), F.substr(large, e + 2)), r"\.0?$", "")
        return F.concat(F.when(text.startswith("-"), "-").otherwise(""), F.when(e < 0, small).otherwise(whole))

    return _let(F.struct(number.alias("number"), place.alias("e"), digits.alias("digits")), joined)


def _one_digit(number: Column, e: Column, digits: Column) -> Column:
    """One digit in place of two where it tells the same number, as next to zero, where the cast gives two at least."""
    one = F.round(F.abs(number.cast("double")), 0).cast("int").cast("string")
    same = F.concat(one, F.lit("E"), e.cast("string")).cast("double") == F.concat(F.abs(number.cast("double")).cast("string"), F.lit("E"), e.cast("string")).cast("double")
    return F.when((F.length(digits) == 2) & same, one).otherwise(digits)


def _fraction(c: Column) -> Column:
    """ISO text with three or six fraction digits if there is a fraction, none if there is not."""
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(F.regexp_replace(text, r"\.000000$", ""), r"(\.\d{3})000$", "$1")


def truncated(c: Column, max_bytes: int) -> Column:
    """Whole characters within a budget of UTF-8 bytes, with a suffix if it fits, else the bare prefix."""
    room = max_bytes - len(SUFFIX) if max_bytes >= len(SUFFIX) else max_bytes
    tail = SUFFIX if max_bytes >= len(SUFFIX) else ""
    # a cut inside a character does not decode; one of four neighbouring cuts is between characters
    cuts = [F.try_validate_utf8(F.substring(F.encode(c, "UTF-8"), 1, room - k).cast("string")) for k in range(4) if room >= k]
    valid = F.coalesce(*cuts)
    return F.when(F.octet_length(c) <= max_bytes, c).otherwise(F.concat(valid, F.lit(tail)))


def escaped(c: Column) -> Column:
    """A string inside a nested value: quoted, with backslash, tab, CR and LF escaped."""
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _nested(c: Column, t: T.DataType, elements: int | None) -> Column:
    if isinstance(t, T.StringType):
        return escaped(c)
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        return display(c, t, elements=elements)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return c.cast("string")
    return display(c, t)


def display(c: Column, t: T.DataType, max_bytes: int | None = None, elements: int | None = 256) -> Column:
    """The display text of a column of type ``t``; null stays null."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        out = _floats(c)
    elif isinstance(t, T.BinaryType):
        out = F.concat(F.lit("0x"), F.lower(F.hex(c)))
    elif isinstance(t, T.TimestampNTZType):
        out = _fraction(c)
    elif isinstance(t, T.TimestampType):
        out = F.concat(_fraction(c), F.date_format(c, "XXX"))
    elif isinstance(t, T.ArrayType):
        shown = F.slice(c, 1, elements) if elements else c
        body = F.array_join(F.transform(shown, lambda x: F.coalesce(_nested(x, t.elementType, elements), F.lit("null"))), ", ")
        if elements:
            body = F.when(F.size(c) > elements, F.concat(body, F.lit(", " + SUFFIX))).otherwise(body)
        out = F.when(c.isNotNull(), F.concat(F.lit("["), body, F.lit("]")))
    elif isinstance(t, T.MapType):
        entry = lambda x: F.concat(_nested(x.key, t.keyType, elements), F.lit(": "), F.coalesce(_nested(x.value, t.valueType, elements), F.lit("null")))
        out = F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), entry), ", "), F.lit("}")))
    elif isinstance(t, T.StructType):
        fields = [F.concat(F.lit(f"{f.name}: "), F.coalesce(_nested(c[f.name], f.dataType, elements), F.lit("null"))) for f in t]
        out = F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))
    else:
        out = c.cast("string")
    return truncated(out, max_bytes) if max_bytes else out
