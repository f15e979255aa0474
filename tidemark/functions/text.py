"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleanup(text: Column, allow_dot: bool = False) -> Column:
    """Drop characters beyond U+00FF, turn all but letters, digits, ':', '_', '-' (and '.') into '_', keep 64."""
    kept = "0-9A-Za-z:_\\-" + ("." if allow_dot else "")
    return F.substring(F.regexp_replace(F.regexp_replace(text, "[^\\x{0000}-\\x{00FF}]", ""), f"[^{kept}]", "_"), 1, 64)


def cleanup_words(text: Column) -> Column:
    """Drop characters beyond U+00FF and turn all but ASCII letters and digits into '_'."""
    return F.regexp_replace(F.regexp_replace(text, "[^\\x{0000}-\\x{00FF}]", ""), "[^0-9A-Za-z]", "_")


def is_digits(text: Column) -> Column:
    """Whether all characters are decimal digits of any script; true for an empty text."""
    return text.rlike("^\\p{Nd}*$")


def pairs_of(text: Column) -> Column:
    """'a:b,c:d' as an array of (key, value); empty items are skipped, others must hold exactly one ':'."""
    items = F.filter(F.split(text, ","), lambda x: x != "")
    cut = lambda x: F.split(x, ":")
    bad = F.exists(items, lambda x: F.size(cut(x)) != 2)
    pairs = F.transform(items, lambda x: F.struct(F.element_at(cut(x), 1).alias("key"), F.element_at(cut(x), 2).alias("value")))
    return F.when(~bad, pairs).otherwise(F.raise_error(F.concat(F.lit("bad pair list: "), text)).cast("array<struct<key:string,value:string>>"))


def to_text(value: Column) -> Column:
    """A value as text, null as 'nil'."""
    return F.coalesce(value.cast("string"), F.lit("nil"))


def rounded(number: Column) -> Column:
    """A number rounded half to even, in plain digits."""
    return F.bround(number.cast("double"), 0).cast("decimal(38,0)").cast("string")


def hash_of(text: Column) -> Column:
    """A 64-bit hash."""
    return F.xxhash64(text)


def dump(value: Column, pretty: bool = False) -> Column:
    """A struct, map or array as JSON."""
    return F.to_json(value, {"pretty": "true"} if pretty else {})


def shuffled(values: Column) -> Column:
    return F.shuffle(values)


_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """The geohash of a point: longitude and latitude bits in turn, five to a letter."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    cell = lambda x, low, span, n: F.least(F.floor((x - F.lit(low)) / F.lit(span) * F.lit(float(1 << n))).cast("long"), F.lit((1 << n) - 1).cast("long"))
    x, y = cell(lon, -180.0, 360.0, lon_bits), cell(lat, -90.0, 180.0, lat_bits)
    letters = []
    for letter in range(precision):
        index = F.lit(0).cast("long")
        for i in range(5 * letter, 5 * letter + 5):
            source, place = (x, lon_bits - 1 - i // 2) if i % 2 == 0 else (y, lat_bits - 1 - i // 2)
            index = index * 2 + F.shiftright(source, place).bitwiseAND(F.lit(1).cast("long"))
        letters.append(F.substring(F.lit(_BASE32), index.cast("int") + F.lit(1), F.lit(1)))
    return F.concat(*letters)
