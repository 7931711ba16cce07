"""Identifiers, keys, hashes and text predicates."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, CharType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, MapType, NullType, StringType, StructType, TimestampNTZType, TimestampType, VarcharType


def sanitized(value: Column, most: int = 64) -> Column:
    """A key of letters, digits, dots, underscores and hyphens; `unknown` if nothing is left."""
    kept = F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z0-9._-]+", "-")
    kept = F.substring(F.regexp_replace(kept, r"^[-.]+|[-.]+$", ""), 1, most)
    return F.when(F.length(kept) == 0, "unknown").otherwise(kept)


def short_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 12))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def normalized_path(path: Column) -> Column:
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != ".") & (p != ".."))
    return F.array_join(parts, "/")


def stem(path: Column) -> Column:
    """Lower-case file name without folder and extension."""
    return F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))


def normalized_sample_id(value: Column) -> Column:
    """A sample id without the image- prefix, an owner's prefix before the last hyphen, or a dataset prefix."""
    plain = F.regexp_replace(value, r"^image-", "")
    return F.regexp_replace(F.element_at(F.split(plain, "-"), -1), r"^voc2012_", "")


def class_from_name(path: Column) -> Column:
    """The number after `class` in a file or folder name."""
    return F.nullif(F.regexp_extract(F.lower(path), r"class[_-]?(\d+)", 1), F.lit("")).cast("int")


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def window_id(sequence: Column, digest: Column) -> Column:
    return F.format_string("window-%06d-%s", sequence, F.substring(digest, 1, 12))


def canonical_string(value: Column) -> Column:
    """A JSON string in ASCII: quotes, backslashes and controls escaped, all beyond ASCII as lower-case UTF-16 units."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def escaped(part: Column) -> Column:
        short = F.when(part == "\n", r"\n").when(part == "\r", r"\r").when(part == "\t", r"\t").when(part == "\b", r"\b").when(part == "\f", r"\f")
        own = F.regexp_replace(F.lower(F.hex(F.encode(part, "UTF-16BE"))), "(.{4})", r"\\u$1")
        text = F.replace(F.replace(part, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.coalesce(short, F.when(part.rlike(r"^[ -~]+\z"), text).otherwise(own))

    parts = F.regexp_extract_all(value, F.lit("[ -~]+|[^ -~]"), F.lit(0))
    inner = F.when(value.rlike(r"^[ -~]*\z"), plain).otherwise(F.array_join(F.transform(parts, escaped), ""))
    return F.concat(F.lit('"'), inner, F.lit('"'))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _decimal(digits: Column, point: Column) -> Column:
    """Significant digits without zeros around them, and where the point stands behind their start."""
    kept = F.regexp_replace(digits, "^0+", "")
    return F.struct(F.regexp_replace(kept, "0+$", "").alias("digits"), (point - F.length(digits) + F.length(kept)).cast("int").alias("point"))


def _digits_of(size: Column) -> Column:
    """The fewest digits that read back as a positive double, and the place of the point."""
    part = lambda text, sign, i: F.split_part(text, F.lit(sign), F.lit(i))

    def own(text: Column) -> Column:
        body = part(text, "E", 1)
        whole, rest = part(body, ".", 1), part(body, ".", 2)
        return _decimal(F.concat(whole, rest), F.length(whole) + F.coalesce(part(text, "E", 2).try_cast("int"), F.lit(0)))

    def rounded(numbers: range) -> Column:
        """Of texts with so many digits behind the first, and their neighbours, the first that reads back."""

        def reads(text: Column) -> Column:
            whole, power = F.replace(part(text, "E", 1), F.lit("."), F.lit("")), part(text, "E", 2).try_cast("int")
            near = F.transform(F.array(*map(F.lit, (0, 1, -1))), lambda d: F.struct((whole.try_cast("long") + d).cast("string").alias("m"), (power + 1 - F.length(whole)).alias("e")))
            good = F.get(F.filter(near, lambda x: F.concat(x["m"], F.lit("E"), x["e"].cast("string")).try_cast("double") == size), F.lit(0))
            return _bound(good, lambda x: F.when(x.isNotNull(), _decimal(x["m"], F.length(x["m"]) + x["e"])))

        texts = F.transform(F.array(*(F.format_string(f"%.{n}E", size) for n in numbers)), reads)
        return F.get(F.filter(texts, lambda x: x.isNotNull()), F.lit(0))

    def cut(exact: Column) -> Column:
        """The exact digits of a whole number, cut where the nearest cut reads back."""

        def at(unit: Column) -> Column:
            below = exact - exact % unit
            good = F.filter(F.array(below, below + unit), lambda x: x.try_cast("double") == size)
            return F.array_min(F.transform(good, lambda x: F.struct(F.abs(x - exact).alias("apart"), x.alias("x"))))["x"].cast("string")

        units = F.array(*(F.lit("1" + "0" * k).cast("decimal(20,0)") for k in range(18, -1, -1)))
        best = F.get(F.filter(F.transform(units, at), lambda x: x.isNotNull()), F.lit(0))
        return _bound(best, lambda x: _decimal(x, F.length(x)))

    # up to 15 digits tell doubles apart, so that a text with no more has no shorter equal; below the normal ones fewer do
    found = lambda x: (
        F.when(size < 2.2250738585072014e-308, rounded(range(17)))
        .when(F.length(x["digits"]) <= 15, x)
        .when((size >= 2.0**53) & (size < 2.0**63), _bound(size.try_cast("bigint").cast("decimal(38,0)"), cut))
        .otherwise(F.coalesce(rounded(range(14, 17)), x))
    )
    return _bound(own(size.cast("string")), found)


def canonical_double(value: Column) -> Column:
    """The shortest decimal text that reads back as the same double, with an exponent below 1e-4 and from 1e16 on.

    Where several texts of 17 digits read back, it is the one that the JVM gives, which may differ from the nearest in its last digit.
    """

    def written(x: Column) -> Column:
        digits, point, n = x["digits"], x["point"], F.length(x["digits"])
        fixed = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n), F.lit(".0")))
            .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        )
        power = F.abs(point - 1).cast("string")
        tail = F.concat(F.when(point > 0, "+").otherwise("-"), F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")))
        wide = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.lit("e"), tail)
        return F.when((point > -4) & (point <= 16), fixed).otherwise(wide)

    def text(v: Column) -> Column:
        size = F.abs(v)
        minus = F.when((v < 0) | (v.cast("string") == "-0.0"), "-").otherwise("")
        body = F.when(size == 0, "0.0").when(size == float("inf"), "Infinity").otherwise(_bound(_bound(size, _digits_of), written))
        return F.when(F.isnan(v), "NaN").otherwise(F.concat(minus, body))

    # up to 15 digits tell doubles apart, and from 1e-3 to 1e7 the JVM writes them without an exponent
    size, digits = F.abs(value), F.abs(value).cast("string")
    short = (size >= 1e-3) & (size < 1e7) & (F.length(digits) <= 16) & (digits.endswith(".0") | ~digits.endswith("0"))
    return F.when(short | (size == 0), value.cast("string")).otherwise(_bound(value, lambda v: F.when(v.isNotNull(), text(v))))


def _single(size: Column, kind: DataType, first: Column, all_: Column, text: Callable[[Column], Column]) -> Column:
    """The text of one string without a lambda, which Spark interprets, else that of all elements."""
    return F.when(size == 1, text(first)).otherwise(all_) if isinstance(kind, StringType) else all_


def canonical_value(value: Column, kind: DataType) -> Column:
    """JSON text of a column of any type, built from its type: keys sorted at every depth, no white space, nulls kept.

    Structs and maps are objects; a map's keys are sorted as values and written as texts. Decimals are written
    with their scale, dates and timestamps as ISO texts. Binary columns have no JSON and are refused.
    """
    if isinstance(kind, StructType):
        fields = [F.concat(F.lit(json.dumps(f.name) + ":"), canonical_value(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    elif isinstance(kind, ArrayType):
        element = lambda x: canonical_value(x, kind.elementType)
        text = F.concat(F.lit("["), _single(F.size(value), kind.elementType, F.get(value, F.lit(0)), F.array_join(F.transform(value, element), ","), element), F.lit("]"))
    elif isinstance(kind, MapType):
        names = F.array_sort(F.map_keys(value))
        key = lambda k: canonical_string(k) if isinstance(kind.keyType, StringType) else F.concat(F.lit('"'), canonical_value(k, kind.keyType), F.lit('"'))
        pair = lambda k: F.concat(key(k), F.lit(":"), canonical_value(F.element_at(value, k), kind.valueType))
        text = F.concat(F.lit("{"), _single(F.size(value), kind.valueType, F.get(names, F.lit(0)), F.array_join(F.transform(names, pair), ","), pair), F.lit("}"))
    elif isinstance(kind, (StringType, VarcharType, CharType)):
        text = canonical_string(value)
    elif isinstance(kind, (DoubleType, FloatType)):
        text = canonical_double(value.cast("double"))
    elif isinstance(kind, (IntegralType, DecimalType, BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, DateType):
        text = F.concat(F.lit('"'), F.date_format(value, "yyyy-MM-dd"), F.lit('"'))
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        text = F.concat(F.lit('"'), F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"'))
    elif isinstance(kind, NullType):
        return F.lit("null")
    else:
        raise TypeError(f"{kind.simpleString()} has no JSON")
    return F.coalesce(text, F.lit("null"))


def canonical(frame: DataFrame, *columns: str) -> Column:
    """One JSON text for each row of `frame`, an object of the named columns or of all of them."""
    kind = StructType([f for f in frame.schema.fields if not columns or f.name in columns])
    return canonical_value(F.struct(*(F.col(f"`{name}`") for name in kind.names)), kind)


def canonical_hash(frame: DataFrame, *columns: str) -> Column:
    return F.sha2(canonical(frame, *columns), 256)


def is_hash(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def is_signature(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[0-9a-fA-F]{128}\z"), F.lit(False))


def found_in(needle: str, *columns: str) -> Column:
    """Whether any of the columns holds the text, in either case."""
    return F.lower(F.concat_ws(" ", *columns)).contains(needle.lower())


def is_true(value: Column) -> Column:
    return value.isin("1", "true", "True")


def model_key(name: Column) -> Column:
    """The `id-` number in a model's name, else the name in lower case without extension."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"id-\d{8}", 0), F.lit("")), F.lower(F.regexp_replace(name, r"\.[^.]*$", "")))
