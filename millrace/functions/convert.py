"""Conversions between types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes in a unit.
SIZES = {"b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "pb": 10**15, "eb": 10**18, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40, "pib": 1 << 50, "eib": 1 << 60}

#: Type names and their types here; unsigned types widen.
DTYPES = {
    "bool": T.BooleanType(), "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "f32": T.FloatType(), "f64": T.DoubleType(),
    "str": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(), "null": T.NullType(),
}


def dtype(name: str) -> T.DataType:
    """A type from its name: those of DTYPES, `datetime<unit, zone>`, `duration<unit>`, `decimal<p,s>`, `list<t>`."""
    name = name.strip().lower()
    if name in DTYPES:
        return DTYPES[name]
    m = re.fullmatch(r"(\w+)<(.*)>", name)
    if name == "datetime" or m and m[1] == "datetime":
        zone = m and m[2].split(",")[1:2]
        return T.TimestampType() if zone and zone[0].strip() not in ("", "*") else T.TimestampNTZType()
    if name == "duration" or m and m[1] == "duration":
        return T.LongType()
    if m and m[1] == "decimal":
        p, s = (x.strip() for x in m[2].split(","))
        return T.DecimalType(38 if p == "*" else int(p), int(s))
    if m and m[1] == "list":
        return T.ArrayType(dtype(m[2]))
    raise ValueError(f"type {name} is not known")


def schema(record: dict) -> T.StructType:
    """A schema from a record of names and type names; a nested record is a struct."""
    return T.StructType([T.StructField(k, schema(v) if isinstance(v, dict) else dtype(v)) for k, v in record.items()])


def cast(c: Column, name: str, strict: bool = False) -> Column:
    """To a named type; what does not fit is null, or an error if `strict`."""
    return c.cast(dtype(name)) if strict else c.try_cast(dtype(name))


def into_bool(c: Column, relaxed: bool = False) -> Column:
    """`true` and `false` in any case, and numbers: 0 is false. With `relaxed`, also yes/no, on/off, y/n, t/f. Else null."""
    text = F.lower(F.trim(c.cast("string")))
    number = text.try_cast("double")
    yes, no = (["true", "yes", "on", "y", "t"], ["false", "no", "off", "n", "f", ""]) if relaxed else (["true"], ["false"])
    return F.when(text.isin(yes), True).when(text.isin(no), False).when(number.isNotNull(), number != 0)


def into_int(c: Column, radix: int = 10) -> Column:
    """Whole numbers from text, `_` and `,` left out; `0x`, `0o` and `0b` set the base. Decimals are cut."""
    text = F.lower(F.regexp_replace(F.trim(c.cast("string")), "[_,]", ""))
    if radix != 10:
        return F.when(text.rlike("^[0-9a-z]+$"), F.conv(text, radix, 10).try_cast("long"))
    body = F.substring(text, F.lit(3), F.char_length(text))
    based = F.when(text.rlike("^0x[0-9a-f]+$"), F.conv(body, 16, 10)).when(text.rlike("^0o[0-7]+$"), F.conv(body, 8, 10)).when(text.rlike("^0b[01]+$"), F.conv(body, 2, 10))
    return F.coalesce(based.try_cast("long"), text.try_cast("decimal(38,10)").try_cast("long"))


def into_float(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def into_string(c: Column, decimals: int | None = None, group: bool = False) -> Column:
    """As text; numbers with a fixed number of decimals or grouped digits."""
    if group:
        return F.format_number(c, decimals or 0)
    return F.format_string(f"%.{decimals}f", c.cast("double")) if decimals is not None else c.cast("string")


def into_filesize(c: Column) -> Column:
    """Bytes from text such as `1.5 KiB`; a bare number counts bytes. Null where it does not fit."""
    text = F.lower(F.regexp_replace(F.trim(c.cast("string")), "[_,]", ""))
    table = F.create_map(*(F.lit(x) for k, v in SIZES.items() for x in (k, v)), F.lit(""), F.lit(1))
    number = F.regexp_extract(text, r"^([-+]?\d*\.?\d+)", 1).try_cast("decimal(30,6)")
    unit = F.regexp_extract(text, r"^[-+]?\d*\.?\d+\s*([a-z]*)$", 1)
    return F.when(text.rlike(r"^[-+]?\d*\.?\d+\s*[a-z]*$"), (number * F.try_element_at(table, unit)).cast("long"))


def format_filesize(c: Column, unit: str) -> Column:
    """Bytes as a number with a unit."""
    value = c / F.lit(float(SIZES[unit.lower()]))
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(text, F.lit(f" {unit}"))


def into_binary(c: Column, kind: T.DataType, big: bool = False) -> Column:
    """Text as UTF-8, whole numbers as eight bytes (little-endian unless `big`)."""
    if isinstance(kind, T.IntegralType):
        high = F.lpad(F.hex(c.cast("long")), 16, "0")
        pairs = F.regexp_extract_all(high, F.lit("(..)"), F.lit(1))
        return F.unhex(high if big else F.array_join(F.reverse(pairs), ""))
    return c.cast("binary")


def into_record(c: Column) -> Column:
    """A map from a list of two-field entries."""
    return F.map_from_entries(c)


def into_semver(c: Column) -> Column:
    """Parts of a semantic version; null where it is not one."""
    p = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"
    g = lambda k: F.regexp_extract(c, p, k)
    return F.when(c.rlike(p), F.struct(g(1).cast("long").alias("major"), g(2).cast("long").alias("minor"), g(3).cast("long").alias("patch"), g(4).alias("pre"), g(5).alias("build")))


def semver_bump(v: Column, level: str) -> Column:
    """The next major, minor or patch version, as text."""
    major, minor, patch = v["major"], v["minor"], v["patch"]
    parts = {"major": (major + 1, F.lit(0), F.lit(0)), "minor": (major, minor + 1, F.lit(0)), "patch": (major, minor, patch + 1)}[level]
    return F.concat_ws(".", *(p.cast("string") for p in parts))


def detect_type(c: Column) -> Column:
    """The narrowest kind of value that a text shows."""
    t = F.trim(c)
    return (
        F.when(t.rlike("(?i)^(true|false)$"), "bool")
        .when(t.rlike(r"^[-+]?\d+$"), "int")
        .when(t.rlike(r"^[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?$"), "float")
        .when(t.rlike(r"(?i)^[-+]?\d+(\.\d+)?\s*[kmgtpe]i?b$"), "filesize")
        .when(t.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[-+]\d\d:?\d\d)?)?$"), "datetime")
        .when(t.rlike(r"^-?\d+(\.\d+)?\s*(ns|us|µs|ms|sec|min|hr|day|wk)$"), "duration")
        .otherwise("string")
    )


def _semver_key(v: Column) -> Column:
    """Versions in order: a release comes after its pre-releases."""
    return F.struct(v["major"], v["minor"], v["patch"], (v["pre"] == "").alias("released"), v["pre"])


def semver_range(text: str) -> list[tuple[str, tuple[int, int, int]]]:
    """Bounds of a range such as `>=1.0.0, <2`, `^1.2.3`, `~1.2`, `1.2.*`: (comparison, version)."""
    out: list[tuple[str, tuple[int, int, int]]] = []
    for part in filter(None, re.split(r"\s*,\s*", text.strip())):
        m = re.fullmatch(r"(\^|~|>=|<=|>|<|=)?\s*(\d+|\*|x)(?:\.(\d+|\*|x))?(?:\.(\d+|\*|x))?", part)
        if not m:
            raise ValueError(f"{part} is not a version range")
        given = [int(x) for x in m.groups()[1:] if x and x.isdigit()]
        low = tuple((given + [0, 0, 0])[:3])
        sign = m[1] or ("^" if len(given) == 3 else "=")
        if sign in ("<", "<=", ">", ">=") or sign == "=" and len(given) == 3:
            out.append((sign, low))
            continue
        if sign == "^":  # the first number that is not 0 stays
            stay = next((k for k, x in enumerate(given) if x), len(given) - 1)
        else:
            stay = min(1, len(given) - 1) if sign == "~" else len(given) - 1
        out.append((">=", low))
        if given:
            out.append(("<", tuple(x + (k == stay) if k <= stay else 0 for k, x in enumerate(low))))
    return out


def semver_matches(v: Column, text: str) -> Column:
    """Whether a version (see into_semver) lies in a range (see semver_range)."""
    out = v.isNotNull()
    for sign, version in semver_range(text):
        at = F.struct(*(F.lit(x).cast("long") for x in version), F.lit(True), F.lit(""))
        key = _semver_key(v)
        out = out & {"<": key < at, "<=": key <= at, ">": key > at, ">=": key >= at, "=": key == at}[sign]
    return F.coalesce(out, F.lit(False))
