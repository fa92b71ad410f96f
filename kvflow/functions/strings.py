"""Scalar helpers as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Binary prefixes and their powers of 1024.
PREFIXES = "kmgtpe"


def escape(text: Column, char: str = ",", mark: str = "\\") -> Column:
    """``mark`` before every ``mark`` and ``char``."""
    return F.replace(F.replace(text, F.lit(mark), F.lit(mark + mark)), F.lit(char), F.lit(mark + char))


def unescape(text: Column, char: str = ",", mark: str = "\\") -> Column:
    """``mark`` before a ``mark`` or ``char`` goes, from left to right; any other character stays, whatever it is."""
    m, c = re.escape(mark), re.escape(char)
    return F.regexp_replace(text, f"{m}({m}|{c})", "$1")


def split_escaped(text: Column, char: str = ",", mark: str = "\\") -> Column:
    """Parts at unescaped ``char``, without trailing empty ones; escapes stay in the parts."""
    m, c = re.escape(mark), re.escape(char)
    # a part is any run of escaped characters and of characters other than the separator; a mark may end the text
    parts = F.regexp_extract_all(text, F.lit(f"(?s)((?:{m}.|[^{c}{m}])*+(?:{m})?)(?:{c}|\\z)"), F.lit(1))
    last = F.aggregate(F.transform(parts, lambda p, i: F.when(p != "", i + 1).otherwise(0)), F.lit(0), lambda a, i: F.greatest(a, i))
    return F.slice(parts, 1, last)


def split_string(text: Column, separators: str) -> Column:
    """Non-empty tokens between any of the separator characters."""
    return F.filter(F.split(text, "[" + "".join(map(re.escape, separators)) + "]"), lambda t: t != "")


def number_of(text: Column, kind: str = "long") -> Column:
    """A token as a number, null if it is none."""
    return F.trim(text).try_cast(kind)


def bytes_to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def hex_to_bytes(text: Column) -> Column:
    return F.unhex(text)


def human_readable(n: Column) -> Column:
    """``512``, ``1.5k``, ``2.0m``, ``3.0g``: powers of 1024, one digit."""
    size = F.abs(n)
    shown = lambda power, suffix: F.format_string("%.1f" + suffix, n / float(1 << power))
    return F.when(size < 1 << 10, n.cast("string")).when(size < 1 << 20, shown(10, "k")).when(size < 1 << 30, shown(20, "m")).otherwise(shown(30, "g"))


def byte_description(n: Column) -> Column:
    """``1.46 KB``, ``2 MB``: at most two digits after the point, units by powers of 1024; smaller ones in KB."""
    size = F.abs(n)
    unit = F.when(size < 1 << 20, F.struct(F.lit(float(1 << 10)).alias("of"), F.lit(" KB").alias("name"))).when(size < 1 << 30, F.struct(F.lit(float(1 << 20)).alias("of"), F.lit(" MB").alias("name"))).otherwise(F.struct(F.lit(float(1 << 30)).alias("of"), F.lit(" GB").alias("name")))
    return F.concat(F.regexp_replace(F.format_string("%.2f", n / unit["of"]), r"\.?0+$", ""), unit["name"])


def percent(done: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", done * 100.0)


def limit_two_decimals(x: Column) -> Column:
    return F.format_string("%.2f", x.cast("double"))


def time_difference(ms: Column) -> Column:
    """``1hrs, 2mins, 3sec``, without leading zero parts."""
    s = F.floor(ms / 1000)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    hours = F.when(h != 0, F.concat(h.cast("string"), F.lit("hrs, "))).otherwise("")
    minutes = F.when((h != 0) | (m != 0), F.concat(m.cast("string"), F.lit("mins, "))).otherwise("")
    return F.concat(hours, minutes, (s % 60).cast("string"), F.lit("sec"))


def format_time(finish_ms: Column, start_ms: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """The finish time, followed by ``(time taken)`` where a start is known; empty without a finish time."""
    at = F.date_format(F.timestamp_millis(finish_ms.cast("long")), pattern)
    taken = F.concat(F.lit(" ("), time_difference(F.abs(finish_ms - start_ms)), F.lit(")"))
    return F.when(finish_ms.isNull() | (finish_ms == 0), "").otherwise(F.concat(at, F.when(start_ms.isNull() | (start_ms == 0), "").otherwise(taken)))


def binary_prefix_to_long(text: Column) -> Column:
    """``1k`` is 1024, ``-2m`` is -2097152; null for what is no number."""
    t = F.lower(F.trim(text))
    power = F.instr(F.lit(PREFIXES), F.substring(t, -1, 1))
    number = F.when(power > 0, F.expr("null")).otherwise(t).try_cast("long")
    scaled = F.rtrim(F.regexp_replace(t, f"[{PREFIXES}]$", "")).try_cast("long") * F.element_at(F.array(*[F.lit(1 << 10 * k).cast("long") for k in range(1, 7)]), F.greatest(power, F.lit(1)))
    return F.when((power > 0) & (F.length(t) > 1), scaled).otherwise(number)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def utf8_length(text: Column) -> Column:
    return F.octet_length(text)


def find(text: Column, what: str, start: int = 0) -> Column:
    """0-based byte position of ``what`` at or after ``start``, -1 if absent."""
    at = F.instr(F.substring(text.cast("binary"), start + 1, 1 << 30).cast("string"), what)
    prefix = F.substring(F.substring(text.cast("binary"), start + 1, 1 << 30).cast("string"), F.lit(1), at - 1)
    return F.when(at > 0, F.octet_length(prefix) + start).otherwise(-1)


def half_digest(data: Column) -> Column:
    """First 8 bytes of md5 as a signed long."""
    return F.conv(F.substring(F.md5(data), 1, 16), 16, -10).cast("long")


def distance(xs: list[Column], ys: list[Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(xs, ys)), F.lit(0.0)))


def char_at(text: Column, position: int) -> Column:
    """Code point that begins at a 0-based byte position, -1 beyond either end."""
    rest = F.substring(text.cast("binary"), position + 1, 4)
    inside = (F.lit(position) >= 0) & (F.lit(position) < F.octet_length(text))
    return F.when(inside, F.ascii(F.substring(rest.cast("string"), 1, 1))).when(text.isNotNull(), -1)


def valid_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data)
