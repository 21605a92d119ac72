"""Text columns: HTML clean-up, natural order keys, file names, label lines."""

from __future__ import annotations

import functools
import html
import html.entities
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities that the oracles replace one by one; `&amp;` must stay last.
COMMON_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&nbsp;": " ",
    "&middot;": "·",
    "&copy;": "©",
    "&amp;": "&",
}

_TAG = r"<[^>]+>"
_SPACE = r"(?U)[\s\x1c-\x1f]+"
# What can follow an ampersand in a reference: a decimal or hexadecimal number, or a name.
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_UNKNOWN = "\ufffd"
_WHOLE = 33


@functools.lru_cache(maxsize=1)
def _numbers() -> dict[int, str]:
    """Character numbers that do not stand for their own character."""
    planes = [plane << 16 | low for plane in range(17) for low in (0xFFFE, 0xFFFF)]
    numbers = [*range(160), *range(0xFDD0, 0xFDF0), *planes]
    found = {n: html.unescape(f"&#{n};") for n in numbers}
    return {n: text for n, text in found.items() if text != chr(n)}


@functools.lru_cache(maxsize=1)
def _names() -> dict[str, dict[str, str]]:
    """All named references by their first letter: a map column is searched from its start."""
    out: dict[str, dict[str, str]] = {}
    for name, text in html.entities.html5.items():
        out.setdefault(name[0], {})[name] = text
    return out


def _literal(texts: Mapping) -> Column:
    """A literal map, folded by the optimiser from one literal string."""
    pairs = "\x01".join(f"{k}\x02{v}" for k, v in texts.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))


def _named(name: Column) -> Column:
    """The text of a whole name (with its semicolon, if it has one), or of the longest name it begins with
    and the rest as it is; null if there is none."""
    first = F.substring(name, 1, 1)
    own = functools.reduce(
        lambda found, item: F.when(first == item[0], _literal(item[1])).otherwise(found),
        _names().items(), F.lit(None).cast("map<string,string>"),
    )
    # Names without semicolon are short, and the longest that a text begins with counts.
    longest = max(len(n) for names in _names().values() for n in names if not n.endswith(";"))
    sizes = F.array(F.lit(_WHOLE), *[F.lit(n) for n in range(longest, 1, -1)])
    tried = F.transform(sizes, lambda n: F.when(
        (n == _WHOLE) | (F.length(name) > n),
        F.concat(F.try_element_at(own, F.substring(name, F.lit(1), n)), F.substring(name, n + 1, F.lit(_WHOLE))),
    ))
    return F.get(F.filter(tried, lambda text: text.isNotNull()), F.lit(0))


def _numbered(reference: Column) -> Column:
    """The character of a number reference."""
    hexadecimal = reference.rlike("^#[xX]")
    digits = F.regexp_extract(reference, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    short = F.when(digits == "", "0").when(F.length(digits) <= 8, digits)
    number = F.when(hexadecimal, F.conv(short, 16, 10)).otherwise(short).cast("long")
    valid = number.isNotNull() & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    bits = F.unhex(F.lpad(F.hex(F.when(valid, number)), 8, "0"))
    exception = F.try_element_at(_literal(_numbers()), number.cast("string"))
    return F.when(~valid, _UNKNOWN).otherwise(F.coalesce(exception, F.decode(bits, "UTF-32")))


def unescape(value: Column) -> Column:
    """All named and numbered character references replaced in one pass, as browsers read them."""
    parts = F.split(value, "&")

    def part(text: Column) -> Column:
        reference = F.regexp_extract(text, _REFERENCE, 1)
        plain = F.when(reference == "", None).when(
            F.substring(reference, 1, 1) == "#", _numbered(reference)
        ).otherwise(_named(reference))
        rest = F.substring(text, F.length(reference) + 1, F.length(text))
        return F.coalesce(F.concat(plain, rest), F.concat(F.lit("&"), text))

    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), part)
    return F.when(
        F.contains(value, F.lit("&")), F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))
    ).otherwise(value)


def clean_html(value: Column) -> Column:
    """References unescaped, tags to spaces, squeezed spaces. Null becomes empty."""
    untagged = F.regexp_replace(unescape(F.coalesce(value, F.lit(""))), _TAG, " ")
    return F.trim(F.regexp_replace(untagged, _SPACE, " "))


def natural_key(name: Column) -> Column:
    """Sort key: digit runs compare as numbers (length, then digits), the rest without case."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def encode(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.when(
            run.rlike("^[0-9]"),
            F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits),
        ).otherwise(run)

    return F.array_join(F.transform(runs, encode), "")


def starts_with_number(name: Column) -> Column:
    return name.rlike("^[0-9]")


def safe_filename(name: Column, index: Column) -> Column:
    """`NNNNN-name` with other characters collapsed to '-'; `index` is 1-based."""
    text = index.cast("string")
    number = F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)
    cleaned = F.regexp_replace(name, "[^a-zA-Z0-9._-]+", "-")
    fallback = F.concat(F.lit("image-"), text, F.lit(".jpg"))
    return F.concat_ws("-", number, F.when(cleaned == "", fallback).otherwise(cleaned))


def label_filename(image_filename: Column) -> Column:
    """The last extension (if any, and not at position 0) replaced by `.txt`."""
    return F.concat(F.regexp_replace(image_filename, r"(?s)^(.+)\.[^.]*$", "$1"), F.lit(".txt"))


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text of the half-up rounded value."""
    return value.cast(f"decimal(38,{digits})").cast("string")


def trimmed_decimal(value: Column, digits: int = 10) -> Column:
    """Fixed-point text without trailing zeros or a bare dot."""
    return F.rtrim(F.rtrim(fixed(value, digits), F.lit("0")), F.lit("."))


def clock(seconds: Column) -> Column:
    """`m:ss`"""
    minutes = F.floor(seconds / 60)
    rest = F.floor(seconds - minutes * 60)
    return F.concat(
        minutes.cast("string"), F.lit(":"), F.lpad(rest.cast("string"), 2, "0")
    )


def percent(share: Column, digits: int) -> Column:
    return F.concat(fixed(share * 100, digits), F.lit("%"))
