"""Codes, names, colours and tile addresses as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_key(c: Column) -> Column:
    """3, 3.0 and '003' as '3'; blanks, nan, none and null as null; other text trimmed."""
    t = F.trim(c.cast("string"))
    whole = F.regexp_extract(t, r"^([+-]?\d+)(\.0*)?$", 1)
    return F.when(F.lower(t).isin("", "nan", "none", "null"), None).when(whole != "", whole.try_cast("bigint").cast("string")).otherwise(t)


def raw_code(c: Column) -> Column:
    """A code as it is to be cut: digits as written, other values by norm_key()."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(r"^\d+$"), t).otherwise(norm_key(c))


def parse_code(c: Column, how: str, k: int = 1, sep: str = "_") -> tuple[Column, Column]:
    """(v, h): a code's first k signs and the rest, all but its last k and these, or its parts around the first separator.

    Both null where the code is too short, lacks the separator or either part is blank.
    """
    t = raw_code(c)
    n = F.length(t)
    if how == "sep":
        at = F.locate(sep, t)
        ok, a, b = at > 0, F.substring(t, F.lit(1), at - 1), F.substring(t, at + len(sep), n)
    else:
        cut = F.lit(k) if how == "first" else n - k
        ok, a, b = n > k, F.substring(t, F.lit(1), cut), F.substring(t, cut + 1, n)
    a, b = norm_key(a), norm_key(b)
    ok = ok & a.isNotNull() & b.isNotNull()
    return F.when(ok, a), F.when(ok, b)


def display(c: Column) -> Column:
    """Whole numbers without decimals, others with up to two."""
    n = c.try_cast("double")
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", n), "0+$", ""), r"\.$", "")
    return F.when(n.isNull(), c.cast("string")).otherwise(text)


def safe_name(c: Column) -> Column:
    """Letters, digits and underscores; runs of others become one underscore."""
    return F.regexp_replace(c, r"(?U)[^\w]+", "_")


def replace_codes(c: Column, pairs: dict[int, int]) -> Column:
    """All at once: what a replacement gives is not replaced again."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def replacement_pairs(text: str) -> dict[int, int]:
    """'4=1; 5=2' as pairs; two targets for one code are an error."""
    out: dict[int, int] = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        a, b = (int(x) for x in part.split("="))
        if out.setdefault(a, b) != b:
            raise ValueError(f"{a} is to become {out[a]} and {b}")
    return out


def recode(c: Column, log: list[tuple[str, tuple[int, ...], int]]) -> Column:
    """Replays a log of ('merge', codes, target) or ('renumber', (code,), target), in order."""
    for _, codes, target in log:
        c = F.when(c.isin(list(codes)), target).otherwise(c)
    return c


def signature(*cols: Column, sep: str = "|") -> Column:
    """The MD5 by which a change of any part shows."""
    return F.md5(F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def quadkey(x: Column, y: Column, zoom: Column) -> Column:
    digit = lambda i: F.call_function("shiftright", x, i - 1).bitwiseAND(F.lit(1)) + 2 * F.call_function("shiftright", y, i - 1).bitwiseAND(F.lit(1))
    return F.array_join(F.transform(F.sequence(zoom, F.lit(1), F.lit(-1)), lambda i: digit(i).cast("string")), "")


#: What names of categorical layers usually hold.
CATEGORICAL = r"(?i)(flowdir|flow_dir|d8|geomorph|landform|scl|class|mask|lulc|landcover|land_cover|qa|pixel_qa|cloud|categ|_cat\b|label|zone)"


def is_categorical(name: Column) -> Column:
    return name.rlike(CATEGORICAL)


def hex_colour(c: Column) -> Column:
    """#RRGGBB in upper case, or null."""
    t = F.upper(F.trim(c))
    return F.when(t.rlike("^#?[0-9A-F]{6}$"), F.concat(F.lit("#"), F.regexp_replace(t, "^#", "")))


def channels(colour: Column) -> list[Column]:
    return [F.conv(F.substring(colour, 2 + 2 * i, 2), 16, 10).cast("double") for i in range(3)]


def from_channels(rgb: list[Column]) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)) + 0.5).cast("long")), 2, "0") for c in rgb])


def tone(colour: Column, share: Column, mode: str) -> Column:
    """tint: towards white; shade: towards black; grey: towards middle grey."""
    to = {"tint": 255.0, "shade": 0.0, "grey": 128.0}[mode]
    return from_channels([c + (to - c) * share for c in channels(colour)])


def luminance(colour: Column) -> Column:
    r, g, b = channels(colour)
    return (0.299 * r + 0.587 * g + 0.114 * b) / 255


def label(code: Column, name: Column) -> Column:
    return F.concat_ws(" — ", code.cast("string"), F.coalesce(name, F.lit("")))


def accuracy_band(c: Column) -> Column:
    """How an overall accuracy reads."""
    return F.when(c >= 0.9, "excellent").when(c >= 0.8, "good").when(c >= 0.7, "fair").otherwise("poor")


def xml_escape(c: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")), c)
