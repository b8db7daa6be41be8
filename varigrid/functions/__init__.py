"""Column expressions: names of realizations, strings, digests, branch maps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name of a realization in which every point has its baseline.
BASELINE = "Baseline.baseline"
#: Longer names are replaced by their digest.
LONGEST_NAME = 250
#: The signs that a glob means literally and a pattern does not. All others, such as the - of a range, pass through.
_LITERAL = (".", "\\", "+", "(", ")", "|", "^", "$", "@", "%")
_TRUE, _FALSE = ("true", "1", "enable", "t"), ("false", "0", "disable", "f")


def realization(points: dict[str, Column], baselines: dict[str, str], sep: str = "+") -> Column:
    """Canonical name: ``Point.branch`` of every branch that is no baseline, by point name; absent points are left out."""
    parts = [F.when(c != baselines[p], F.concat(F.lit(f"{p}."), c)) for p, c in sorted(points.items())]
    return short_name(F.coalesce(F.nullif(F.concat_ws(sep[:1].lower(), *parts), F.lit("")), F.lit(BASELINE)))


def realization_full(points: dict[str, Column], sep: str = "+") -> Column:
    """Name with baselines as well."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"{p}."), c)) for p, c in sorted(points.items()) if p != "Baseline"]
    return F.coalesce(F.nullif(F.concat_ws(sep[:1].lower(), *parts), F.lit("")), F.lit(BASELINE))


def short_name(c: Column) -> Column:
    return F.when(F.length(c) > LONGEST_NAME, F.upper(F.md5(c))).otherwise(c)


def glob_to_regex(glob: str) -> str:
    """Anchored pattern of a glob: ``*``, ``?`` and ``{a,b}``; square brackets and what they hold pass through, so ``[a-c]`` is a range and ``[!x]`` one of two signs."""
    out, depth = [], 0
    for c in glob:
        if c == "{":
            depth += 1
            out.append("(")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "}":
            out.append(r"\}")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append({"*": ".*", "?": "."}.get(c, f"\\{c}" if c in _LITERAL else c))
    return f"^(?:{''.join(out)})$"


def match_name(c: Column, glob: str) -> Column:
    return c.rlike(glob_to_regex(glob))


def split_first(c: Column, sep: str) -> Column:
    """[before, after] the first ``sep``; without one, [all, null]."""
    at = F.locate(sep, c)
    return F.array(F.when(at > 0, F.substring_index(c, sep, 1)).otherwise(c), F.when(at > 0, c.substr(at + len(sep), F.length(c))))


def split_last(c: Column, sep: str) -> Column:
    """[before, after] the last ``sep``; without one, [all, null]."""
    after = F.substring_index(c, sep, -1)
    return F.when(F.locate(sep, c) > 0, F.array(c.substr(F.lit(1), F.length(c) - F.length(after) - len(sep)), after)).otherwise(F.array(c, F.lit(None)))


def split_on(c: Column, sep: str) -> Column:
    return F.split(c, re.escape(sep))


def human_size(c: Column) -> Column:
    """Bytes as 1.5 KB and so on."""
    out = F.format_string("%.1f %s", c / 1024.0**8, F.lit("YB"))
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB")))):
        out = F.when(c < 1024.0 ** (i + 1), F.format_string("%.1f %s", c / 1024.0**i, F.lit(unit))).otherwise(out)
    return out


def basename(c: Column, *suffixes: str) -> Column:
    out = F.substring_index(c, "/", -1)
    return F.regexp_replace(out, f"(?:{'|'.join(re.escape(s) for s in suffixes)})$", "") if suffixes else out


def digest(c: Column, alg: str = "md5") -> Column:
    return {"md5": F.md5, "sha1": F.sha1}[alg](c)


def parse_bool(c: Column) -> Column:
    """Boolean words; null stays null, any other word is an error."""
    word = F.lower(F.trim(c))
    return F.when(word.isin(*_TRUE), True).when(word.isin(*_FALSE), False).when(c.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean"))


def format_ts(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def namespace(c: Column) -> Column:
    """[namespace, name], cut at the last slash; without one the namespace is empty."""
    return F.when(F.locate("/", c) > 0, split_last(c, "/")).otherwise(F.array(F.lit(""), c))


def exit_ok(c: Column) -> Column:
    return F.coalesce(F.trim(F.substring_index(c, "\n", 1)) == "0", F.lit(False))


def parse_number(c: Column) -> Column:
    """Decimal with a digit left of the point and an optional exponent; anything else is null."""
    return F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), c.try_cast("decimal(38,10)"))


def merge_branches(a: Column, b: Column) -> Column:
    """One map of branches from two; where both choose, b wins."""
    return F.map_zip_with(F.coalesce(a, F.create_map().cast("map<string,string>")), F.coalesce(b, F.create_map().cast("map<string,string>")), lambda _, x, y: F.coalesce(y, x))


def drop_branches(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def all_branches(m: Column, test) -> Column:
    return F.forall(F.map_entries(m), lambda e: test(e["key"], e["value"]))


def has_branch(m: Column, point: str) -> Column:
    return F.exists(F.map_entries(m), lambda e: e["key"] == point)


def zip3(a: Column, b: Column, c: Column) -> Column:
    return F.arrays_zip(a, b, c)


def count_where(arr: Column, test) -> Column:
    return F.size(F.filter(arr, test))
