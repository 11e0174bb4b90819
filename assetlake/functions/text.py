"""String functions of paths, names and versions (STR-01 to STR-12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Device names that can't be file names.
RESERVED = ("con", "prn", "aux", "nul", *(f"{d}{n}" for d in ("com", "lpt") for n in range(1, 10)))
#: Characters that file names can't hold.
FORBIDDEN = r'[\x00-\x1F\x7F/\\:*?"<>|]'


def ascii_lower(text: Column) -> Column:
    """STR-02: lower case in A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def portable_name(path: Column) -> Column:
    """STR-01: the part after the last `::`, and in it after the last slash of either kind."""
    return F.regexp_extract(F.substring_index(path, "::", -1), r"([^/\\]*)$", 1)


def exported_name(path: Column) -> Column:
    """STR-01, for exports: the last part that isn't empty, with `:` as a separator too."""
    return F.coalesce(F.try_element_at(F.filter(F.split(path, r"[/\\:]"), lambda p: p != ""), F.lit(-1)), F.lit(""))


def resource_path(path: Column) -> Column:
    """STR-03: without leading `archive:/`, with `/` as separator, in ASCII lower case."""
    return ascii_lower(F.regexp_replace(F.regexp_replace(path, r"^(archive:[/\\]+)+", ""), r"\\", "/"))


def trim_name(name: Column) -> Column:
    """Without spaces and dots at either end."""
    return F.regexp_replace(F.regexp_replace(name, r"^[ .]+", ""), r"[ .]+$", "")


def sanitize(name: Column, fallback: str = "unnamed") -> Column:
    """STR-04: a component that any file system takes; an empty or reserved one gets a sure name."""
    clean = trim_name(F.regexp_replace(name, FORBIDDEN, "_"))
    stem = ascii_lower(F.substring_index(clean, ".", 1))
    return F.when(F.coalesce(clean, F.lit("")) == "", fallback).when(stem.isin(*RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)


def is_unsafe(path: Column) -> Column:
    """STR-05: absolute, with a drive, or with a component that leaves the folder."""
    return path.rlike(r"^[/\\]") | path.rlike(r"^[A-Za-z]:") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def before_extension(name: Column, suffix: Column) -> Column:
    """STR-07: the name with a suffix before its last extension."""
    extension = F.regexp_extract(name, r"(?s).(\.[^.]*)$", 1)
    return F.concat(name.substr(F.lit(1), F.length(name) - F.length(extension)), suffix, extension)


def join_path(base: Column, path: Column) -> Column:
    """STR-09: a null base leaves the path as it is; an empty one doesn't."""
    return F.when(base.isNull(), path).otherwise(F.concat(base, F.lit("/"), path))


def without_suffix(name: Column, suffix: str) -> Column:
    """STR-10: remove a suffix, if it is there."""
    return F.when(name.endswith(suffix), name.substr(F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def with_extension(name: Column, extension: str = ".txt") -> Column:
    """STR-11: keep the name's own extension, else add one."""
    return F.when(name.rlike(r".\.[^.]+$"), name).otherwise(F.concat(name, F.lit(extension)))


def version(text: Column) -> Column:
    """STR-12: (major, minor, build, kind, revision) of a version such as 2022.3.62f2; kind is empty
    without a letter, missing numbers are 0, and a text without a leading number is null."""
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)
    at = lambda i: F.coalesce(F.get(numbers, F.lit(i - 1)).cast("int"), F.lit(0))
    kind = F.regexp_extract(text, r"\d([A-Za-z]+)\d*", 1)
    return F.when(text.rlike(r"^\d"), F.struct(at(1).alias("major"), at(2).alias("minor"), at(3).alias("build"), kind.alias("kind"), at(4).alias("revision")))


def version_gate(parsed: Column, floor: tuple[int, int, int], ceiling: tuple[int, int, int]) -> Column:
    """FLT-04: `unsupported` below the floor or without a version, `verified` up to the ceiling, else `attempt`."""
    now = F.struct(parsed["major"], parsed["minor"], parsed["build"])
    bound = lambda v: F.struct(*[F.lit(x) for x in v])
    return F.when(parsed.isNull() | (now < bound(floor)), "unsupported").when(now <= bound(ceiling), "verified").otherwise("attempt")
