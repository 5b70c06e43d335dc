"""Ignore rules and exclusions that depend on marker files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders that only markers exclude, and the markers.
ENV_DIRS = ("env", ".env", "venv", ".venv", "virtualenv")
BUILD_DIRS = ("dist", "build", "out", "lib")
ENV_MARKERS = ("pyvenv.cfg", "pip-selfcheck.json")
BUILD_MARKERS = (".tsbuildinfo", ".buildinfo")


def _glob(rule: str) -> str:
    body = rule.strip("/")
    parts = [r"(?:.*/)?" if x == "**/" else r".*" if x == "**" else r"[^/]*" if x == "*" else r"[^/]" if x == "?" else re.escape(x) for x in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", body)]
    head = "^" if "/" in rule.rstrip("/") else r"(?:^|.*/)"
    return head + "".join(parts) + (r"/.*$" if rule.endswith("/") else r"(?:/.*)?$")


def is_ignored(rel: Column, rules: list[str]) -> Column:
    """The last rule that fits a path, in either case, decides; ! takes it back; blank and # lines are no rules."""
    out = F.lit(False)
    for rule in (r.strip() for r in rules):
        if rule and not rule.startswith("#"):
            out = F.when(F.lower(rel).rlike(_glob(rule.removeprefix("!").strip().lower())), F.lit(not rule.startswith("!"))).otherwise(out)
    return out


def marked_dirs(listing: DataFrame) -> DataFrame:
    """(dir) at the root of a listing (rel) whose markers tell that it is an environment or a build."""
    rel = F.col("rel")
    top = F.regexp_extract(rel, r"^([^/]+)/", 1)
    inner = F.regexp_replace(rel, r"^[^/]+/", "")
    env = top.isin(*ENV_DIRS) & (inner.isin(*ENV_MARKERS) | inner.rlike(r"^lib/python[^/]*/"))
    build = top.isin(*BUILD_DIRS) & inner.isin(*BUILD_MARKERS)
    own = listing.filter(env | build).select(top.alias("dir")).distinct()
    project = listing.filter(rel.isin("package.json", "tsconfig.json")).limit(1)
    there = listing.filter(top.isin("dist", "build", "out")).select(top.alias("dir")).distinct()
    return own.union(there.join(project.select(F.explode(F.array(*map(F.lit, ("dist", "build", "out")))).alias("dir")), "dir", "left_semi")).distinct()


def excluded_dirs(listing: DataFrame, names, always=(), never=()) -> list[str]:
    """Excluded folders in order: always, by name, by marker; none of ``never``. At most as many as the fixed lists hold."""
    marked = sorted(r["dir"] for r in marked_dirs(listing).collect())
    return [d for d in dict.fromkeys([*always, *names, *marked]) if d not in never]
