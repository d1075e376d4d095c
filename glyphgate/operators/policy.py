"""Policies over findings: allowed characters, severity overrides, and rules that depend on a path."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgate.functions import properties as P

SEVERITIES = ("error", "warning", "info")


def code_point(entry: str | int) -> int:
    """An allow entry: U+HEX or a number; surrogates and values beyond U+10FFFF are refused."""
    if isinstance(entry, str):
        if not re.fullmatch(r"[Uu]\+[0-9A-Fa-f]{1,6}", entry):
            raise ValueError(f"not a code point: {entry}")
        entry = int(entry[2:], 16)
    if isinstance(entry, bool) or not isinstance(entry, int) or not 0 <= entry <= 0x10FFFF or 0xD800 <= entry <= 0xDFFF:
        raise ValueError(f"not a code point: {entry}")
    return entry


@dataclass
class Block:
    """Settings for paths that a glob matches; for all paths without one."""

    files: tuple[str, ...] = ()
    rules: dict[str, str | bool] = field(default_factory=dict)
    allow: tuple[int, ...] = ()
    code: bool | None = None


def read_policy(text: str) -> list[Block]:
    """Parse and check a JSON policy: {rules, allow, isCode, overrides: [{files, rules, allow, isCode}]}."""
    raw = json.loads(text)

    def block(part: dict, keys: set[str]) -> Block:
        if not isinstance(part, dict) or set(part) - keys:
            raise ValueError(f"unknown settings: {sorted(set(part) - keys) if isinstance(part, dict) else part}")
        rules = part.get("rules", {})
        for rule, value in rules.items():
            if rule not in P.RULES or value is not False and value not in SEVERITIES:
                raise ValueError(f"unknown rule or severity: {rule}: {value}")
        if not isinstance(part.get("isCode", False), bool):
            raise ValueError("isCode is true or false")
        files = part.get("files", [])
        return Block((files,) if isinstance(files, str) else tuple(files), rules, tuple(code_point(x) for x in part.get("allow", [])), part.get("isCode"))

    own = block({k: v for k, v in raw.items() if k != "overrides"}, {"rules", "allow", "isCode"})
    return [own, *[block(x, {"files", "rules", "allow", "isCode"}) for x in raw.get("overrides", [])]]


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ``**`` any, ``*`` and ``?`` within one name, a leading slash anchors."""
    body = re.escape(glob.lstrip("/").rstrip("/")).replace(r"\*\*", "\0").replace(r"\*", "[^/]*").replace(r"\?", "[^/]").replace("\0", ".*")
    return ("^" if glob.startswith("/") else "^(.*/)?") + body + "(/.*)?$"


def allow(findings: DataFrame, points: list[int]) -> DataFrame:
    """Drop findings all of whose code points are allowed."""
    if not points:
        return findings
    allowed = F.array(*[F.lit(p).cast("long") for p in points])
    return findings.where(~F.forall("code_points", lambda c: F.array_contains(allowed, c)))


def override(findings: DataFrame, rules: dict[str, str | bool]) -> DataFrame:
    """Give rules other severities; False disables one."""
    off = [r for r, v in rules.items() if v is False]
    changed = {r: v for r, v in rules.items() if v is not False}
    out = findings.where(~F.col("rule").isin(*off)) if off else findings
    if not changed:
        return out
    table = F.create_map(*[F.lit(x) for item in sorted(changed.items()) for x in item])
    return out.withColumn("severity", F.coalesce(F.element_at(table, F.col("rule")), F.col("severity")))


def _holds(blocks: list[Block], path: str) -> list[Column]:
    return [F.lit(True) if not b.files else F.greatest(*[F.col(path).rlike(glob_pattern(g)) for g in b.files], F.lit(False)) for b in blocks]


def code_by_path(blocks: list[Block], path: str = "path") -> Column:
    """Whether a path's text is code: the last matching block that says so decides, and prose is the default."""
    code = F.lit(False)
    for b, hit in zip(blocks, _holds(blocks, path)):
        if b.code is not None:
            code = F.when(hit, F.lit(b.code)).otherwise(code)
    return F.coalesce(code, F.lit(False))


def by_path(findings: DataFrame, blocks: list[Block], path: str = "path") -> DataFrame:
    """Apply ordered blocks: the last matching block that names a rule decides, allowed characters add up.

    A policy is a handful of blocks, so it becomes expressions of the plan; no join is needed.
    """
    holds = _holds(blocks, path)
    severity, allowed = F.col("severity"), F.array().cast("array<long>")
    for b, hit in zip(blocks, holds):
        for rule, value in b.rules.items():
            severity = F.when(hit & (F.col("rule") == rule), F.lit("off" if value is False else value)).otherwise(severity)
        if b.allow:
            allowed = F.when(hit, F.concat(allowed, F.array(*[F.lit(p).cast("long") for p in b.allow]))).otherwise(allowed)
    out = findings.withColumn("__allowed", allowed).where(~F.forall("code_points", lambda c: F.array_contains("__allowed", c)))
    return out.withColumn("severity", severity).where(F.col("severity") != "off").drop("__allowed")
