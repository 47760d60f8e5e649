"""A version of all rules, from constants or from a rule table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from . import fixed

RULE_SCHEMA = "version string, kind string, category string, cat_pos int, term string, term_pos int"


@dataclass(frozen=True)
class RuleSet:
    industries: dict[str, list[str]]
    industry_excludes: dict[str, list[str]] = field(default_factory=lambda: fixed.INDUSTRY_EXCLUDES)
    roles: dict[str, list[str]] = field(default_factory=lambda: fixed.ROLE_TAXONOMY)
    excluded_roles: list[str] = field(default_factory=lambda: fixed.EXCLUDED_ROLES)
    levels: dict[str, list[str]] = field(default_factory=lambda: fixed.LEVEL_TAXONOMY)
    skills: list[str] = field(default_factory=lambda: fixed.SKILLS_VOCABULARY)
    version: str = "current"

    @classmethod
    def versions(cls, table: DataFrame) -> dict[str, RuleSet]:
        """All versions held by a table of ``RULE_SCHEMA``.

        ``kind`` is ``industry``, ``industry_exclude``, ``role``, ``excluded_role``, ``level`` or
        ``skill``; kinds that a version leaves out keep their fixed values. Rules are written by people, so
        they are read whole.
        """
        rows = table.select("version", "kind", "category", "cat_pos", "term", "term_pos").collect()
        grouped: dict[str, dict[str, dict[str, list[str]]]] = {}
        for r in sorted(rows, key=lambda r: (r.version, r.kind, r.cat_pos, r.term_pos)):
            grouped.setdefault(r.version, {}).setdefault(r.kind, {}).setdefault(r.category, []).append(r.term)
        out = {}
        for version, kinds in grouped.items():
            rules = cls(industries=kinds.get("industry", {}), version=version)
            named = {"industry_exclude": "industry_excludes", "role": "roles", "level": "levels"}
            changes = {attr: kinds[kind] for kind, attr in named.items() if kind in kinds}
            flat = {"excluded_role": "excluded_roles", "skill": "skills"}
            changes |= {attr: [t for ts in kinds[k].values() for t in ts] for k, attr in flat.items() if k in kinds}
            out[version] = replace(rules, **changes)
        return out

    @classmethod
    def read(cls, spark: SparkSession, path: str, version: str | None = None) -> RuleSet:
        """Rules from a CSV file with a header, columns as in ``RULE_SCHEMA``."""
        found = cls.versions(spark.read.csv(path, header=True, schema=RULE_SCHEMA))
        return found[version] if version else next(iter(found.values()))
