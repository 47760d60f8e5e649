"""Rule dictionaries: roles, grades, skills and, as a parameter, industries."""

from .ruleset import RuleSet

__all__ = ["RuleSet"]
