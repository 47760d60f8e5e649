"""Small helpers shared by the column functions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and word characters as Unicode-aware text tools see them. Java's plain \s and \w are
# ASCII-only, and \w under (?U) also takes combining marks, so both classes are spelled out.
SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    The optimizer inlines a projected column that is used once, even when that use sits inside a
    lambda that runs per array element. Binding through a one-element array keeps it at one evaluation
    and keeps nested expressions from growing exponentially.
    """
    return F.transform(F.array(value), body).getItem(0)


def quote(term: str) -> str:
    """Escape a literal for both Java regex and RE2."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def whole_words(terms: Iterable[str]) -> str:
    """One pattern that finds any of ``terms`` between word borders."""
    body = "|".join(quote(t) for t in terms)
    return f"(?<!{WORD})(?:{body})(?!{WORD})"


def text_array(values: Iterable[str]) -> Column:
    """Constant array of texts (one folded literal, however long)."""
    return F.from_json(F.lit(json.dumps(list(values), ensure_ascii=False)), "array<string>")


def text_map(mapping: Mapping[str, str]) -> Column:
    """Constant map of texts."""
    return F.from_json(F.lit(json.dumps(dict(mapping), ensure_ascii=False)), "map<string,string>")


def lookup(c: Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Translate ``c`` through a small constant mapping; other values give ``default`` (or stay)."""
    return F.coalesce(F.try_element_at(text_map(mapping), c), c if default is None else default)


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out
