"""Keyword and role rules as column expressions."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import SPACE, col, contains_any, let, text_array, whole_words

_EMPTY = "array<string>"


def find_keywords(text: Column | str, keywords: Sequence[str], lowered_text: bool = False) -> Column:
    """Keywords that occur anywhere in the text (substring, any case), in rule order.

    ``lowered_text`` says that the text is in lower case already, which spares a pass over it.
    """
    lowered = {k: k.lower() for k in keywords}
    if not lowered:
        return F.array().cast(_EMPTY)

    def scan(t: Column) -> Column:
        if all(k == v for k, v in lowered.items()):
            return F.filter(text_array(lowered), lambda k: F.contains(t, k))
        return F.filter(text_array(lowered), lambda k: F.contains(t, F.lower(k)))

    return F.coalesce(let(col(text) if lowered_text else F.lower(col(text)), scan), F.array().cast(_EMPTY))


GRAM = 3


def _word_grams(term: str) -> list[str]:
    return [w[i : i + GRAM] for w in term.split(" ") for i in range(len(w) - GRAM + 1)]


def keyword_index(groups: Mapping[str, Sequence[str]]) -> tuple[list[str], dict[str, list[int]], list[int]]:
    """``(keywords, gram -> their numbers, numbers without a gram)`` of lower-cased keywords, numbered group by group.

    A keyword stands under one run of three letters inside a word of it, the one that the fewest keywords have.
    """
    keywords = [k.lower() for words in groups.values() for k in words]
    common = Counter(g for k in keywords for g in set(_word_grams(k)))
    index: dict[str, list[int]] = {}
    short = []
    for i, k in enumerate(keywords):
        grams = _word_grams(k)
        if grams:
            index.setdefault(min(grams, key=lambda g: (common[g], g)), []).append(i)
        else:
            short.append(i)
    return keywords, index, short


def grams(text: Column) -> Column:
    """Distinct runs of three letters inside the words of a text."""
    words = F.array_distinct(F.split(text, " "))
    cut = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (GRAM - 1), F.lit(1))), lambda i: F.substring(w, i, F.lit(GRAM))))
    return F.array_distinct(F.flatten(cut))


def find_grouped(text: Column, groups: Mapping[str, Sequence[str]], texts: Mapping[str, Column]) -> Column:
    """Map of group -> its keywords that occur in ``texts[group]``, in rule order.

    ``text`` is the lower-cased text, and ``texts`` the same with phrases blanked. The text's runs of three letters are met
    with those that keywords stand under, whatever their number, and only keywords that are met are looked for.
    """
    keywords, index, short = keyword_index(groups)
    met = F.flatten(
        F.transform(
            F.array_intersect(grams(text), text_array(index)),
            lambda g: F.try_element_at(F.from_json(F.lit(json.dumps(index, ensure_ascii=False)), "map<string,array<int>>"), g),
        )
    )
    numbers = F.array_sort(F.concat(met, F.from_json(F.lit(json.dumps(short)), "array<int>")))

    ruled = [k for words in groups.values() for k in words]

    def hits_of(found: Column, searched: Column, first: int, last: int) -> Column:
        mine = F.filter(found, lambda i: (i >= first) & (i < last))
        held = F.filter(mine, lambda i: F.contains(searched, F.get(text_array(keywords), i)))
        return F.transform(held, lambda i: F.get(text_array(ruled), i))

    def hits(found: Column) -> Column:
        ends = list(accumulate(len(words) for words in groups.values()))
        out = [hits_of(found, texts[name], end - len(groups[name]), end) for name, end in zip(groups, ends, strict=True)]
        return F.map_from_arrays(F.array(*map(F.lit, groups)), F.array(*out)) if out else F.create_map().cast("map<string,array<string>>")

    return let(F.coalesce(numbers, F.array().cast("array<int>")), hits)


def tight(text: Column | str) -> Column:
    """Lower case, no space around slashes and hyphens: ``AI / ML`` equals ``ai/ml``."""
    t = F.regexp_replace(F.lower(col(text)), f"{SPACE}*/{SPACE}*", "/")
    return F.regexp_replace(t, f"{SPACE}*-{SPACE}*", "-")


def _tight_py(term: str) -> str:
    import re

    return re.sub(r"\s*-\s*", "-", re.sub(r"\s*/\s*", "/", term.lower()))


def find_roles(title: Column | str, taxonomy: Mapping[str, Sequence[str]]) -> Column:
    """Roles with an alias between word borders, in taxonomy order, each once."""

    def scan(t: Column) -> Column:
        hits = [
            F.when(F.rlike(t, F.lit(whole_words(map(_tight_py, aliases)))), F.lit(role))
            for role, aliases in taxonomy.items()
        ]
        return F.array_compact(F.array(*hits)) if hits else F.array().cast(_EMPTY)

    return F.coalesce(let(tight(title), scan), F.array().cast(_EMPTY))


def find_excluded_roles(title: Column | str, excluded: Sequence[str]) -> Column:
    """Every unwanted role named in the title."""
    return find_roles(title, {role: [role] for role in excluded})


def guess_level(
    title: Column | str,
    taxonomy: Mapping[str, Sequence[str]],
    unless: Mapping[str, str] | None = None,
) -> Column:
    """Grades named in the title, NULL when none. ``unless`` maps an alias to a word that voids it."""
    unless = {"lead": "generation"} if unless is None else unless

    def scan(t: Column) -> Column:
        hits = []
        for grade, aliases in taxonomy.items():
            plain = [_tight_py(a) for a in aliases if a not in unless]
            found = F.rlike(t, F.lit(whole_words(plain))) if plain else F.lit(False)
            for a in aliases:
                if a in unless:
                    word = F.rlike(t, F.lit(whole_words([_tight_py(a)])))
                    found = found | (word & ~F.contains(t, F.lit(unless[a])))
            hits.append(F.when(found, F.lit(grade)))
        return F.array_compact(F.array(*hits))

    levels = let(tight(title), scan)
    return F.when(F.size(levels) > 0, levels)


def industry_text(
    company: Column, title: Column, text: Column, excludes: Sequence[str], lowered_text: bool = False
) -> Column:
    """Text to search for one industry.

    A phrase of ``excludes`` in company or title rules the whole posting out; in the body it is only
    blanked, one phrase after the other.
    """
    if not excludes:
        return text
    head = F.lower(F.concat_ws(" ", company, title))
    body = text if lowered_text else F.lower(text)
    for phrase in excludes:
        body = F.replace(body, F.lit(phrase), F.lit(" "))
    return F.when(contains_any(head, excludes), F.lit("")).otherwise(body)
