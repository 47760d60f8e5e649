"""Keys and sets that say when two postings may be the same one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import NOT_WORD, SPACE, WORD, col, let, lookup, text_array, whole_words

# --- fixed values: legal forms, placeholders for a hidden employer, letter tables ---------------
LEGAL_FORMS = ["ооо", "ао", "пао", "зао", "llc", "ltd", "inc"]
HIDDEN_EMPLOYER = rf"^(?:nda|companyhidden|kompaniyaskryta{WORD}*)$"
CYRILLIC_SINGLE = "абвгдеёзийклмнопрстуфхцыэ"
LATIN_SINGLE = "abvgdeeziiklmnoprstufhcye"
CYRILLIC_SILENT = "ъь"
CYRILLIC_MULTI = {"ж": "zh", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "yu", "я": "ya"}
# --- fixed values: title words that mean the same, and words that carry no meaning --------------
TITLE_SYNONYMS = {
    "старший": "senior",
    "сеньор": "senior",
    "sr": "senior",
    "младший": "junior",
    "jr": "junior",
    "мидл": "middle",
    "финтех": "fintech",
    "ии": "ai",
    "ит": "it",
}
TITLE_STOP_WORDS = ["в", "во", "для", "на", "по", "и", "с", "команду", "группу"]


def url_key(url: Column | str) -> Column:
    """URL without the readable slug after a numeric posting id."""
    return F.regexp_replace(col(url), r"(/(?:vacancies|jobs)/\d+)-[^/?#]*", "$1")


def company_key(company: Column | str) -> Column:
    """Company name without legal form and punctuation, in Latin letters; '' when hidden or absent."""
    key = F.regexp_replace(F.lower(col(company)), whole_words(LEGAL_FORMS), " ")
    key = F.regexp_replace(key, r"[^\p{L}\p{N}]+", "")
    key = F.translate(key, CYRILLIC_SINGLE + CYRILLIC_SILENT, LATIN_SINGLE)
    for letter, latin in CYRILLIC_MULTI.items():
        key = F.replace(key, F.lit(letter), F.lit(latin))
    key = F.replace(key, F.lit("ks"), F.lit("x"))
    return F.coalesce(F.regexp_replace(key, HIDDEN_EMPLOYER, ""), F.lit(""))


def title_words(title: Column | str) -> Column:
    """Sorted set of meaningful title words; empty for a missing title."""
    words = F.regexp_extract_all(F.replace(F.lower(col(title)), F.lit("ё"), F.lit("е")), F.lit("([a-zа-я0-9+#]+)"), F.lit(1))
    words = F.transform(words, lambda w: lookup(w, TITLE_SYNONYMS))
    words = F.array_sort(F.array_except(words, text_array(TITLE_STOP_WORDS)))
    return F.coalesce(words, F.array().cast("array<string>"))


def title_head(title: Column | str) -> Column:
    """Words of the part before the first bracket, comma, «в/для/на» or spaced dash."""
    border = rf"{SPACE}*[(,]|{SPACE}+(?:в|для|на){SPACE}+|{SPACE}+[-–—/|]{SPACE}+"
    return title_words(F.split(col(title), border, 2).getItem(0))


def shingles(text: Column | str, size: int = 3) -> Column:
    """Distinct runs of ``size`` consecutive words, joined by one space; empty for short texts."""
    words = F.regexp_extract_all(F.lower(col(text)), F.lit(f"({WORD}+)"), F.lit(1))

    def runs(w: Column) -> Column:
        heads = F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0)))
        return F.array_distinct(
            F.transform(heads, lambda x, i: F.concat(x, *[p for k in range(1, size) for p in (F.lit(" "), F.get(w, i + k))]))
        )

    return F.coalesce(let(words, runs), F.array().cast("array<string>"))


def shingle_hashes(text: Column | str, size: int = 3) -> Column:
    """The same runs as two 64-bit hashes each, for counting and joining without moving text."""
    return F.transform(shingles(text, size), lambda s: F.struct(F.xxhash64(s).alias("h"), F.xxhash64(F.lit(1), s).alias("g")))


def completeness(salary_min: Column, salary_max: Column, description: Column, skills: Column) -> Column:
    """How much a posting tells: salary bounds, thousands of characters, number of skills."""
    return (
        (salary_min.isNotNull().cast("int") + salary_max.isNotNull().cast("int"))
        + F.coalesce(F.length(description) / F.lit(1000.0), F.lit(0.0))
        + F.coalesce(F.size(skills), F.lit(0))
    )


def repost_key(company: Column | str, title: Column | str, url: Column | str) -> Column:
    """Same employer and same title; the url itself when the employer is unknown."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), f"{NOT_WORD}+", " "))
    return let(
        company_key(company),
        lambda k: F.when(k != "", F.concat(k, F.lit("|"), flat)).otherwise(col(url)),
    )


def split_keys(value: Column | str) -> Column:
    """``'a | b'`` -> sorted distinct array; NULL -> empty array."""
    parts = F.filter(
        F.transform(F.split(col(value), r"\|"), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")),
        lambda x: x != "",
    )
    return F.coalesce(F.array_sort(F.array_distinct(parts)), F.array().cast("array<string>"))


def parse_list_cell(value: Column | str) -> Column:
    """Array written as text (``"['python', 'sql']"``) back to an array; anything else gives NULL."""
    return F.from_json(F.translate(col(value), "'", '"'), "array<string>", {"mode": "PERMISSIVE"})


def rename_keys(keys: Column | str, renames: dict[str, str]) -> Column:
    """Replace outdated keys, as a sorted set; NULL -> empty."""
    out = F.array_sort(F.array_distinct(F.transform(col(keys), lambda k: lookup(k, renames))))
    return F.coalesce(out, F.array().cast("array<string>"))


def toggle(keys: Column | str, key: Column | str) -> Column:
    """Symmetric difference: add the key when absent, drop it when present."""
    a, b = col(keys), F.array(col(key))
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def titles_compatible(a: Column, b: Column) -> Column:
    """One non-empty word set contains the other."""
    nested = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    return (F.size(a) > 0) & (F.size(b) > 0) & nested


def same_company(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.startswith(a, b) | F.startswith(b, a))
