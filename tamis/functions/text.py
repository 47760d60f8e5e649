"""Text clean-up: whitespace, categories, HTML, URLs."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import SPACE, col, contains_any, let, lookup, text_map

# --- fixed values: spellings of cities that mean the same place -------------------------------
LOCATION_ALIASES = {
    "мск": "москва",
    "спб": "санкт-петербург",
    "spb": "санкт-петербург",
    "с.петербург": "санкт-петербург",
    "петербург": "санкт-петербург",
}
# --- fixed values: words that decide the work format, first match wins -------------------------
WORK_FORMATS = {
    "hybrid": ["hybrid", "гибрид"],
    "remote": ["remote", "удален", "удалён", "дистанцион"],
    "onsite": ["office", "офис"],
}


def strip(c: Column | str) -> Column:
    """Cut white space (NBSP included) off both ends."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def normalize_text(c: Column | str) -> Column:
    """Lower-case, one space between words, no outer space; blank becomes NULL."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.rlike(c, F.lit(f"^{SPACE}*$")), F.lit(None).cast("string")).otherwise(c)


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Apply :func:`blank_to_null` to every string column of a table."""
    return df.select(
        *[
            blank_to_null(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def normalize_location(c: Column | str) -> Column:
    def tidy(t: Column) -> Column:
        t = F.regexp_replace(t, r"^г\. *", "")
        t = F.regexp_replace(t, r"^город +", "")
        return F.btrim(t, F.lit(" ,"))

    return let(tidy(normalize_text(c)), lambda t: lookup(t, LOCATION_ALIASES))


def normalize_work_format(c: Column | str) -> Column:
    def pick(t: Column) -> Column:
        out = t
        for name, words in reversed(WORK_FORMATS.items()):
            out = F.when(contains_any(t, words), F.lit(name)).otherwise(out)
        return out

    return let(normalize_text(c), pick)


# --- HTML ---------------------------------------------------------------------------------------

# What never counts as text: comments, doctype, and the bodies of script and style.
_NO_TEXT = r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>|<![^>]*>|<\?[^>]*>"
_TAG = r"(?s)</?[A-Za-z][^>]*>"
_CUT = "\x00"
_ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);?"


def decode_entities(c: Column | str) -> Column:
    """Resolve named (HTML 4 set) and numeric character references; unknown names stay as written."""
    named = text_map({name: chr(cp) for name, cp in name2codepoint.items()} | {"apos": "'"})

    def char(code: Column, base: int) -> Column:
        point = F.conv(code, base, 10).cast("long")
        ok = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))

    def one(piece: Column) -> Column:
        def resolve(ref: Column) -> Column:
            value = (
                F.when(F.rlike(ref, F.lit("^#[xX]")), char(F.substring(ref, 3, 8), 16))
                .when(F.startswith(ref, F.lit("#")), char(F.substring(ref, 2, 8), 10))
                .otherwise(F.try_element_at(named, ref))
            )
            return F.coalesce(
                F.concat(value, F.regexp_replace(piece, _ENTITY, "")), F.concat(F.lit("&"), piece)
            )

        return let(F.regexp_extract(piece, _ENTITY, 1), resolve)

    def whole(text: Column) -> Column:
        return let(
            F.split(text, "&"),
            lambda p: F.concat(
                p.getItem(0), F.array_join(F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), one), "")
            ),
        )

    c = col(c)
    return F.when(F.contains(c, F.lit("&")), whole(c)).otherwise(c)


def strip_html(c: Column | str) -> Column:
    """Visible text of an HTML fragment: every text node trimmed, joined by one space."""
    nodes = F.split(F.regexp_replace(F.regexp_replace(col(c), _NO_TEXT, _CUT), _TAG, _CUT), _CUT)
    clean = F.filter(F.transform(nodes, lambda n: strip(decode_entities(n))), lambda n: n != "")
    return F.array_join(clean, " ")


def joined_html(c: Column | str) -> Column:
    """Like :func:`strip_html`, but text nodes are trimmed and glued without a separator."""
    nodes = F.split(F.regexp_replace(F.regexp_replace(col(c), _NO_TEXT, _CUT), _TAG, _CUT), _CUT)
    return F.array_join(F.transform(nodes, lambda n: strip(decode_entities(n))), "")


def resolve_url(base: str, href: Column | str) -> Column:
    """Absolute link of ``href`` found on page ``base`` (absolute, protocol-, root- or page-relative)."""
    from urllib.parse import urlsplit

    parts = urlsplit(base)
    root = f"{parts.scheme}://{parts.netloc}"
    folder = root + (parts.path.rsplit("/", 1)[0] if parts.path else "") + "/"
    page = root + parts.path
    h = col(href)
    return (
        F.when(h.isNull(), F.lit(None).cast("string"))
        .when(h == "", F.lit(base))
        .when(F.rlike(h, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), h)
        .when(F.startswith(h, F.lit("//")), F.concat(F.lit(parts.scheme + ":"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(F.lit(root), h))
        .when(F.startswith(h, F.lit("?")) | F.startswith(h, F.lit("#")), F.concat(F.lit(page), h))
        .otherwise(F.concat(F.lit(folder), h))
    )
