"""Quality rules as a short-circuit cascade.

The base counts decide first. The other rules run one after another and stop at the first that rejects; their order
comes from a sample on which every rule is timed and counted: the rule with the most rejections per second of work runs
first. A document is kept when no rule rejects it, so the order changes the cost of a run and never its result.

Defined cases: a null or empty text has no words, so it fails the base rule. Null and repeated ids are passed through;
every input row gives one output row. Only the id and text columns are read, so further columns may have any name.
"""

from __future__ import annotations

import time
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(lines) - len(set(lines))


def counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        dup_lines(text),
        repeated_words(words),
    )


def base_failed(c: tuple[int, int, int, int, int]) -> bool:
    return c[0] < 10 or 100 * c[4] > 20 * c[0]


# Each rule: (text, its bytes, its counts) -> reject.
def many_symbols(text: str, data: bytes, c: tuple) -> bool:
    return 10 * c[2] > c[1]


def odd_word_length(text: str, data: bytes, c: tuple) -> bool:
    return not 2 * c[0] <= c[1] <= 25 * c[0]


def many_dup_lines(text: str, data: bytes, c: tuple) -> bool:
    return c[3] > 0 and 10 * c[3] > 3 * (text.count("\n") + 1)


def shouting(text: str, data: bytes, c: tuple) -> bool:
    upper = len(data) - len(data.translate(None, UPPER))
    return 2 * upper > upper + len(data) - len(data.translate(None, LOWER))


def many_digits(text: str, data: bytes, c: tuple) -> bool:
    return 10 * (len(data) - len(data.translate(None, DIGITS))) > 3 * len(data)


def compressible(text: str, data: bytes, c: tuple) -> bool:
    return len(data) > 12 * len(zlib.compress(data, 1))


RULES = {f.__name__: f for f in (many_symbols, odd_word_length, many_dup_lines, shouting, many_digits, compressible)}

# Documents, about, on which the rules are timed.
SAMPLE_ROWS = 1000


def rule_stats(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, rules: dict = RULES) -> DataFrame:
    """(rule, n, rejected, ns): what each rule cost and rejected on a sample drawn by a hash of the text."""
    total = docs.count()
    share = 1.0 if total <= sample_rows else sample_rows / total
    sample = docs.select(F.col(text_col).cast("string").alias("text"))
    sample = sample.where(F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    def timed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, hits, spent = 0, dict.fromkeys(rules, 0), dict.fromkeys(rules, 0)
        for frame in frames:
            for value in frame["text"]:
                text = as_text(value)
                data = text.encode()
                c = counts(text, data.split())
                if base_failed(c):
                    continue
                n += 1
                for name, rule in rules.items():
                    start = time.perf_counter_ns()
                    hits[name] += rule(text, data, c)
                    spent[name] += time.perf_counter_ns() - start
        yield pd.DataFrame({"rule": list(rules), "n": n, "rejected": list(hits.values()), "ns": list(spent.values())})

    parts = sample.mapInPandas(timed, "rule string, n long, rejected long, ns long")
    return parts.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"), F.sum("ns").alias("ns"))


def cascade_order(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, rules: dict = RULES) -> list[str]:
    """Names of the rules, most rejections per cost first; one row per rule reaches the driver."""
    stats = {r["rule"]: (r["rejected"] + 0.5) / (r["ns"] + 1) for r in rule_stats(docs, text_col, sample_rows, rules).collect()}
    return sorted(rules, key=lambda name: (-stats.get(name, 0.0), name))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, rules: dict = RULES) -> DataFrame:
    """Per row: id, the five base counts, ``base_failed`` and ``kept``."""
    order = [rules[name] for name in cascade_order(docs, text_col, sample_rows, rules)]

    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for value in batch:
                text = as_text(value)
                data = text.encode()
                c = counts(text, data.split())
                failed = base_failed(c)
                out.append((*c, failed, not failed and not any(rule(text, data, c) for rule in order)))
            yield pd.DataFrame(out, columns=[*COUNTS, "base_failed", "kept"])

    judge = F.pandas_udf(judged, SCHEMA)
    rows = docs.select(F.col(id_col).alias("doc_id"), judge(F.col(text_col).cast("string")).alias("r"))
    return rows.select("doc_id", "r.*")
