"""Spelling variants by permuterm rotations: words one edit apart, and the form that each variant stands for.

1. Runs of letters are counted over all texts. For trial errors, a run whose checksum with the row's id is divisible by
   ``ERROR_RATE`` loses one character, so that the table holds known misspellings.
2. Each word, closed by ``$``, is written in all its rotations. The rotation that ends with character i, without it, is the
   rest of the word after i, ``$``, and the part before i. Words that differ by a replacement at i share this prefix; a
   word that lacks character i has it as a whole rotation. So the sorted rotations hold the neighbours of a word in
   ranges with one prefix, of which a range has a member per letter of the alphabet at most, and one whole rotation.
3. A scan of each range tells every member how many others it meets and the most frequent of them: as many rows as
   members, never their pairs. A removed character that repeats the one before it gives the same shorter word as that one,
   so such members do not count the whole rotation again.
4. The form of a word is its most frequent neighbour if at least ``RATIO`` times as frequent. Forms grow along their chain, so
   roots are found by jumping over two, four, eight forms at a time.

Defined cases: a null or empty text has no words; a null id stands as the empty text before the colon; repeated rows count
repeatedly. Only the id and text columns are read, and everything runs as DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import lower_ascii

RUN = r"[A-Za-zÀ-ÿ]+"
ERROR_RATE = 97
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
END = "$"


def with_errors(doc_id: Column, run: Column, rate: int = ERROR_RATE) -> Column:
    """The run, without one character if the checksum of id and run is divisible by ``rate``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % rate == 0, cut).otherwise(run)


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = ERROR_RATE) -> DataFrame:
    """(word, n): words that are long and frequent enough."""
    runs = F.regexp_extract_all(lower_ascii(F.col(text_col).cast("string")), F.lit(RUN), F.lit(0))
    words = docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("run")).select(with_errors(F.col("doc_id"), F.col("run"), rate).alias("word"))
    return words.where(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, word, n, whole, new): each word under its whole rotations and under those that skip their last character.

    ``new``: the skipped character differs from the one before it.
    """
    word, size = F.col("word"), F.char_length("word")

    def turned(at: Column, skip: int) -> Column:
        """What follows the first ``at + skip`` characters, the end mark, and the first ``at`` characters."""
        return F.concat(F.substring(word, at + 1 + skip, size), F.lit(END), F.substring(word, F.lit(1), at))

    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(turned(i, 0).alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("new")))
    new = lambda i: (i == 0) | (F.substring(word, i + 1, F.lit(1)) != F.substring(word, i, F.lit(1)))
    skipping = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(turned(i, 1).alias("prefix"), F.lit(False).alias("whole"), new(i).alias("new")))
    return words.select("word", "n", F.explode(F.concat(whole, skipping)).alias("r")).select("r.prefix", "word", "n", "r.whole", "r.new")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have a neighbour."""
    same = Window.partitionBy("prefix")
    first = same.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.struct("word", "n")
    scanned = rotations(words).select(
        "word",
        "whole",
        "new",
        F.count("*").over(same).alias("members"),
        F.count_if("whole").over(same).alias("wholes"),
        F.count_if("new").over(same).alias("shorter"),
        F.nth_value(other, 1).over(first).alias("top"),
        F.nth_value(other, 2).over(first).alias("next"),
    )
    met = scanned.where("members > 1").select(
        "word",
        F.when(F.col("whole"), F.col("shorter")).otherwise(F.col("members") - F.col("wholes") - 1 + F.when(F.col("new"), F.col("wholes")).otherwise(0)).alias("near"),
        F.when(F.col("top.word") == F.col("word"), F.col("next")).otherwise(F.col("top")).alias("best"),
    )
    rank = F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word"))
    best = met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(rank).alias("best"))
    return best.select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; each round doubles the steps, and stops when nothing moves."""
    steps = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        far = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(steps.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = ERROR_RATE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = materialize(counted_words(docs, id_col, text_col, rate), "spelling-words")
    found = materialize(words.join(neighbours(words), "word", "left"), "spelling-neighbours")
    wins = F.col("best_n") >= RATIO * F.col("n")
    out = found.select("word", F.when(wins, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(wins, F.col("best_n")).alias("form_n"))
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
