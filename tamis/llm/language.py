"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded by its code point. A trigram binds its
letters: the vectors of the first two are rotated by two places and by one, and all three are multiplied. A text bundles
(adds up) the vectors of its trigrams; a language prototype bundles its training texts. The prediction is the prototype
with the largest cosine.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text if nothing was learned.
Ties go to the smaller language name. Texts are read whole, in pieces that overlap by two letters. Every input row gives
one output row; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release

DIMENSIONS = 512
PIECE = 1 << 20
CACHED = 16_000
SPACE = 32
FRINGE = 2


class Encoder:
    """Trigram counts of texts, and the vectors of trigrams; keeps at most ``CACHED`` vectors."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.kind = np.zeros(0x110000, np.int8)  # 0: not seen yet, 1: letter, 2: other
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((2048, dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([7, code]).integers(0, 2, self.dimensions)
            self.letters[code] = (2 * bits - 1).astype(np.float32)
        return self.letters[code]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of letters and single spaces between words, with their counts; none without letters."""
        found, many = [], []
        for start in range(0, len(text), PIECE):
            piece = text[max(0, start - FRINGE) : start + PIECE].lower()
            codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
            kinds = self.kind[codes]
            if not kinds.all():
                new = np.unique(codes[kinds == 0])
                self.kind[new] = [1 if chr(c).isalpha() else 2 for c in new.tolist()]
                kinds = self.kind[codes]
            letter = kinds == 1
            if not letter.any():
                continue
            line = np.empty(len(codes) + 2, np.int64)
            line[0] = line[-1] = SPACE
            line[1:-1] = np.where(letter, codes, SPACE)
            line = line[np.append(True, (line[1:] != SPACE) | (line[:-1] != SPACE))]
            ids, n = np.unique((line[:-2] << 42) | (line[1:-1] << 21) | line[2:], return_counts=True)
            found.append(ids)
            many.append(n)
        if len(found) == 1:
            return found[0], many[0]
        return added_up(found, many)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        if len(self.rows) > CACHED:
            self.rows.clear()
        rows, places = self.rows, []
        for g in ids.tolist():
            at = rows.get(g)
            if at is None:
                at = rows[g] = len(rows)
                if at == len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                a, b, c = (self.letter(g >> 42), self.letter((g >> 21) & 0x1FFFFF), self.letter(g & 0x1FFFFF))
                self.table[at] = np.roll(a, 2) * np.roll(b, 1) * c
            places.append(at)
        return self.table[places]

    def bundle(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dimensions)
        for k in range(0, len(ids), 4096):
            out += n[k : k + 4096].astype(np.float32) @ self.vectors(ids[k : k + 4096])
        return out


def added_up(found: list[np.ndarray], many: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids, back = np.unique(np.concatenate(found), return_inverse=True)
    return ids, np.bincount(back, np.concatenate(many)).astype(np.int64)


def prototypes(train: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Bundled trigrams of all rows with a language; one vector per language reaches the driver."""

    def bundled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(dimensions)
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                total = np.zeros(dimensions)
                found, many, size = [], [], 0
                for text in texts:
                    ids, n = encoder.grams(text)
                    found.append(ids)
                    many.append(n)
                    size += len(ids)
                    if size > 1 << 18:
                        total += encoder.bundle(*added_up(found, many))
                        found, many, size = [], [], 0
                total += encoder.bundle(*added_up(found, many))
                yield pd.DataFrame({"lang": [lang], "vector": [np.rint(total).astype(np.int64)]})
            release()

    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    parts = rows.dropna().mapInPandas(bundled, "lang string, vector array<long>")
    sums = parts.select("lang", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["lang"], np.zeros(dimensions))[r["at"]] = r["value"]
    return {k: v for k, v in sorted(out.items()) if v.any()}


def predict(text: Column, learned: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> Column:
    """Struct (lang_pred, score) of a text column."""
    names = list(learned)
    profile = np.array([v / np.linalg.norm(v) for v in learned.values()]).reshape(len(names), dimensions)

    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(dimensions)
        for batch in texts:
            langs, scores = [], []
            for text in batch:
                ids, n = encoder.grams(text) if isinstance(text, str) else (np.empty(0), None)
                if not len(ids) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                vector = encoder.bundle(ids, n)
                cosines = profile @ vector / max(np.linalg.norm(vector), 1e-9)
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
            release()

    return F.pandas_udf(predicted, "lang_pred string, score double")(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that is never learned from; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    return prototypes(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))


def language_id(docs: DataFrame, learned: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learns from the documents that are not held out."""
    learned = learn(docs) if learned is None else learned
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), learned).alias("r"))
    return rows.select("doc_id", "held_out", "r.*")
