"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One binary n-gram classifier a bit tells the languages whose bit is one from the others; the
nearest codeword, with each bit's loss weighted by how reliable its classifier is, names the language.

A classifier is the log-odds of byte trigrams under its two sides, each side the mean of its languages' trigram distributions. The
trigram counts are sums over all training rows, gathered by Spark; the driver gets languages x ``GRAMS`` of them at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trigrams are hashed to so many features.
GRAMS = 1 << 16
SMOOTHING = 0.5
#: Up to so many languages get every distinct split of the languages as a bit; above it, random splits.
EXHAUSTIVE_UP_TO = 6
#: A margin is scaled by this before the logistic loss: trigram log-odds of a clear text are near one.
SHARPNESS = 4.0
#: The gap of the two best codewords below which a text is ambiguous, as a share of the total loss weight.
AMBIGUOUS_BELOW = 0.05
UNKNOWN = "und"
BYTES_AT_ONCE = 1 << 20

_LETTER = regex.compile(r"\p{L}")
_ONLY_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def trigrams(text: str) -> np.ndarray:
    """Features of the whole text: lower case, what is not a letter as one space, a space at either end."""
    letters = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_ONLY_LETTERS).split())
    b = np.frombuffer(b" " + letters + b" ", np.uint8).astype(np.uint32)
    if b.size < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1. Up to EXHAUSTIVE_UP_TO languages: all splits, up to sign. More: of 50 random codes of 10 log2(n) bits, the one whose nearest rows differ most."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE_UP_TO:
        return np.array([[1, *s] for s in product((1, -1), repeat=n - 1) if -1 in s]).T.astype(float)
    rng = np.random.default_rng(n)
    bits, best, apart = int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(50):
        code = rng.choice((-1.0, 1.0), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        near = (code @ code.T - 1e9 * np.eye(n)).max()
        if code.shape[1] - near > apart:
            best, apart = code, code.shape[1] - near
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    reliability: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous). A text that is null or has no letter is UNKNOWN with score 0."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        grams = trigrams(text)
        total = np.zeros(self.weights.shape[1])
        for at in range(0, grams.size, BYTES_AT_ONCE):
            total += self.weights[grams[at : at + BYTES_AT_ONCE]].sum(0, dtype=np.float64)
        margin = SHARPNESS * total / max(1, grams.size)
        loss = np.logaddexp(0, -self.code * margin) @ self.reliability
        order = np.argsort(loss, kind="stable")
        likely = np.exp(-(loss - loss[order[0]]) * SHARPNESS)
        ambiguous = len(order) > 1 and loss[order[1]] - loss[order[0]] < AMBIGUOUS_BELOW
        return self.languages[order[0]], float(min(1.0, 1 / likely.sum())), bool(ambiguous)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            own = counts.get(lang)
            if own is None:
                own = counts[lang] = np.zeros(GRAMS, np.int64)
            np.add.at(own, trigrams(text), 1)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "gram": at, "n": own[at]})


def in_training(id_col: str) -> Column:
    """A null id counts as the empty text, whose remainder is 0."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 4 != 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from text and language of all training rows. Rows with a null text or language, and repeats of none, teach nothing; without any row the model knows no language and predicts UNKNOWN."""
    rows = docs.where(in_training(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInPandas(_counted, "lang string, gram int, n long")
    found = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0), np.float32), np.zeros(0))
    seen = np.zeros((len(languages), GRAMS))
    seen[found["lang"].map({x: k for k, x in enumerate(languages)}), found["gram"]] = found["n"]
    share = (seen + SMOOTHING) / (seen.sum(1, keepdims=True) + SMOOTHING * GRAMS)
    code = codewords(len(languages))
    side = lambda sign: (share.T @ (code == sign)) / np.maximum(1, (code == sign).sum(0))
    weights = np.log(np.maximum(side(1), 1e-12) / np.maximum(side(-1), 1e-12)) if len(languages) > 1 else np.zeros((GRAMS, 1))
    expected = (share @ weights) * code
    reliability = np.maximum(expected.min(0), 1e-3)
    return Model(languages, code, weights.astype(np.float32), reliability / reliability.sum())


def predicted(text: Column, model: Model) -> Column:
    """struct(lang_pred string, score double, ambiguous boolean) of each whole text."""

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch]
            lang, score, doubt = zip(*found, strict=True) if found else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], ["lang_pred", "score", "ambiguous"])

    return predict(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, ambiguous. Only the text is an input of a prediction.

    Ties of codewords go to the language first in alphabetical order and are ambiguous. Rows that repeat are predicted alike; an
    empty table gives an empty result; other columns are not looked at.
    """
    model = train(docs, id_col, text_col, lang_col)
    rows = docs.select(id_col, (~in_training(id_col)).alias("held_out"), predicted(F.col(text_col), model).alias("p"))
    return rows.select(id_col, "held_out", "p.*")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is known: those without a letter, and those that lie between two codewords, go."""
    model = train(docs, id_col, text_col, lang_col)
    own = "__tm_lang"
    rows = docs.withColumn(own, predicted(F.col(text_col), model))
    return rows.where((F.col(f"{own}.lang_pred") != UNKNOWN) & ~F.col(f"{own}.ambiguous")).select(docs.columns)
