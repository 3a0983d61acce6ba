"""Token counts of a subword model, without the ids of any document.

The model marks each space in its pieces; none of its pieces reaches over the boundary before a space, or over one between a letter and another sign
(:func:`_model` checks it), so a text is the chain of its pre-tokens: letters, or other signs, with the spaces before them. The pieces of each distinct
pre-token are counted once and joined to the pre-token frequencies of each document:

1. the distinct pre-tokens of all documents, with how often each occurs and its number of pieces, are written as a table;
2. the most frequent ones, as many as fit into ``SENT_BYTES``, go to every task; there a document's frequent pre-tokens are summed at once to one number;
3. the other pre-tokens of each document are counted, joined to the table by a shuffle, and summed. With keys of at most 66 bytes some hundred thousand words
   are more frequent than any of these, so none of them could fill a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, OWN, numbered, written

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 4096
#: Bytes of the frequent pre-tokens (the key and 16 for each). Keys longer than so many bytes are digests.
SENT_BYTES, KEY_BYTES = 16 << 20, 64
SPACE, LETTER = "▁", "A-Za-zÀ-ɏ"
PRE_TOKEN = f"[ {SPACE}]*(?:[{LETTER}]+|[^{LETTER} {SPACE}]+)|[ {SPACE}]+"

RID, ID, BYTES, WORD, KEY, RARE, N = (OWN + x for x in ("rid", "id", "bytes", "word", "key", "rare", "n"))


@lru_cache(maxsize=2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, which must keep white space and signs as they are, put a space before a text, and have no piece across a boundary of :data:`PRE_TOKEN`."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(k) for k in range(model.vocab_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k)))
    across = re.compile(f"[^{SPACE}]{SPACE}|[{LETTER}][^{LETTER}]|[^{LETTER}{SPACE}][{LETTER}]")
    probe = "  ﬁ ①  x "
    if any(map(across.search, names)) or model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError(f"{path}: texts cannot be cut into pre-tokens for this model")
    return model


def pre_tokens(text: Column) -> Column:
    """array<string>: the pre-tokens of a text and the space that the model puts before it; null for a null or empty text."""
    return F.when(F.length(text) > 0, F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(PRE_TOKEN), 0))


def pieces(pre_token: Column, model: str = MODEL) -> Column:
    """long: the number of pieces of a pre-token of :func:`pre_tokens`. Its first space is the one that the model puts before it; without one it is counted behind a sign that no piece ties to it."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = _model(model)
        signs = {sign: len(m.encode(sign)) for sign in (".", "a")}
        space = 1 if m.piece_to_id(SPACE) != m.unk_id() else len(SPACE.encode())  # a space alone, which cannot be had from a text
        letter = re.compile(f"[{LETTER}]").match
        for batch in batches:
            words = batch.to_pylist()
            before = ["" if w[0] in (" ", SPACE) else "." if letter(w) else "a" for w in words]
            ids = m.encode([b + w if b else w[1:] for b, w in zip(before, words, strict=True)], num_threads=1)
            yield pa.array([len(x) - signs[b] if b else len(x) or space for b, x in zip(before, ids, strict=True)], pa.int64())

    return count(pre_token)


def _key(word: Column) -> Column:
    """What a pre-token is joined by: itself, or its SHA-256 where that is shorter."""
    return F.when(F.octet_length(word) <= KEY_BYTES, word).otherwise(F.concat(F.lit("# "), F.sha2(F.encode(word, "UTF-8"), 256)))


def piece_table(words: DataFrame, model: str = MODEL) -> DataFrame:
    """A written table of the distinct pre-tokens of ``words``: key, times, n (its pieces)."""
    counted = words.where(F.col(WORD).isNotNull()).groupBy(WORD).agg(F.count("*").alias("times"))
    return written(counted.select(_key(F.col(WORD)).alias(KEY), "times", pieces(F.col(WORD), model).alias(N)), "token-pieces")


def _frequent_from(table: DataFrame) -> int:
    """The least power of two such that the pre-tokens that occur as often, or more often, fit into ``SENT_BYTES``."""
    sizes = table.groupBy(F.floor(F.log2("times")).alias("power")).agg(F.sum(F.octet_length(KEY) + 16).alias("bytes")).collect()
    least, held = 63, 0
    for r in sorted(sizes, reverse=True):
        held += r.bytes
        if held > SENT_BYTES:
            break
        least = r.power
    return 1 << least if least < 63 else LAST_ID


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT, model: str = MODEL) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (more tokens than ``limit``).

    Counts are those of the library for the whole text, without begin, end or other special tokens; strings that look like special tokens
    are ordinary text. Null counts as the empty text, which has no token. Rows that repeat are counted each; a null id stays null; an empty
    table gives an empty result. Other columns of ``docs``, whatever their names, are not looked at.
    """
    _model(model)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = numbered(docs.select(F.col(id_col).alias(ID), text.alias(WORD)), RID)
    words = rows.select(RID, ID, F.octet_length(WORD).cast("long").alias(BYTES), F.explode_outer(pre_tokens(F.col(WORD))).alias(WORD))
    table = piece_table(words, model)
    frequent = table.where(F.col("times") >= _frequent_from(table)).select(KEY, N)
    known = words.select(RID, ID, BYTES, _key(F.col(WORD)).alias(KEY)).join(F.broadcast(frequent), KEY, "left")
    parts = written(
        known.groupBy(RID, ID, BYTES, F.when(F.col(N).isNull(), F.col(KEY)).alias(RARE)).agg(F.coalesce(F.sum(N), F.lit(0)).alias(N), F.count("*").alias("times")),
        "token-parts",
    )
    rare = parts.where(F.col(RARE).isNotNull()).select(RID, ID, BYTES, F.col(RARE).alias(KEY), F.col("times").alias("here")).join(table, KEY)
    sums = parts.where(F.col(RARE).isNull()).select(RID, ID, BYTES, N).unionByName(rare.select(RID, ID, BYTES, (F.col(N) * F.col("here")).alias(N)))
    found = sums.groupBy(RID, ID, BYTES).agg(F.sum(N).cast("long").alias("n_tokens"))
    return found.select(F.col(ID).alias(id_col), F.col(BYTES).alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
