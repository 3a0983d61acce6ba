"""Byte-level BPE: the tokenizers library over Arrow batches, and its inverse through the byte table.

Texts are cut where a boundary of the split pattern is certain (before a space between two letters or signs that no pattern joins
across it); each distinct piece is encoded by the library once and kept, as the bytes of its ids, in a bounded table, so that frequent words cost one look-up.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces that are kept; past that the table starts anew. Longer pieces are not kept.
KEPT_PIECES, KEPT_CHARS = 300_000, 40
#: Characters whose pieces are looked up together.
CHARS_AT_ONCE = 1 << 19

#: Plain printable signs and Latin letters: none of them is white space, and a space between two of them starts a match.
_SOLID = r"[!-~À-ɏ]"
_CUT = re.compile(f"(?<={_SOLID})(?= {_SOLID})")


class _Pieces:
    """piece -> its ids as bytes, four an id."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.known: dict[str, bytes] = {}
        self.tokenizer = tokenizer

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_CUT.split(t) if t else [] for t in texts]
        wanted = set().union(*cut)
        new = list(wanted.difference(self.known))
        if len(self.known) + len(new) > KEPT_PIECES:
            self.known.clear()
            new = list(wanted)
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.known.update(zip(new, [array("i", e.ids).tobytes() for e in found], strict=True))
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        for p in [p for p in new if len(p) > KEPT_CHARS]:
            del self.known[p]
        return out


def _some(texts: Iterator[str | None]) -> Iterator[list[str]]:
    """Lists of texts of CHARS_AT_ONCE characters or a little more; null is empty."""
    held, chars = [], 0
    for text in texts:
        held.append(text or "")
        chars += len(held[-1])
        if chars >= CHARS_AT_ONCE:
            yield held
            held, chars = [], 0
    yield held


def _byte_of_char() -> dict[str, int]:
    """The byte-to-character table: printable bytes stand for themselves, the others for the characters from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def _loaded(vocabulary: str) -> tuple[Tokenizer, _Pieces, list[bytes]]:
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True
    to_byte, special = _byte_of_char(), {k for k, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    table = [b""] * tokenizer.get_vocab_size()
    for token, k in tokenizer.get_vocab().items():
        table[k] = token.encode() if k in special else bytes(to_byte[c] for c in token)
    return tokenizer, _Pieces(tokenizer), table


def encode_text(text: str | None, vocabulary: str = VOCABULARY) -> list[int]:
    """Null is empty; strings of special tokens are ordinary text."""
    return np.frombuffer(_loaded(vocabulary)[1].encode([text or ""])[0], np.int32).tolist()


def decode_bytes(ids: list[int], vocabulary: str = VOCABULARY) -> bytes:
    return b"".join(map(_loaded(vocabulary)[2].__getitem__, ids))


def token_offsets(text: str, ids: list[int], vocabulary: str = VOCABULARY) -> list[tuple[int, int]]:
    """(start, end) of each token in characters. A token that holds a part of a character covers all of it, so neighbours that share a split character overlap there."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    sizes = [len(_loaded(vocabulary)[2][k]) for k in ids]
    ends = np.cumsum(sizes)
    return [(int(char[e - n]), int(char[e - 1]) + 1) for e, n in zip(ends, sizes, strict=True)]


def _lists(rows: list[bytes], kind: type = np.int32) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) // np.dtype(kind).itemsize for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), kind)))


def encoded(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """array<int> of token ids of each whole text."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _loaded(vocabulary)[1]
        for batch in batches:
            yield _lists([r for texts in _some(x.as_py() for x in batch) for r in pieces.encode(texts)])

    return encode(text)


def checked(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """struct(input_ids, round_trip): the ids of each whole text, and whether they decode to it."""

    @F.arrow_udf("input_ids array<int>, round_trip boolean")
    def check(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _, pieces, table = _loaded(vocabulary)
        for batch in batches:
            ids, same = [], []
            for texts in _some(x.as_py() for x in batch):
                rows = pieces.encode(texts)
                ids += rows
                same += (_joined(table, r) == t.encode("utf-8", "surrogatepass") for r, t in zip(rows, texts, strict=True))
            yield pa.StructArray.from_arrays([_lists(ids), pa.array(same, pa.bool_())], ["input_ids", "round_trip"])

    return check(text)


def _joined(table: list[bytes], ids: bytes, between: bytes = b"") -> bytes:
    return between.join(map(table.__getitem__, np.frombuffer(ids, np.int32).tolist()))


def decoded(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """binary: the bytes that the ids stand for. A character that tokens split is whole again here."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _loaded(vocabulary)[2]
        for batch in batches:
            yield pa.array([b"".join(map(table.__getitem__, row.values.to_numpy().tolist())) if row.is_valid else b"" for row in batch], pa.binary())

    return decode(ids)


def decoded_text(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """string: as :func:`decoded`; what is not UTF-8, as when ids were cut inside a character, reads U+FFFD."""
    return _replaced(decoded(ids, vocabulary))


@F.arrow_udf(StringType())
def _replaced(data: pa.Array) -> pa.Array:
    return pa.array([x.as_py().decode("utf-8", "replace") if x.is_valid else None for x in data], pa.string())


def encode_documents(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns of ``docs`` (one named input_ids is replaced) and input_ids.

    Null and empty texts have no ids. Rows that repeat are encoded alike; an empty table gives an empty result.
    """
    return docs.withColumn("input_ids", encoded(F.col(text_col), vocabulary))


def split_tokens(data: bytes, ends: np.ndarray) -> int:
    """How many tokens, of those that end at these places of a text's bytes, begin or end inside a character."""
    inside = np.append(np.frombuffer(data, np.uint8)[ends[:-1]] & 0xC0 == 0x80, False)
    return int((inside | np.concatenate([[False], inside[:-1]])).sum())


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (of the decimal ids, one space between), decoded_sha256 (of the decoded bytes), n_split (tokens that hold a part of a character only, told by their offsets). The ids are encoded, decoded and digested in one pass and do not leave the task."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _, pieces, table = _loaded(vocabulary)
        decimal, sizes = [str(k).encode() for k in range(len(table))], np.array([len(x) for x in table])
        sha = lambda data: hashlib.sha256(data).hexdigest()

        def row(ids: bytes) -> tuple[int, str, str, int]:
            data = _joined(table, ids)
            split = 0 if data.isascii() else split_tokens(data, np.cumsum(sizes[np.frombuffer(ids, np.int32)]))
            return len(ids) // 4, sha(_joined(decimal, ids, b" ")), sha(data), split

        for batch in batches:
            rows = [row(r) for texts in _some(x.as_py() for x in batch) for r in pieces.encode(texts)]
            count, ids, data, split = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.StructArray.from_arrays([pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string()), pa.array(split, pa.int64())], ["n_tokens", "ids_sha256", "decoded_sha256", "n_split"])

    return docs.select(id_col, digest(F.col(text_col)).alias("d")).select(id_col, "d.*")
