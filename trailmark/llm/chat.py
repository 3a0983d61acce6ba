"""Chat formatting at token level.

A turn is ``### role: text</turn>`` and a line end. Role and text are encoded by themselves; the three marks are reserved ids above the
vocabulary and are spliced in between, so no merge runs across a mark and no text can produce one. The loss mask of a turn is the prefix sum
of +1 where an assistant's text begins and -1 where it ends; a window's running sum gives each turn its place in the conversation.

So that the rendered string can be parsed too, marks that occur inside a role or a text are escaped by a backslash, as is the backslash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import VOCABULARY, _lists, _loaded, _some, decode_bytes

#: The marks, in the order of their reserved ids.
MARKS = ("### ", ": ", "</turn>\n")
LEARNED_ROLE = "assistant"
_IN_TEXT = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str, marks: re.Pattern[str] = _IN_TEXT) -> str:
    return marks.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def reserved(vocabulary: str = VOCABULARY) -> tuple[int, int, int]:
    """The ids of the marks: the first that the vocabulary leaves free."""
    n = len(_loaded(vocabulary)[2])
    return n, n + 1, n + 2


def assembled(roles: list[str | None], texts: list[str | None], vocabulary: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """Ids, four bytes each, and loss masks, one byte an id, of turns. The segments of some turns are encoded together."""
    start, colon, end = (np.int32(k).tobytes() for k in reserved(vocabulary))
    pieces, rest = _loaded(vocabulary)[1], iter(roles)
    ids, masks = [], []
    for said in _some(iter(texts)):
        by = list(islice(rest, len(said)))
        encoded = pieces.encode([escape(r or "", _IN_ROLE) for r in by] + [escape(t) for t in said])
        for role, head, body in zip(by, encoded, encoded[len(by) :], strict=False):
            ids.append(start + head + colon + body + end)
            change = np.zeros(len(ids[-1]) // 4 + 1, np.int8)
            if role == LEARNED_ROLE:
                at = len(head) // 4 + 2
                change[at] += 1
                change[at + len(body) // 4] -= 1
            masks.append(np.cumsum(change[:-1], dtype=np.int8).tobytes())
    return ids, masks


def assemble(role: str | None, text: str | None, vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of a turn."""
    ids, masks = assembled([role], [text], vocabulary)
    return np.frombuffer(ids[0], np.int32), np.frombuffer(masks[0], np.int8)


def take_apart(ids: np.ndarray, loss: np.ndarray, vocabulary: str = VOCABULARY) -> tuple[str, str, str, int]:
    """(role, text, text under the mask, characters of the rendered turn), read from ids and mask alone."""
    start, colon, end = reserved(vocabulary)
    marks = np.flatnonzero(ids >= start)
    if ids[marks].tolist() != [start, colon, end] or marks[0] or marks[2] != ids.size - 1:
        raise ValueError("not a turn")
    said = lambda k: decode_bytes(k.tolist(), vocabulary).decode("utf-8", "surrogatepass")
    role, text = said(ids[1 : marks[1]]), said(ids[marks[1] + 1 : marks[2]])
    learned = said(ids[loss.astype(bool)]) if loss.any() else ""
    return unescape(role), unescape(text), unescape(learned), len(role) + len(text) + sum(map(len, MARKS))


def format_turns(chats: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per turn: conv_id, turn, token_start (its place in the conversation), input_ids, loss_mask.

    A conversation is the concatenation of its rows by turn. A null turn comes first; equal turns are ordered by their ids. A null or
    empty text is empty, a null role too; a null conv_id is a conversation of its own. Repeated rows are turns of their own. An empty table gives
    an empty result; other columns are not looked at.
    """

    @F.arrow_udf("input_ids array<int>, loss_mask array<tinyint>")
    def formatted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for roles, texts in batches:
            ids, masks = assembled(roles.to_pylist(), texts.to_pylist(), vocabulary)
            yield pa.StructArray.from_arrays([_lists(ids), _lists(masks, np.int8)], ["input_ids", "loss_mask"])

    turns = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), formatted("role", "text").alias("t")).select("conv_id", "turn", "t.*")
    before = Window.partitionBy("conv_id").orderBy("turn", "input_ids").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.size("input_ids").cast("long")).over(before), F.lit(0)).cast("long")
    return turns.repartition("conv_id").withColumn("token_start", start).select("conv_id", "turn", "token_start", "input_ids", "loss_mask")


class _Digest:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss_chars, self.chars, self.tokens = conv_id, 0, 0, 0, 0
        self.said, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, loss: np.ndarray, start: int, vocabulary: str) -> None:
        if start != self.tokens:
            raise ValueError(f"conversation {self.conv_id}: a turn starts at {start}, not at {self.tokens}")
        role, text, learned, chars = take_apart(ids, loss, vocabulary)
        self.turns, self.tokens, self.chars, self.loss_chars = self.turns + 1, self.tokens + ids.size, self.chars + chars, self.loss_chars + len(learned)
        self.said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.learned.update(learned.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.said.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars, self.tokens


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def read_back(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per conversation, from the formatted turns alone: their digests and counts. Turns pass one by one, so a conversation may be of any length."""
    names = [x.split()[0] for x in _DIGEST.split(", ")]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return batch

        for batch in batches:
            convs, starts = batch.column("conv_id").to_pylist(), batch.column("token_start").to_pylist()
            for conv, start, ids, loss in zip(convs, starts, batch.column("input_ids"), batch.column("loss_mask"), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(ids.values.to_numpy(), loss.values.to_numpy(), start, vocabulary)
            if done:
                yield flush()
        if now is not None:
            done.append(now.row())
            yield flush()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "token_start")
    return ordered.select("conv_id", "token_start", "input_ids", "loss_mask").mapInArrow(digests, _DIGEST)
