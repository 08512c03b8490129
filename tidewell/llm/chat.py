"""Chat formatting by token-level assembly.

Each turn's segments are encoded on their own and spliced with reserved ids above the tokenizer's vocabulary, so no text can
ever produce a control token.  The same layout exists as text, where control strings that occur inside a text are escaped
reversibly.  The loss mask covers assistant texts; its span offsets in a conversation come from prefix sums over the turns.

Layout: user ``[INST]text[/INST]``, system ``[SYS]text[/SYS]``, assistant ``[OUT]text</s>``, any other role
``[ROLE]role[/ROLE]text</s>``; a null role is ``[ROLE]`` with ``[NULL]`` for its name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Control strings, in the order of their reserved ids (vocabulary + position).
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE]", "[/ROLE]", "[NULL]"]
ID = {c: k for k, c in enumerate(CONTROLS)}
_tails = "|".join(re.escape(c[1:]) for c in CONTROLS)
#: A control string with any number of backslashes after its first character.
GUARDED = re.compile(rf"([<\[])(\\*)({_tails})")
ESCAPED = re.compile(rf"([<\[])\\(\\*)({_tails})")
OPEN = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("[OUT]", "</s>")}


def escape(text: str) -> str:
    """One more backslash inside everything that is a control string, guarded or not; unescape() takes it away."""
    return GUARDED.sub(r"\1\\\2\3", text) if "]" in text or ">" in text else text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


def segments(role: str | None, text: str) -> list[tuple[str, bool, bool]]:
    """A turn as (string, is it a control string, is it in the loss)."""
    if role in OPEN:
        before, after = OPEN[role]
        return [(before, True, False), (escape(text), False, role == "assistant"), (after, True, False)]
    name = [("[NULL]", True, False)] if role is None else [(escape(role), False, False)]
    return [("[ROLE]", True, False), *name, ("[/ROLE]", True, False), (escape(text), False, False), ("</s>", True, False)]


class ChatEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.base = self.tokenizer.get_vocab_size()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False) if ids else ""


def _format(batches: Iterable, tokenizer: str):
    import os

    import pyarrow as pa

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder = ChatEncoder(tokenizer)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            turns = [segments(r, t or "") for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist())]
            plain = [s for turn in turns for s, control, _ in turn if not control]
            coded = iter(encoder.encode(plain))
            ids, mask, chars = [], [], []
            for turn in turns:
                own = [[encoder.base + ID[s]] if control else next(coded) for s, control, _ in turn]
                # the mask as runs: +1 where a loss segment starts, -1 where it ends, then a prefix sum
                ends = np.cumsum([len(x) for x in own])
                edges = np.zeros(int(ends[-1]) + 1, np.int8)
                for (_, _, loss), x, end in zip(turn, own, ends):
                    if loss and x:
                        edges[end - len(x)] += 1
                        edges[end] -= 1
                ids.append(np.array([i for x in own for i in x], "<u4").tobytes())
                mask.append(np.cumsum(edges[:-1]).astype(np.int8).tobytes())
                chars.append(sum(len(s) for s, _, _ in turn))
            columns = [part.column("conv_id"), part.column("turn"), pa.array(ids, pa.binary()), pa.array(mask, pa.binary()), pa.array(chars, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "ids", "loss_mask", "chars"])


def format_chats(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Format (conv_id, turn, role, text) rows: one row a turn with ``ids`` (little-endian uint32), ``loss_mask`` (a byte an id)
    and ``chars`` (of the turn as text), written to the shared folder.

    Turns are encoded where they lie, before any shuffle.  Null text is empty; a null conv_id is a conversation of its own;
    equal (conv_id, turn) rows are kept, ordered by their ids; other columns are ignored.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return stash(rows.mapInArrow(lambda b: _format(b, tokenizer), "conv_id long, turn long, ids binary, loss_mask binary, chars long"), "chat")


def turn_offsets(formatted: DataFrame) -> DataFrame:
    """Where each turn starts in its conversation's token sequence (after the leading ``<s>``), by a prefix sum of lengths."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn", "ids").rowsBetween(Window.unboundedPreceding, -1)
    n = (F.octet_length("ids") / 4).cast("long")
    return formatted.withColumn("start", F.coalesce(F.sum(n).over(order), F.lit(0)) + 1)


def parse_turn(ids: np.ndarray, mask: np.ndarray, encoder: ChatEncoder) -> tuple[str | None, str, str]:
    """(role, text, text under the loss mask) of a formatted turn."""
    marks = np.flatnonzero(ids >= encoder.base)
    part = lambda a, b: unescape(encoder.decode(ids[a:b].tolist()))
    opening = CONTROLS[ids[0] - encoder.base]
    loss = unescape(encoder.decode(ids[mask.astype(bool)].tolist()))
    if opening == "[ROLE]":
        close = int(np.flatnonzero(ids == encoder.base + ID["[/ROLE]"])[0])
        role = None if ids[1] == encoder.base + ID["[NULL]"] else part(1, close)
        return role, part(close + 1, len(ids) - 1), loss
    role = next(r for r, (o, _) in OPEN.items() if o == opening)
    return role, part(1, int(marks[-1])), loss


def _digest(batches: Iterable, tokenizer: str):
    import pyarrow as pa

    encoder, at, state, rows = ChatEncoder(tokenizer), object(), None, []
    kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())])

    def end():
        n, whole, chars, loss, formatted, tokens = state
        return (at, n, whole.hexdigest(), chars, loss.hexdigest(), formatted, tokens)

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("conv_id", "ids", "loss_mask", "chars")]
        for conv, ids, mask, chars in zip(*columns):
            if state is None or conv != at:
                if state is not None:
                    rows.append(end())
                at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), len(CONTROLS[0]), 1]
            role, text, loss = parse_turn(np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.int8), encoder)
            state[0] += 1
            state[1].update(f"{role or ''}\n{text}\n".encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += chars
            state[5] += len(ids) // 4
        if len(rows) > 5000:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], schema=kind)
            rows = []
    if state is not None:
        rows.append(end())
    yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], schema=kind)


def read_chats(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Digest each conversation of a formatted table, decoding its ids.

    The rows stream through in (conv_id, turn) order with a running digest, so a conversation of any length takes the
    memory of one turn.  A SHA-256 over all turns in order can't be split, so its turns are hashed by one task.
    """
    parts = max(1, int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = formatted.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    return rows.mapInArrow(lambda b: _digest(b, tokenizer), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
