"""Chat formatting by token-level assembly.

Each turn is encoded in separate segments (role, text), and reserved ids outside the vocabulary are
spliced between them, so no text can produce a mark. Control strings that occur in a text are escaped
before encoding: an escape character goes behind the first character of each, and doubles itself. A
text written back as a string therefore holds no control string either, and removing the escapes gives
the text again. Loss masks come from prefix sums of +1 and -1 at the bounds of the assistant texts.

Turns are encoded where they are read. Only the running token position of a conversation needs its turns
in order: turns are dealt by conversation, sorted by Spark, and streamed with one counter, so a
conversation of any length takes bounded memory. A digest over a whole conversation is sequential by
definition, so one task reads the turns of a conversation, as a stream.

Null text and null role are empty; null conversation ids form one conversation; turns of equal number are
ordered by role, then text; a null turn number comes first. An empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of the template and the control strings of known chat templates.
MARKS = ("<|turn|>", "<|text|>", "<|end|>")
CONTROL = r"<\|[^|<>\s]{1,64}\|>|</?s>|\[/?INST\]|<</?SYS>>|</?(?:bos|eos|start_of_turn|end_of_turn)>"
ESCAPE = "␛"

_START = re.compile(f"{ESCAPE}|(?=(?:{CONTROL})).", re.S)
_ESCAPED = re.compile(f"{ESCAPE}({ESCAPE}?)")
FORMATTED = "conv_id long, turn long, position long, token_start long, ids array<int>, loss_mask array<boolean>"
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
           "n_tokens long, loss_tokens long")


def escape(text: str) -> str:
    """No control string is left, and ``unescape`` gives the text again."""
    return _START.sub(lambda m: m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _encode(path: str, loss_role: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        turn, text, end = (tokenizer.get_vocab_size() + i for i in range(3))
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                roles, texts = part.column("role").to_pylist(), part.column("text").to_pylist()
                coded = tokenizer.encode_batch_fast([escape(x) for pair in zip(roles, texts) for x in pair], add_special_tokens=False)
                coded = [np.array(c.ids, np.int32) for c in coded]
                mark = [np.array([i], np.int32) for i in (turn, text, end)]
                segments = [s for i in range(len(roles)) for s in (mark[0], coded[2 * i], mark[1], coded[2 * i + 1], mark[2])]
                ids = np.concatenate(segments) if segments else np.zeros(0, np.int32)
                bounds = np.concatenate(([0], np.cumsum([len(s) for s in segments], dtype=np.int64)))
                step = np.zeros(len(ids) + 1, np.int32)
                for i, role in enumerate(roles):
                    if role == loss_role:
                        step[bounds[5 * i + 3]] += 1
                        step[bounds[5 * i + 4]] -= 1
                mask = np.cumsum(step[:-1]) > 0
                offsets = pa.array(bounds[::5].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), part.column("role"), part.column("text"),
                     pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(mask))],
                    names=["conv_id", "turn", "role", "text", "ids", "loss_mask"])

    return encode


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position of each turn and of its first token; rows come sorted by conversation and turn."""
    conv, position, tokens = object(), 0, 0
    for batch in batches:
        lengths = np.diff(np.array(batch.column("ids").offsets))
        positions, starts = [], []
        for c, n in zip(batch.column("conv_id").to_pylist(), lengths.tolist()):
            if c != conv:
                conv, position, tokens = c, 0, 0
            positions.append(position)
            starts.append(tokens)
            position, tokens = position + 1, tokens + n
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), pa.array(positions, pa.int64()), pa.array(starts, pa.int64()),
             batch.column("ids"), batch.column("loss_mask")],
            names=["conv_id", "turn", "position", "token_start", "ids", "loss_mask"])


def format_conversations(turns: DataFrame, tokenizer_path: str, loss_role: str = "assistant") -> DataFrame:
    """One row per turn, in order within its conversation: token ids, loss mask and place in the conversation.

    The ids of a conversation are those of its turns from position 0 on, laid end to end.
    """
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    coded = clean.mapInArrow(_encode(tokenizer_path, loss_role),
                             "conv_id long, turn long, role string, text string, ids array<int>, loss_mask array<boolean>")
    ordered = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.drop("role", "text").mapInArrow(_place, FORMATTED)


def _read(path: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        base = tokenizer.get_vocab_size()
        conv, state, done = object(), None, []

        def result():
            n, turns, chars, loss, formatted, tokens, masked = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, tokens, masked)

        for batch in batches:
            ids, masks = batch.column("ids"), batch.column("loss_mask")
            bounds = np.array(ids.offsets)
            ids, masks = np.array(ids.values), masks.values.to_numpy(zero_copy_only=False)
            for c, a, b in zip(batch.column("conv_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if state is None or c != conv:
                    if state is not None:
                        done.append(result())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                own, mask = ids[a:b], masks[a:b]
                marks = np.flatnonzero(own >= base)
                assert own[marks].tolist() == [base, base + 1, base + 2] and marks[0] == 0 and marks[2] == b - a - 1
                role, text = (tokenizer.decode(own[i + 1 : j].tolist(), skip_special_tokens=False) for i, j in zip(marks, marks[1:]))
                learnt = tokenizer.decode(own[mask].tolist(), skip_special_tokens=False)
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                plain = unescape(learnt)
                state[2] += len(plain)
                state[3].update(plain.encode())
                state[4] += len(role) + len(text) + sum(map(len, MARKS))
                state[5] += b - a
                state[6] += int(mask.sum())
            if done:
                yield _rows(done)
                done = []
        if state is not None:
            yield _rows([result()])

    return read


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=[c.split()[0] for c in DIGESTS.split(", ")])


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digests of each conversation, decoded from the formatted ids and masks of ``format_conversations``."""
    return formatted.mapInArrow(_read(tokenizer_path), DIGESTS)
