"""Best-fit packing of token sequences with vectors of capacities.

Texts are encoded where they are read; only ids longer than a sequence are cut. Pieces are dealt by hash to
blocks of about ``rows_per_block`` pieces, and each block is packed alone: longest piece first, into the
open sequence that has room under every capacity (tokens, documents, attention cost as the sum of squared
lengths) and scores best, by the norm of what stays free or by the weighted dot product of the need with
what is free. Blocks leave one or two sequences that are not full, out of thousands.

Null and empty texts are one end id. Repeated and null ids are documents of their own. An empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.arrays import LOWER, SLICE, WHITE, Prefix, column_bytes, look_up, runs, slices
from caseloom.llm.common import cut, with_fields

#: Words whose ids a worker keeps, about 40 bytes each; beyond that it begins anew.
KEPT_WORDS = 1_500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


class WordIds:
    """Ids of a text by the vocabulary's library, word by word.

    This vocabulary drops white space and its pre-tokenizer never crosses it, so the ids of a text are those
    of its words in order, and equal words (of equal 64-bit hash) share them. Words of letters, digits and marks of ASCII and Latin-1 go to the library's merge
    model directly, others through its whole encoder.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = regex.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
        # Fixed value: the split pattern of the vocabulary file.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.shown = str.maketrans({b: chr(256 + i) for i, b in enumerate(hidden)})
        self.number = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.clear()

    def clear(self) -> None:
        """Known words: sorted hashes, and where the ids of each lie in ``ids``."""
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def part(self, part: str) -> bytes:
        symbols = part if part.isascii() else part.encode().decode("latin-1").translate(self.shown)
        return b"".join([self.number[t.id] for t in self.model.tokenize(symbols)])

    def word(self, word: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of one word."""
        text = word.decode()
        if text.isascii() and text.isalpha() and len(text) < 200:
            return self.part(text.lower())
        if text.isascii() and text[:-1].isalpha() and text[-1] in ".,;:!?" and len(text) < 200:
            return self.part(text[:-1].lower()) + self.part(text[-1])
        if len(text) < 200 and "<|" not in text and self.plain.fullmatch(text):
            return b"".join([self.part(p) for p in self.split.findall(text.lower())])
        return b"".join([self.number[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _learn(self, hashes: np.ndarray, coded: list[bytes]) -> None:
        size = np.array([len(c) // 4 for c in coded], np.int64)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(coded), "<u4")))
        keys = np.concatenate((self.keys, hashes))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[order], np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all rows end to end, and where each row begins."""
        low = data if b"<|" in data.tobytes() else LOWER[data]  # an added token is only itself in lower case
        starts, ends, first = runs(~WHITE[low], offsets)
        words, sample, place = np.unique(Prefix(low).span(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_WORDS:
            self.clear()
        new = np.flatnonzero(~look_up(self.keys, words)[1])
        raw = low.tobytes()
        self._learn(words[new], [self.word(raw[a:b]) for a, b in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist())])
        found = np.searchsorted(self.keys, words)[place]
        size = self.size[found]
        bounds = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(self.at[found] - bounds[:-1], size) + np.arange(bounds[-1])]
        return ids, bounds[first]


def _pieces(path: str, tokens: int, end_id: int, with_ids: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = WordIds(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for i, j in slices(offsets, SLICE // 4):
                ids, bounds = coder.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = []
                for doc_id, a, b in zip(doc_ids[i:j], bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = ids[a:b].tobytes() + end
                    for piece, at in enumerate(range(0, len(own), 4 * tokens)):
                        part = own[at : at + 4 * tokens]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    names=[c.split()[0] for c in PIECES.split(", ")])

    return encode


def encode_pieces(docs: DataFrame, tokenizer_path: str, tokens: int = 4096, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Ids of each text and an end id, cut into pieces of ``tokens`` ids only where longer."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _pieces(tokenizer_path, tokens, end_id, with_ids), PIECES)


def pack_block(lengths: np.ndarray, capacity: tuple[float, float, float], weights=(1.0, 0.01, 0.01), rule: str = "norm"):
    """(bin, offset) of each piece; a piece that no empty bin has room for takes a bin alone."""
    need = np.column_stack((lengths, np.ones(len(lengths)), lengths.astype(float) ** 2))
    room, weight = np.array(capacity, float), np.array(weights)
    order = np.argsort(-lengths, kind="stable")
    smallest = need.min(axis=0) if len(need) else need
    free, numbers, used = np.empty((1024, 3)), np.empty(1024, np.int64), 0
    bins, offsets, count = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    dead = 0
    for i in order:
        ask, best = need[i], -1
        if used:
            left = free[:used] - ask
            fits = np.flatnonzero((left >= 0).all(axis=1))
            if len(fits):
                if rule == "norm":
                    value = ((left[fits] / room) ** 2 @ weight)
                    best = fits[np.argmin(value)]
                else:
                    value = (free[fits] / room) @ (weight * ask / room)
                    best = fits[np.argmax(value)]
        if best < 0:
            if used == len(free):
                free, numbers = np.concatenate((free, np.empty_like(free))), np.concatenate((numbers, np.empty_like(numbers)))
            free[used], numbers[used], best = room, count, used
            used, count = used + 1, count + 1
        bins[i], offsets[i] = numbers[best], room[0] - free[best, 0]
        free[best] -= ask
        if (free[best] < smallest).any():
            free[best] = -1
            dead += 1
            if dead > 256:  # forget the full ones
                open_ = np.flatnonzero(free[:used, 0] >= 0)
                free[: len(open_)], numbers[: len(open_)] = free[open_], numbers[open_]
                used, dead = len(open_), 0
    return bins, offsets


def pack(
    pieces: DataFrame, tokens: int = 4096, documents: int | None = None, cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", rows_per_block: int = 20_000,
) -> DataFrame:
    """``pieces`` with sequence_id and offset. Without ``documents`` and ``cost`` tokens alone bind."""
    pieces = cut(pieces, "pieces")
    count = pieces.count()
    blocks = max(1, -(-count // rows_per_block))
    room = (float(tokens), float(documents or tokens), float(cost or tokens * tokens))

    def block(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable")
        bins, offsets = pack_block(rows.length.to_numpy(), room, weights, rule)
        return rows.drop(columns="_block").assign(sequence_id=key[0] * (1 << 32) + bins, offset=offsets)

    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(blocks)))
    return dealt.groupBy("_block").applyInPandas(block, with_fields(pieces.schema, sequence_id="long", offset="long"))
