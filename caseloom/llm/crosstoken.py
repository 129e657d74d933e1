"""Alignment of two tokenisations of one text, over whole-word anchors.

Every text is tokenised whole by both tokenisers: a byte-level BPE (A), given a blank and the text, and a piece model (B), which
puts the blank before the text itself. Tokens are bytes; a text whose joined tokens are not the blank and the text on either side has none.

Anchors. Prefix sums of the tokens' byte lengths give the places where tokens of both sides end together. Where the tokens that follow are
marked with a blank on both sides, the text is cut, so that it falls into windows of a word or so. What happens in a window depends on its two id
tuples alone: its groups (cut at every shared end) and its links (tokens whose byte ranges overlap) are worked out once and kept
under those tuples. The memory of a task starts anew beyond ``MEMO`` windows; long windows are not kept. Of A's side, the ids of the pieces between blanks are
kept likewise, as A never merges across them.

Counts. How many documents link an id pair is summed inside a chunk (the documents of an Arrow batch, at most about ``CHUNK_BYTES``
of text, or one longer text) before it is shuffled: a chunk is one written row with its distinct pairs, and its documents hold places in that list. The
summed counts come back to each chunk once for a pair, not once for a document, and the documents' sums are taken from there.
So a pair that all documents link is a row a chunk, which Spark can split. Tokenising happens once; nothing is broadcast or collected.

Rows: null and empty texts have no tokens and give zeros; repeated rows are documents of their own; a null id stays null. An empty table gives
no rows. One text is tokenised by one task.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.arrays import Prefix, slices
from caseloom.llm.common import cut

MEMO, LONG_WINDOW, LONG_PIECE, JOINED = 400_000, 64, 256, 10_000
PIECE_STARTS = re.compile(r"(?= [^\W_])")
CHUNK_BYTES = 4 << 20
BLANK = "▁"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_alphabet() -> dict[str, int]:
    """The bytes behind the characters of a byte-level vocabulary: printable ones are themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def piece_bytes(piece: str) -> bytes:
    """A piece in UTF-8, its blank mark as a blank; ``<0xHH>`` is a byte."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(BLANK, " ").encode()


class Tokens:
    """The bytes of a vocabulary's ids."""

    def __init__(self, entries: list[bytes]):
        self.bytes = entries
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.marked = np.array([e.startswith(b" ") for e in entries], bool)


class Both:
    """The two tokenisers of a task."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet, vocab = byte_alphabet(), self.a.get_vocab()
        names: list[str] = [""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            names[i] = name
        self.tokens_a = Tokens([bytes(alphabet[c] for c in n) if all(c in alphabet for c in n) else n.encode() for n in names])
        self.pieces: dict[str, bytes] = {}
        self.tokens_b = Tokens([piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())])

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        """A's ids of a blank and each text.

        No token of A crosses the place before a blank that a letter or digit follows: its words are cut there before they are merged. So the
        pieces between such places are tokenised once each and kept, as bytes of their ids; new ones are tokenised end to end and told
        apart by their lengths. As each piece gives back its bytes, so do the texts.
        """
        cut_up = [PIECE_STARTS.split(f" {t}") for t in texts]
        if len(self.pieces) > MEMO:
            self.pieces = {}
        known = self.pieces
        fresh = list({p: None for pieces in cut_up for p in pieces if p not in known})
        alone = [p for p in fresh if len(p) > LONG_PIECE or not PIECE_STARTS.match(p)]
        apart = set(alone)
        joined = [p for p in fresh if p not in apart]
        new = {p: np.array(e.ids, np.int32).tobytes() for p, e in zip(alone, self.a.encode_batch_fast(alone, add_special_tokens=False))}
        for k in range(0, len(joined), JOINED):
            own = joined[k : k + JOINED]
            ids = np.array(self.a.encode_batch_fast(["".join(own)], add_special_tokens=False)[0].ids, np.int32)
            ends, stops = np.cumsum(self.tokens_a.sizes[ids]), np.cumsum([len(p.encode()) for p in own])
            last = np.searchsorted(ends, stops)
            if not np.array_equal(ends[last], stops):
                raise ValueError("a token crosses the start of a piece")
            bounds, raw = [0, *(4 * last + 4).tolist()], ids.tobytes()
            new |= {p: raw[x:y] for p, x, y in zip(own, bounds, bounds[1:])}
        if b"".join([self.tokens_a.bytes[i] for i in np.frombuffer(b"".join(new.values()), np.int32).tolist()]) != "".join(new).encode():
            raise ValueError("a byte-level vocabulary gives back all bytes")
        known |= {p: i for p, i in new.items() if len(p) <= LONG_PIECE}
        if any(len(p) > LONG_PIECE for p in alone):
            known = known | new
        return [np.frombuffer(b"".join([known[p] for p in pieces]), np.int32) for pieces in cut_up]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text on both sides; of none where the bytes do not come back."""
        pairs, none = [], np.zeros(0, np.int32)
        for text, left, right in zip(texts, self.encode_a(texts), self.b.encode(texts, num_threads=1)):
            good = text and b"".join(map(self.tokens_b.bytes.__getitem__, right)) == f" {text}".encode()
            pairs.append((left, np.array(right, np.int32)) if good else (none, none))
        return pairs


class Memo:
    """Windows by their id tuples: text of the groups, number of groups, links laid end to end."""

    def __init__(self):
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.texts: list[str] = []
        self.groups, self.links, self.bounds = array("q"), array("q"), array("q", [0])

    def full(self) -> bool:
        return len(self.known) > MEMO or len(self.links) > 16 * MEMO

    def add(self, tokens: tuple[Tokens, Tokens], ids: list[np.ndarray], numbers: list[np.ndarray]) -> None:
        """Align new windows, whose ids are laid end to end; ``numbers`` tells how many each has on both sides.

        A token of A is linked to the tokens of B from the one in which it begins to the one in which it ends; groups end where both sides do.
        """
        sizes = [t.sizes[i] for t, i in zip(tokens, ids)]
        ends = [np.cumsum(x) for x in sizes]
        first, last = np.searchsorted(ends[1], ends[0] - sizes[0], "right"), np.searchsorted(ends[1], ends[0])
        often = last - first + 1
        partner = np.repeat(first - np.cumsum(often) + often, often) + np.arange(often.sum())
        links = (np.repeat(ids[0].astype(np.int64), often) << 32) | ids[1][partner]
        shared = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(shared, e) for e in ends]
        bounds = [np.concatenate(([0], np.cumsum(n))) for n in numbers]
        count = np.diff(np.searchsorted(shared, np.concatenate(([0], ends[0]))[bounds[0]], "right"))
        # ids in the order of the text, each with what follows it
        written = []
        for own, g, close in zip(ids, group, "|;"):
            ending = np.append(g[1:] != g[:-1], True)
            written += [f"{i}{close}" if e else f"{i}," for i, e in zip(own.tolist(), ending.tolist())]
        order = np.argsort(np.concatenate((group[0] * 2, group[1] * 2 + 1)), kind="stable").tolist()
        stops = (bounds[0] + bounds[1]).tolist()
        self.texts += ["".join([written[k] for k in order[x:y]])[:-1] for x, y in zip(stops, stops[1:])]
        self.groups.frombytes(count.astype(np.int64).tobytes())
        self.links.frombytes(links.astype(np.int64).tobytes())
        self.bounds.frombytes((np.concatenate(([0], np.cumsum(often)))[bounds[0][1:]] + self.bounds[-1]).astype(np.int64).tobytes())


def windows(ids: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray], tokens: tuple[Tokens, Tokens],
            doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the windows, as token numbers on both sides, of documents laid end to end."""
    shared, at_a, at_b = np.intersect1d(*ends, assume_unique=True, return_indices=True)
    begins = [np.append(t.marked[i], True)[at + 1] for t, i, at in zip(tokens, ids, (at_a, at_b))]
    chosen = (begins[0] & begins[1]) | np.isin(shared, doc_ends)
    return at_a[chosen] + 1, at_b[chosen] + 1


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]], tokens: tuple[Tokens, Tokens], memo: Memo) -> tuple[dict[str, np.ndarray], list[str], np.ndarray]:
    """The counts and the digest of the groups of each document, and all links in order, document by document."""
    numbers = [np.array([len(p[s]) for p in pairs], np.int64) for s in (0, 1)]
    ids = tuple(np.concatenate([p[s] for p in pairs]) for s in (0, 1))
    ends = tuple(np.cumsum(t.sizes[i]) for t, i in zip(tokens, ids))
    doc_a = np.cumsum(numbers[0])
    to_a, to_b = windows(ids, ends, tokens, ends[0][doc_a[doc_a > 0] - 1])
    # equal windows of the chunk by two 64-bit hashes, then one look into the memory for each
    from_a, from_b = np.append(0, to_a)[:-1], np.append(0, to_b)[:-1]
    names = [Prefix(i.astype(np.uint64)).span(x, y) for i, x, y in zip(ids, (from_a, from_b), (to_a, to_b))]
    order = np.lexsort(names)
    first = np.ones(len(order), bool)
    first[1:] = np.diff(names[0][order]).astype(bool) | np.diff(names[1][order]).astype(bool)
    heads = order[first]
    raw_a, raw_b = (i.tobytes() for i in ids)
    known, found, new, places = memo.known, [], [], len(memo.texts)
    for a, x, b, y in zip(*(v[heads].tolist() for v in (from_a, to_a, from_b, to_b))):
        key = raw_a[4 * a : 4 * x], raw_b[4 * b : 4 * y]
        place = known.get(key)
        if place is None:
            place = places + len(new)
            new.append((a, x, b, y))
            if x - a + y - b <= LONG_WINDOW:
                known[key] = place
        found.append(place)
    if new:
        spans = np.array(new, np.int64)
        fresh = [np.repeat(f - np.cumsum(n) + n, n) + np.arange(n.sum()) for f, n in ((spans[:, 0], spans[:, 1] - spans[:, 0]), (spans[:, 2], spans[:, 3] - spans[:, 2]))]
        memo.add(tokens, [i[at] for i, at in zip(ids, fresh)], [spans[:, 1] - spans[:, 0], spans[:, 3] - spans[:, 2]])
    place, texts = np.empty(len(order), np.int64), memo.texts
    place[order] = np.array(found, np.int64)[np.cumsum(first) - 1]
    groups, flat, bounds = (np.array(x, np.int64) for x in (memo.groups, memo.links, memo.bounds))
    starts, sizes = bounds[place], bounds[place + 1] - bounds[place]
    links = flat[np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    of_doc = np.searchsorted(to_a, np.concatenate(([0], doc_a)), "right")
    total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[of_doc])
    digests, named = [], place.tolist()
    for k in range(len(pairs)):
        own = named[of_doc[k] : of_doc[k + 1]]
        digests.append(hashlib.sha256(";".join([texts[w] for w in own]).encode()).hexdigest() if own else "")
    return {"n_a": numbers[0], "n_b": numbers[1], "n_groups": total(groups[place]), "n_links": total(sizes)}, digests, links


CHUNK = ("chunk long, doc_ids array<{id}>, " + ", ".join(f"{c} array<long>" for c in COUNTS) + ", groups_sha256 array<string>, "
         "pairs array<long>, holders array<int>, held binary")


def _chunk_rows(path_a: str, path_b: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import zstandard

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # the kept pieces and windows hold no cycles, and walking them costs as much as aligning
        try:
            both, memo, press, number = Both(path_a, path_b), Memo(), zstandard.ZstdCompressor(level=1), 0
            part = TaskContext.get().partitionId()
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for i, j in slices(np.cumsum([0, *map(len, texts)]), CHUNK_BYTES):
                    memo = Memo() if memo.full() else memo
                    counts, digests, flat = aligned(both.encode(texts[i:j]), (both.tokens_a, both.tokens_b), memo)
                    pairs, place = np.unique(flat, return_inverse=True)
                    doc = np.repeat(np.arange(j - i), counts["n_links"])
                    held, often = np.unique(doc * max(len(pairs), 1) + place, return_counts=True)
                    holders = np.bincount(held % max(len(pairs), 1), minlength=len(pairs))
                    blob = press.compress(np.concatenate((np.diff(held, prepend=0), often)).astype(np.int64).tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part << 32 | number]), pa.array([batch.column("doc_id").slice(i, j - i).to_pylist()], pa.list_(batch.schema.field("doc_id").type)),
                         *(pa.array([counts[c]], pa.list_(pa.int64())) for c in COUNTS), pa.array([digests], pa.list_(pa.string())),
                         pa.array([pairs], pa.list_(pa.int64())), pa.array([holders.astype(np.int32)], pa.list_(pa.int32())), pa.array([blob], pa.binary())],
                        names=[c.split()[0] for c in CHUNK.split(", ")])
                    number += 1
        finally:
            gc.enable()

    return work


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each chunk with the sums over their links."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k] for n in batch.schema.names}
            ids = row["doc_ids"].values
            table = np.zeros(0, np.int64)
            if row["counted"].is_valid and len(row["counted"].values):
                places, values = (row["counted"].values.field(f).to_numpy() for f in ("place", "value"))
                table = np.empty(len(places), np.int64)
                table[places] = values
            held, often = np.frombuffer(press.decompress(row["held"].as_py()), np.int64).reshape(2, -1)
            held = np.cumsum(held)
            doc, place = np.divmod(held, max(len(table), 1))
            value = table[place] if len(held) else held
            n = len(ids)
            best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(best, doc, often * (value & 1))
            np.add.at(total, doc, often * (value >> 1))
            yield pa.RecordBatch.from_arrays([ids, *(row[c].values for c in COUNTS), pa.array(best), pa.array(total), row["groups_sha256"].values],
                                             names=["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])


def chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One written row a chunk: its documents' counts and digests, its distinct pairs with the number of documents that hold them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut(docs.select("doc_id", "text").mapInArrow(_chunk_rows(path_a, path_b), CHUNK.format(id=kind)), "aligned-chunks")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): the documents that link each id pair ``a << 32 | b``, and whether that is the most for its A id."""
    held = rows.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x"))
    counts = held.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))  # as many rows a key as B has ids at most
    return counts.withColumn("best", F.col("n") == most)


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of (doc_id, text)."""
    rows = chunks(docs, path_a, path_b)
    counts = cut(pair_counts(rows), "pair-counts")
    asked = rows.select("chunk", F.posexplode("pairs").alias("place", "pair")).join(counts, "pair")
    value = F.shiftleft("n", 1) + F.col("best").cast("long")
    counted = asked.groupBy("chunk").agg(F.collect_list(F.struct("place", value.alias("value"))).alias("counted"))  # a chunk's pairs, bounded by its text
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.drop("pairs", "holders").join(counted, "chunk", "left").mapInArrow(
        _sums, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_best", "count_sum")) + ", groups_sha256 string")
