"""Language-model scores of whole texts by the likelihood of all segmentations into subwords.

The subwords are those of an existing vocabulary; they never cross words, and single bytes complete them, so every word has
at least one segmentation. A word is the word mark and its bytes. Its probability is the sum over all its segmentations of the product
of the unigram probabilities of the pieces, by a forward recursion in log space; a text is its words and one end.

The vocabulary's own scores (merge ranks, taken as 1 / rank) weight the segmentations of the training words; their expected piece counts
(forward and backward, ``rounds`` times) over all training documents, and the vocabulary's scores as a prior worth ``PRIOR`` pieces, give the
scores that the texts are measured with. The word counts of the training documents also give a smoothed unigram baseline.

Corpus counts are gathered by Spark per distinct word; each distinct word is scored once. Texts are cut in blocks of about
``BLOCK`` bytes; each block joins its distinct words with their counts and scores, and its texts are summed against them, so
nothing that grows with the corpus is broadcast and no hot word is shuffled more than once a block. Words of a text are found in the block's
table by a 64-bit hash; counting itself is by the words.

Null and empty texts are the end alone. Repeated rows count each time. A null id is held out or not as an empty id. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.arrays import LOWER, SLICE, WHITE, Prefix, column_bytes, look_up, row_sums, runs, slices
from caseloom.llm.common import cut

#: Bytes of text in a block, and words worked on at once.
BLOCK = 32 << 20
WORDS = 20_000
#: Weight of the vocabulary's own scores against the counted pieces.
PRIOR = 1000.0
MARK = "▁".encode()


class Pieces:
    """Scores (natural log) of the pieces of a vocabulary by the hash of their bytes."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray, scores: np.ndarray, longest: int):
        self.hashes, self.numbers, self.scores, self.longest = hashes, numbers, scores, longest
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(hashes >> np.uint64(42)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are pieces, their places)."""
        hit = np.flatnonzero(self.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
        place, found = look_up(self.hashes, hashes[hit])
        return hit[found], place[found]

    @classmethod
    def of(cls, path: str) -> Pieces:
        """Pieces of a sentencepiece model without marks inside, and the 256 bytes; scores 1 / rank, normalised."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = dict.fromkeys(p.encode() for p in names if p and "▁" not in p[1:])
        pieces |= dict.fromkeys(bytes([b]) for b in range(256) if bytes([b]) not in pieces)
        pieces = list(pieces)
        rank = np.arange(1, len(pieces) + 1, dtype=float)
        hashes = np.array([Prefix(np.frombuffer(p, np.uint8)).span(np.array([0]), np.array([len(p)]))[0] for p in pieces], np.uint64)
        order = np.argsort(hashes)
        score = -np.log(rank) - np.log((1 / rank).sum())
        return cls(hashes[order], order, score[order], max(map(len, pieces)))


def _lattice(words: list[bytes], pieces: Pieces) -> Iterator[tuple[np.ndarray, int, list]]:
    """Words of equal length together: (their places, length, spans); a span is (start, end, words, piece places)."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        which = np.flatnonzero(lengths == length)
        for k in range(0, len(which), max(1, (1 << 18) // int(length + len(MARK)))):
            own = which[k : k + max(1, (1 << 18) // int(length + len(MARK)))]
            data = np.frombuffer(b"".join(MARK + words[i] for i in own), np.uint8)
            total = int(length) + len(MARK)
            prefix, base, spans = Prefix(data), np.arange(len(own)) * total, []
            for end in range(1, total + 1):
                for start in range(max(0, end - pieces.longest), end):
                    hit, place = pieces.find(prefix.span(base + start, base + end))
                    if len(hit):
                        spans.append((start, end, hit, place))
            yield own, total, spans


def _forward(n: int, total: int, spans: list, scores: np.ndarray) -> np.ndarray:
    """Log probability of all segmentations up to each place."""
    reach = np.full((total + 1, n), -np.inf)
    reach[0] = 0
    for start, end, hit, place in spans:  # ordered by end
        reach[end, hit] = np.logaddexp(reach[end, hit], reach[start, hit] + scores[place])
    return reach


def word_scores(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Natural log of the probability of each word over all segmentations."""
    out = np.zeros(len(words))
    for own, total, spans in _lattice(words, pieces):
        out[own] = _forward(len(own), total, spans, pieces.scores)[total]
    return out


def expected_counts(words: list[bytes], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected number of each piece in the words, over all segmentations."""
    expected = np.zeros(len(pieces.hashes))
    for own, total, spans in _lattice(words, pieces):
        reach = _forward(len(own), total, spans, pieces.scores)
        back = np.full((total + 1, len(own)), -np.inf)
        back[total] = 0
        for start, end, hit, place in reversed(spans):
            back[start, hit] = np.logaddexp(back[start, hit], back[end, hit] + pieces.scores[place])
        weights = [np.exp(reach[start, hit] + pieces.scores[place] + back[end, hit] - reach[total, hit]) * counts[own[hit]]
                   for start, end, hit, place in spans]
        expected += np.bincount(np.concatenate([s[3] for s in spans]), np.concatenate(weights), minlength=len(expected))
    return expected


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, in blocks of consecutive rows of this task."""
    import zstandard
    from pyspark import TaskContext

    press, task, block, size = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        numbers, texts = [], []
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            if size > BLOCK:
                block, size = block + 1, 0
            size += len(raw) + 16
            numbers.append(task << 24 | block)
            texts.append(press.compress(raw))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(numbers, pa.int64()), pa.array(texts, pa.binary())],
                                         names=["doc_id", "held_out", "block", "packed"])


def _parsed(batch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(lower-case bytes, starts, ends, first word of each row, word hashes, rows i..j) of slices of a batch of packed texts."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    raws = [press.decompress(p) for p in batch]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raws], dtype=np.int64)))
    for i, j in slices(offsets, SLICE):
        low = LOWER[np.frombuffer(b"".join(raws[i:j]), np.uint8)]
        starts, ends, first = runs(~WHITE[low], offsets[i : j + 1] - offsets[i])
        yield low, starts, ends, first, Prefix(low).span(starts, ends), i, j


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``WORDS`` rows, however short those are that arrive; words of one length are worked on together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= WORDS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class _Words:
    """Distinct words of one block and their number in training rows."""

    def __init__(self):
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.words: list[bytes] = []
        self.count = np.zeros(0)

    def add(self, hashes: np.ndarray, weight: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        value, sample, place = np.unique(hashes, return_index=True, return_inverse=True)
        number = np.bincount(place, weight, minlength=len(value))
        spot, known = look_up(self.keys, value)
        self.count[self.at[spot[known]]] += number[known]
        new = np.flatnonzero(~known)
        keys = np.concatenate((self.keys, value[new]))
        at = np.concatenate((self.at, len(self.words) + np.arange(len(new))))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]
        self.words += [raw[a:b] for a, b in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist())]
        self.count = np.concatenate((self.count, number[new]))

    def rows(self, block: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(self.keys), block)), pa.array(self.keys.view(np.int64)), pa.array(self.words, pa.binary()).take(pa.array(self.at)),
             pa.array(self.count[self.at].astype(np.int64))], names=["block", "hash", "word", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, hash, word, n): distinct words of each block in this task, n counted in training rows."""
    current, found = None, _Words()
    for batch in batches:
        blocks, learn = np.array(batch.column("block").to_pylist(), np.int64), ~np.array(batch.column("held_out").to_pylist(), bool)
        for block in dict.fromkeys(blocks.tolist()):
            if block != current:
                if current is not None:
                    yield found.rows(current)
                current, found = block, _Words()
            own = np.flatnonzero(blocks == block)
            for low, starts, ends, first, hashes, i, j in _parsed([batch.column("packed")[int(r)].as_py() for r in own]):
                row = np.repeat(np.arange(j - i), np.diff(first))
                found.add(hashes, learn[own[i:j]][row].astype(float), low.tobytes(), starts, ends)
    if current is not None:
        yield found.rows(current)


def _learn(counted: DataFrame, given: Pieces, scores: np.ndarray, ends: int) -> tuple[np.ndarray, float]:
    """(weight of each piece, sum with the end's) after one round of expected counts of (word, n) under ``scores``."""
    sent = counted.sparkSession.sparkContext.broadcast((given.hashes, given.numbers, scores, given.longest))  # one entry a piece

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, found = Pieces(*sent.value), None
        for batch in _gathered(batches):
            for k in range(0, batch.num_rows, WORDS):
                part = batch.slice(k, WORDS)
                own = expected_counts(part.column("word").to_pylist(), np.array(part.column("n"), float), pieces)
                found = own if found is None else found + own
        if found is not None:
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], names=["piece", "n"])

    sums = counted.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    number = PRIOR * np.exp(given.scores)
    number[sums.piece.to_numpy(np.int64)] += sums.n.to_numpy()
    return number, number.sum() + ends + 1


def score(docs: DataFrame, held_out: Column, model_path: str, rounds: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of (doc_id, text)."""
    spark = docs.sparkSession
    texts = cut(docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        _blocks, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, block long, packed binary"), "lm-texts")
    ends = texts.agg(F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0)).alias("n")).first().n
    local = cut(texts.mapInArrow(_count, "block long, hash long, word binary, n long"), "lm-block-words")
    words = cut(local.groupBy("hash", "word").agg(F.sum("n").alias("n")), "lm-words")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("v")).first()
    tokens, kinds = totals.n + ends, totals.v + (ends > 0)
    given = Pieces.of(model_path)
    counted, number = words.filter("n > 0").select("word", "n"), None
    for _ in range(rounds):
        number, whole = _learn(counted, given, given.scores if number is None else np.log(number / whole), ends)
    learnt = spark.sparkContext.broadcast((given.hashes, given.numbers, np.log(number / whole), given.longest))  # one entry a piece
    end_score, smooth = np.log10((ends + 1) / whole), tokens + 0.1 * (kinds + 1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(*learnt.value)
        for batch in _gathered(batches):
            for k in range(0, batch.num_rows, WORDS):
                part = batch.slice(k, WORDS)
                yield pa.RecordBatch.from_arrays([part.column("hash"), part.column("n"), pa.array(word_scores(part.column("word").to_pylist(), pieces) / np.log(10))],
                                                 names=["hash", "n", "score"])

    measured = cut(words.mapInArrow(measure, "hash long, n long, score double").dropDuplicates(["hash"]), "lm-word-scores")
    joined = local.select("block", "hash").join(measured, "hash")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(right.hash.to_numpy(np.int64).view(np.uint64))
        keys = right.hash.to_numpy(np.int64).view(np.uint64)[order]
        count, logs = right.n.to_numpy(np.int64)[order], right.score.to_numpy()[order]
        base = np.log10((count + 0.1) / smooth)
        rows = []
        for _, _, _, first, hashes, i, j in _parsed(left.packed.tolist()):
            place, found = look_up(keys, hashes)
            assert found.all()
            rows.append(np.column_stack((np.diff(first) + 1, row_sums(count[place] > 0, first) + (ends > 0),
                                         row_sums(base[place], first) + np.log10((ends + 0.1) / smooth), row_sums(logs[place], first) + end_score)))
        values = np.concatenate(rows)
        return pd.DataFrame({"doc_id": left.doc_id, "held_out": left.held_out, "n_tokens": values[:, 0].astype(np.int64),
                             "n_known": values[:, 1].astype(np.int64), "train_tokens": tokens, "base_score": values[:, 2], "score": values[:, 3]})

    # a block without words has no partner
    return texts.groupBy("block").cogroup(joined.groupBy("block")).applyInPandas(
        sums, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
