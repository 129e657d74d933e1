"""Removal of passages that an earlier document holds, found by difference-cover anchors.

A window is ``length`` consecutive words of one document. A word goes if a window covers it whose word sequence also starts in a
document of a smaller id. Words are the maximal runs of bytes other than blanks and the five control characters behind tab.

Anchors. A difference cover D of period v holds, for any two residues, a shift that brings both into D. Only the grams of
``length - v + 1`` words that start at places of D modulo v are hashed. Two equal windows, wherever they start, hold such a
gram at the same place in the window and at places of D in both texts, so they share an aligned anchor. For 13 words: v = 7, D = {0, 1, 3},
grams of 7 words at three of seven places.

Candidates. The anchors are dealt by hash; those that several documents hold are kept. This is a choice only: a clash of hashes
makes a candidate more, never one less.

Extension. Around each kept anchor the windows that hold it are spelt out and named by 96 bits of their words. A window
goes if the smallest document of its name is smaller than its own. Of exact copies (128 bits of the text) only the first takes part in this step:
the windows of the others are those of the first, so all of them go.

Hot anchors and windows. Inside an Arrow batch, what several documents of the batch share is settled on the spot; one row for the smallest
and one for the largest document stand for the batch in the shuffle. A passage that a third of all documents hold is a row
or two a batch there, and its settled places are dealt evenly. Nothing is broadcast and nothing is collected.

Rows: a null text has no words. Rows of equal id are one document, which never counts against itself; a null id is larger than all others.
Repeated rows get the same result. Texts of fewer words than ``length`` stay whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.arrays import WHITE, Prefix, column_bytes, mix, runs, slices
from caseloom.llm.common import cut, with_fields

#: Perfect difference sets: every residue but 0 is the difference of exactly one pair (fixed values).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
#: Columns beside those of the input, by names that it will not have.
DOC, HASH, TWIN, BYTES, SPANS, NULL = "_cover_doc", "_cover_hash", "_cover_twin", "_cover_bytes", "_cover_spans", "_cover_null"
LAST_ID, LAST_PLACE = (1 << 63) - 1, (1 << 31) - 1


def period_for(length: int) -> int:
    """The largest period that leaves anchors at least as long as itself."""
    return max(v for v in COVERS if 2 * v - 1 <= max(length, 1))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word place, name) of the anchors of all rows that have a window."""
    starts, ends, first = runs(~WHITE[data], offsets)
    words = Prefix(data).span(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    number = np.diff(first)
    period = period_for(length)
    gram = length - period + 1
    row = np.repeat(np.arange(len(number)), number)
    place = np.arange(len(words)) - np.repeat(first[:-1], number)
    covered = np.zeros(period, bool)
    covered[list(COVERS[period])] = True
    chosen = np.flatnonzero(covered[place % period] & (place + gram <= number[row]) & (number[row] >= length))
    name = np.zeros(len(chosen), np.uint64)
    for j in range(gram):
        name = (name + words[chosen + j]) * STEP
    return row[chosen], place[chosen], mix(name)


def _shared(order: np.ndarray, new: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, largest) doc of the group of each sorted entry; ``new`` marks where groups begin."""
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    own = doc[order]
    return np.minimum.reduceat(own, head)[group], np.maximum.reduceat(own, head)[group]


def _fresh(docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Marks the first of repeated rows of a batch."""
    seen = np.zeros(len(docs), bool)
    seen[np.unique(np.column_stack((docs, hashes)), axis=0, return_index=True)[1]] = True
    return seen


ANCHORS = f"{DOC} long, place int, name long, sure boolean"


def _anchor_rows(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hashes = (batch.column(c).to_numpy() for c in (DOC, HASH))
            data, offsets = column_bytes(batch.column("text"))
            fresh = _fresh(docs, hashes) if len(docs) else np.zeros(0, bool)
            for i, j in slices(offsets):
                row, place, name = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                kept = fresh[i + row]
                row, place, name = i + row[kept], place[kept], name[kept].view(np.int64)
                if not len(row):
                    continue
                order = np.argsort(name, kind="stable")
                new = np.concatenate(([True], name[order][1:] != name[order][:-1]))
                low, high = _shared(order, new, docs[row])
                sure = np.zeros(len(row), bool)
                sure[order] = low != high
                stand = order[np.flatnonzero(new & (low != high))]  # one place of each shared name
                own = ~sure
                spread = mix(hashes[row[sure]].view(np.uint64) + place[sure].astype(np.uint64) * STEP).view(np.int64)
                ends = [low[new & (low != high)], high[new & (low != high)]]
                size = own.sum(), sure.sum(), len(stand)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([docs[row[own]], docs[row[sure]], *ends])),
                    pa.array(np.concatenate([place[own], place[sure], np.full(2 * size[2], -1)]).astype(np.int32)),
                    pa.array(np.concatenate([name[own], spread, name[stand], name[stand]])),
                    pa.array(np.repeat([False, True, False], [size[0], size[1], 2 * size[2]]))], names=[c.split()[0] for c in ANCHORS.split(", ")])

    return work


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for cheaper shuffles."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        small = [press.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(small, pa.binary())], names=[*kept, BYTES])


def candidate_windows(places: np.ndarray, n: int, length: int) -> np.ndarray:
    """Starts of the windows of an ``n``-word text that hold one of the anchors at ``places``."""
    before = period_for(length)
    starts = np.unique((places[:, None] - np.arange(before)[None, :]).ravel())
    return starts[(starts >= 0) & (starts + length <= n)]


WINDOWS = f"{DOC} long, {HASH} long, first int, last int, wa long, wb int, sure boolean"


def _window_rows(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (DOC, HASH, BYTES, "places")]
            seen, names, parts, held = set(), [], [], 0
            for k, (doc, own, small, places) in enumerate(zip(*columns)):
                if (doc, own) not in seen:
                    seen.add((doc, own))
                    words = press.decompress(small).split()
                    starts = candidate_windows(np.array(places, np.int64), len(words), length)
                    names += [xxhash.xxh3_128_digest(b" ".join(words[s : s + length])) for s in starts.tolist()]
                    parts.append(np.column_stack((np.full(len(starts), doc), np.full(len(starts), own), starts)))
                    held += len(starts)
                if held and (held > 200_000 or k == len(columns[0]) - 1):
                    yield _settled(np.concatenate(parts), np.frombuffer(b"".join(names), np.int64).reshape(-1, 2))
                    names, parts, held = [], [], 0

    return work


def _settled(rows: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    """Windows of a batch: those that a smaller document of the batch holds as runs that go for sure, the others one by one."""
    docs, hashes, starts = rows.T
    order = np.lexsort((names[:, 0], names[:, 1]))
    sorted_names = names[order]
    new = np.concatenate(([True], (sorted_names[1:] != sorted_names[:-1]).any(axis=1)))
    low, _ = _shared(order, new, docs)
    sure = np.zeros(len(docs), bool)
    sure[order] = docs[order] > low
    d, h, s = docs[sure], hashes[sure], starts[sure]  # still in the order of rows and places
    begins = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (s[1:] != s[:-1] + 1)))) if len(d) else np.zeros(0, np.int64)
    last = s[np.append(begins[1:], len(s)) - 1] if len(d) else s
    own = ~sure
    spread = mix(h[begins].view(np.uint64) + s[begins].astype(np.uint64) * STEP).view(np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([docs[own], d[begins]])), pa.array(np.concatenate([hashes[own], h[begins]])),
        pa.array(np.concatenate([starts[own], s[begins]]).astype(np.int32)), pa.array(np.concatenate([starts[own], last]).astype(np.int32)),
        pa.array(np.concatenate([names[own, 0], spread])), pa.array(np.concatenate([names[own, 1], np.zeros(len(begins), np.int64)]).astype(np.int32)),
        pa.array(np.repeat([False, True], [own.sum(), len(begins)]))], names=[c.split()[0] for c in WINDOWS.split(", ")])


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of its rows: the id (a null id is the largest) and a hash of the text."""
    return docs.withColumns({DOC: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), HASH: F.xxhash64(F.coalesce("text", F.lit("")))})


def repeated_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(doc, place): anchors that several documents hold, of keyed rows."""
    found = docs.select(DOC, HASH, "text").mapInArrow(_anchor_rows(length), ANCHORS)
    same = Window.partitionBy("name")
    met = found.withColumns({"low": F.min(DOC).over(same), "high": F.max(DOC).over(same)})
    return met.filter("(sure OR low < high) AND place >= 0").select(DOC, "place")


def marked_texts(docs: DataFrame, length: int) -> DataFrame:
    """Columns of ``docs`` but the text, with the compressed text and the runs of window starts that go."""
    rows = keyed(docs)
    keys = rows.select(DOC, HASH, F.xxhash64(F.lit(TWIN), F.coalesce("text", F.lit(""))).alias(TWIN)).distinct()
    firsts = keys.groupBy(HASH, TWIN).agg(F.min(DOC).alias("first_doc"))
    known = cut(keys.join(firsts, [HASH, TWIN]).select(DOC, HASH, (F.col(DOC) > F.col("first_doc")).alias("copy")), "text-keys")
    places = cut(repeated_anchors(rows, length), "shared-anchors").groupBy(DOC).agg(F.collect_set("place").alias("places"))
    wanted = known.filter("NOT copy").join(places, DOC).select(DOC, HASH, "places")
    kept = rows.drop("text")
    texts = rows.select(*kept.columns, "text").mapInArrow(_pack, with_fields(kept.schema, **{BYTES: "binary"}))
    windows = texts.join(wanted, [DOC, HASH]).mapInArrow(_window_rows(length), WINDOWS)  # all columns, so that both joins read one shuffle of the texts
    same = Window.partitionBy("wa", "wb")
    gone = windows.withColumn("low", F.min(F.when(~F.col("sure"), F.col(DOC))).over(same)).filter(f"sure OR low < {DOC}")
    runs_gone = gone.select(DOC, HASH, "first", "last").unionByName(
        known.filter("copy").select(DOC, HASH, F.lit(0).alias("first"), F.lit(LAST_PLACE).alias("last")))
    spans = runs_gone.groupBy(DOC, HASH).agg(F.collect_set(F.struct("first", "last")).alias(SPANS))
    return texts.join(spans, [DOC, HASH], "left").drop(DOC, HASH)


def kept_words(words: list[bytes], spans: list[dict] | None, length: int) -> list[bytes]:
    """The words that no window of the runs covers."""
    if not spans or len(words) < length:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, [s["first"] for s in spans], 1)
    np.add.at(gone, [min(s["last"] + length, len(words)) for s in spans], -1)
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g]


def _texts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """(all words, kept words) of each row."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    for small, spans in zip(batch.column(BYTES), batch.column(SPANS)):
        words = press.decompress(small.as_py()).split()
        yield words, kept_words(words, spans.as_py(), length)


def digests(docs: DataFrame, length: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for words, kept in _texts(batch, length)]
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string())))],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked_texts(docs.select("doc_id", "text"), length).mapInArrow(work, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def without_earlier(docs: DataFrame, length: int = 13) -> DataFrame:
    """``docs`` with its columns, passages of earlier documents cut out of ``text``.

    Texts that lose nothing stay as they are; of the others the kept words are joined by one blank. A null text stays null; ``n_chars``, where
    there is one, follows the text.
    """
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = []
            for null, small, (words, kept) in zip(batch.column(NULL).to_pylist(), batch.column(BYTES), _texts(batch, length)):
                texts.append(None if null else (b" ".join(kept) if len(kept) < len(words) else press.decompress(small.as_py())).decode())
            columns = {n: batch.column(n) for n in batch.schema.names if n in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return marked_texts(docs.withColumn(NULL, F.col("text").isNull()), length).mapInArrow(work, docs.schema)
