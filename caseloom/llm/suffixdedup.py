"""Removal of repeated passages by a sparse, distributed suffix sort with hash-compared suffixes.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else in the corpus. The same search runs over words: a text is
then the sequence of its words, each a 64-bit code of its bytes, and a window ``length`` words. Below, a unit is a byte or a word.

Anchors. Of the ``gram``-byte strings inside a window of ``length`` bytes, the one of lowest hash (the leftmost of
equals) is the window's anchor. Equal windows have equal anchors at equal places, so a window is only ever compared with
windows of the same anchor string and the same place in it. At first an anchor is no more than a 64-bit name and its place; those that several
places share inside a batch are settled on the spot and stand for the batch by one row. Only anchors whose name occurs elsewhere are spelt out. The windows of one anchor are consecutive; the bytes they
span are its block. About one position in ``(length - gram) / 2`` is an anchor.

Counting. Blocks are named by 128-bit content hashes of anchor string and span. An anchor string that occurs once repeats
nothing. If all its blocks are equal, all their windows repeat. Both are settled by sums, combined on the map side, so a
passage copied a million times is one row per task. Only anchors with several different blocks are left.

Suffix sort. One block of each content goes to a task by its anchor string (strings with very many blocks are cut by window
place), where the suffixes that start its windows are sorted by mergesort, one list for each anchor string and place.
Two suffixes are compared by the hash of their whole windows first, then by binary search over prefix polynomial hashes for
their common extension, and by the byte behind it: logarithmic in the length, whatever they share. Neighbours whose
common extension is a whole window repeat; every such verdict is verified byte by byte, and lists with a collision are sorted
again by their bytes.

Spans. Repeating windows come back to the rows by block name; the union of a row's windows is cut out of its bytes.

Nulls: a null text is empty. Rows are told apart by a hash of id and text; repeated rows are copies of each other and
lose what repeats, like any copies. Null ids are rows like any other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.arrays import SLICE, WHITE, Prefix, column_bytes, mix, slices
from caseloom.llm.arrays import runs as runs_of
from caseloom.llm.common import cut, row_key, with_fields

#: Bytes of blocks sorted by one task at once, and most blocks of one anchor string in a list.
SORTED_BYTES = 2 << 20
MOST_BLOCKS = 4096
#: Kinds of units, and the numbers that hold one.
BYTES, WORDS = 0, 1
UNIT = {BYTES: np.dtype(np.uint8), WORDS: np.dtype(np.uint64)}
#: Columns beside those of the input, by names that it will not have.
KEY, PACKED, RUNS, NULL = "_repeat_key", "_repeat_packed", "_repeat_runs", "_repeat_null"
NAMES = "key long, spot int, name long, sure boolean"
ANCHORS = "key long, kind int, place int, low int, high int, ga long, gb long, ua long, ub long"


class Search(NamedTuple):
    """Windows of ``length`` units of a kind, with anchors of ``gram`` units."""

    kind: int
    length: int
    gram: int


def searches(length: int, gram: int, words: int) -> list[Search]:
    return [Search(BYTES, length, gram), *([Search(WORDS, words, max(1, words // 3))] if words else [])]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs_of(~WHITE[data], np.array([0, len(data)]))[:2]


def units(data: np.ndarray, kind: int) -> np.ndarray:
    """The bytes of a text, or a code for each of its words."""
    return data if kind == BYTES else Prefix(data).span(*word_bounds(data))


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each block of one array of units."""
    windows, width = len(data) - length + 1, length - gram + 1
    if windows < 1:
        return (np.zeros(0, np.int64),) * 3
    found = []
    for begin in range(0, windows, SLICE):
        end = min(begin + SLICE, windows)
        grams = Prefix(data[begin : end + length - 1]).grams(gram)
        # the place takes the low bits, so that the minimum tells it and is leftmost among equals
        bits = np.uint64(int(len(grams)).bit_length())
        packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        pad = -len(packed) % width
        blocks = np.append(packed, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        best = np.minimum(behind[: end - begin], ahead[width - 1 : width - 1 + end - begin])
        found.append((best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64) + begin)
    chosen = np.concatenate(found)
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    return chosen[first], first, np.append(first[1:], windows) - 1


def _name(data: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(data)
    return digest & ((1 << 64) - 1), digest >> 64


def _anchor_names(wanted: list[Search]):
    """Names of all anchors; ``spot`` is twice the place, and one more for words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for i, j in slices(offsets):
                found = []
                for r in range(i, j):
                    own = data[offsets[r] : offsets[r + 1]]
                    for kind, length, gram in wanted:
                        codes = units(own, kind)
                        place = anchors(codes, length, gram)[0]
                        if len(place):
                            found.append((np.full(len(place), keys[r]), place * 2 + kind, Prefix(codes).span(place, place + gram) + np.uint64(kind)))
                if found:
                    yield _settled_names(*map(np.concatenate, zip(*found)))

    return work


def _settled_names(keys: np.ndarray, spots: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    """Anchors that share their name inside the batch are sure to repeat; one of them also stands for the batch."""
    names = names.view(np.int64)
    order = np.argsort(names, kind="stable")
    new = np.concatenate(([True], names[order][1:] != names[order][:-1]))
    head = np.flatnonzero(new)
    often = np.diff(np.append(head, len(names)))
    sure = np.zeros(len(names), bool)
    sure[order] = np.repeat(often > 1, often)
    stand = order[head[often > 1]]
    spread = mix(keys[sure].view(np.uint64) + spots[sure].astype(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([keys[~sure], keys[sure], keys[stand]])),
        pa.array(np.concatenate([spots[~sure], spots[sure], np.full(len(stand), -1)]).astype(np.int32)),
        pa.array(np.concatenate([names[~sure], spread, names[stand]])),
        pa.array(np.repeat([False, True, False], [(~sure).sum(), sure.sum(), len(stand)]))], names=[c.split()[0] for c in NAMES.split(", ")])


def _name(data: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(data)
    return digest & ((1 << 64) - 1), digest >> 64


def _anchor_rows(wanted: list[Search]):
    """The anchors of each text at the given spots, with their windows and content names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, names = [], []
            columns = [batch.column(c).to_pylist() for c in ("key", "packed", "spots")]
            for r, (key, small, spots) in enumerate(zip(*columns)):
                data = np.frombuffer(press.decompress(small), np.uint8)
                for kind, length, gram in wanted:
                    codes = units(data, kind)
                    place, low, high = anchors(codes, length, gram)
                    kept = np.isin(place * 2 + kind, spots)
                    place, low, high = place[kept], low[kept], high[kept]
                    raw, size, mark = codes.tobytes(), UNIT[kind].itemsize, b"%d " % kind
                    names += [(*_name(mark + raw[size * p : size * (p + gram)]), *_name(b"%d %d %d " % (kind, p - a, b - p) + raw[size * a : size * (b + length)]))
                              for p, a, b in zip(place.tolist(), low.tolist(), high.tolist())]
                    rows.append(np.column_stack((np.full(len(place), key), np.full(len(place), kind), place, low, high)))
                if names and (len(names) > 50_000 or r == len(columns[0]) - 1):
                    numbers, hashes = np.concatenate(rows), np.array(names, np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers[:, 0]), *(pa.array(numbers[:, k].astype(np.int32)) for k in range(1, 5)),
                         *(pa.array(np.ascontiguousarray(hashes[:, k])) for k in range(4))],
                        names=[c.split()[0] for c in ANCHORS.split(", ")])
                    rows, names = [], []

    return work


class Suffixes:
    """Windows of ``length`` units in one array, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.prefix = data, length, Prefix(data)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common bytes of the windows at a and b, by binary search over prefix hashes."""
        low = np.where(self.prefix.span(a, a + self.length) == self.prefix.span(b, b + self.length), self.length, 0)
        high = np.full(len(a), self.length)  # equal up to low; not beyond high
        while len(open_ := np.flatnonzero(high - low > 1)):
            middle = (low[open_] + high[open_]) // 2
            x, y = a[open_], b[open_]
            same = self.prefix.span(x, x + middle) == self.prefix.span(y, y + middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same]
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the window at a sorts after the one at b is false."""
        common = self.extension(a, b)
        at = np.minimum(common, self.length - 1)
        return (common == self.length) | (self.data[a + at] <= self.data[b + at])

    def sort(self, suffix: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bottom-up mergesort of the suffixes of each group; all merges of a level advance together, a comparison each."""
        order = np.argsort(group, kind="stable")
        suffix, group = suffix[order], group[order]
        bounds = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(group))
        starts, ends = bounds[:-1], bounds[1:]
        width = 1
        while True:
            big = ends - starts > width
            starts, ends = starts[big], ends[big]
            if not len(starts):
                return suffix, group
            number = -(-(ends - starts) // (2 * width))
            base = np.repeat(starts, number) + (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)) * 2 * width
            stop = np.minimum(base + 2 * width, np.repeat(ends, number))
            middle = np.minimum(base + width, stop)
            left, right, out = base.copy(), middle.copy(), base.copy()
            merged = suffix.copy()
            live = np.flatnonzero(middle < stop)
            while len(live):
                i, j = left[live], right[live]
                take = self.before(suffix[i], suffix[j])
                merged[out[live]] = np.where(take, suffix[i], suffix[j])
                left[live] += take
                right[live] += ~take
                out[live] += 1
                live = live[(left[live] < middle[live]) & (right[live] < stop[live])]
            for at, to in ((left, middle), (right, stop)):  # what is left of one side follows as it is
                rest = to - at
                source = np.repeat(at, rest) + np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest)
                target = np.repeat(out, rest) + np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest)
                merged[target] = suffix[source]
                out += rest
            suffix, width = merged, 2 * width

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows at a and b are equal byte by byte; runs along a diagonal are read once."""
        if not len(a):
            return np.zeros(0, bool)
        order = np.lexsort((a, b - a))
        x, step = a[order], (b - a)[order]
        new = np.concatenate(([True], (x[1:] != x[:-1] + 1) | (step[1:] != step[:-1])))
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(x)) - 1
        good = np.ones(len(x), bool)
        for h, t in zip(head.tolist(), tail.tolist()):
            i, j, n = x[h], x[h] + step[h], x[t] - x[h] + self.length
            if not np.array_equal(self.data[i : i + n], self.data[j : j + n]):
                differ = np.concatenate(([0], np.cumsum(self.data[i : i + n] != self.data[j : j + n])))
                good[h : t + 1] = differ[self.length : ][: t - h + 1] == differ[: t - h + 1]
        result = np.empty(len(x), bool)
        result[order] = good
        return result


def repeating(data: np.ndarray, suffix: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """The suffixes (positions in data) whose window equals another's of their group."""
    suffixes = Suffixes(data, length)
    order, groups = suffixes.sort(suffix, group)
    same = np.flatnonzero(groups[1:] == groups[:-1])
    same = same[suffixes.extension(order[same], order[same + 1]) == length]
    good = suffixes.verified(order[same], order[same + 1])
    twice = np.zeros(len(order), bool)
    twice[same[good]] = twice[same[good] + 1] = True
    found = [order[twice]]
    for g in np.unique(groups[same[~good]]):  # a hash collision: this list again, by its bytes
        seen: dict[bytes, list[int]] = {}
        for s in order[groups == g].tolist():
            seen.setdefault(data[s : s + length].tobytes(), []).append(s)
        found += [np.array(places) for places in seen.values() if len(places) > 1]
    return np.unique(np.concatenate(found))


def _sort_blocks(wanted: list[Search]):
    lengths = {s.kind: s.length for s in wanted}

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        """Runs of repeating windows of each block, as places before the anchor."""
        rows = rows.sort_values(["ga", "gb"], kind="stable").reset_index(drop=True)
        kind = int(rows.kind.iloc[0])  # of one kind in a group
        length, unit = lengths[kind], UNIT[kind]
        sizes = np.array([len(b) // unit.itemsize for b in rows.block], np.int64)
        data = np.frombuffer(b"".join(rows.block), unit)
        base = np.cumsum(sizes) - sizes
        number = sizes - length + 1
        block = np.repeat(np.arange(len(rows)), number)
        within = np.arange(len(block)) - np.repeat(np.cumsum(number) - number, number)
        string = np.concatenate(([0], np.cumsum((rows.ga.to_numpy()[1:] != rows.ga.to_numpy()[:-1]) | (rows.gb.to_numpy()[1:] != rows.gb.to_numpy()[:-1]))))
        place = rows.before.to_numpy(np.int64)[block] - within  # units from the window's start to the anchor
        twice = repeating(data, base[block] + within, string[block] * (1 << 20) + place, length)
        own = np.searchsorted(base, twice, "right") - 1
        at = twice - base[own]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))) if len(own) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(own)) - 1 if len(own) else head
        of = rows.iloc[own[head]]
        first = of.before.to_numpy(np.int64) - at[head]
        return pd.DataFrame({"ga": of.ga.to_numpy(), "gb": of.gb.to_numpy(), "ua": of.ua.to_numpy(), "ub": of.ub.to_numpy(),
                             "first": first.astype(np.int32), "last": (first - (at[tail] - at[head])).astype(np.int32)})

    return work


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for cheaper shuffles."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [press.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(packed, pa.binary())], names=[*kept, PACKED])


def packed(docs: DataFrame) -> DataFrame:
    kept = docs.drop("text")
    return docs.select(*kept.columns, "text").mapInArrow(_pack, with_fields(kept.schema, **{PACKED: "binary"}))


def _blocks(searched: list[Search]):
    lengths = {s.kind: s.length for s in searched}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The units of the wanted blocks of each row, cut by window place where a string has many blocks."""
        import zstandard

        press, last = zstandard.ZstdDecompressor(), None
        for batch in batches:
            out, size = [], 0
            for key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("key", "packed", "wanted"))):
                if key == last:  # a repeated row; the join brings them side by side
                    continue
                last = key
                data = np.frombuffer(press.decompress(text), np.uint8)
                codes = {kind: units(data, kind) for kind in {w["kind"] for w in wanted}}
                for w in wanted:
                    own, length = codes[w["kind"]], lengths[w["kind"]]
                    step = max(1, -(-(length + 1) // w["parts"]))
                    windows = w["high"] - w["low"] + 1
                    before = w["place"] - w["low"]
                    for part in range(w["parts"]):  # places before the anchor part*step ... part*step+step-1
                        far, near = min(before, part * step + step - 1), max(before - windows + 1, part * step)
                        if far >= near:
                            block = own[w["place"] - far : w["place"] - near + length].tobytes()
                            out.append((w["ga"], w["gb"], w["ua"], w["ub"], w["kind"], part, far, block))
                            size += len(block)
                    if size > 1 << 20:
                        yield _block_rows(out)
                        out, size = [], 0
            if out:
                yield _block_rows(out)

    return work


BLOCKS = "ga long, gb long, ua long, ub long, kind int, part int, before int, block binary"


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])


STRING, BLOCK = ["ga", "gb"], ["ga", "gb", "ua", "ub"]


def repeated_spots(docs: DataFrame, wanted: list[Search]) -> DataFrame:
    """(key, spots): anchors of (key, text) whose name occurs elsewhere. A clash of names brings a spot more, never one less."""
    found = docs.select("key", "text").mapInArrow(_anchor_names(wanted), NAMES)
    met = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name"))).filter("(sure OR n > 1) AND spot >= 0")
    return cut(met.select("key", "spot"), "met-names").groupBy("key").agg(F.collect_set("spot").alias("spots"))


def _merged(runs: F.Column) -> F.Column:
    """Runs (first, last) of falling places, those of neighbouring parts made one."""
    def add(made, run):
        end = F.get(made, F.size(made) - 1)
        longer = F.struct(end["first"].alias("first"), F.least(end["last"], run["last"]).alias("last"))
        return F.when(run["first"] >= end["last"] - 1, F.concat(F.slice(made, F.lit(1), F.size(made) - 1), F.array(longer))).otherwise(
            F.concat(made, F.array(run)))

    return F.aggregate(F.reverse(F.array_sort(runs)), F.array().cast("array<struct<first:int,last:int>>"), add)


def repeated_windows(docs: DataFrame, texts: DataFrame, wanted: list[Search]) -> DataFrame:
    """(key, kind, first, last): runs of window starts that repeat, from (key, text); ``texts`` has (key, packed)."""
    spots = repeated_spots(docs, wanted)
    found = cut(texts.join(spots, "key").select("key", "packed", "spots").mapInArrow(_anchor_rows(wanted), ANCHORS), "anchors")
    strings = cut(found.groupBy(*STRING).agg(  # written, so that both sides of the join are dealt anew and a hot string can be split
        F.count(F.lit(1)).alias("n"),
        ((F.min("ua") != F.max("ua")) | (F.min("ub") != F.max("ub"))).alias("several")).filter("n > 1"), "repeated-strings")
    met = cut(found.join(strings.select(*STRING, "several"), STRING), "met-anchors")
    blocks = cut(met.groupBy(*BLOCK).agg(
        F.count(F.lit(1)).alias("n"), F.max("several").alias("several"), F.min(F.struct("key", "kind", "place", "low", "high")).alias("at")), "blocks")
    mixed, most = blocks.filter("several"), max(s.length for s in wanted)
    parts = mixed.groupBy(*STRING).agg(F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.count(F.lit(1)) / MOST_BLOCKS))).cast("int").alias("parts"))
    asked = mixed.join(parts, STRING).groupBy("at.key").agg(F.collect_list(F.struct(*BLOCK, "at.kind", "at.place", "at.low", "at.high", "parts")).alias("wanted"))
    cut_out = cut(texts.join(asked, "key").select("key", "packed", "wanted").mapInArrow(_blocks(wanted), BLOCKS), "block-bytes")
    size = cut_out.agg(F.coalesce(F.sum(F.length("block")), F.lit(0)).alias("n")).first().n
    buckets = max(1, -(-size // SORTED_BYTES))
    runs = cut_out.withColumn("bucket", F.pmod(F.xxhash64(*STRING, "part"), F.lit(buckets))).groupBy("kind", "bucket").applyInPandas(
        _sort_blocks(wanted), "ga long, gb long, ua long, ub long, first int, last int")
    again = cut(runs, "block-runs").join(blocks.filter("n = 1").select(*BLOCK), BLOCK, "left_semi")  # copies of a block repeat whole
    # one row a block, so that the join gives each anchor back once, in however many parts its block was searched
    again = again.groupBy(*BLOCK).agg(F.collect_list(F.struct("first", "last")).alias("runs")).withColumn("runs", _merged(F.col("runs")))
    whole = F.struct((F.col("at.place") - F.col("at.low")).alias("first"), (F.col("at.place") - F.col("at.high")).alias("last"))
    copies = blocks.filter("n > 1").select(*BLOCK, F.array(whole).alias("runs"))
    return met.join(again.unionByName(copies), BLOCK).select("key", "kind", "place", F.explode("runs").alias("run")).select(
        "key", "kind", (F.col("place") - F.col("run.first")).alias("first"), (F.col("place") - F.col("run.last")).alias("last"))


def _spans(runs: list[dict] | None, search: Search) -> list[tuple[int, int]]:
    """Maximal ranges of units covered by the runs of window starts of one search."""
    merged: list[list[int]] = []
    length = search.length
    for first, last in sorted((r["first"], r["last"]) for r in runs or [] if r["kind"] == search.kind):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], last + length)
        else:
            merged.append([first, last + length])
    return [tuple(m) for m in merged]


def _join(docs: DataFrame, wanted: list[Search]) -> DataFrame:
    """Columns of docs but the text, with packed and runs."""
    keyed = docs.withColumn(KEY, row_key("doc_id", "text"))
    texts = packed(keyed)
    runs = repeated_windows(keyed.select(F.col(KEY).alias("key"), "text"), texts.select(F.col(KEY).alias("key"), F.col(PACKED).alias("packed")), wanted)
    spans = runs.groupBy(F.col("key").alias(KEY)).agg(F.collect_set(F.struct("kind", "first", "last")).alias(RUNS))
    return texts.join(spans, KEY, "left").drop(KEY)


def digests(docs: DataFrame, length: int = 400, gram: int = 200, words: int = 0) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of (doc_id, text).

    With ``words``, also n_repeated: the words covered by strings of that many words that also start anywhere else, whatever is between them.
    """
    wanted = searches(length, gram, words)
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"n_repeated": pa.int64()} if words else {})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(PACKED).to_pylist(), batch.column(RUNS).to_pylist()):
                raw, spans = press.decompress(text), _spans(runs, wanted[0])
                kept, at = hashlib.sha256(), 0
                for a, b in [*spans, (len(raw), len(raw))]:
                    kept.update(raw[at:a])
                    at = b
                rows.append((len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), *(sum(b - a for a, b in _spans(runs, s)) for s in wanted[1:])))
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds.values()))], names=["doc_id", *kinds])

    made = ", ".join(f"{c} {'string' if k == pa.string() else 'long'}" for c, k in kinds.items())
    return _join(docs.select("doc_id", "text"), wanted).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {made}")


def byte_spans(raw: bytes, runs: list[dict] | None, wanted: list[Search]) -> list[tuple[int, int]]:
    """What all searches together remove, as maximal ranges of bytes; words go from the first letter to the last."""
    if not runs:
        return []
    spans = _spans(runs, wanted[0])
    for search in wanted[1:]:
        if own := _spans(runs, search):
            starts, ends = word_bounds(np.frombuffer(raw, np.uint8))
            spans = spans + [(int(starts[a]), int(ends[b - 1])) for a, b in own]
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [tuple(m) for m in merged]


def without_repeats(docs: DataFrame, length: int = 400, gram: int = 200, words: int = 0) -> DataFrame:
    """``docs`` with its columns, repeated passages cut out of ``text``; a character goes if all its bytes do.

    With ``words``, strings of that many words that occur anywhere else go too, however few bytes they have.
    A null text stays null; ``n_chars``, where there is one, follows the text.
    """
    names = docs.columns
    marked, wanted = docs.withColumn(NULL, F.col("text").isNull()), searches(length, gram, words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = []
            for text, runs, null in zip(*(batch.column(c).to_pylist() for c in (PACKED, RUNS, NULL))):
                raw, kept, at = press.decompress(text), [], 0
                for a, b in [*byte_spans(raw, runs, wanted), (len(raw), len(raw))]:
                    while a < len(raw) and raw[a] & 0xC0 == 0x80:  # a whole character stays
                        a += 1
                    kept.append(raw[at:a])
                    at = b
                    while at < len(raw) and at > 0 and raw[at] & 0xC0 == 0x80:
                        at -= 1
                texts.append(None if null else b"".join(kept).decode())
            columns = {n: batch.column(n) for n in batch.schema.names if n not in (PACKED, RUNS, NULL)} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return _join(marked, wanted).mapInArrow(work, docs.schema)
