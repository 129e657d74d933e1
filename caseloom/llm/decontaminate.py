"""Benchmark decontamination by template canonicalisation.

Texts become tokens: runs of letters, and numbers. Numbers, names (capitalised words inside a sentence) and units (unit words
behind a number) are replaced by typed placeholders, all else is lower case. Windows of ``size`` tokens are hashed, and the windows
of documents are hash-joined with those of benchmark items, so a question asked again with other numbers or names
still meets its template. A template needs half of its tokens literal to count. Windows are hashed by what stands in them, too (in lower case):
windows of equal values match whatever their placeholders are, so numbers and names copied verbatim, and copies in capitals, are found.

Slot consistency: windows of one document and item on one diagonal (same distance of places) are one alignment. There each value in a
slot of the item stands for the value that most windows put in its place (its own value, then the largest hash, if several do), and
windows with another value there are dropped. So one of two equal numbers may be edited, or asked anew as another, and the rest still counts; windows
of equal values always do. A document is contaminated by an item if the windows left cover ``share`` of the item's, or if ``run`` tokens in a row match. Coverage is
the greater one of two: over all windows of the item, and over those with enough literal tokens, as only these can match with other values.

Documents first pass a filter of all window hashes of the benchmark, sent in blocks of at most ``BLOCK`` hashes; a larger
benchmark takes more passes over the documents. Only windows that meet one are shuffled.

Nulls: null texts and null items have no tokens. Null ids are rows like any other. An item shorter than a window is one window. Repeated rows are found alike. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.arrays import LOWER, SLICE, Prefix, column_bytes, look_up, mix, runs, slices
from caseloom.llm.common import cut, row_key

#: Hashes sent to tasks at once (8 bytes each).
BLOCK = 1_000_000
#: Key of a row, by a name that the input will not have.
KEY = "_leak_key"
UNITS = """mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg mg lb lbs oz
gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute
minutes h hr hour hours day days week weeks month months year years mph kmh km/h percent dollar dollars cent cents euro euros eur usd
degree degrees celsius fahrenheit watt watts volt volts joule joules newton newtons byte bytes kb mb gb tb hz khz mhz ghz""".split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA3C59AC2F1B7D5E1, 0x5D1F0B9E37C4A8F3, 0xC7E19B3D5A2F8461))
LETTER, DIGIT = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT[range(48, 58)] = True
STOP = np.isin(np.arange(256), [ord(c) for c in ".!?:;\n\""])
FOUND = "key long, doc_id long, place int, hash long, slots array<long>"
ITEM = "item_id long, place int, tokens int, literal boolean, hash long, slots array<long>"
#: Told apart from hashes of templates.
VALUES = np.uint64(0x2545F4914F6CDD1D)


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8."""
    low = LOWER[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1 if len(data) else []
    low[upper] += 32
    return low


_units = np.sort(np.concatenate([Prefix(np.frombuffer(u.encode(), np.uint8)).span(np.array([0]), np.array([len(u)])) for u in UNITS]))


class Tokens:
    """Template codes of the tokens of some rows; ``value`` is the hash of what stands there."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        digit = DIGIT[data]
        joins = np.zeros(len(data), bool)
        if len(data) > 2:
            joins[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            joins &= ~edge[:-1] & ~edge[1:]
        low = _fold(data)
        words, numbers = runs(LETTER[data], offsets), runs(digit | joins, offsets)
        starts, ends = np.concatenate((words[0], numbers[0])), np.concatenate((words[1], numbers[1]))
        order = np.argsort(starts, kind="stable")
        self.starts, ends = starts[order], ends[order]
        number = order >= len(words[0])
        self.first = np.searchsorted(self.starts, offsets)
        self.value = Prefix(low).span(self.starts, ends)
        stops = np.concatenate(([0], np.cumsum(STOP[data])))
        before = np.concatenate(([0], ends[:-1]))[: len(ends)]
        opening = stops[self.starts] > stops[before]
        opening[self.first[:-1][self.first[:-1] < len(opening)]] = True
        head = data[self.starts] if len(self.starts) else np.zeros(0, np.uint8)
        capital = (head != low[self.starts]) if len(self.starts) else np.zeros(0, bool)
        two = self.starts[head == 0xC3]
        capital[head == 0xC3] = data[two + 1] != low[two + 1]
        name = ~number & capital & ~opening
        unit = ~number & look_up(_units, self.value)[1]
        unit[1:] &= number[:-1] & (self.starts[1:] - ends[:-1] <= 1)
        unit[:1] = False
        self.code = self.value.copy()
        self.code[name], self.code[number], self.code[unit] = NAME, NUMBER, UNIT
        self.slot = name | number | unit

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token where it begins, hash, whether it is of a template, whether half of the tokens are literal) of the windows inside a row.

        Every window has the hash of its values; one with slots and enough literal tokens has that of its template besides.
        """
        n = len(self.code) - size + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)
        total, equal, factor = np.full(n, np.uint64(size)), np.full(n, VALUES), np.uint64(0x9FB21C651E98DF25)
        for k in range(size):
            total = total * factor + self.code[k : k + n]
            equal = equal * factor + self.value[k : k + n]
        filled = np.concatenate(([0], np.cumsum(self.slot)))
        filled = filled[size:] - filled[:-size]
        row_end = self.first[np.searchsorted(self.first, np.arange(n), "right")]
        inside = np.arange(n) + size <= row_end
        literal = filled * 2 <= size
        whole, slotted = np.flatnonzero(inside), np.flatnonzero(inside & literal & (filled > 0))
        at = np.concatenate((whole, slotted))
        return at, mix(np.concatenate((equal[whole], total[slotted]))), np.arange(len(at)) >= len(whole), literal[at]

    def values(self, at: int, size: int) -> list[int]:
        """What stands in the slots of a window."""
        own = slice(at, at + size)
        return self.value[own][self.slot[own]].view(np.int64).tolist()


def _items(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            rows = []
            for r, item in enumerate(batch.column("item_id").to_pylist()):
                tokens = Tokens(data[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]))
                own = min(size, len(tokens.code))
                if own:
                    at, hashes, template, literal = tokens.windows(own)
                    rows += [(item, p, own, good, h, tokens.values(p, own) if t else [])
                             for p, h, t, good in zip(at.tolist(), hashes.view(np.int64).tolist(), template.tolist(), literal.tolist())]
            if rows:
                yield _rows(rows, ITEM)

    return work


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*rows), schema.split(", "))], names=names)


def _meet(sent, sizes: list[int]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        table = np.zeros(1 << 22, bool)
        table[(wanted >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            keys, ids = batch.column("key").to_pylist(), batch.column("doc_id").to_pylist()
            for i, j in slices(offsets, SLICE // 4):
                tokens = Tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = []
                for size in sizes:
                    at, hashes, template, _ = tokens.windows(size)
                    maybe = np.flatnonzero(table[(hashes >> np.uint64(42)).astype(np.int64)])
                    maybe = maybe[look_up(wanted, hashes[maybe])[1]]
                    at, hashes, template = at[maybe], hashes[maybe], template[maybe]
                    row = np.searchsorted(tokens.first, at, "right") - 1
                    # rows without tokens share their first token with the next one; the last of them owns it
                    rows += [(keys[i + r], ids[i + r], p - int(tokens.first[r]), h, tokens.values(p, size) if t else [])
                             for r, p, h, t in zip(row.tolist(), at.tolist(), hashes.view(np.int64).tolist(), template.tolist())]
                if rows:
                    yield _rows(rows, FOUND)

    return work


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: float = 0.5, run: int = 13) -> DataFrame:
    """(key, doc_id, item_id, matched, windows, coverage, longest_run, changed_slots) of each contaminated (document, item).

    ``key`` is ``row_key("doc_id", "text")``. ``changed_slots`` counts the slot values of the item that the document replaces.
    """
    spark = docs.sparkSession
    items = cut(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_items(size), ITEM), "items")
    sizes = sorted(r.tokens for r in items.select("tokens").distinct().collect())  # at most ``size`` numbers
    hashes = cut(items.select("hash").distinct(), "item-hashes")
    blocks = -(-hashes.count() // BLOCK)
    keyed = docs.select(row_key("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = spark.createDataFrame([], FOUND)
    for k in range(blocks):
        own = hashes.filter(F.pmod("hash", F.lit(blocks)) == k).toPandas().hash.to_numpy(np.int64).view(np.uint64)
        met = met.unionByName(keyed.mapInArrow(_meet(spark.sparkContext.broadcast(np.sort(own)), sizes), FOUND))
    joined = cut(met.distinct().join(items.withColumnsRenamed({"place": "at", "slots": "asked"}), "hash").withColumn(
        "diagonal", F.col("place") - F.col("at")), "met-windows")
    alignment = ["key", "doc_id", "item_id", "diagonal"]
    # each slot value of the item stands for the value that most windows of the alignment put in its place
    pairs = joined.select(*alignment, F.explode(F.arrays_zip("asked", "slots")).alias("s")).groupBy(*alignment, "s.asked", "s.slots").agg(F.count(F.lit(1)).alias("n"))
    chosen = pairs.groupBy(*alignment, "asked").agg(F.max(F.struct("n", (F.col("slots") == F.col("asked")).alias("same"), "slots")).getField("slots").alias("slot"))
    mapping = chosen.groupBy(*alignment).agg(
        F.map_from_entries(F.collect_list(F.struct("asked", "slot"))).alias("mapping"),  # at most the slots of the item
        F.count_if(F.col("slot") != F.col("asked")).alias("changed_slots"))
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"c.{c}")) for c in alignment]
    agrees = F.forall(F.arrays_zip("asked", "slots"), lambda s: F.col("mapping")[s["asked"]] == s["slots"])  # windows of equal values have no pairs
    good = joined.alias("g").join(mapping.alias("c"), same, "left").filter(agrees).groupBy(*(f"g.{c}" for c in alignment)).agg(
        F.sort_array(F.collect_set(F.struct("at", "tokens", "literal"))).alias("seen"),  # at most the windows of the item
        F.coalesce(F.max("changed_slots"), F.lit(0)).alias("changed_slots"))
    longest = F.aggregate("seen", F.struct(F.lit(-9).alias("at"), F.lit(0).alias("now"), F.lit(0).alias("best")), lambda a, x: F.struct(
        x.at.alias("at"), F.when(x.at == a.at + 1, a.now + 1).otherwise(x.tokens).alias("now"),
        F.greatest(a.best, F.when(x.at == a.at + 1, a.now + 1).otherwise(x.tokens)).alias("best")), lambda a: a.best)
    matched = good.withColumn("run", longest).groupBy("key", "doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("seen.at")))).cast("long").alias("all_matched"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.filter("seen", lambda w: w.literal).at)))).cast("long").alias("literal_matched"),
        F.max("run").alias("longest_run"),
        F.min_by("changed_slots", F.struct(-F.size("seen"), "diagonal")).cast("long").alias("changed_slots"))
    counts = items.groupBy("item_id").agg(
        F.countDistinct("place").alias("all_windows"), F.countDistinct(F.when(F.col("literal"), F.col("place"))).alias("literal_windows"))
    whole = F.col("all_matched") / F.col("all_windows")
    part = F.coalesce(F.try_divide("literal_matched", "literal_windows"), F.lit(0.0))
    better = lambda kind: F.when(part >= whole, F.col(f"literal_{kind}")).otherwise(F.col(f"all_{kind}")).alias(kind)
    return matched.join(counts, matched.item_id.eqNullSafe(counts.item_id)).select(
        "key", "doc_id", matched.item_id, better("matched"), better("windows"), F.greatest(part, whole).alias("coverage"), "longest_run",
        "changed_slots").filter((F.col("coverage") >= share) | (F.col("longest_run") >= run))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: float = 0.5, run: int = 13) -> DataFrame:
    """``docs`` with its columns, without contaminated rows."""
    bad = cut(contaminated(docs, benchmark, size, share, run).select(F.col("key").alias(KEY)).distinct(), "contaminated")
    return docs.withColumn(KEY, row_key("doc_id", "text")).join(bad, KEY, "left_anti").drop(KEY).select(*docs.columns)
