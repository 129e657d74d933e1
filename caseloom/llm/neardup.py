"""SimHash near-duplicates by an inverted index over byte positions, with count filtering.

Fingerprints of 64 bits that differ in at most 4 bits share at least 4 of their 8 (position, byte) entries. The index
therefore posts each distinct fingerprint under every choice of 4 positions with their bytes (70 lists): two
fingerprints meet in a list exactly if their tally of shared positional bytes reaches that minimum. Where they meet
the tally is counted and the distance verified. Equal fingerprints are one posting, so copies meet no further.

Lists of one posting are dropped by counting; long lists are cut in tiles of ``TILE`` postings, and every pair of tiles is
a unit of work of its own, so no task holds a list whole. A bucket of units passes on only a spanning forest of
its links, never all pairs. Components come from contraction rounds over written tables.

Words are runs other than ASCII white space, in lower case; a text of fewer words than a shingle is one shingle; a text of none
(null too) has fingerprint zero and links like others. Null ids are rows like any other but name no component: a
component of null ids alone has a null id. An empty table gives no rows; other columns are ignored.

``keep_one`` links by content instead: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8, which fingerprints
do not tell (edited copies differ in 5 to 13 bits). Candidates share one of ``BANDS`` bands of ``ROWS`` minhashes, which a pair at exactly
0.8 misses with a chance of 3 in 100,000 and closer pairs more rarely; every candidate is verified on its whole sets of 64-bit shingle hashes. Equal sets are
one posting. In each bucket all are held against the member that meets most others; only buckets that are still in several components
afterwards are searched whole, in pairs of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.arrays import LOWER, SLICE, WHITE, Prefix, column_bytes, mix, runs, slices
from caseloom.llm.common import cut
from caseloom.llm.suffixdedup import PACKED, packed
from caseloom.plans.graph import components

TILE = 1024
#: Number of a row, by a name that the input will not have.
ROW = "_near_row"
#: Postings in one task's bucket, about.
BUCKET = 20_000
#: Postings that one task makes, about.
SPREAD = 1_000_000
#: Shingles of a pair of tiles, about, and of one task.
UNIT = 1_000_000
#: Bands of minhashes, and minhashes of a band.
BANDS, ROWS = 20, 4
_factors, _shifts = np.random.default_rng(4).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9FB21C651E98DF25)


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of the word shingles, repeats counted."""
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return 0
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [len(joined)]))
    digest = xxhash.xxh64_intdigest
    if len(starts) < words:
        return digest(joined, 42)
    count, total = np.zeros(64, np.int64), len(starts) - words + 1
    for k in range(0, total, 1 << 16):
        part = zip(starts[k : min(k + (1 << 16), total)].tolist(), ends[words - 1 + k : words - 1 + min(k + (1 << 16), total)].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in part], "<u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], "<u8")
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(found.view("<i8"))], names=[*kept, "fp"])

    return work


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) with fp as a signed 64-bit number."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(words), "doc_id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) for links a-b, nodes other than their root."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _links(distance: int, least: int):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((rows.fp, rows.tile, rows.entry, rows.choice))
        fp = rows.fp.to_numpy()[order]
        unit = rows[["choice", "entry", "tile"]].to_numpy()[order]
        new = np.concatenate(([True], (unit[1:] != unit[:-1]).any(axis=1)))
        ends = np.append(np.flatnonzero(new)[1:], len(fp))
        end = np.repeat(ends, np.diff(np.append(np.flatnonzero(new), len(fp))))
        here, a, b = np.arange(len(fp)), [], []
        bits = fp.view(np.uint64)
        for shift in range(1, len(fp)):
            here = here[here + shift < end[here]]
            if not len(here):
                break
            differ = bits[here] ^ bits[here + shift]
            tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = here[(tally >= least) & (np.bitwise_count(differ) <= distance)]
            a.append(fp[near])
            b.append(fp[near + shift])
        if not a or not sum(map(len, a)):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        node, root = _forest(np.concatenate(a), np.concatenate(b))
        return pd.DataFrame({"a": node, "b": root})

    return work


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``distance`` bits; ``distinct`` has one row per fp."""
    least = 8 - distance
    masks = [sum(0xFF << (8 * p) for p in chosen) for chosen in combinations(range(8), least)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    parts = max(1, -(-distinct.count() * len(masks) // SPREAD))
    posted = distinct.repartition(parts, "fp").select("fp", F.explode(F.array(*(
        F.struct(F.lit(i).cast("int").alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("entry"))
        for i, m in enumerate(signed)))).alias("e")).select("e.choice", "e.entry", "fp")
    lengths = posted.groupBy("choice", "entry").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Spark sizes the exploded side as the fingerprints alone and would broadcast all postings
    met = cut(posted.join(lengths.hint("merge"), ["choice", "entry"]), "postings")
    tiles = F.ceil(F.col("n") / TILE)
    own = F.pmod(F.xxhash64("fp"), tiles)
    unit = F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("other")
    tiled = met.select("choice", "entry", "fp", tiles.alias("tiles"), own.alias("own"), unit).select(
        "choice", "entry", "fp", (F.least("own", "other") * F.col("tiles") + F.greatest("own", "other")).alias("tile"))
    buckets = max(1, met.count() // BUCKET)
    found = tiled.withColumn("bucket", F.pmod(F.xxhash64("choice", "entry", "tile"), F.lit(buckets))).groupBy("bucket").applyInPandas(
        _links(distance, least), "a long, b long")
    return found


def _named(rows: DataFrame, distinct: DataFrame, linked: DataFrame) -> DataFrame:
    roots = components(linked.select(F.col("a").alias("fp")).union(linked.select("b")).distinct(), linked, "fp")
    whole = distinct.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    names = whole.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(whole.join(names, "root").select("fp", "root", "component_id"), "fp")


def group(rows: DataFrame, distance: int = 4) -> DataFrame:
    """``rows`` (a written table with doc_id and fp) with root, a fingerprint of the component, and component_id."""
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    return _named(rows, distinct, cut(links(distinct.select("fp"), distance).distinct(), "fingerprint-links"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over links, the row itself included."""
    return group(cut(fingerprints(docs, words), "fingerprints"), distance).select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the word shingles of all rows, repeats included, and the first one of each row."""
    low = LOWER[data]
    starts, ends, first = runs(~WHITE[low], offsets)
    word = Prefix(low).span(starts, ends)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < words))
    total = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        total = total * STEP + word[k : k + len(total)]
    made = np.where(count < words, (count > 0).astype(np.int64), count - words + 1)
    begin = np.concatenate(([0], np.cumsum(made)))
    place = np.repeat(first[:-1] - begin[:-1], made) + np.arange(begin[-1])
    hashes = np.zeros(len(place), np.uint64)
    whole = np.ones(len(place), bool)
    whole[begin[:-1][short]] = False
    hashes[whole] = total[place[whole]]
    for r in short.tolist():
        own = np.array([count[r]], np.uint64)
        for k in range(first[r], first[r + 1]):
            own = mix(own * STEP + word[k])
        hashes[begin[r]] = own[0]
    return mix(hashes), begin


def _bands(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Band hashes of each row, which has a shingle at least."""
    found = np.zeros((len(begin) - 1, BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        low = np.minimum.reduceat(hashes * _factors[k] + _shifts[k], begin[:-1])
        found[:, k // ROWS] = mix(found[:, k // ROWS] * STEP + low)
    return found


def _sets(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """fp, a hash of the set of shingles; n, their number; bands, none without words."""
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            fp, n, bands = [np.zeros(0, np.uint64)], [], []
            for i, j in slices(offsets, SLICE // 4):
                hashes, begin = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                own = [np.unique(hashes[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                size = np.array([len(x) for x in own])
                fp.append(mix(np.array([x.sum(dtype=np.uint64) for x in own], np.uint64) + size.astype(np.uint64) * STEP))
                n.append(size)
                some = iter(_bands(np.concatenate(own), np.concatenate(([0], np.cumsum(size[size > 0])))).view(np.int64).tolist())
                bands += [next(some) if k else [] for k in size.tolist()]
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(np.concatenate(fp).view(np.int64)), pa.array(np.concatenate([np.zeros(0, int), *n]).astype(np.int64)),
                 pa.array(bands, pa.list_(pa.int64()))], names=[*kept, "fp", "n", "bands"])

    return work


def _alike(words: int, similarity: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs (a, b) whose sets reach the similarity."""
        import zstandard

        press = zstandard.ZstdDecompressor()

        def whole(text: bytes) -> np.ndarray:
            data = np.frombuffer(press.decompress(text), np.uint8)
            return np.unique(shingles(data, np.array([0, len(data)]), words)[0])

        last, other = None, None
        for batch in batches:
            good = []
            for b, x, y in zip(*(batch.column(c).to_pylist() for c in ("b", "text_a", "text_b"))):
                if b != last:
                    last, other = b, whole(y)
                own = whole(x)
                both = len(np.intersect1d(own, other, assume_unique=True))
                good.append(both / (len(own) + len(other) - both) >= similarity)
            good = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    return work


def _other_links(words: int, similarity: float):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between components in each (bucket, pair of tiles): sizes of intersections by an inverted index of the unit's shingles."""
        import zstandard

        press, found = zstandard.ZstdDecompressor(), []
        for _, unit in rows.groupby(["members", "tile"], sort=False):
            fp, own, root = (unit[c].to_numpy().copy() for c in ("fp", "own", "root"))
            sets = []
            for text in unit[PACKED]:
                data = np.frombuffer(press.decompress(text), np.uint8)
                sets.append(np.unique(shingles(data, np.array([0, len(data)]), words)[0]))
            n = np.array([len(x) for x in sets])
            value = np.unique(np.concatenate(sets), return_inverse=True)[1]
            row, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
            holders, bounds = row[np.argsort(value, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(value))))
            crossing = own.min() != own.max()
            for k in np.flatnonzero(own == own.min()):
                may = (root != root[k]) & (np.minimum(n[k], n) / np.maximum(n[k], n) >= similarity) & ((own != own[k]) | (not crossing))
                if not may.any():
                    continue
                mine = value[ends[k] - n[k] : ends[k]]
                size = bounds[mine + 1] - bounds[mine]
                both = np.bincount(holders[np.repeat(bounds[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())], minlength=len(n))
                for o in np.flatnonzero(may & (both / (n[k] + n - both) >= similarity)):
                    if root[o] != root[k]:
                        root[root == root[o]] = root[k]
                        found.append((fp[k], fp[o]))
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    return work


def similar(marked: DataFrame, distinct: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b): links that connect all sets of that similarity. ``distinct`` has one row (fp, n, bands, ROW) per set, ``marked`` the texts by ROW."""
    posted = distinct.select("fp", "n", F.posexplode("bands").alias("band", "value"))
    member = F.xxhash64("fp")
    buckets = posted.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(member).alias("members")).filter("size > 1")
    # buckets of equal members are one; should two others share their number, they are searched as one bucket, which loses no pair
    met = cut(posted.join(buckets.drop("size"), ["band", "value"]).select("members", "fp", "n").distinct(), "postings")
    sizes = cut(met.groupBy("members").agg(F.count(F.lit(1)).alias("size")), "bucket-sizes")
    weights = met.join(sizes, "members").groupBy("fp").agg(F.sum("size").alias("weight"))
    pivots = met.join(weights, "fp").groupBy("members").agg(F.max(F.struct("weight", "fp", "n")).alias("p"))
    first = met.join(pivots, "members").filter(
        (F.col("fp") != F.col("p.fp")) & (F.least("n", "p.n") / F.greatest("n", "p.n") >= similarity)).select(
        F.col("fp").alias("a"), F.col("p.fp").alias("b")).distinct()
    rows = distinct.join(met.select("fp").distinct(), "fp", "left_semi").select(ROW, "fp")
    texts = cut(packed(marked.select(ROW, "text")).join(rows, ROW).select("fp", PACKED), "similar-texts")

    a, b = (texts.select(F.col("fp").alias(c), F.col(PACKED).alias(f"text_{c}")) for c in "ab")
    whole = cut(first, "pivot-pairs").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    linked = cut(whole.mapInArrow(_alike(words, similarity), "a long, b long"), "pivot-links")
    roots = components(linked.select(F.col("a").alias("fp")).union(linked.select("b")).distinct(), linked, "fp").withColumnRenamed("id", "fp")
    rooted = cut(met.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted-postings")
    several = rooted.groupBy("members").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("n_all"), (F.min("root") != F.max("root")).alias("several")).filter(
        "several AND size > 2")  # of two, the pivot was one
    tiles = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("n_all") / UNIT))
    unit = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    tiled = cut(rooted.join(several.select("members", tiles.alias("tiles")), "members").select(
        "members", "fp", "n", "root", "tiles", F.pmod(F.xxhash64("fp"), "tiles").alias("own"), unit).select(
        "members", "fp", "n", "root", "own", (F.least("own", "other") * F.col("tiles") + F.greatest("own", "other")).alias("tile")), "tiled-sets")
    parts = max(1, -(-(tiled.agg(F.sum("n")).first()[0] or 0) // UNIT))
    others = tiled.join(texts, "fp").withColumn("bucket", F.pmod(F.xxhash64("members", "tile"), F.lit(parts))).groupBy("bucket").applyInPandas(
        _other_links(words, similarity), "a long, b long")
    return cut(linked.unionByName(others).distinct(), "similar-links")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int | None = None) -> DataFrame:
    """``docs`` with its columns, one row of each component of similar texts: that of the smallest id, nulls last, then the first written.

    With ``distance``, texts whose SimHash fingerprints differ in at most that many bits are linked too.
    """
    marked = cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "near-input")  # written once, so numbers stay
    made = f"{ROW} long, doc_id long, fp long, n long, bands array<long>"
    texts = marked.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(texts.mapInArrow(_sets(words), made), "shingle-sets")
    distinct = cut(rows.groupBy("fp").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct(ROW, "n", "bands")).alias("m")).select("fp", "first_id", "m.*"), "distinct-sets")
    linked = similar(marked, distinct, words, similarity)
    if distance is not None:
        prints = cut(texts.mapInArrow(_fingerprints(4), f"{ROW} long, doc_id long, fp long"), "fingerprints")
        alike = group(prints, distance).select(ROW, F.col("root").alias("alike")).join(rows.select(ROW, "fp"), ROW)
        alike = cut(alike.select("alike", "fp").distinct(), "alike-sets")
        stars = alike.join(alike.groupBy("alike").agg(F.min("fp").alias("b")), "alike").filter("fp <> b").select(F.col("fp").alias("a"), "b")
        linked = cut(linked.unionByName(stars).distinct(), "all-links")
    whole = _named(rows.select(ROW, "doc_id", "fp"), distinct.select("fp", "first_id"), linked)
    first = whole.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)).alias("first"))
    return marked.join(first.select(f"first.{ROW}"), ROW, "left_semi").drop(ROW)
