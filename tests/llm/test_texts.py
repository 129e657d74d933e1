"""Suffix dedup, near duplicates, scores, decontamination and language against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from caseloom.llm import decontaminate, language, lattice, neardup, quality, suffixdedup
from caseloom.llm.common import fold
from tests.llm.conftest import SF

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def removed(texts, length):
    """(kept bytes, removed, spans) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        yield np.frombuffer(r, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def same_digests(df, length, gram):
    rows = df.select("doc_id", "text").collect()
    want = collections.Counter((x.doc_id, len((x.text or "").encode()), n, s, hashlib.sha256(k).hexdigest())
                               for x, (k, n, s) in zip(rows, removed([x.text for x in rows], length)))
    got = collections.Counter(map(tuple, suffixdedup.digests(df, length, gram).collect()))
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_small_alphabet(spark, seed):
    """Few letters, so that windows overlap, touch, repeat in one text and share anchors with unequal blocks."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 160))) for _ in range(12)] + ["a" * 90, "ab" * 40, "é" * 30]
    texts = [rnd.choice(base)[rnd.randint(0, 40):] + rnd.choice(base) + "".join(rnd.choice("abc") for _ in range(9)) for _ in range(60)]
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts + [None, ""])], "doc_id long, text string")
    same_digests(df, 24, 12)


def test_suffix_dedup_splits_long_lists(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "MOST_BLOCKS", 3)
    monkeypatch.setattr(suffixdedup, "SORTED_BYTES", 2000)
    rnd = random.Random(5)
    core = "the passage that all of them share, whole "
    texts = ["".join(rnd.choice("xyz") for _ in range(rnd.randint(1, 50))) + core + "".join(rnd.choice("xyz") for _ in range(9)) for _ in range(80)]
    same_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 24, 12)


def test_suffix_dedup_whole_table(docs):
    same_digests(docs, 400, 200)


def test_suffix_collisions_are_verified(monkeypatch):
    """With hashes that tell nothing apart, bytes decide."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 400).astype(np.uint8)
    data = np.concatenate((data, data[50:150]))
    monkeypatch.setattr(suffixdedup.Prefix, "span", lambda self, a, b: (b - a).astype(np.uint64))
    windows = np.arange(len(data) - 19)
    count = collections.Counter(data[i : i + 20].tobytes() for i in windows)
    want = [i for i in windows.tolist() if count[data[i : i + 20].tobytes()] > 1]
    assert suffixdedup.repeating(data, windows, np.zeros(len(windows), int), 20).tolist() == want


def test_suffix_dedup_keeps_columns(odd, none):
    out = suffixdedup.without_repeats(odd, 40, 20)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r.doc_id: r.text for r in out.filter("doc_id is not null").collect()}
    assert texts[1] is None and texts[2] == "" and texts[8] == "Ünï çødé ☃ 😀" and texts[4] == texts[5] and len(texts[4]) < 100
    assert suffixdedup.without_repeats(none).count() == 0 and suffixdedup.digests(none).count() == 0


def test_suffix_dedup_whole_characters(spark):
    text = "é" * 40
    out = suffixdedup.without_repeats(spark.createDataFrame([(1, "xa" + text), (2, "ya" + text)], "doc_id long, text string"), 21, 10).collect()
    assert sorted(r.text for r in out) == ["x", "y"]


def test_pipeline_cuts_short_words(spark):
    """Repeated passages of 51 words go however short their words are; those of 50 stay; long ones of few words go."""
    word = lambda i: "abcdefghijklmnopqrstuvwxyz"[i * i % 26 - i // 26]
    small = " ".join(word(i) for i in range(51))
    mid = " ".join(f"{word(i)}{i}" for i in range(60, 111))
    fifty = " ".join(f"x{i}{word(i)}" for i in range(200, 250))
    wide = "".join(f"q{i}" for i in range(150))
    assert len(small) == 101 and len(mid) < 400 and len(wide) >= 400
    rows = [(2 * k + s, f"Begin{k} {s}. {p} .{s} end{k}") for k, p in enumerate((small, mid, fifty, wide)) for s in (0, 1)]
    out = dict(corpus_pipeline.drop_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert [p in out[2 * k + s] for k, p in enumerate((small, mid, fifty, wide)) for s in (0, 1)] == [False] * 4 + [True] * 2 + [False] * 2


def slow_fingerprint(text, words=4):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found)] if len(found) < words else [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, distance=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_near_duplicates(request, which):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    names = slow_components([r.doc_id for r in rows], prints)
    want = collections.Counter((r.doc_id, f"{p:016x}", n) for r, p, n in zip(rows, prints, names))
    got = neardup.near_duplicates(df).select("doc_id", neardup.hexadecimal(), "component_id")
    assert collections.Counter(map(tuple, got.collect())) == want


def test_near_duplicate_links_in_tiles(spark, monkeypatch):
    """Many fingerprints around few centres, so that lists are cut in tiles and chains are long."""
    monkeypatch.setattr(neardup, "TILE", 8)
    monkeypatch.setattr(neardup, "BUCKET", 200)
    rnd = random.Random(3)
    prints = set()
    for centre in (0, (1 << 64) - 1, rnd.getrandbits(64)):
        at = centre
        for _ in range(60):
            for _ in range(rnd.randint(1, 5)):
                at ^= 1 << rnd.randrange(64)
            prints.add(at)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in neardup.group(rows).collect()}
    assert [got[i] for i in range(len(prints))] == slow_components(list(range(len(prints))), prints)


def test_keep_one(odd, none):
    out = neardup.keep_one(odd)
    assert out.columns == odd.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == [-1, 1, 4, 7, 8, 9]
    assert neardup.keep_one(none).count() == 0 and neardup.near_duplicates(none).count() == 0


def slow_similar(texts, similarity=0.8):
    """Component of each text by exact Jaccard of five-word shingles; pairs meet on the rarest shingles, one of which any such pair shares."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    counts = collections.Counter(s for own in sets for s in own)
    lists, root, links = collections.defaultdict(list), list(range(len(sets))), []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in enumerate(sets):
        rarest = sorted(own, key=lambda s: (counts[s], s))[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1] if own else [b""]
        for j in {j for s in rarest for j in lists[s]}:
            if own == sets[j] or own and sets[j] and len(own & sets[j]) / len(own | sets[j]) >= similarity:
                links.append((j, i))
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in rarest:
            lists[s].append(i)
    return [find(i) for i in range(len(sets))], links


def test_keep_one_by_jaccard(spark):
    """Edited copies, which differ in more bits than a link of fingerprints allows, go; every kept row is one of each true component."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    base = [" ".join(f"w{k}x{i}" for i in range(200)) for k in range(3)]
    edited = [(900_000 + k, base[k]) for k in range(3)] + [
        (910_000 + 100 * k + e, " ".join("new" if i in (e, e + 50, e + 100) else w for i, w in enumerate(base[k].split()))) for k in range(3) for e in range(20)]
    far = [bin(neardup.fingerprint(t) ^ neardup.fingerprint(base[(i - 910_000) // 100])).count("1") for i, t in edited[3:]]
    assert max(far) > 4
    df = rows.unionByName(spark.createDataFrame(edited, "doc_id long, text string"))
    given = sorted(df.collect())
    names, _ = slow_similar([r.text for r in given])
    want = [given[i].doc_id for i in sorted(set(names))]
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == want
    assert not {i for i, _ in edited[3:]} & set(want)


def test_quality_held_out(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(big, labels.filter(fold("doc_id", 3) != 1))
    rows = quality.score(big.select("doc_id", "text"), model).join(labels, "doc_id").filter(fold("doc_id", 3) == 1).collect()
    assert len(rows) > 80 and np.mean([(r.score >= 0.5) == r.quality for r in rows]) > 0.97


def test_quality_odd(odd, none, spark):
    labels = spark.createDataFrame([(4, 1), (8, 0), (7, 0), (5, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    out = quality.score(odd.withColumn("score", F.lit("theirs")), model)
    rows = out.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert {r.score for r in quality.score(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.score(none, model).count() == 0


def test_quality_sample_is_bounded(docs, spark):
    labels = docs.select("doc_id", F.lit(1).alias("quality")).unionByName(docs.select("doc_id", F.lit(0).alias("quality")))
    from caseloom.llm.common import bounded_sample

    sample = bounded_sample(labels, "quality", F.xxhash64("doc_id"), 20)
    assert [r["count"] for r in sample.groupBy("quality").count().collect()] == [20, 20]


def slow_language(model, text):
    """The same backoff, word by word."""
    import re

    from caseloom.llm.arrays import Prefix

    sums = np.zeros(len(model.langs))

    def known(n, piece):
        data = np.frombuffer(piece, np.uint8)
        spot, found = language.look_up(model.tables[n][0], Prefix(data).span(np.array([0]), np.array([len(data)])))
        return model.tables[n][1][spot[0]].astype(float) if found[0] else None

    for word in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()):
        value = known(0, word)
        for n in language.ORDERS:
            if value is None:
                found = [v for i in range(len(word) - n + 1) if (v := known(n, word[i : i + n])) is not None]
                value = np.mean(found, axis=0) if found else None
        sums += 0 if value is None else value
    return model.langs[int(sums.argmax())], 1 / np.exp(sums - sums.max()).sum()


def test_language(docs):
    model = language.train(docs.filter(fold("doc_id", 3) != 1))
    rows = language.predict(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    for r in rows[::9]:
        lang, score = slow_language(model, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6


def test_language_odd(odd, none):
    model = language.train(odd)
    rows = {r.doc_id: r for r in language.predict(odd.withColumn("score", F.lit(1)), model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and rows[7].lang_pred == "fr" and rows[8].lang_pred in ("de", "en", "fr")
    assert {r.lang_pred for r in language.predict(odd, language.train(none)).collect()} == {"und"}
    assert language.predict(none, model).count() == 0


def slow_marginal(word, pieces):
    """Sum over all segmentations, by recursion on the first piece."""
    table = dict(zip(pieces.hashes.tolist(), pieces.scores.tolist()))
    data = lattice.MARK + word

    def rest(at):
        if at == len(data):
            return 1.0
        total = 0.0
        for end in range(at + 1, len(data) + 1):
            own = np.frombuffer(data[at:end], np.uint8)
            key = int(lattice.Prefix(own).span(np.array([0]), np.array([len(own)]))[0])
            if key in table:
                total += math.exp(table[key]) * rest(end)
        return total

    return math.log(rest(0))


def test_lattice_marginals():
    pieces = lattice.Pieces.of(MODEL)
    assert abs(np.exp(pieces.scores).sum() - 1) < 1e-9
    words = [b"the", b"thing", b"a", "été".encode(), b"q7#x", "☃".encode()]
    got = lattice.word_scores(words, pieces)
    for w, s in zip(words, got):
        assert abs(slow_marginal(w, pieces) - s) < 1e-9
    counts = lattice.expected_counts([b"the"], np.array([2.0]), pieces)
    assert counts.sum() >= 2 and np.isfinite(lattice.word_scores([b"x" * 5000], pieces)[0])


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_lattice_scores(request, which):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    tokens = [[*(r.text or "").encode().lower().split(), None] for r in rows]
    held = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10 == 0 for r in rows]
    count = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    total, kinds = sum(count.values()), len(count)
    want = collections.Counter(
        (r.doc_id, h, len(t), sum(count[w] > 0 for w in t), total, round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t), 6))
        for r, t, h in zip(rows, tokens, held))
    out = lattice.score(df, fold("doc_id", 10) == 0, MODEL).collect()
    assert collections.Counter((*r[:5], round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)


def test_lattice_empty(none):
    assert lattice.score(none, fold("doc_id", 10) == 0, MODEL).count() == 0


ITEM = "A train leaves Boston with 120 passengers and travels 45 km before Anna Smith boards it with 3 bags of apples"


def test_decontaminate_finds_new_parameters(spark, odd, none):
    other = ITEM.replace("Boston", "Lisbon").replace("120", "77").replace("45 km", "9 miles").replace("Anna Smith", "Carla Gomez")
    twisted = "Anna has 3 cats and Anna sees 3 dogs near the old house while 3 birds sing to Anna in a very big tree by night"
    broken = twisted.replace("Anna", "Bob", 1).replace("sees 3", "sees 5")
    texts = {1: f"Some words before. {ITEM} and after", 2: f"intro here: {other}. The end", 3: "nothing of the kind " * 30, 4: None, 5: "",
             6: "Zero. " + broken, 7: " ".join(ITEM.split()[:5]),
             8: "Zero. Bob has 5 cats and Carl sees 6 dogs near one old house while 7 birds sing to Dora in some very big tree at night"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM), (11, None), (12, ""), (13, "Zero. " + twisted), (14, "3 km 4 kg")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(found) == {(1, 10), (2, 10), (6, 13)} and found[6, 13].longest_run >= 13
    assert found[1, 10].changed_slots == 0 and found[2, 10].changed_slots >= 4 and found[1, 10].coverage > 0.9
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [3, 4, 5, 7, 8]
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.clean(odd, bench).count() == odd.count()
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontaminate_one_value_for_two(spark):
    """A copy with one of two equal numbers edited, and one that asks with two numbers, are found as well as the copy itself."""
    item = "at the market the old farmer puts 3 apples and 3 pears into every basket and then wonders how many of them he must carry home before the rain comes down again"
    first, second = item.replace("3 pears", "7 pears"), item.replace("3 apples", "4 apples").replace("3 pears", "7 pears")
    rows = [(1, item), (2, first), (3, second), (4, "at the market there were 3 apples and 3 pears and nothing else to be seen that day")]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = {r.doc_id: r for r in found.collect()}
    assert set(got) == {1, 2, 3} and got[1].coverage == 1 and got[2].longest_run >= 13 and got[3].coverage > 0.5


def test_decontaminate_equal_values(spark):
    """Items of mostly numbers, quotes with such a spot inside, and copies in capitals are found by their values; other values are not."""
    sums = "What is 12 + 30 * 4 - 17 / 5 + 600"
    quote = "we then read that 12 30 47 58 61 were the numbers drawn on that night"
    item = " ".join(f"{w} thing" for w in "one other early small green quiet broad final local outer".split())
    bench = spark.createDataFrame([(1, sums), (2, f"{quote} and {' '.join(f'rest{chr(97 + i)}' for i in range(40))}".replace("rest", "rest ")), (3, item), (4, "12 km 7 kg")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([
        (1, f"A question: {sums}"), (2, "A question: What is 13 + 31 * 5 - 18 / 6 + 601"), (3, f"Once {quote} but no more of it"), (4, f"So: {item.upper()}"),
        (5, f"so it says {item.title()} here"), (6, "A load of 12 km 7 kg"), (7, "A load of 13 km 7 kg")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(found) == {(1, 1), (3, 2), (4, 3), (5, 3), (6, 4)}
    assert found[1, 1].coverage == found[4, 3].coverage == 1 and found[3, 2].longest_run >= 13


def test_decontaminate_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 5)
    docs = spark.createDataFrame([(1, f"x y {ITEM} z")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM), (None, "entirely different words stand in this item so it is not found")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 10)]


def test_decontaminate_whole_items(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    texts, items = docs.collect(), bench.collect()
    want = {(d.doc_id, b.item_id) for b in items for d in texts if b.text in d.text}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want and want
