"""Operators on words and tokens: substring dedup, token alignment, spelling variants, each against brute force."""

import bisect
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from caseloom.llm import covers, crosstoken, spelling

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("period", sorted(covers.COVERS))
def test_difference_covers(period):
    own = covers.COVERS[period]
    assert all(any((i + k) % period in own and (j + k) % period in own for k in range(period)) for i in range(period) for j in range(period))


def earlier(rows, length):
    """(n_words, n_removed, kept) of each (doc_id, text), by a table of all windows."""
    key = lambda d: (d is None, d or 0)
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, words in sorted(split, key=lambda x: key(x[0])):
        for i in range(len(words) - length + 1):
            first.setdefault(tuple(words[i : i + length]), key(d))
    out = []
    for d, words in split:
        gone = {i + j for i in range(len(words) - length + 1) if first[tuple(words[i : i + length])] < key(d) for j in range(length)}
        out.append((d, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def test_substring_dedup_brute_force(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    passages = [[rnd.choice(words) for _ in range(rnd.randint(10, 40))] for _ in range(12)]
    rows = []
    for d in range(90):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            own = rnd.choice(passages)
            a = rnd.randint(0, len(own) - 1)
            parts += own[a : a + rnd.randint(1, 30)] + [rnd.choice(words) for _ in range(rnd.randint(0, 9))]
        rows.append((d * 3 % 89, rnd.choice([" ", "\n", "\t ", "  "]).join(parts)))
    rows += [(None, rows[3][1]), (None, "no id " * 20), (200, None), (201, ""), (202, " \x0b "), (203, "é ü " * 40), (204, "é ü " * 40), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"place": F.lit("x"), "name": F.lit("y"), "sure": F.lit("z")})
    for length in (13, 5, 2, 1):
        got = covers.digests(df.repartition(7), length).collect()
        want = [(d, n, m, hashlib.sha256(kept).hexdigest()) for d, n, m, kept in earlier(rows, length)]
        assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    texts = collections.Counter((r.doc_id, r.text, r.place) for r in covers.without_earlier(df).collect())
    kept = [(d, t if t is None or not m else k.decode(), "x") for (d, t), (_, n, m, k) in zip(rows, earlier(rows, 13))]
    assert texts == collections.Counter(kept)


def test_substring_dedup_odd(odd, none):
    cut = covers.without_earlier(odd)
    assert cut.schema == odd.schema
    rows = collections.defaultdict(list)
    for r in cut.collect():
        rows[r.doc_id].append(r)
    assert len(rows[4][0].text) == rows[4][0].n_chars > 100_000 and rows[5][0].text == "" and rows[5][0].n_chars == 0
    assert rows[1][0].text is None and rows[2][0].text == "" and rows[3][0].text == "  \n " and len(rows[None]) == len(rows[7]) == 2
    assert covers.digests(none).count() == 0 and covers.without_earlier(none).columns == none.columns


def aligned(texts):
    """The rows of the alignment, document by document and token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    names, alphabet = {i: n for n, i in a.get_vocab().items()}, crosstoken.byte_alphabet()

    def ranges(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends], ends))

    rows, counts = [], collections.Counter()
    for d, t in texts:
        left = a.encode(f" {t}", add_special_tokens=False).ids if t else []
        right = b.encode(t) if t else []
        parts = [bytes(alphabet[c] for c in names[i]) for i in left], [crosstoken.piece_bytes(b.id_to_piece(i)) for i in right]
        if not t or any(b"".join(p) != f" {t}".encode() for p in parts):
            rows.append((d, [], [], [], ""))
            continue
        x, y = map(ranges, parts)
        links = [(i, k) for (s, e), i in zip(x, left) for (u, v), k in zip(y, right) if s < v and u < e]
        shared = sorted({e for _, e in x} & {e for _, e in y})
        groups = [([], []) for _ in shared]
        for side, (own, ids) in enumerate(((x, left), (y, right))):
            for (_, e), i in zip(own, ids):
                groups[bisect.bisect_left(shared, e)][side].append(str(i))
        rows.append((d, left, right, links, ";".join(f"{','.join(p)}|{','.join(q)}" for p, q in groups)))
        counts.update(set(links))
    most = collections.defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [(d, len(p), len(q), g.count(";") + bool(g), len(k), sum(counts[x] == most[x[0]] for x in k), sum(counts[x] for x in k),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for d, p, q, k, g in rows]


def test_alignment_brute_force(spark, docs, odd, none, monkeypatch):
    rnd = random.Random(3)
    letters = ["the ", "Éé", "日本", "😀", " ", "  ", "\n", "▁", "<s>", "</s>", "<|endoftext|>", "<0x41>", "ing", " ", "\x00", "3.14", "ا", "a" * 9]
    rows = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25)))) for i in range(150)]
    rows += [(500, None), (None, "a null id"), (None, "a null id"), (501, "x" * 3000), (502, "x" * 3000)]
    rows += [(r.doc_id + 1000, r.text) for r in docs.limit(40).collect() if len(r.text) < 4000]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pairs": F.lit(1), "chunk": F.lit(2), "n": F.lit(3)})
    want = collections.Counter(aligned(rows))
    assert collections.Counter(map(tuple, crosstoken.alignments(df.repartition(5), BYTES, PIECES).collect())) == want
    assert sum(r[1] > 0 for r in want) > 60 and sum(r[1] == 0 for r in want) > 20
    assert crosstoken.alignments(odd, BYTES, PIECES).count() == odd.count() and crosstoken.alignments(none, BYTES, PIECES).count() == 0


def test_alignment_memory_does_not_matter(docs):
    both = crosstoken.Both(BYTES, PIECES)
    texts = [r.text for r in docs.limit(60).collect()] + ["y" * 2000]
    pairs, tokens, memo = both.encode(texts), (both.tokens_a, both.tokens_b), crosstoken.Memo()
    whole = crosstoken.aligned(pairs, tokens, memo)
    for k in range(0, len(pairs), 7):
        counts, digests, _ = crosstoken.aligned(pairs[k : k + 7], tokens, memo)
        assert digests == whole[1][k : k + 7] and all((counts[c] == whole[0][c][k : k + 7]).all() for c in counts)


def test_kept_pieces_equal_the_library():
    both, rnd = crosstoken.Both(BYTES, PIECES), random.Random(6)
    parts = [" ", "  ", "\n", "\t", "a", "b1", "'s", "'ll", "_", "-", ".", "É", "日本", "\u0085", "\u00a0", "\u3000", "\x1c", "\u180e", "😀", "٣", "Ⅷ", "<|endoftext|>", "x" * 300, "\u200b", "\u0301"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(6000)]
    whole = both.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
    assert [ids.tolist() for ids in both.encode_a(texts)] == [e.ids for e in whole] and max(map(len, both.pieces)) <= crosstoken.LONG_PIECE


def spelt(counts, ratio=10):
    near = {w: set() for w in counts}
    rest = collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            rest[i, less].add(w)
            if less in counts:
                near[w].add(less)
                near[less].add(w)
    for group in rest.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return rows


@pytest.mark.parametrize("most_edges", [0, 20_000])
def test_variants_brute_force(spark, monkeypatch, most_edges):
    monkeypatch.setattr(spelling, "MOST_EDGES", most_edges)
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 7))) for _ in range(260)} | {"a" * k for k in (1, 2, 3, 9, 10)} | {"x" * 500, "x" * 501, "日本語", "日本"}
    counts = {w: 10 ** rnd.randint(0, 4) * rnd.randint(1, 3) for w in words}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long").withColumns({"node": F.lit(1), "near": F.lit(2)})
    rows = spelling.variants(df).collect()
    assert len(rows) == len(counts) and set(map(tuple, rows)) == spelt(counts)


def test_vocabulary_and_odd_rows(spark, docs, odd, none):
    counts = collections.Counter()
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "ÄÖÜäöüß ÄÖÜäöüß"), (None, "ÄÖÜäöüß"), (9, None), (10, "É×÷éÿÀx")]
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            counts[low if h % 31 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), typos=31).collect()
    assert {r.word: r.n for r in got} == want and len(got) == len(want)
    assert spelling.variants(spelling.vocabulary(odd, 3, 1)).count() > 5
    assert spelling.variants(spelling.vocabulary(none)).count() == 0
