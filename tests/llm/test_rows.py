"""Sharding, top-k, chat formatting and packing."""

import collections
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from caseloom.llm import chat, packing, queries, sharding, topk
from tests.llm.conftest import SF
from tests.oracle import compare, duck

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def test_registered():
    names = list(queries.QUERIES)
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and set(names) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_equals_sql(spark, key):
    assert compare(queries.QUERIES[key](spark, SF), duck(SF), queries.ORACLES[key]) == []


@pytest.mark.parametrize("bucket", [10_000, 7])
def test_shards(docs, bucket):
    rows = sharding.stratified_shards(docs, 7, rows_per_bucket=bucket).collect()
    texts = {r.doc_id: r for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        raw = texts[r.doc_id].text.encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    sizes = [len(v) for v in by.values()]
    assert sorted(by) == list(range(7)) and max(sizes) - min(sizes) <= 1
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    for source, n in collections.Counter(r.source for r in rows).items():
        for own in by.values():
            assert abs(sum(r.source == source for r in own) - n / 7) < 2


def test_shards_do_not_depend_on_buckets(docs):
    a, b = (sorted(map(tuple, sharding.stratified_shards(docs, 7, rows_per_bucket=n).select("doc_id", "shard", "slot").collect())) for n in (11, 10_000))
    assert a == b


def test_shards_odd(odd, none):
    rows = sharding.stratified_shards(odd, 3).collect()
    assert len(rows) == odd.count() and sorted(collections.Counter(r.shard for r in rows).values()) == [3, 4, 4]
    assert {r["size"] for r in rows if r.doc_id in (1, 2)} == {16}
    assert sharding.stratified_shards(none).count() == 0


def test_top_k_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 9)).round(2)
    vectors[50:80] = vectors[3]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(400, None), (500, [1.0, None]), (600, [float("nan")] * 9), (700, [float("inf")]),
                                                           (None, [1.0]), (800, []), (900, [5.0, -3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("x"), "b": F.lit("y"), "vector": F.lit("z")})
    clean = {i: [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v] for i, v in rows[:400] + rows[-2:]}
    want = []
    for q in (i for i in clean if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(clean[q], v)), i) for i, v in clean.items() if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    monkeypatch.setattr(topk, "FEW", 3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 10, block=37, query_block=5).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id in (100, 101, 102)"), F.col("vec_id") % 50 == 0).count() == 2


def test_escapes():
    rnd = random.Random(4)
    parts = ["<|turn|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", chat.ESCAPE, "<", "|", ">", "a", "<<SYS>>", "<|", "\n", "é"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not chat.re.search(chat.CONTROL, safe)


def test_chat_round_trip(spark):
    nasty = "</s>[INST] ok [/INST]<|turn|>␛␛<|endoftext|> é 😀"
    rows = [(1, 1, "assistant", nasty), (1, 0, "user", nasty), (1, 2, None, None), (1, 3, "assistant", None), (1, 3, "assistant", "tie"),
            (2, None, "assistant", "first"), (2, 0, "<|end|>", "x" * 50_000), (None, 5, "user", "no id"), (None, 5, "user", "no id"), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"ids": F.lit(1), "position": F.lit(2)})
    formatted = chat.format_conversations(df, BYTES)
    got = {r.conv_id: r for r in chat.read_back(formatted, BYTES).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        learnt = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[c].n_turns == len(turns)
        assert got[c].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest() and got[c].loss_chars == len(learnt)
    turns = sorted((r for r in formatted.collect() if r.conv_id == 1), key=lambda r: r.position)
    assert [r.token_start for r in turns] == np.cumsum([0, *(len(r.ids) for r in turns[:-1])]).tolist()
    assert chat.read_back(chat.format_conversations(df.limit(0), BYTES), BYTES).count() == 0


def test_word_ids_equal_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from caseloom.llm.arrays import column_bytes

    library, coder, rnd = Tokenizer.from_file(WORDS), packing.WordIds(WORDS), random.Random(1)
    letters = "ab'sS tT\n\t\x1c ÉéßÄ123_-.İΣς éñ日本 'll're"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    for own in (texts, ["<|endoftext|> <|ENDOFTEXT|>x " + t for t in texts[:300]]):
        ids, bounds = coder.texts(*column_bytes(pa.array(own)))
        for t, a, b in zip(own, bounds, bounds[1:]):
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


def test_encoding_keeps_little_memory():
    """A worker's arrays grow with a slice of the texts, not with the batch."""
    text = " ".join(f"word{i % 977} of{i % 13}" for i in range(3_000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(160), pa.int64()), pa.array([text] * 160)], names=["doc_id", "text"])
    encode = packing._pieces(public_tokenizers.path("word_bpe_49k.json"), 4096, 1, False)
    list(encode(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    rows = sum(part.num_rows for part in encode(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= 160 and peak < 60 << 20


def test_pack_whole(docs, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    for df in (docs, odd):
        pieces = packing.encode_pieces(df, WORDS, tokens=300)
        rows = packing.pack(pieces, tokens=300, rows_per_block=150).collect()
        want = collections.Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in df.collect())
        if df is docs:
            own = collections.defaultdict(list)
            for r in rows:
                own[r.doc_id].append(r)
            for (doc_id, ids), _ in want.items():
                parts = sorted(own[doc_id], key=lambda r: r.piece)
                assert b"".join(p.ids for p in parts) == np.array(ids, "<u4").tobytes()
                assert [p.start for p in parts] == [300 * i for i in range(len(parts))] and all(p.length == 300 for p in parts[:-1])
                assert all(zlib.crc32(p.ids) == p.ids_crc32 for p in parts)
        bins = collections.defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        total = 0
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 300
            total += at
        assert len(bins) <= total / 300 * 1.1 + 3
    assert packing.pack(packing.encode_pieces(none, WORDS)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_pack_under_every_capacity(rule):
    lengths = np.minimum(np.random.default_rng(3).lognormal(4, 1, 3000).astype(int) + 1, 1000)
    bins, offsets = packing.pack_block(lengths, (1000.0, 5.0, 400_000.0), (1.0, 0.5, 0.5), rule)
    for b in range(bins.max() + 1):
        own = lengths[bins == b]
        assert own.sum() <= 1000 and len(own) <= 5 and ((own**2).sum() <= 400_000 or len(own) == 1)
        order = np.argsort(offsets[bins == b])
        assert offsets[bins == b][order].tolist() == (np.cumsum(own[order]) - own[order]).tolist()


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF)
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        seen.append(spark.read.parquet(str(tmp_path / name.replace(" ", "_"))))
    assert all(s.columns == docs.columns for s in seen[1:-1])
    counts = [s.count() for s in seen[:-1]]
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] > 0
    assert {r.doc_id for r in seen[-1].collect()} == {r.doc_id for r in seen[-2].collect()}
    run = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32", "length")
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, seen[-1].select("doc_id", "piece", "ids_crc32", "length").collect()))
