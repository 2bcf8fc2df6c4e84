"""Token counts, piece encoding and packing against the libraries."""

import hashlib
import random
import time
import zlib

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from evalspark.llm import packing, piece_codec, pretokens, token_counts

DOC = "doc_id long, text string"
PARTS = [" ", "  ", "\n", " \n", "\n ", "\t", "▁", "a", "the", "é", "é", "日", "🙂", "\x00", "\x1c", "\x85", "\xa0", "'s", "'", "123", "...",
         "</s>", "<0x0A>", "<s>", "<|endoftext|>", "ing", "Ünd", "x", "\r", "　", "(ction", "�", "ⅷ", "՘"]


def texts(n=3000):
    rnd = random.Random(3)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def rows():
    return [(i, t) for i, t in enumerate(texts(300))] + [(None, "no id"), (1000, None), (1001, ""), (900, "again"), (900, "again"),
                                                          (1002, "lorem ipsum dolor " * 20_000), (1003, "x" * 50_000)]


def test_pieces_give_the_library_ids(place):
    path = place("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    sample = texts()
    for text, raw in zip(sample, pretokens.id_bytes(path, sample, cache_entries=50)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_count_tokens(spark, clash, place):
    path = place("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    data = rows()
    got = token_counts.count_tokens(clash(spark.createDataFrame(data, DOC)), path, cache_entries=100, sample_rows=10).collect()
    want = sorted((d if d is not None else -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in data)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.count_tokens(spark.createDataFrame([], DOC), path).collect() == []


def test_agenda_is_the_library(place):
    path = place("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = piece_codec.PieceCodec(path)
    sample = texts()
    for text, (ids, n) in zip(sample, codec.encode_texts(sample)):
        want = library.encode(text)
        assert [*map(int, ids.split())] == want and n == len(want), text
        assert codec.decode(want) == library.decode(want)
    assert not codec.wrong
    rnd = random.Random(1)
    for _ in range(2000):  # ids that no encoder gives: bad bytes, control and unknown pieces
        ids = [rnd.choice([rnd.randrange(32_000), rnd.randrange(260)]) for _ in range(rnd.randint(0, 8))]
        assert codec.decode(ids) == library.decode(ids)


def test_long_segments_take_near_linear_time(place):
    """A megabyte without a break, text without spaces, one character repeated: ids as the library's."""
    path = place("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = piece_codec.PieceCodec(path)
    rnd = random.Random(3)
    sample = ["".join(rnd.choices("ABCDEFabcdefghijklmnop0123456789+/", k=1_000_000)), "x" * 100_000,
              "".join(rnd.choices("的一是不了人我在有他这中大来上国龘", k=50_000)), "".join(rnd.choices(["the", "ing", "a🙂", "\x00"], k=20_000))]
    sample += ["".join(rnd.choices("etaoin", k=piece_codec.LONG + d)) for d in (-2, -1, 0, 1)]
    start = time.monotonic()
    got = list(codec.encode_texts(sample))
    assert time.monotonic() - start < 60
    assert [[*map(int, ids.split())] for ids, _ in got] == library.encode(sample)
    assert not codec.wrong


def test_encode_round_trip(spark, clash, place):
    path = place("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    data = rows()
    df = clash(spark.createDataFrame(data, DOC))
    got = piece_codec.encode_digests(df, path, cache_entries=100).collect()
    want = []
    for d, t in data:
        ids = library.encode(t or "", add_eos=True)
        want.append((d if d is not None else -1, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted((r.doc_id if r.doc_id is not None else -1, *r[1:]) for r in got) == sorted(want)
    back = piece_codec.decode(piece_codec.encode(df, path), path).collect()
    assert sorted(r.text for r in back) == sorted(library.decode(library.encode(t or "")) for _, t in data)
    assert piece_codec.encode_digests(spark.createDataFrame([], DOC), path).collect() == []


def test_plan_covers_the_histogram():
    rnd = random.Random(0)
    for hist in ({}, {113: 1000, 3: 5}, {128: 7}, {1: 1000}, {u: rnd.randint(0, 50) for u in range(1, 129)}, {65: 100, 64: 3}):
        used = {}
        for combo, times in packing.plan(hist, 128):
            assert sum(combo) <= 128 and times > 0
            for u in combo:
                used[u] = used.get(u, 0) + times
        assert used == {u: c for u, c in hist.items() if c}


def test_nnls_reaches_the_optimum():
    rnd = np.random.default_rng(0)
    for _ in range(20):
        a, b = rnd.random((8, 12)), rnd.random(8)
        x = packing.nnls(a, b)
        slope = a.T @ (a @ x - b)
        assert (x >= 0).all() and (slope > -1e-7).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-7


def test_pack(spark, clash, place):
    path = place("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(5)
    data = rows() + [(2000 + i, " ".join(rnd.choice(["alpha", "beta", "gam"]) for _ in range(rnd.randint(1, 900)))) for i in range(300)]
    got = packing.pack(clash(spark.createDataFrame(data, DOC).repartition(4)), path).collect()
    ids = {}
    for d, t in data:
        ids[d] = library.encode(t or "", add_special_tokens=False).ids + [0]
    copies = {d: sum(1 for x, _ in data if x == d) for d in ids}
    seen = {}
    for r in got:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.asarray(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {d: len(v) * copies[d] for d, v in ids.items()}
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    filled = sum(r.length for r in got) / 1024 / len(sequences)
    assert filled > 0.95
    assert packing.pack(spark.createDataFrame([], DOC), path).collect() == []
