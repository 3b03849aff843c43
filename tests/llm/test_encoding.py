"""Token files and byte-level BPE against their libraries, and round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from ondula.llm import byte_bpe, common, sharding, tokens

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, size string, shard string, ids string"


def strange_texts(n=300):
    rng = random.Random(5)
    alphabet = list("ab  \n\n\t'sré1２\x85　\x1c!?-_aaaaÉÑßΣσé́") + [
        "'re", "ing", "the ", "日本", "​", "🙂", "<|endoftext|>", "</w>", "word, ",
    ]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(n)]
    return [None, "", " ", "a" * 3000, " " * 2000, "ab" * 2000, "日本" * 900, *texts]


@pytest.fixture
def odd(spark):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(strange_texts())]
    rows += [rows[9], rows[9], (None, "no id", None, None, None), (9, "other text", "", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_replay_equals_the_library():
    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    encoder, decoder = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    texts = [t or "" for t in strange_texts(3000)]
    flat, counts = encoder.encode(texts)
    for ids, text in zip(np.split(flat, np.cumsum(counts)[:-1]), texts):
        assert ids.tolist() == library.encode_ordinary(text)
        assert decoder.decode(ids) == text.encode()


def test_replay_with_ranks_out_of_order():
    """A merge may make a pair of a lower rank than its own, and pairs overlap."""
    rng = random.Random(1)
    for _ in range(40):
        words = {bytes([b]): None for b in range(256)}
        for _ in range(40):
            words[bytes(rng.choices(b"abc", k=rng.randint(2, 5)))] = None
        many = list(words)
        rng.shuffle(many)
        ranks = {w: n for n, w in enumerate(many)}
        library = tiktoken.Encoding("t", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
        pieces = [bytes(rng.choices(b"abc", k=rng.randint(1, 30))) for _ in range(60)]
        pieces = [p for p in pieces if p not in ranks]
        flat, counts = byte_bpe.replay(pieces, byte_bpe.Merges(ranks))
        for ids, p in zip(np.split(flat, np.cumsum(counts)[:-1]), pieces):
            assert ids.tolist() == library.encode_ordinary(p.decode())


def test_caches_start_anew(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_CHUNKS", 5)
    encoder = byte_bpe.Encoder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    first = [encoder.encode([f"one two {n} three four five six"])[0].tolist() for n in range(4)]
    again = [encoder.encode([f"one two {n} three four five six"])[0].tolist() for n in range(4)]
    assert first == again


def test_round_trip_rows(odd, empty):
    out = byte_bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert len(out) == odd.count()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], set()).add((r["text"] or "").encode())
    for r in out:
        assert r["decoded_sha256"] in {hashlib.sha256(t).hexdigest() for t in texts[r["doc_id"]]}
    assert byte_bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_encode_and_decode(odd):
    encoded = byte_bpe.encode(odd.where("doc_id < 50"), RANKS, public_tokenizers.PATTERN)
    back = {(r["doc_id"], bytes(r["bytes"])) for r in byte_bpe.decode(encoded, RANKS).collect()}
    want = {(r["doc_id"], (r["text"] or "").encode()) for r in odd.where("doc_id < 50").collect()}
    assert back == want


def test_token_files(spark, odd):
    library = Tokenizer.from_file(WORDS)
    want = []
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    rows = tokens.token_files(odd, WORDS, 2).collect()
    key = lambda t: tuple((x is not None, x) for x in t)
    assert sorted(((r[0], r[2], r[3]) for r in rows), key=key) == sorted(want, key=key)
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] is None for r in rows][0]
    assert [r["doc_id"] for r in rows[1:]] == sorted(r["doc_id"] for r in rows[1:])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]


def test_words_of_a_slice_are_looked_up_once():
    encoder = tokens.ChunkEncoder(WORDS)
    asked = []

    class Counting(common.Numbered):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    encoder.known = Counting("", encoder.fresh, [0])
    flat, counts = encoder.encode(["one two. three, One\ntwo. " * 500, "two three. " * 500], 2)
    assert len(asked) == len(set(asked)) < 10
    one, two, three, dot, comma = (
        Tokenizer.from_file(WORDS).encode(t, add_special_tokens=False).ids
        for t in ("one", "two", "three", ".", ",")
    )
    first = (one + two + dot + three + comma + one + two + dot) * 500
    assert flat.tolist() == [*first, 2, *(two + three + dot) * 500, 2]
    assert counts.tolist() == [len(first) + 1, len(flat) - len(first) - 1]


def test_chunks_of_latin_marks_and_others():
    whole = Tokenizer.from_file(WORDS)
    texts = [f"a{chr(c)}. B{chr(c)}, {chr(c)}\n{chr(c)}x.\n" for c in range(1, 0x180)]
    texts += ["a. b, c.\nd.", "a., b. . c", "A. ΑΣ. b. İ, c", "x. <|endoftext|> y, ", ". ", "a.", ""]
    flat, counts = tokens.ChunkEncoder(WORDS).encode(texts, 2)
    for ids, text in zip(np.split(flat, np.cumsum(counts)[:-1]), texts):
        assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2], text


def test_token_files_hold_ids(spark, empty):
    docs = spark.createDataFrame([(5, "some words"), (1, "the first"), (3, None)], "doc_id long, text string")
    folder = common.shared_folder(spark, "files")
    tokens.write_tokens(docs, WORDS, 2, folder)
    rows = tokens.read_tokens(spark, folder, tokens.id_type(49408)).orderBy("start").collect()
    library = Tokenizer.from_file(WORDS)
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in docs.collect()}
    assert [(r["doc_id"], r["ids"]) for r in rows] == sorted(want.items())
    assert tokens.token_files(empty, WORDS, 2).count() == 0
    assert tokens.id_type(1 << 16) == np.dtype("<u2") and tokens.id_type((1 << 16) + 1) == np.dtype("<u4")


def brute_shards(rows, n):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[2], r[1]))
    total = sum(r[1] for r in rows)
    out, at, slots = [], 0, {}
    for r in rows:
        shard = (2 * at + r[1]) * n // (2 * total)
        slots[shard] = slots.get(shard, -1) + 1
        out.append((r[0], r[1], r[2], shard, slots[shard]))
        at += r[1]
    return out


def test_shards(odd, empty):
    want = []
    for r in odd.collect():
        data = (r["text"] or "").encode()
        want.append((r["doc_id"], len(data) + 16, zlib.crc32(data)))
    key = lambda t: tuple((x is not None, x) for x in t)
    for n in (1, 7, 40):
        got = [tuple(r) for r in sharding.shard_by_bytes(odd, n).collect()]
        assert sorted(got, key=key) == sorted(brute_shards(want, n), key=key)
    assert sharding.shard_by_bytes(empty, 40).count() == 0
