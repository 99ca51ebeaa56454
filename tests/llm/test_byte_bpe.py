"""Ids against the tiktoken library, and decoding against the texts."""

import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

from fieldloom.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
NAMES = ["n_tokens", "ids_sha256", "decoded_sha256"]


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def data():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def enc(data):
    return library({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())})


def ids_of(codec, texts):
    out = []
    for _, lengths, ids in codec.encode(pa.array(texts, pa.string())):
        ends = np.cumsum(lengths)
        out += [ids[a:b].tolist() for a, b in zip(ends - lengths, ends, strict=True)]
    return out


def test_query_matches_library(spark, enc):
    sf = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    want = {}
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        ids = enc.encode_ordinary(t or "")
        want[i] = len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in byte_bpe.op12_byte_bpe(spark, sf).collect()}
    assert got == want


def test_odd_texts(data, enc):
    rng = random.Random(1)
    some = [" ", "  ", "\n", "\t", "　", "a", "the", "The", "é", "中", "文", "1", "23", "'s", "'ll", "!", "?.", "\x1c", "\x85", "aaaa", "ab" * 30, "🙂", "=====", "<|endoftext|>"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["", " ", "  ", "a" * 60_000, "ab" * 30_000, " " * 5000 + "x", "中" * 20_000, "x\n y \n z", "".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x30000)))]
    codec = byte_bpe.Codec(data, public_tokenizers.PATTERN)
    assert ids_of(codec, texts) == enc.encode_ordinary_batch(texts, num_threads=1)


@pytest.mark.parametrize("seed", range(20))
def test_merges_that_make_lower_ranks(seed):
    """Ranks in no order of training: a merge may make a pair that ranks below it."""
    rng = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)}
    for _ in range(200):
        tokens.add(b"".join(rng.choice(sorted(tokens - {bytes([b]) for b in range(256)}) or [b"a"]) if rng.random() < 0.4 else rng.choice([b"a", b"b", b"c"]) for _ in range(2)))
    longer = sorted(t for t in tokens if len(t) > 1 and len(t) < 9)
    rng.shuffle(longer)
    ranks = {t: i for i, t in enumerate([bytes([b]) for b in range(256)] + longer)}
    file = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items())
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    assert ids_of(byte_bpe.Codec(file, public_tokenizers.PATTERN), texts) == library(ranks).encode_ordinary_batch(texts, num_threads=1)


def test_memory_of_words_starts_anew(data, enc, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN", 20)
    codec, texts = byte_bpe.Codec(data, public_tokenizers.PATTERN), [f"one {i} two {i * i} three" for i in range(60)]
    assert [ids_of(codec, [t])[0] for t in texts] == enc.encode_ordinary_batch(texts, num_threads=1)


def test_edge_rows(spark, data, enc):
    rows = [(1, None, b"x"), (2, "", b"x"), (3, "twice", None), (3, "twice", None), (None, "no id", None), (4, "long " * 400_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary")
    out = byte_bpe.encode(docs, data, public_tokenizers.PATTERN)
    got = byte_bpe.encode(docs, data, public_tokenizers.PATTERN, packed=False).collect()
    assert [(r["doc_id"], r["text"]) for r in got] == [r[:2] for r in rows]
    assert [r["ids"] for r in got] == [None if t is None else enc.encode_ordinary(t) for _, t, _ in rows]
    back = byte_bpe.decode(out, data).collect()
    assert [None if r["decoded"] is None else bytes(r["decoded"]).decode() for r in back] == [r[1] for r in rows]
    assert byte_bpe.encode(docs.limit(0), data, public_tokenizers.PATTERN).count() == 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, n_tokens long").write.parquet(f"{tmp_path}/documents.parquet")
    out = byte_bpe.op12_byte_bpe(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", *NAMES]
