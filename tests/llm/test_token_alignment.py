"""Alignments against a plain reading of their definition with the two libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers as public
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fieldloom.llm import token_alignment

PATHS = [public.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def files():
    return [open(p, "rb").read() for p in PATHS]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    letter = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    return a, b, letter


def tokens_of(libraries, text):
    a, b, letter = libraries
    if not text:
        return None
    one = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (one, two) if b"".join(t for _, t in one) == whole == b"".join(t for _, t in two) else None


def groups_of(tokens):
    one, two = tokens
    ends = []
    for side in (one, two):
        at, own = 0, []
        for _, t in side:
            at += len(t)
            own.append(at)
        ends.append(own)
    out, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        x, y = i, j
        while i < len(one) and ends[0][i] <= cut:
            i += 1
        while j < len(two) and ends[1][j] <= cut:
            j += 1
        out.append(([t for t, _ in one[x:i]], [t for t, _ in two[y:j]]))
    return out


def rows_of(libraries, texts):
    known = {}
    for t in set(texts):
        tokens = tokens_of(libraries, t)
        known[t] = groups_of(tokens) if tokens else []
    links = {t: Counter((a, b) for x, y in g for a in x for b in y) for t, g in known.items()}
    counts = Counter(p for t in texts for p in links[t])
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for t in texts:
        g, own = known[t], links[t]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()), sum(n for p, n in own.items() if counts[p] == most[p[0]]),
                    sum(n * counts[p] for p, n in own.items()), hashlib.sha256(written.encode()).hexdigest() if g else ""))
    return out


def test_query_matches_brute_force(spark, libraries):
    sf = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    want = dict(zip(docs["doc_id"], rows_of(libraries, docs["text"]), strict=True))
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in token_alignment.op13_token_alignment(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("large", [token_alignment.LARGE, 3])
def test_odd_texts(spark, libraries, files, large, monkeypatch):
    monkeypatch.setattr(token_alignment, "LARGE", large)
    rng = random.Random(2)
    some = [" ", "  ", "\n", "\t", "　", "▁", "a", "the", "The", "é", "中", "文", "1", "23", "'s", "!", "?.", "\x1c", "\x85", "\x00", "aaaa", "\U0001f642", "=====", "<|endoftext|>", "<s>", "<0x41>", "</s>"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 14))) for _ in range(700)]
    texts += ["", None, " ", "  ", "a ", " a", "x\n y", "x\n  y ", "a" * 5000, "中" * 3000, "".join(map(chr, range(1, 0x3000)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in token_alignment.measures(docs, *files, public.PATTERN).collect()}
    want = dict(enumerate(rows_of(libraries, texts)))
    assert {i: (texts[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_chunks_and_copies(spark, libraries, files, monkeypatch):
    monkeypatch.setattr(token_alignment, "BYTES", 60)
    texts = ["one two three"] * 40 + ["two three four, five"] * 3 + [f"number {i} of a few" for i in range(30)] + [None, ""]
    docs = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = sorted(tuple(r[n] for n in ["doc_id", *NAMES]) for r in token_alignment.measures(docs, *files, public.PATTERN).collect())
    assert got == sorted((i % 50, *r) for i, r in enumerate(rows_of(libraries, texts)))


def test_groups_are_written(spark, libraries, files):
    texts = ["Hello, world 中文", None, "", "a▁b", "two  blanks"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, groups string")
    got = {r["doc_id"]: r["groups"] for r in token_alignment.align(docs, *files, public.PATTERN).collect()}
    for i, t in enumerate(texts):
        tokens = tokens_of(libraries, t)
        assert got[i] == (None if tokens is None else ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups_of(tokens)))
    assert token_alignment.align(docs.limit(0), *files, public.PATTERN).count() == 0


def test_empty_table_and_null_ids(spark, tmp_path, files):
    spark.createDataFrame([], "doc_id long, text string, n_a long").write.parquet(f"{tmp_path}/documents.parquet")
    out = token_alignment.op13_token_alignment(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", *NAMES]
    docs = spark.createDataFrame([(None, "same"), (None, "same"), (1, None)], "doc_id long, text string")
    assert sorted(r["n_a"] for r in token_alignment.measures(docs, *files, public.PATTERN).collect()) == [0, 1, 1]
