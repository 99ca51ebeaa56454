"""Runs and collapsed texts against a plain reading of their definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from fieldloom.llm import periodic_runs


def runs_of(words, least=24):
    n, seen = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q):
                seen.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda r: (r[0], r[2]))


def collapsed_of(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def planted_of(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def row_of(doc_id, text):
    words = planted_of(doc_id, text)
    runs = runs_of(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest, hashlib.sha256(collapsed_of(words, runs)).hexdigest())


NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    want = {i: row_of(i, t) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in periodic_runs.op11_periodic_runs(spark, sf).collect()}
    assert got == want
    assert sum(r[0] > 0 for r in want.values()) > 5


def some_words(rng):
    n, kinds = rng.choice([0, 1, 5, 30, 200, 700, 1500]), rng.choice([1, 2, 3, 50])
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n > 3 else 0):
        start, p = rng.randrange(n), rng.randint(1, max(1, min(n // 3, rng.choice([3, 20, 60, 130, 400]))))
        for i in range(start + p, min(n, start + rng.randint(2 * p, 5 * p))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_texts(seed):
    rng = random.Random(seed)
    texts = [some_words(rng) for _ in range(rng.randint(1, 4))]
    flat = [w for i, t in enumerate(texts) for w in [*t, -1 - i]]
    got = periodic_runs.find_runs(np.array(flat, np.int64), np.array([len(t) for t in texts], np.int64))
    want, at = [], 0
    for t in texts:
        want += [(s + at, n, q) for s, n, q in runs_of(t)]
        at += len(t) + 1
    assert list(map(tuple, got.tolist())) == want


@pytest.mark.parametrize("words", [np.zeros(300_000, np.int64), np.arange(300_000) % 2, np.arange(300_000) % 99_999])
def test_long_periodic_texts_are_one_run(words):
    got = periodic_runs.find_runs(np.append(words, -1), np.array([len(words)]))
    assert got.tolist() == [[0, 300_000, len(set(words.tolist()))]]


def test_a_run_with_many_equal_words_in_its_period():
    period = np.where(np.arange(1009) % 101 == 0, np.arange(1009) + 1, 0)
    got = periodic_runs.find_runs(np.append(np.tile(period, 4), -1), np.array([4 * 1009]))
    assert [0, 4 * 1009, 1009] in got.tolist()


def test_edge_rows(spark):
    loop = " ".join(["a b"] * 20)
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n ", "x"), (4, loop, "x"), (4, loop, "y"), (None, "a b c\u0085d \x1c e", None), (5, "w " * 120_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = periodic_runs.collapse_runs(docs).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["collapsed"] for i in (1, 2, 3, 4, 5)] == ["", "", "", "a b", "w"]
    assert [tuple(x) for x in by[4]["runs"]] == [(0, 40, 2)] and [tuple(x) for x in by[5]["runs"]] == [(0, 120_000, 1)]
    assert by[None]["collapsed"] == "a b c\u0085d \x1c e" and by[None]["runs"] == []
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0
    assert "_text" not in out[0] and docs.columns == ["doc_id", "text", "runs"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, n_runs long").write.parquet(f"{tmp_path}/documents.parquet")
    out = periodic_runs.op11_periodic_runs(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", *NAMES]
