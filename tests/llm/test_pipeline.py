"""The pipeline's stages, each against a brute-force version on its own input."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import minhash_dedup, mixing, pii, sentencepiece_codec, toxicity
from tests.llm.test_text_operators import DOCS, brute_pseudonyms, shingles

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents of the smallest table with copies, rows that share an id, nulls, empty texts and clashing columns."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [tuple(r) for r in base.collect()]
    rows += [(1000 + i, t, "en", s, None) for i, (t, s) in enumerate([("", "a"), (None, None), (rows[3][1], "a"), (rows[3][1].upper(), "a"), ("  ", "a"), ("", None)])]
    rows += [(rows[0][0], "another text under the same id " * 3, "en", "a", 1), rows[5], (None, rows[7][1], "en", "a", 1), (None, None, "en", "a", 1), (None, None, "en", "a", 1)]
    return spark.createDataFrame(rows, DOCS)


def same_rows(a, b):
    key = lambda r: tuple(map(repr, r))
    return sorted(map(key, a)) == sorted(map(key, b))


def test_stages_keep_the_columns(spark, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "pii", "mixing", "sentencepiece"]
    extra = odd.withColumns({c: F.lit(1) for c in ("_row", "node", "component", "found")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.columns[:5] == COLUMNS and (len(out.columns) == 5) == (name != "sentencepiece")
        assert {"_row", "node", "component", "found"} <= set(stage(spark, extra, SF).columns)
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_toxic_documents_go(spark, odd):
    lexicon = toxicity.train(spark, odd, SF)
    texts = [r.text for r in odd.collect()]
    rows = odd.collect()
    want = [r for r, (s, _) in zip(rows, toxicity.Scorer(lexicon).scores(texts), strict=True) if s < toxicity.THRESHOLD]
    assert same_rows(corpus_pipeline.drop_toxic(spark, odd, SF).collect(), want)


def test_one_of_each_group_stays(spark, odd):
    """Rows are joined by links of whole sets, whatever their ids; the least id of each group stays, once."""
    rows = odd.collect()
    sets = [shingles(r.text, 5) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        if sets[i]:
            groups.setdefault(find(i), []).append(rows[i])
    out = corpus_pipeline.drop_near_copies(spark, odd, SF).collect()
    empty = [r for r, s in zip(rows, sets, strict=True) if not s]
    assert len(out) == len(groups) + len(empty)
    assert same_rows([r for r in out if not shingles(r.text, 5)], empty)
    kept = {(r.doc_id, r.text) for r in out}
    for members in groups.values():
        stay = [m for m in {(m.doc_id, m.text) for m in members} if m in kept]
        assert len(stay) == 1 and stay[0][0] == min((m.doc_id for m in members if m.doc_id is not None), default=None)


def test_personal_data_is_hidden(spark, odd):
    want = []
    for r in odd.collect():
        text = brute_pseudonyms(r.text, pii.DEMO_KEY)[0]
        want.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text)))
    assert same_rows([tuple(r) for r in corpus_pipeline.hide_personal_data(spark, odd, SF).collect()], want)


def test_sources_are_mixed(spark, odd):
    """Every row appears as often as its own draw says."""
    rates = {r.source: r.rate for r in mixing.rates(odd).collect()}
    out = corpus_pipeline.mix_sources(spark, odd, SF).collect()
    assert {(r.doc_id, r.text) for r in out} <= {(r.doc_id, r.text) for r in odd.collect()}
    want = 0
    for r in odd.collect():
        who = f"{'null' if r.doc_id is None else r.doc_id}|{'null' if r.text is None else hashlib.md5(r.text.encode()).hexdigest()}"
        u = int(hashlib.md5(f"7|{who}".encode()).hexdigest()[:13], 16) / 2**52
        rate, c, p, n = rates[r.source or ""], math.exp(-rates[r.source or ""]), math.exp(-rates[r.source or ""]), 0
        while c <= u:
            n += 1
            p *= rate / n
            c += p
        want += n
    assert len(out) == want


def test_texts_are_encoded(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec.read_model(spark))
    for r in corpus_pipeline.encode(spark, odd, SF).collect():
        assert r.ids == (None if r.text is None else sp.encode(r.text))
        assert r.n_tokens == (None if r.text is None else len(r.ids))


def test_run_chains_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*COLUMNS, "ids", "n_tokens"] and out.count() > 50
    assert minhash_dedup.near_duplicates(out.select("doc_id", "text").distinct()).where("not kept").count() <= 2
