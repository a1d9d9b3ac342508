"""Very long texts beside short ones, and pipeline stages on odd and empty tables."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chains, lm, packing, piece, quality, secrets, simhash, suffix
from tessera.llm._common import staged
from tessera.llm.queries import tokenizer_files
from tests.llm.test_brute import fingerprint_of, plain_score, quality_of, random_model

N = 60_000


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a, b in zip(rng.choice(["bar", "ton", "el", "gri", "mo"], N), rng.integers(0, 10**5, N), strict=True)]
    one = " ".join(words)
    part = " ".join(words[20_000:20_200])
    texts = {1: one, 2: one, 3: part, 4: "short", 5: None, 6: "x" * 300_000, 7: "a b " * 50_000 + 'key = "9c1185a5c5e9fc54612808977ee8f548b2258d31"'}
    return texts, spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_measures_and_fingerprints(long):
    texts, df = long
    got = {r["doc_id"]: r for r in quality.ledger(df).collect()}
    for i, t in texts.items():
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == quality_of(t or "")
    fps = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.clusters(df).collect()}
    assert fps == {i: fingerprint_of(t or "") for i, t in texts.items()}


def test_removal_and_passages(long):
    texts, df = long
    got = {r["doc_id"]: r for r in suffix.dedup(df).collect()}
    assert got[1]["n_removed"] == got[2]["n_removed"] == len(texts[1]) and got[3]["n_removed"] == len(texts[3])
    assert got[6]["n_removed"] == 300_000 and got[7]["n_removed"] > 199_000 and got[4]["n_removed"] == got[5]["n_removed"] == 0
    out = {r["doc_id"]: r["text"] for r in chains.cleaned(df).collect()}
    assert out[1] == texts[1] and out[2] == "" and out[3] == "" and out[6] == texts[6] and out[5] is None and out[7] == texts[7]


def test_tokens_packing_and_scores(long):
    import public_tokenizers as P
    import sentencepiece

    texts, df = long
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in piece.round_trip(df, P.path("piece_bpe_32k.model")).collect():
        ids = sp.encode(texts[r["doc_id"]] or "") + [sp.eos_id()]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["n_unlike"] == 0
    rows = packing.pack(df, tokenizer_files()).collect()
    t = packing.tokenizer(*tokenizer_files())
    for i, text in texts.items():
        assert sum(r["length"] for r in rows if r["doc_id"] == i) == len(t.ids(text or "")) + 1
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 1024) + 1
    _, m = random_model(4)
    ids = np.append(t.ids(texts[1])[:5000].astype(np.int64), lm.STOP)
    assert np.isclose(m.scores([ids])[0], plain_score(m, ids.tolist()), rtol=1e-4)
    found = secrets.scan(df, secrets.trained(n=1000)).where("doc_id = 7").collect()
    assert [r["start"] for r in found] == [texts[7].index("9c11")]


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    for df in (odd, none):
        docs = df
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            alone = stage(spark, df, "")  # each stage also takes the table as it is
            assert alone.count() <= df.count() or i == 4
            docs = staged(stage(spark, docs, ""), name)
            if i < 4:
                assert docs.columns == df.columns
        assert set(docs.select("doc_id").distinct().toPandas()["doc_id"].dropna()) <= {x["doc_id"] for x in df.select("doc_id").collect()}
    assert odd.where(F.col("doc_id").isNull()).count() == 1
