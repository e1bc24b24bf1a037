"""corpus_pipeline's stages, each judged on its own input by brute force, and run() as a whole."""

import numpy as np
import pytest

import corpus_pipeline
from tallyline.llm import mixing, simhash, toxicity

from .test_llm_operators import brute_repeats, check_pieces, closed


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{x}" for x in rng.zipf(1.3, n) % 400)
    rows, labels = [], []
    for i in range(300):
        t = word(int(rng.integers(10, 200)))
        if i % 10 == 0:
            t = t.replace(" ", f" {('nasty', 'vile')[i % 20 // 10]} ", 1)
        rows.append((i, t, "en", "hot" if i % 3 else f"s{i % 4}", len(t)))
        labels.append((i, 1, int(i % 10 == 0)))
    passage = word(60)
    for i in range(300, 330):
        t = rows[i - 300 + 1][1] if i % 2 else word(30) + " " + passage
        rows.append((i, t, "en", "s1", len(t)))
    rows += [(330, None, None, None, None), (331, "", "en", "s2", 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
    return d


def test_each_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns
        texts = dict(zip(before.doc_id, before.text))
        if name == "toxicity":
            machine = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
            scores = machine.scores([toxicity.terms((t or "").encode()) for t in before.text])
            assert set(after.doc_id) == set(before.doc_id[scores < 0.5]) and set(range(0, 300, 10)).isdisjoint(after.doc_id)
            assert len(after) >= len(before) - 30 - 5  # clean documents stay
        elif name == "near_dedup":
            sets = {i: set(simhash.shingles((t or "").encode(), 5)) for i, t in texts.items()}
            root = closed([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], sets)
            assert sorted(after.doc_id) == sorted(i for i in texts if root[i] == i)
        elif name == "substrings":
            split, kept = brute_repeats(texts)
            for i, t, n in zip(after.doc_id, after.text, after.n_chars):
                want = texts[i] if len(kept[i]) == len(split[i]) else b" ".join(kept[i]).decode()
                assert t == want and (want is None or n == len(want))
        elif name == "mixing":
            uses = after.groupby("doc_id").size()
            assert set(uses.index) == set(before.doc_id) and uses.max() <= mixing.REPEATS + 1
            for r in after.itertuples():
                assert r.text == texts[r.doc_id]
        else:
            texts = dict(zip(before.doc_id, before.text))
            assert set(after.doc_id) == set(before.doc_id)
            once = after[~after.doc_id.isin(before.doc_id[before.doc_id.duplicated()])]
            check_pieces_of_some(once, texts)


def check_pieces_of_some(pieces, texts):
    for _, g in pieces.groupby("doc_id"):
        assert g.length.sum() == g.doc_tokens.iloc[0]
    whole = pieces[pieces.doc_tokens < 2048]
    whole = whole.assign(sequence_id=range(len(whole)), offset=0)[whole.length == whole.doc_tokens]
    check_pieces(whole, texts)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 200
