"""The pipeline stages, each against its operator's rule on its own input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from edgecraft.llm import common, langid, shingle_join, toxicity
from edgecraft.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    base, out = tmp_path_factory.mktemp("stages"), [common.documents(spark, sf)]
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{base}/{i}")
        out.append(spark.read.parquet(f"{base}/{i}"))
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language_id", "near_duplicates", "secrets", "packing"]
    assert all(d.columns == list(common.DOCUMENT_COLUMNS) for d in stages[1:-1])


def test_filters_reject_what_their_operator_rejects(spark, sf, stages):
    raw, calm, told, single, clean, packed = stages
    model = toxicity.fit(toxicity.labelled(raw, spark.read.parquet(f"{sf}/labels.parquet")))
    bad = {r.doc_id for r in toxicity.score(raw, model, ["doc_id"]).where("score >= 0.5").collect()}
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert bad and ids(calm) == ids(raw) - bad
    lang = langid.fit(calm.where(common.fold(F.col("doc_id")) != 0))
    lost = {r.doc_id for r in langid.predict(calm, lang, ["doc_id"]).where("lang_pred = 'und' or score < 0.5").collect()}
    assert ids(told) == ids(calm) - lost
    text = {r.doc_id: shingle_join.shingle_sets([r.text], 5)[0] for r in told.collect()}
    label = {i: i for i in text}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    order, sets = sorted(text), {i: set(h.tolist()) for i, h in text.items()}
    for x, a in enumerate(order):
        for b in order[:x]:
            s, t = sets[a], sets[b]
            if min(len(s), len(t)) * 100 >= 80 * max(len(s), len(t), 1) and 100 * len(s & t) >= 80 * len(s | t):
                label[max(root(a), root(b))] = min(root(a), root(b))
    assert ids(single) == {i for i in text if root(i) == i}
    assert ids(clean) == ids(single) and ids(packed) == ids(clean)


def test_run_gives_the_last_stage(spark, sf, stages):
    got = cp.run(spark, sf)
    assert got.columns == stages[-1].columns and got.count() == stages[-1].count()


def test_empty_table(spark, sf, stages):
    docs = stages[0].limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
