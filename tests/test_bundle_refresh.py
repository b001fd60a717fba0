"""Model bundle (F16 / F17) and incremental refresh."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from edgecraft.config import DEFAULT
from edgecraft.plans import bundle, manifest, recommend, refresh


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(4)
    rows = [(f"u{u}", f"cup-{c}", f"p{p}", rnd.random() < .5, rnd.randint(0, 2)) for u in range(12) for c in range(14)
            for p in rnd.sample(range(10), 2)]
    i = spark.createDataFrame(rows, "user_id string, contest_id string, problem_id string, solved boolean, penalty_count int") \
        .withColumn("normalized_score", F.when(F.col("solved"), 1.0).otherwise(0.5))
    problems = spark.createDataFrame([(f"p{p}", [f"t{p % 3}", f"t{p % 4}"]) for p in range(10)],
                                     "problem_id string, tags array<string>")
    return i.cache(), problems


@pytest.mark.parametrize("choice,parts", [("als", {"als", "als_cal"}),
                                          ("content", {"content_profiles", "problem_tags", "content_cal"}),
                                          ("all", {"als", "als_cal", "content_profiles", "problem_tags", "content_cal"})])
def test_bundle_of_each_choice(spark, data, tmp_path, choice, parts):
    i, problems = data
    m = recommend.train(i, problems, choice=choice, rank=4, max_iter=2)
    assert set(bundle.save(spark, m, str(tmp_path))["parts"]) == parts
    back = bundle.load(spark, str(tmp_path), DEFAULT)
    for name in ("als", "als_cal", "content_profiles", "problem_tags", "content_cal"):
        assert (getattr(back, name) is not None) == (name in parts)
    if back.als is not None:
        pairs = i.select("user_id", "problem_id").distinct()
        a, b = ({(r.user_id, r.problem_id): r.als_raw for r in x.raw_scores(pairs).collect()} for x in (m.als, back.als))
        assert a == b and len(a) > 50
        assert back.als_cal.arrays()[1].tolist() == m.als_cal.arrays()[1].tolist()
    if back.content_profiles is not None:
        assert {tuple(r) for r in back.content_profiles.collect()} == {tuple(r) for r in m.content_profiles.collect()}
    if choice != "all":
        with pytest.raises(ValueError):
            recommend.recommend(i.select("user_id"), i, problems, m, None, None)


def test_bundle_versions(spark, data, tmp_path):
    i, problems = data
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        bundle.load(spark, root)
    with pytest.raises(ValueError):
        recommend.train(i, problems, choice="tree")
    m = recommend.train(i, problems, choice="content", calibrate=False)
    first = bundle.save(spark, m, root)
    again = recommend.refit(m, i, problems)
    assert again.als is None and again.content_profiles.count() >= m.content_profiles.count()
    # a version without a manifest does not exist
    again.content_profiles.write.parquet(f"{root}/versions/half/content_profiles")
    assert manifest.latest(spark, root) == first
    second = bundle.save(spark, again, root, replace(DEFAULT, seed=7))
    assert second["number"] == first["number"] + 1 and manifest.latest(spark, root) == second
    with pytest.raises(ValueError):
        bundle.load(spark, root, DEFAULT)
    assert bundle.load(spark, root, replace(DEFAULT, seed=7)).content_cal is None


def test_refresh_writes_what_changed(spark, data, tmp_path):
    i, _ = data
    root, asked = str(tmp_path), []

    def score(users):
        asked.append({r.user_id for r in users.collect()})
        return i.join(users, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))

    columns = ["problem_id", "solved"]
    rows = lambda: {(r.user_id, r["rows"]) for r in refresh.read_pool(spark, root).collect()}
    assert refresh.refresh(spark, i, score, root, columns) == list(range(refresh.BUCKETS))
    whole = rows()
    assert len(whole) == 12 and refresh.refresh(spark, i, score, root, columns) == [] and len(asked) == 1
    assert manifest.numbers(spark, root) == [1]
    # one changed user: its bucket alone is scored and written
    more = i.unionByName(i.where("user_id = 'u3'").limit(1))
    mine = spark.createDataFrame([("u3",)], "user_id string").select(refresh.bucket_of()).first()[0]
    i_before, i = i, more
    assert refresh.refresh(spark, i, score, root, columns) == [mine]
    assert "u3" in asked[-1] and asked[-1] < {u for u, _ in whole}
    n = dict(whole)["u3"]
    assert rows() == whole - {("u3", n)} | {("u3", n + 1)}
    # a user that is gone, and another context
    i = i_before.where("user_id <> 'u5'")
    assert set(refresh.refresh(spark, i, score, root, columns)) == {mine, *[r[0] for r in spark.createDataFrame(
        [("u5",)], "user_id string").select(refresh.bucket_of()).collect()]}
    assert {u for u, _ in rows()} == {u for u, _ in whole} - {"u5"}
    assert len(refresh.refresh(spark, i, score, root, columns, context="new models")) == refresh.BUCKETS


def test_refresh_of_nothing(spark, data, tmp_path):
    i, _ = data
    none = i.limit(0)
    score = lambda users: none.join(users, "user_id", "left_semi").select("user_id", "problem_id")
    refresh.refresh(spark, none, score, str(tmp_path), ["problem_id"])
    assert refresh.read_pool(spark, str(tmp_path)).count() == 0
