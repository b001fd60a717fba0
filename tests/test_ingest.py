"""Ingest and clean."""

import json

from pyspark.sql import functions as F

from edgecraft.operators import clean
from edgecraft.sources import jsonl


def _records(spark, lines):
    return jsonl.parse_contest_lines(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_explode_keeps_one_row_per_submission(spark):
    feed = {"user_slug": "mei", "contest_id": "cup-7", "rank": 31,
            "submissions": {"901": {"fail_count": 3, "lang": "go", "date": 77},
                            "77": {"fail_count": 0, "date": 60}, "8": {"lang": None}}}
    rows = {r["frontend_id"]: r for r in clean.explode_records(_records(spark, [json.dumps(feed)])).collect()}
    assert {k: (r["solved"], r["penalty_count"], r["submission_date"]) for k, r in rows.items()} == {
        "901": (False, 3, 77), "77": (True, 0, 60), "8": (True, 0, None)}
    # a missing language is unknown, an explicit null is not
    assert {k: r["language"] for k, r in rows.items()} == {"901": "go", "77": "unknown", "8": None}
    assert {(r["contest_id"], r["rank"]) for r in rows.values()} == {("cup-7", 31)}


def test_explode_skips_what_is_not_a_record(spark):
    task = {"5": {"fail_count": 1}}
    feed = [json.dumps(x) for x in (
        {"user_slug": "", "contest_id": "cup-1", "submissions": task}, {"user_slug": "ana", "submissions": task},
        {"user_slug": "ana", "contest_id": "cup-1", "submissions": {}}, {"user_slug": "ana", "contest_id": "cup-1"},
        {"user_slug": "ivo", "contest_id": 12, "submissions": {"5": "done", "6": [1], "7": None}},
        {"_page": 4, "_empty": True})]
    recs = _records(spark, feed + ["{", "  "])
    assert clean.explode_records(recs).count() == 0
    assert jsonl.bad_record_audit(recs).first()["bad_lines"] == 1


def test_rank_as_python_reads_it(spark):
    ranks = [12, "12", 7.9, "7.9", " 3 ", "third", None]
    feed = [json.dumps({"user_slug": f"u{i}", "contest_id": "c", "rank": r, "submissions": {"1": {}}})
            for i, r in enumerate(ranks)]
    rows = {r["user_slug"]: r["rank"] for r in clean.explode_records(_records(spark, feed)).collect()}
    assert [rows[f"u{i}"] for i in range(len(ranks))] == [12, 12, 7, None, 3, None, None]


def test_folder_scan(spark, tmp_path):
    import pytest
    line = json.dumps({"user_slug": "ana", "contest_id": "cup-2", "rank": 2, "_page": 1,
                       "submissions": {"88": {"fail_count": 0, "lang": "rust", "date": 4000}}})
    with pytest.raises(FileNotFoundError):
        jsonl.read_contest_dir(spark, str(tmp_path))
    (tmp_path / "cup-2.jsonl").write_text(f"{line}\n\n<html>\n")
    (tmp_path / "cup-3.jsonl").write_text(line.replace('"_page": 1', '"_page": 0') + "\n")
    (tmp_path / "readme.md").write_text("not a feed\n")
    recs = jsonl.read_contest_dir(spark, str(tmp_path))
    assert [tuple(r) for r in jsonl.bad_record_audit(recs).collect()] == [("cup-2.jsonl", 1)]
    assert [r["_page"] for r in jsonl.limit_records(recs, 1).collect()] == [0]
    rows = clean.derive_contest_columns(clean.explode_records(recs)).collect()
    assert {(r["frontend_id"], r["rank_percentile"]) for r in rows} == {("88", -1.0)}      # rank 2 of one user
    jsonl.combine_files(spark, str(tmp_path), str(tmp_path / "all"))
    assert spark.read.text(str(tmp_path / "all")).count() == 4


def test_page_audit_reads_pages_and_sentinels(spark):
    from edgecraft.operators import extras
    pages = spark.createDataFrame([("cup-2", 1, None), ("cup-2", 1, None), ("cup-2", 3, True), ("cup-4", None, None)],
                                  "contest_id string, _page long, _empty boolean")
    expected = spark.createDataFrame([("cup-2", 76), ("cup-4", 0)], "contest_id string, user_num long")
    assert sorted(tuple(r) for r in extras.missing_pages(pages, expected).collect()) == [
        ("cup-2", 2), ("cup-2", 4), ("cup-4", 1)]
    assert sorted(tuple(r) for r in extras.page_audit(pages, expected).collect()) == [
        ("cup-2", 4, 2, 2), ("cup-4", 1, 0, 1)]


def test_ingest_resumes_without_repeats(spark, tmp_path):
    from edgecraft.streaming.ingest import run_ingest
    rec = lambda u, p: json.dumps({"user_slug": u, "contest_id": "cup-5", "_page": p})
    src, args = tmp_path / "src", (str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck"))
    src.mkdir()
    (src / "a.jsonl").write_text(rec("ana", 1) + "\n" + rec("ana", 1) + "\nbroken\n")
    assert run_ingest(spark, *args).count() == 1
    (src / "b.jsonl").write_text(rec("ana", 1) + "\n" + rec("ivo", 2) + "\n")
    assert sorted(r["user_slug"] for r in run_ingest(spark, *args).collect()) == ["ana", "ivo"]
    assert run_ingest(spark, *args).count() == 2


def test_rank_percentile_and_finish(spark):
    lines = [json.dumps({"user_slug": u, "contest_id": "c-1", "rank": r,
                         "submissions": {"1": {"fail_count": f, "lang": "py", "date": d}}})
             for u, r, f, d in [("a", 1, 0, 600), ("b", 4, 1, 660), ("c", None, 2, 690)]]
    rows = {r["user_slug"]: r for r in clean.derive_contest_columns(
        clean.explode_records(_records(spark, lines))).collect()}
    assert abs(rows["a"]["rank_percentile"] - (1 - 1 / 3)) < 1e-12
    assert abs(rows["b"]["rank_percentile"] - (1 - 4 / 3)) < 1e-12  # may go negative
    assert rows["c"]["rank_percentile"] == 0.5
    assert rows["a"]["finish_time_min"] == 0.0 and rows["c"]["finish_time_min"] == 1.5
    assert rows["b"]["normalized_score"] == 0.5 and rows["a"]["normalized_score"] == 1.0


def test_catalog_join_drops_and_reports_strangers(spark):
    rows = spark.createDataFrame([("88", "ana"), ("88", "ivo"), ("12", "ana"), ("12", "mei"), ("7", "mei")],
                                 "frontend_id string, user_slug string")
    cat = spark.createDataFrame([("88", "fold-paper", "Fold Paper", ["Geometry"]), ("7", "fold-paper", "Copy", [])],
                                "frontend_id string, problem_id string, title string, tags array<string>")
    assert {(r["user_slug"], r["problem_id"]) for r in clean.join_catalog(rows, cat).collect()} == {
        ("ana", "fold-paper"), ("ivo", "fold-paper"), ("mei", "fold-paper")}
    assert clean.dropped_by_catalog(rows, cat).count() == 2 and clean.problems_clean(cat).count() == 1


def test_drop_duplicate_keys_drops_every_copy(spark):
    df = spark.createDataFrame([("a", "p", "c", 1), ("a", "p", "c", 2), ("b", "p", "c", 3)],
                               "user_slug string, problem_id string, contest_id string, v int")
    keys = ["user_slug", "problem_id", "contest_id"]
    assert [r["v"] for r in clean.drop_duplicate_keys(df, keys).collect()] == [3]
    kept = sorted(r["v"] for r in clean.drop_duplicate_keys(df, keys, keep="first").collect())
    assert kept == [1, 3]


def test_clean_pipeline_invariants(spark, interactions):
    keys = interactions.groupBy("user_id", "problem_id", "contest_id").count()
    assert keys.where("count > 1").count() == 0
    stats = interactions.agg(F.min("difficulty_proxy"), F.max("difficulty_proxy"),
                             F.sum(F.col("user_id").isNull().cast("int"))).first()
    assert 0.1 <= stats[0] and stats[1] <= 3.0 and stats[2] == 0
    assert interactions.where("solved AND normalized_score <> 1.0").count() == 0


def test_user_hash_golden(spark):
    from edgecraft.functions.exprs import hash_user_id
    import hashlib
    row = spark.range(1).select(hash_user_id(F.lit("sample-solver"), "lrs_v1").alias("h")).first()
    assert row["h"] == hashlib.sha256(b"lrs_v1:sample-solver").hexdigest()[:16]


def test_normalise_tags(spark):
    df = spark.createDataFrame([("['a', 'b']",), (None,)], "tags string")
    out = [r["tags"] for r in clean.normalise_tags(df).collect()]
    assert out == [["a", "b"], []]
    m = spark.createDataFrame([("{'DP': 0.2}",)], "tag_scores string")
    assert clean.normalise_tag_scores(m).first()["tag_scores"] == {"DP": 0.2}


def test_json_and_table_paths_agree(spark, sf):
    from edgecraft.plans import build
    a = build.exploded_rows(spark, sf, "jsonl")
    b = build.exploded_rows(spark, sf, "tables")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
