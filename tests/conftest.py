import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("EDGECRAFT_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from edgecraft.session import checkpoint_dir
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def interactions(spark, sf):
    from edgecraft.plans import build
    return build.interactions(spark, sf)


@pytest.fixture
def sample_interactions(spark):
    """Three solvers on one small round; ``ivo`` never finishes a task."""
    rows = [
        ("ana", "cup-7", "fold-paper", True, 12.5, 0, "rust", 900.0, 0.3, ["Geometry", "Greedy"]),
        ("ana", "cup-7", "merge-rivers", False, None, 4, "rust", 900.0, 0.9, ["Union"]),
        ("mei", "cup-7", "fold-paper", True, 9.0, 1, "go", 2100.0, 0.3, ["Geometry", "Greedy"]),
        ("mei", "cup-7", "count-kites", True, 31.0, 0, "go", 2100.0, 1.2, ["Counting", "Greedy"]),
        ("ivo", "cup-7", "fold-paper", False, None, 2, "go", 600.0, 0.3, ["Geometry", "Greedy"]),
    ]
    schema = ("user_id string, contest_id string, problem_id string, solved boolean, "
              "finish_time_min double, penalty_count int, language string, user_rating double, "
              "difficulty_proxy double, tags array<string>")
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("normalized_score", F.when(F.col("penalty_count") > 0,
                                                    1.0 / (1.0 + F.col("penalty_count")))
                         .otherwise(F.col("solved").cast("double"))) \
        .withColumn("rank_percentile", F.col("user_rating") / 3000.0)


@pytest.fixture
def sample_problems(spark):
    rows = [("fold-paper", "Fold Paper", ["Geometry", "Greedy"], "Easy", 0.7),
            ("merge-rivers", "Merge Rivers", ["Union"], "Hard", 0.2),
            ("count-kites", "Count Kites", ["Counting", "Greedy"], "Medium", 0.4)]
    return spark.createDataFrame(rows, "problem_id string, title string, tags array<string>, "
                                       "difficulty_label string, acceptance_rate double")
