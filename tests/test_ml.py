"""The cost-sensitive forest and the command line."""

import random

from tapestride.__main__ import main
from tapestride.operators import ml


def test_forest(spark, tmp_path):
    rng = random.Random(1)
    rows = [(float(x), None if i % 7 == 0 else rng.random(), int(x + rng.random() > 0.9)) for i, x in enumerate(rng.random() for _ in range(300))]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    model = ml.train_forest(df, ["a", "b"], "label", trees=5)
    ml.save(model, str(tmp_path / "m"))
    model = ml.load(str(tmp_path / "m"))
    even, careful, eager = (ml.expected_cost(df, model, ["a", "b"], fn, fp).agg({"predicted": "sum"}).first()[0] for fn, fp in ((1, 1), (1, 10), (10, 1)))
    assert careful <= even <= eager and careful < eager


def test_command(spark, sf, tmp_path):
    main(["redirects", "--data", sf, "--out", str(tmp_path / "r"), "--format", "tsv"])
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "r")).count() >= 0
