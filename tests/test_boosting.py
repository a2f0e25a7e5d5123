"""Boosting over coded columns against the library's own on the vectors."""

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from orderlens.operators import boosting, ml_data, ml_models


def feature_rows(spark, n=900):
    """Rows with repeats, numerics of few and many values, categories of one and of several labels, and a tie in each."""
    place = lambda k, m: F.pmod(F.xxhash64(F.col("id") % 700, F.lit(k)), F.lit(m))
    numerics = [(place(k, m) / 2).alias(c) for k, (c, m) in enumerate(zip(ml_data.NUMERIC["A"], (4, 500, 50, 1, 90), strict=True))]
    categories = [
        F.concat(F.lit("v"), place(9 if c == "shipping_mode" else k + 20, m).cast("string")).alias(c)
        for k, (c, m) in enumerate(zip(ml_data.CATEGORICAL["A"], (4, 7, 5, 9, 30, 1, 3, 7), strict=True))
    ]
    label = (place(0, 4) + place(23, 9) + place(40, 6) > 8).cast("double").alias("label")
    return spark.range(n).select(*numerics, *categories, label)


@pytest.mark.parametrize("depth", [3, 1])
def test_scores_are_those_of_the_library(spark, monkeypatch, depth):
    rows, name = feature_rows(spark), ml_models.GRADIENT_BOOSTING
    options = {name: dict(maxIter=7, maxDepth=depth)}
    coded = ml_models.fit_models(rows, [name], overrides=options, partitions=3)[name]
    plain = ml_models.classifier
    monkeypatch.setattr(ml_models, "classifier", lambda *args, **kept: plain(*args, **kept).plain)
    library = ml_models.fit_models(rows, [name], overrides=options, partitions=3)[name]
    assert type(coded.stages[-1]) is type(library.stages[-1])
    gap = ml_models.score_difference(coded, library, rows).collect()[0]
    assert gap["n"] == 900 and gap["max_difference"] < 1e-9
    assert coded.stages[-1].treeWeights == library.stages[-1].treeWeights


def test_a_pass_sends_a_cell_a_code_and_not_a_row_a_slot(spark, monkeypatch):
    """Nothing is planned in a pass, and no rows of one-hot vectors are made for it."""
    seen, plain = [], boosting._pass

    def met(blocks, *rest):
        assert isinstance(blocks, RDD)
        found = plain(blocks, *rest)
        seen.append(found.shape)
        return found

    monkeypatch.setattr(boosting, "_pass", met)
    name = ml_models.GRADIENT_BOOSTING
    model = ml_models.fit_models(feature_rows(spark), [name], overrides={name: dict(maxIter=2)})[name]
    assert [s[:2] for s in seen] == [(3, 1), (3, 2), (3, 4)] * 2
    slots = model.stages[-1].numFeatures
    # Five numerics; each category has one code more than slots, which is that of unseen labels.
    assert all(s[2] <= 5 * ml_models.BINS + slots - 5 + 8 for s in seen)


def test_ties_go_to_the_first_slot_and_empty_sides_are_no_split():
    columns = boosting.Columns([2, 3], [2])
    sums = np.zeros((3, 8))
    for first, codes in ((0, (3.0, 5.0)), (2, (3.0, 5.0, 0.0)), (5, (3.0, 5.0, 0.0))):
        n = np.array(codes)
        sums[:, first : first + len(codes)] = [n, np.where(n == 3, -3.0, n), n]
    found = boosting.best_split(columns, sums)
    assert (found.slot, found.left_values, found.arity) == (0, [0.0], 2)
    assert found.left.tolist() == [3, -3, 3] and found.right.tolist() == [5, 5, 5]
    pure = sums.copy()
    pure[1] = pure[0]
    assert boosting.best_split(columns, pure) is None


def test_a_table_without_rows_is_refused(spark):
    coded = boosting.CodedBoosting(maxIter=1)
    coded.columns = boosting.Columns([2], [2])
    rows = spark.createDataFrame([], "codes array<smallint>, label double, n_equal double")
    with pytest.raises(ValueError):
        coded.fit(rows)
