import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peakloom.functions.scalars import id_width, isotope_prefix_match, padded_id, prefix_lengths
from peakloom.operators.grouping import prefix_match


@pytest.mark.parametrize(
    ("c", "r", "want"),
    [(2, 2, (2, 2)), (3, 4, (2, 3)), (4, 5, (3, 4)), (6, 9, (4, 5)), (8, 6, (4, 5)), (9, 20, (5, 6)), (1, 5, None), (5, 1, None)],
)
def test_prefix_lengths(c, r, want):
    assert prefix_lengths(c, r) == want


@pytest.mark.parametrize(("n", "w"), [(9, 1), (10, 2), (99, 2), (100, 3)])
def test_id_width(n, w):
    assert id_width(n) == w


def test_padded_id(spark):
    assert [r[0] for r in spark.range(1, 4).select(padded_id("FT", F.col("id"), 100)).collect()] == ["FT001", "FT002", "FT003"]


masses = st.lists(st.integers(0, 30), min_size=0, max_size=8, unique=True).map(lambda v: [x / 10 for x in sorted(v)])


def test_expression_is_the_array_form(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(300):
        a, b = (sorted({round(float(x), 1) for x in rng.uniform(0, 6, rng.integers(0, 9))}) for _ in range(2))
        rows.append((a, b))
    df = spark.createDataFrame(rows, "c array<double>, r array<double>")
    got = [x[0] for x in df.select(isotope_prefix_match("c", "r", 0.45)).collect()]
    assert got == [prefix_match(np.array(a), np.array(b), 0.45) for a, b in rows]
    assert any(got)
    assert not all(got)


@settings(max_examples=50, deadline=None)
@given(masses)
def test_a_list_matches_itself(m):
    k = prefix_lengths(len(m), len(m))
    assert prefix_match(np.array(m), np.array(m), 0.01) == (k is not None and math.isfinite(k[0]))
