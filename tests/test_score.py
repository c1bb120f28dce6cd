import math

import pytest
from pyspark.sql import functions as F

from retentia.functions import score as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_closed_forms(spark):
    fresh = S.composite(F.lit(1.0), S.frequency(F.lit(0.0)), S.utility(F.lit(0.0), F.lit(0.0)), F.lit(0.0))
    assert value(spark, fresh) == 0.45
    assert value(spark, S.time_to_threshold(F.lit(0.15), 0.3, 0.3)) == pytest.approx(math.log(2) / 0.005)
    assert value(spark, S.time_to_threshold(F.lit(0.4), 0.3, 0.3)) is None
    assert value(spark, S.recency(F.lit(0.0), 55 * 3600.0)) > 0.70
    assert value(spark, S.recency(F.lit(10.0), 0.0)) == 1.0
    assert value(spark, S.frequency(F.lit(50.0))) == 1.0 and value(spark, S.frequency(F.lit(5.0), 0)) == 0.0


@pytest.mark.parametrize("s, tier", [(0.30, "delete"), (0.300001, "compress"), (0.70, "compress"), (0.700001, "retain")])
def test_tier_bounds_are_strict(spark, s, tier):
    assert value(spark, S.tier(F.lit(s))) == tier


def test_weights():
    assert S.normalized({"r": 3, "f": 1}) == {"r": 0.75, "f": 0.25}
    assert set(S.leave_one_out({"r": 1.0, "f": 0.0})) == {"f"}
    with pytest.raises(ValueError):
        S.normalized({"r": 0.0})
