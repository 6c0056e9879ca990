import math
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import stores
from lodestrata.operators.percentiles import exact_percentiles

SHARES = (0.0, 0.001, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0)


def nearest(values, p):
    order = sorted(values, key=lambda x: (math.isnan(x), x))
    return order[max(math.ceil(round(p * len(order), 9)), 1) - 1]


@pytest.mark.parametrize("kind", ["long", "double"])
def test_percentiles_are_observed_values(spark, kind):
    rng = random.Random(kind)
    make = {
        "long": lambda: rng.choice([rng.randint(-5, 5), rng.randint(-(2**62), 2**62), 2**63 - 1, -(2**63), 1 << 48, (1 << 48) + 1]),
        "double": lambda: rng.choice([rng.gauss(0, 1), -0.0, 0.0, 1e300, -1e-300, 5e-324, rng.random() * 1e-5, math.inf, -math.inf, math.nan]),
    }[kind]
    rows = [(rng.choice(["a", "b", None]), make() if rng.random() < 0.95 else None) for _ in range(3000)] + [("one", make())] + [("none", None)]
    rows += [("hot", rows[0][1])] * 2000
    got = exact_percentiles(spark.createDataFrame(rows, f"g string, v {kind}").repartition(5), ["g"], "v", SHARES).collect()
    want = {(g, p): nearest([v for h, v in rows if h == g and v is not None], p) for g in ("a", "b", None, "one", "hot") for p in SHARES}
    assert {(r["g"], r["share"]): repr(r["value"] + 0) for r in got} == {k: repr(v + 0) for k, v in want.items()}
    assert len(got) == len(want)


def test_without_groups_and_without_rows(spark):
    df = spark.range(1, 1001).withColumn("id", F.col("id").cast("int"))
    assert {r["share"]: r["value"] for r in exact_percentiles(df, [], "id", (0.95, 0.5, 0.07)).collect()} == {0.95: 950, 0.5: 500, 0.07: 70}
    assert exact_percentiles(df.limit(0), [], "id", (0.5,)).collect() == []
    with pytest.raises(TypeError):
        exact_percentiles(df.select(F.lit("x").alias("id")), [], "id", (0.5,))


def test_token_distribution_of_nothing(spark):
    none = spark.createDataFrame([], "tokens int")
    assert [tuple(r) for r in stores.token_distribution(none).collect()] == [(None, None, None, None, None)]
