from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohera.operators.components import connected_components


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=30))
def test_random_graphs(spark, pairs):
    df = spark.createDataFrame(pairs, "u long, v long")
    assert {r.node: r.component for r in connected_components(df).collect()} == brute(pairs)


def test_long_path_star_and_nothing(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1500)]
    df = spark.createDataFrame([*path, *star, (5, None)], "u long, v long")
    assert {r.node: r.component for r in connected_components(df).collect()} == brute(path + star)
    assert connected_components(df.limit(0)).count() == 0
