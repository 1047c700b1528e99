import math

from quillon.operators import graph, learning, relations
from quillon.sources import lines


def test_logistic_follows_row_order(spark):
    rows = [(1, i, float(i % 3), None if i == 4 else i / 10, i % 2) for i in range(8)]
    df = spark.createDataFrame(rows, "g int, ord int, a double, b double, y int")
    got = learning.train_logistic(df.orderBy("a"), "g", "ord", ["a", "b"], "y", epochs=20).first()
    w = [0.0, 0.0, 0.0]
    for _ in range(20):
        for _, _, a, b, y in rows:
            x = [1.0, a, b or 0.0]
            err = 1 / (1 + math.exp(-sum(p * q for p, q in zip(w, x)))) - y
            w = [p - 0.3 * err * q for p, q in zip(w, x)]
    assert all(abs(p - q) < 1e-9 for p, q in zip((got.bias, got.a, got.b), w))


def test_cover_takes_cheapest_gain_and_breaks_ties_by_name(spark):
    df = spark.createDataFrame([(1, "t2", "x", 2), (1, "t1", "x", 2), (1, "t3", "x", 3), (1, "t3", "y", 3), (1, "t4", "z", 9), (2, "q", None, 1)], "g int, item string, el string, w int")
    got = [(r.place, r.item) for r in learning.cover(df, "g", "item", "el", "w").orderBy("place").collect()]
    assert got == [(1, "t3"), (2, "t4")]


def test_strong_components_of_nested_cycles(spark):
    e = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (7, 7), (6, 8)]
    got = {r.id: r.component for r in graph.strong_components(spark.createDataFrame(e, "src int, dst int")).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 5, 5: 5}
    assert graph.strong_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_recurred_never_on_null_or_empty_keys(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, None), (3, []), (4, ["b", "a"]), (5, ["c"])], "id int, k array<string>")
    got = {r.id: r.recurred for r in relations.recurred(df, "id", df["k"]).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True, 5: False}


def test_lines_of_null_and_unfenced_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a\n## B\nc")], "id int, t string")
    got = [(r.id, r.line, r.section) for r in lines.sections(df, "id", "t").orderBy("id", "line").collect()]
    assert got == [(2, 1, None), (3, 1, None), (3, 2, "B"), (3, 3, "B")]
