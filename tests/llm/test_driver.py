"""What the corpus operators ask of the driver."""

import gc

from querent.llm import components, shared


def labels(monkeypatch):
    seen, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, label: seen.append(label) or write(df, label))
    return seen


def test_a_forest_of_stars_takes_no_further_step(spark, monkeypatch):
    seen = labels(monkeypatch)
    edges = [(5, 1), (1, 9), (7, 1), (4, 3), (3, 3)]
    got = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (3, 3), (4, 3), (5, 1), (7, 1), (9, 1)]
    assert seen == ["edges", "minima"]


def test_a_star_around_another_node_than_its_least_is_no_result(spark, monkeypatch):
    seen = labels(monkeypatch)
    got = components.components(spark.createDataFrame([(9, 1), (9, 2), (9, 30)], "u long, v long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (9, 1), (30, 1)]
    assert "large" in seen


def test_the_driver_gives_its_heap_back(spark, monkeypatch):
    runtime = spark._jvm.Runtime.getRuntime()
    held = spark.sparkContext._gateway.new_array(spark._jvm.long, 75 << 20)
    grown = runtime.totalMemory()
    del held
    monkeypatch.setattr(shared, "HEAP", 0.1)
    monkeypatch.setattr(shared, "_after", {})
    gc.collect()  # the array's last reference goes with its Python proxy
    shared.written(spark.range(3), "small").count()
    assert runtime.totalMemory() < grown - (300 << 20)
