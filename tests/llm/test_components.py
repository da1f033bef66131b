"""Components that have not converged are an error."""

from __future__ import annotations

import pytest

from gridquill.llm import graph


def test_no_convergence(spark, monkeypatch):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {tuple(r) for r in graph.components(path).collect()} == {(i, 0) for i in range(41)}
    monkeypatch.setattr(graph, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        graph.components(path)
