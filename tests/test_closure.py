"""The closure goes to its fixpoint, however long that takes."""

from pyspark.sql import functions as F

from attesta.operators import datalog


def test_a_chain_of_more_than_64_edges(spark, monkeypatch):
    monkeypatch.setattr(datalog, "checkpointed", lambda df: spark.createDataFrame(df.toArrow()).coalesce(1))  # 68 rounds in seconds
    L, n = datalog.Literal, 66
    atoms = datalog.atoms_of(spark, [("at", ["0"]), *(("edge", [str(i), str(i + 1)]) for i in range(n))])
    closed = datalog.closure(atoms, [datalog.Rule("step", L("at", ("?y",)), (L("at", ("?x",)), L("edge", ("?x", "?y"))))])
    assert {r["x"] for r in closed.where("pred = 'at'").select(F.col("args")[0].alias("x")).collect()} == {str(i) for i in range(n + 1)}
    goals = datalog.atoms_of(spark, [("at", [str(n)]), ("at", [str(n + 1)])])
    assert {r.args[0]: r.status for r in datalog.derive(goals, closed).collect()} == {str(n): "proved", str(n + 1): "refuted"}
