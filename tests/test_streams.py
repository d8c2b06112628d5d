from pyspark.sql import functions as F

from vitalspark.streaming import state

VALUES = "workspace_key string, pkey string, source string, source_column string, external_id string, occurred_at string, value string"


def test_routing_waits_for_decisions(spark, tmp_path):
    """Three runs: no decision, the first ones, a later one; a null in the key is a key of its own."""
    at = lambda name: str(tmp_path / name)

    def run(values, decisions):
        spark.createDataFrame([("w", p, "s", "c", e, "", v) for p, e, v in values], VALUES).write.mode("append").parquet(at("values"))
        rows = spark.createDataFrame([("w", p, "s", "c", verdict, "n", "rule", t, i) for p, verdict, t, i in decisions], state.KNOWN.replace("timestamp", "long")).withColumn("decided_at", F.timestamp_seconds("decided_at"))
        rows.write.mode("append").parquet(at("decisions"))
        query = state.start_routing(*(spark.readStream.schema(s).parquet(at(n)) for n, s in (("values", VALUES), ("decisions", state.KNOWN))), at("out"), at("checkpoint"))
        query.awaitTermination()
        # All keys of a batch are routed by Spark's joins: no operator calls Python for each key.
        assert query.lastProgress["stateOperators"] == []
        return sorted((r.kind, r.pkey or "", r.value, r.verdict or "") for r in spark.read.schema(state.ROUTED).parquet(at("out")).collect())

    first = [("request", "", "x", ""), ("request", "a", "1", "")]
    assert run([("a", "1", "1"), ("a", "2", "2"), (None, "3", "x")], []) == first
    second = sorted([*first, ("request", "b", "9", ""), ("routed", "", "x", "append"), ("routed", "a", "1", "join"), ("routed", "a", "2", "join"), ("routed", "a", "3", "join")])
    assert run([("a", "4", "3"), ("b", "5", "9")], [("a", "append", 1, "1"), ("a", "join", 1, "2"), (None, "append", 1, "3")]) == second
    third = sorted([*second, ("routed", "a", "4", "unclear"), ("routed", "a", "5", "unclear")])
    assert run([("a", "6", "4"), ("b", "7", "8"), ("a", "8", "5")], [("a", "unclear", 2, "0")]) == third
    assert sorted(p.name for p in (tmp_path / "checkpoint" / "routing").iterdir()) == ["1", "2"]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("w", "a", "s", "c", "1", "", "1", None, None, None, None, None, False)], f"{VALUES}, verdict string, canonical_name string, decided_by string, decided_at timestamp, id string, is_decision boolean")
    for _ in range(2):
        state._route_batch(rows, 0, f"{tmp_path}/out", f"{tmp_path}/state")
    assert [r.kind for r in spark.read.schema(state.ROUTED).parquet(f"{tmp_path}/out").collect()] == ["request"]
    assert spark.read.schema(state.WAITING).parquet(f"{tmp_path}/state/0/waiting").count() == 1
