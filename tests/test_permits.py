"""Permits as boxes and rules as a table equal the compiled chain."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions.access import DEPARTMENTS, ROLES
from corvane.operators import permits, policy
from corvane.plans import registry

RESOURCE = {f"resource.{n}": n for n in ("owner_dept", "doc_type", "sensitivity")}


def resources(spark):
    rows = [(d, t, s) for d in [*DEPARTMENTS, "legal", None] for t in ["md", "csv", "aggregate", "pdf", None] for s in ["general", "internal", "confidential", "restricted", "new", None]]
    return spark.createDataFrame(rows, "owner_dept string, doc_type string, sensitivity string")


def chain(rows, rules, fixed):
    columns = {k: F.lit(v).cast("string") for k, v in fixed.items()} | {k: F.col(c) for k, c in RESOURCE.items()}
    return sorted(map(repr, rows.where(policy.compiled(rules, columns)["effect"] == "permit").collect()))


def test_boxes_equal_the_chain(spark):
    rows = resources(spark)
    for role in [*ROLES, "guest", None]:
        for action, flags in (("retrieve_chunk", {}), ("view_row", {}), ("view_masked_row", {"hr_masked_rows_mode": "enabled"}), ("aggregate_query", {"hr_aggregate_mode": "enabled"})):
            got = sorted(map(repr, permits.permitted(rows, role, action, flags=flags).collect()))
            fixed = {"subject.role": role, "action": action} | {f"flags.{k}": v for k, v in flags.items()}
            assert got == chain(rows, policy.POLICY, fixed), (role, action)
    boxes = permits.permits(spark, policy.POLICY, "finance", "retrieve_chunk")
    assert len(boxes) == 2  # general documents, and the own department's internal Markdown
    assert not permits.permits(spark, {"rules": []}, "hr", "view_row")
    with pytest.raises(ValueError, match="classes"):
        permits.permits(spark, {"rules": [{"effect": "permit", "when": {"all": [{"eq": ["resource.owner_dept", "resource.doc_type"]}]}}]}, "hr", "x")


def random_policy(seed, n=12):
    r = random.Random(seed)
    values = {"subject.role": [*ROLES, None], "resource.owner_dept": [*DEPARTMENTS, "legal", None], "resource.doc_type": ["md", "csv", None], "resource.sensitivity": ["internal", "restricted", None], "action": ["retrieve_chunk", "view_row"]}

    def condition():
        a = r.choice(list(values))
        if r.random() < 0.1:
            return r.choice([{"like": [a, "x"]}, "odd", {"eq": [a]}, {"eq": ["hr", "hr"]}, {"in": [a, None]}, {"in": ["hr", ["hr"]]}])
        op = r.choice(["eq", "ne", "in", "not_in"])
        if op in ("eq", "ne"):
            right = "subject.role" if a == "resource.owner_dept" and r.random() < 0.5 else r.choice(values[a])
            return {op: [a, right] if r.random() < 0.8 or right is None else [right, a]}
        return {op: [a, r.sample(values[a], r.randrange(len(values[a])))]}

    rules = [{"name": f"r{i}", "effect": r.choice(["permit", "deny"]), "when": r.choice([{"all": [condition() for _ in range(r.randrange(4))]}] * 8 + [{}, {"any": []}])} for i in range(n)]
    return {"default": r.choice(["permit", "deny"]), "rules": rules}


@pytest.mark.parametrize("seed", range(4))
def test_random_policies(spark, seed):
    rules, rows = random_policy(seed), resources(spark)
    for role in ("hr", None):
        got = sorted(map(repr, permits.permitted(rows, role, "view_row", rules).collect()))
        assert got == chain(rows, rules, {"subject.role": role, "action": "view_row"})
    asked = rows.withColumn("role", F.explode(F.array(*(F.lit(r).cast("string") for r in [*ROLES, None])))).withColumn("action", F.explode(F.array(F.lit("retrieve_chunk"), F.lit("view_row"))))
    columns = {"subject.role": F.col("role"), "action": F.col("action")} | {k: F.col(c) for k, c in RESOURCE.items()}
    both = permits.decided(asked.withColumn("x", policy.compiled(rules, columns)), rules, columns)
    assert both.count() == asked.count() and both.where("not (x.effect <=> effect and x.rule <=> rule)").count() == 0


def test_permits_prune_files(spark, tmp_path):
    rows = registry._of_departments(spark, "/root/testdata/sf0.001")
    plan = permits.permitted(rows, "finance")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "owner_dept" in filters and "PushedFilters: [" in plan
    found = permits.permitted(rows, "finance").select(F.col("_metadata.file_path").alias("f")).distinct()
    assert {r.f.split("owner_dept=")[1].split("/")[0] for r in found.collect()} == {"finance", "general"}
