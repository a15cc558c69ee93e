"""An ordered access policy compiled to one Column.

Rules are tried in order; the first whose conditions all hold decides. The rules
become a CASE chain, so a decision costs no join and no Python, and Catalyst
folds what literals decide. Equality is null-safe: null equals null, and null is
in no list.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HR, _READ = ["hr", "c_level"], ["retrieve_chunk", "view_source"]


def _rule(name: str, effect: str, *conditions: dict) -> dict:
    return {"name": name, "effect": effect, "when": {"all": list(conditions)}}


# The rules, in order, and their default.
POLICY = {
    "default": "deny",
    "rules": [
        _rule("c_level_full_access", "permit", {"eq": ["subject.role", "c_level"]}),
        _rule("general_docs_any_role", "permit", {"eq": ["resource.owner_dept", "general"]}, {"in": ["action", _READ]}),
        _rule("same_department_internal_docs", "permit", {"eq": ["resource.doc_type", "md"]}, {"in": ["resource.sensitivity", ["general", "internal"]]}, {"eq": ["subject.role", "resource.owner_dept"]}, {"in": ["action", _READ]}),
        _rule("employee_non_general_deny", "deny", {"eq": ["subject.role", "employee"]}, {"ne": ["resource.owner_dept", "general"]}),
        _rule("cross_department_deny", "deny", {"eq": ["resource.doc_type", "md"]}, {"not_in": ["subject.role", ["c_level"]]}, {"ne": ["subject.role", "resource.owner_dept"]}, {"ne": ["resource.owner_dept", "general"]}),
        _rule("hr_rows_hr_and_c_level_only", "permit", {"eq": ["resource.owner_dept", "hr"]}, {"eq": ["resource.doc_type", "csv"]}, {"eq": ["action", "view_row"]}, {"in": ["subject.role", _HR]}),
        _rule("non_hr_hr_rows_deny", "deny", {"eq": ["resource.owner_dept", "hr"]}, {"eq": ["resource.doc_type", "csv"]}, {"eq": ["action", "view_row"]}, {"not_in": ["subject.role", _HR]}),
        _rule("hr_masked_rows_non_hr_if_enabled", "permit", {"eq": ["flags.hr_masked_rows_mode", "enabled"]}, {"eq": ["resource.owner_dept", "hr"]}, {"eq": ["resource.doc_type", "csv"]}, {"eq": ["action", "view_masked_row"]}, {"not_in": ["subject.role", _HR]}),
        _rule("hr_masked_rows_hr_and_c_level", "permit", {"eq": ["resource.owner_dept", "hr"]}, {"eq": ["resource.doc_type", "csv"]}, {"eq": ["action", "view_masked_row"]}, {"in": ["subject.role", _HR]}),
        _rule("hr_aggregates_non_hr_if_enabled", "permit", {"eq": ["flags.hr_aggregate_mode", "enabled"]}, {"eq": ["resource.owner_dept", "hr"]}, {"eq": ["resource.doc_type", "aggregate"]}, {"in": ["action", [*_READ, "aggregate_query"]]}, {"not_in": ["subject.role", _HR]}),
        _rule("hr_aggregates_hr_and_c_level", "permit", {"eq": ["resource.owner_dept", "hr"]}, {"eq": ["resource.doc_type", "aggregate"]}, {"in": ["action", [*_READ, "aggregate_query"]]}, {"in": ["subject.role", _HR]}),
        _rule("high_sensitivity_md_deny_by_default", "deny", {"eq": ["resource.doc_type", "md"]}, {"in": ["resource.sensitivity", ["confidential", "restricted"]]}, {"not_in": ["subject.role", ["c_level"]]}),
    ],
}


def _operand(value, columns: dict[str, Column]) -> Column:
    """A literal, or the column that a path (subject., resource., flags., or action) names; unknown paths are null."""
    if isinstance(value, str) and (value == "action" or value.split(".")[0] in ("subject", "resource", "flags") and "." in value):
        return columns.get(value, F.lit(None).cast("string"))
    return F.lit(value)


def condition(spec, columns: dict[str, Column]) -> Column:
    """One condition; anything malformed holds for nothing."""
    if not isinstance(spec, dict) or len(spec) != 1:
        return F.lit(False)
    ((op, operands),) = spec.items()
    if not isinstance(operands, list) or len(operands) != 2:
        return F.lit(False)
    left, right = _operand(operands[0], columns), operands[1]
    if op in ("eq", "ne"):
        same = left.eqNullSafe(_operand(right, columns))
        return same if op == "eq" else ~same
    if op in ("in", "not_in"):
        if isinstance(right, list):
            found = F.coalesce(left.isin([x for x in right if x is not None]), F.lit(None in right)) if right else F.lit(False)
        elif right is None:
            found = F.lit(False)
        else:
            found = F.coalesce(F.contains(_operand(right, columns), left), F.lit(False))
        return found if op == "in" else ~found
    return F.lit(False)


def compiled(policy: dict, columns: dict[str, Column]) -> Column:
    """The policy as a struct column (effect, rule)."""
    default = policy.get("default", "deny")

    def decision(effect: str, rule: str | None) -> Column:
        return F.struct(F.lit(effect).alias("effect"), F.lit(rule).cast("string").alias("rule"))

    out = None
    for rule in policy.get("rules") or []:
        when = rule.get("when")
        if not when:
            continue
        every = when.get("all") if isinstance(when, dict) else None
        holds = reduce(and_, (condition(c, columns) for c in every), F.lit(True)) if isinstance(every, list) else F.lit(False)
        then = decision(rule.get("effect", default), rule.get("name"))
        out = F.when(holds, then) if out is None else out.when(holds, then)
    last = decision(default, None)
    return last if out is None else out.otherwise(last)


def decision(role: Column, action: Column, flags: dict[str, Column] | None = None, policy: dict | None = None, prefix: str = "") -> Column:
    """The decision on rows with owner_dept, doc_type and sensitivity."""
    columns = {"subject.role": role, "action": action} | {f"resource.{n}": F.col(prefix + n) for n in ("owner_dept", "doc_type", "sensitivity")} | {f"flags.{k}": v for k, v in (flags or {}).items()}
    return compiled(policy or POLICY, columns)


def permitted(rows: DataFrame, role: Column, action: str = "retrieve_chunk", policy: dict | None = None) -> DataFrame:
    """Rows that the policy permits, with their decision."""
    return rows.withColumn("decision", decision(role, F.lit(action), policy=policy)).where("decision.effect = 'permit'")


def authorized(rows: DataFrame, role: Column, action: Column, flags: dict[str, Column] | None = None) -> DataFrame:
    """rows with the rule that permits them; the first row that is denied fails the job with 403 and the rule."""
    x = decision(role, action, flags)
    refusal = F.raise_error(F.concat(F.lit("403 "), F.coalesce(x["rule"], F.lit("no rule"))))
    return rows.withColumn("rule", F.when(x["effect"] == "permit", x["rule"]).otherwise(refusal))


def load(path: str) -> dict:
    """A policy file (YAML or JSON) in the form of POLICY."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    return yaml.safe_load(text)
