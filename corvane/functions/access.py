"""Access metadata of a resource: type, sensitivity, and the roles that may see it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Departments, roles and their order.
DEPARTMENTS = ["engineering", "finance", "marketing", "hr", "general"]
ROLES = ["finance", "marketing", "hr", "engineering", "c_level", "employee"]


def doc_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix == "md", "md").when(suffix == "csv", "csv").otherwise("unknown")


def default_sensitivity(dept: Column, kind: Column) -> Column:
    return F.when(dept == "general", "general").when((dept == "hr") & (kind == "csv"), "restricted").otherwise("internal")


def allowed_roles(dept: Column, kind: Column, sensitivity: Column) -> Column:
    """Roles admitted before any policy; an owner that is null stays in the list."""
    return (
        F.when(dept == "general", F.array(*map(F.lit, ROLES)))
        .when((kind == "md") & sensitivity.isin("general", "internal"), F.array(dept, F.lit("c_level")))
        .when((dept == "hr") & kind.isin("csv", "aggregate"), F.array(F.lit("hr"), F.lit("c_level")))
        .otherwise(F.array().cast("array<string>"))
    )


def role_flags(roles: Column) -> list[Column]:
    """A boolean column a role, which Parquet filters can use, and the sorted roles joined by commas."""
    return [F.array_contains(roles, r).alias(f"role_{r}") for r in ROLES] + [F.array_join(F.array_sort(roles), ",").alias("allowed_roles_str")]


def role_mask(holds) -> Column:
    """A bit for each role of ROLES for which holds(role) is true."""
    bits = (F.when(holds(r), 1 << i).otherwise(0) for i, r in enumerate(ROLES))
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("int")


def role_bit(role: Column) -> Column:
    """The bit of a role; 0 for a role that is none of ROLES, which sees nothing."""
    bits = (F.when(role == r, 1 << i).otherwise(0) for i, r in enumerate(ROLES))
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("int")


def with_role(rows: DataFrame, users: DataFrame, user: str = "user") -> DataFrame:
    """rows with the role of their user by a table of users (user, role); rows of unknown users are left out, as a refusal is."""
    return rows.join(users.select(user, "role"), user)
