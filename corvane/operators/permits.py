"""Two other forms of an ordered policy: filters that prune files, and rules as a table.

``permits`` turns the first-match chain, for one role and action, into disjoint boxes: lists
of departments, types and sensitivities that are permitted together. Their filter is made of
IN lists, which Parquet and partition pruning can use; the CASE of ``policy.compiled`` is
opaque to both.

``decided`` holds thousands of rules in a table from (attribute, value) to rules. A request
meets the postings of its own values; a rule holds if all its conditions were met and none
was broken, and the smallest number among those decides. Its cost grows with the rules that a
request's values occur in, not with all rules. Both equal ``policy.compiled``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import permutations, product
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import policy as P
from corvane.operators.sparse_index import bounded

FREE = ("resource.owner_dept", "resource.doc_type", "resource.sensitivity")
#: Stands for every value that no condition names.
OTHER = "\x00other"
#: Beside the number of conditions, what a broken one adds: no number of met ones makes up for it.
BROKEN = -1_000_000


def _path(x) -> bool:
    return isinstance(x, str) and (x == "action" or x.split(".")[0] in ("subject", "resource", "flags") and "." in x)


def _conditions(policy: dict):
    """Well-formed conditions: (left, operator, right)."""
    for rule in policy.get("rules") or []:
        when = rule.get("when")
        for c in (when.get("all") if isinstance(when, dict) and isinstance(when.get("all"), list) else None) or []:
            if isinstance(c, dict) and len(c) == 1:
                ((op, operands),) = c.items()
                if isinstance(operands, list) and len(operands) == 2:
                    yield operands[0], op, operands[1]


@dataclass(frozen=True)
class Box:
    """For each attribute the values that it may have; OTHER is every value not among ``named``."""

    values: dict[str, frozenset]
    named: dict[str, frozenset]

    def column(self, columns: dict[str, Column]) -> Column:
        parts = []
        for name, values in self.values.items():
            if values == self.named[name] | {None, OTHER}:
                continue
            c = columns[name]
            if OTHER in values:
                out = sorted(self.named[name] - values)
                part = ~c.isin(out) if out else c.isNotNull()
            else:
                part = c.isin(sorted(v for v in values if v is not None)) if values - {None} else F.lit(False)
            parts.append(part | c.isNull() if None in values else part)
        return reduce(and_, parts, F.lit(True))


def permits(spark: SparkSession, policy: dict, role: str | None, action: str, flags: dict[str, str] | None = None) -> list[Box]:
    """Disjoint boxes of what the policy permits to a role for an action.

    The values that conditions name, null, and one that stands for all others divide each attribute; the policy is
    asked once for each combination, and combinations that differ in one attribute only are joined. A condition
    that compares two attributes of a resource, or looks for a value inside a text, has no such classes and is refused.
    """
    fixed = {"subject.role": role, "action": action} | {f"flags.{k}": v for k, v in (flags or {}).items()}
    named: dict[str, set] = {a: set() for a in FREE}
    for left, op, right in _conditions(policy):
        sides = [x for x in (left, right) if _path(x)] if op in ("eq", "ne") else [left] if _path(left) else []
        free = [x for x in sides if x in named]
        if len(free) > 1 or free and op in ("in", "not_in") and right is not None and not isinstance(right, list):
            raise ValueError(f"no classes of values for {left} {op} {right}")
        for name in free:
            others = right if op in ("in", "not_in") else [right if name == left else left]
            named[name] |= {fixed.get(x) if _path(x) else x for x in others or []}
    classes = {a: [*sorted(v for v in vs if v is not None), None, OTHER] for a, vs in named.items()}
    cells = spark.createDataFrame(list(product(*classes.values())), ", ".join(f"`{a}` string" for a in FREE))
    columns = {k: F.lit(v).cast("string") for k, v in fixed.items()} | {a: F.col(f"`{a}`") for a in FREE}
    found = [tuple(r) for r in cells.where(P.compiled(policy, columns)["effect"] == "permit").collect()]  # as many as the policy's values combine to

    def joined(order) -> list[tuple[frozenset, ...]]:
        boxes = {tuple(frozenset([v]) for v in cell) for cell in found}
        for at in order:
            by: dict[tuple, frozenset] = {}
            for box in boxes:
                rest = (*box[:at], None, *box[at + 1 :])
                by[rest] = by.get(rest, frozenset()) | box[at]
            boxes = {(*rest[:at], values, *rest[at + 1 :]) for rest, values in by.items()}
        return sorted(boxes, key=repr)

    best = min((joined(order) for order in permutations(range(len(FREE)))), key=len)
    known = {a: frozenset(v for v in vs if v is not None) for a, vs in named.items()}
    return [Box(dict(zip(FREE, box, strict=True)), known) for box in best]


def permit_filter(boxes: list[Box], prefix: str = "") -> Column:
    """The boxes as a filter of rows with owner_dept, doc_type and sensitivity."""
    columns = {a: F.col(prefix + a.split(".")[1]) for a in FREE}
    return reduce(or_, (b.column(columns) for b in boxes), F.lit(False))


def permitted(rows: DataFrame, role: str | None, action: str = "retrieve_chunk", policy: dict | None = None, flags: dict[str, str] | None = None) -> DataFrame:
    """The rows that the policy permits to a role; files whose partition or statistics rule them out are not read."""
    boxes = permits(rows.sparkSession, policy or P.POLICY, role, action, flags)
    return rows.where(permit_filter(boxes))


# Rules as a table


def _value(x) -> str:
    """Values as keys of one column, null among them."""
    return "null" if x is None else f"={x}"


def rule_rows(policy: dict) -> tuple[list[tuple], list[tuple], set[str], set[tuple[str, str]]]:
    """(postings, rules, attributes, pairs) of a policy: postings (attribute, value, rule, points), rules (rule, need, effect, name).

    pairs are attributes that conditions compare with each other; their attribute is "a=b" with the value true or false.
    """
    postings, rules, names, pairs = [], [], set(), set()
    for number, rule in enumerate(policy.get("rules") or []):
        when = rule.get("when")
        every = when.get("all") if isinstance(when, dict) else None
        if not isinstance(every, list):
            continue  # without conditions it is skipped; a malformed one holds for nothing
        met, need, sound = [], 0, True
        for c in every:
            op, operands = next(iter(c.items())) if isinstance(c, dict) and len(c) == 1 else (None, None)
            if op not in ("eq", "ne", "in", "not_in") or not isinstance(operands, list) or len(operands) != 2:
                sound = False
                break
            left, right = operands
            if op in ("eq", "ne"):
                if not _path(left) and not _path(right):
                    name, values = None, left == right
                elif _path(left) and _path(right):
                    name, values = f"{left}={right}", ["true"]
                    pairs.add((left, right))
                else:
                    name, values = (left, [_value(right)]) if _path(left) else (right, [_value(left)])
                    names.add(name)
            elif not isinstance(right, list) and right is not None:
                raise ValueError(f"a value inside a text has no postings: {c}")
            elif _path(left):
                name, values = left, sorted({_value(v) for v in right or []})
                names.add(left)
            else:
                name, values = None, left in (right or [])
            wanted = op in ("eq", "in")
            if name is None:  # two constants
                sound &= values == wanted
            else:
                need += wanted
                met += [(name, v, number, 1 if wanted else BROKEN) for v in values]
        if sound:
            if need == 0:
                met, need = [*met, ("", "", number, 1)], 1
            postings += met
            rules.append((number, need, rule.get("effect", policy.get("default", "deny")), rule.get("name")))
    return postings, rules, names, pairs


def decided(rows: DataFrame, policy: dict, columns: dict[str, Column]) -> DataFrame:
    """rows with effect and rule, as ``policy.compiled`` gives them. columns: attribute -> column, as there.

    Equal requests are decided once: rows are brought down to the combinations of values that occur.
    """
    spark = rows.sparkSession
    postings, rules, names, pairs = rule_rows(policy)
    read = lambda a: columns.get(a, F.lit(None)).cast("string")
    wanted = sorted(names | {a for p in pairs for a in p})
    keyed = rows.withColumn("_request", F.struct(*(read(a).alias(f"v{i}") for i, a in enumerate(wanted)), F.lit(0).alias("v")))
    keyed = keyed.withColumn("_key", F.sha2(F.to_json("_request", {"ignoreNullFields": "false"}).cast("binary"), 256))
    requests = keyed.groupBy("_key").agg(F.first("_request").alias("r"))
    own = {a: F.col(f"r.v{i}") for i, a in enumerate(wanted)}
    said = [(a, F.when(own[a].isNull(), "null").otherwise(F.concat(F.lit("="), own[a]))) for a in sorted(names)]
    said += [(f"{a}={b}", own[a].eqNullSafe(own[b]).cast("string")) for a, b in sorted(pairs)]
    said.append(("", F.lit("")))
    asked = requests.select("_key", F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), v.alias("value")) for a, v in said))).alias("s")).select("_key", "s.*")
    table = spark.createDataFrame(postings, "attribute string, value string, rule int, points int")
    needs = spark.createDataFrame(rules, "rule int, need int, effect string, name string")
    holds = asked.join(bounded(table), ["attribute", "value"]).groupBy("_key", "rule").agg(F.sum("points").alias("points")).join(bounded(needs), "rule").where("points = need")
    first = holds.groupBy("_key").agg(F.min_by(F.struct("effect", "name"), "rule").alias("x")).select("_key", "x.*")
    out = keyed.join(bounded(first), "_key", "left").drop("_key", "_request")
    return out.withColumn("rule", F.col("name")).withColumn("effect", F.coalesce("effect", F.lit(policy.get("default", "deny")))).drop("name")
