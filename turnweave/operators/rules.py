"""Contracts as data: a table of rules, one aggregate per artifact, one report of all violations.

A rule names an artifact, a kind, columns and values.  Row rules of an artifact
become counts in one pass over it, rules on groups one count per distinct key set,
rules between artifacts semi and anti joins on distinct keys.  Nothing raises on
the way: the report says how many rows or groups break each rule, and
``require`` raises once, with everything that is wrong.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_finite, to_number

#: kinds that look at one row
ROW_KINDS = ("present", "finite", "among", "between", "implies")
#: kinds that look at groups of an artifact
GROUP_KINDS = ("unique", "at_most", "one_value")
#: kinds that compare an artifact with another
CROSS_KINDS = ("disjoint", "contained", "same_keys", "equal_columns")
#: kinds that look at the artifact as a whole
WHOLE_KINDS = ("rows", "distinct")


@dataclass(frozen=True)
class Rule:
    """``name`` is unique in a report; ``columns`` and ``values`` mean what the kind says.

    present            none of the columns is null or blank
    finite             every column is a finite number
    among              the column is one of the values; a missing value is let pass
    between            the column lies between two values; a missing value is let pass
    implies            where column 0 equals value 0, column 1 equals value 1
    unique             the columns together occur once
    at_most            no group of the columns has more than value 0 rows, among rows where value 1 equals value 2 if given
    one_value          rows equal in all columns but the last are equal in the last
    rows, distinct     the number of rows, or of distinct keys, is value 0
    disjoint           no key (columns) is also in the artifact named by value 0
    contained          every key is in the artifact named by value 0
    same_keys          both, counted from either side
    equal_columns      joined on all columns but the last, the last is the same in the artifact named by value 0
    """

    name: str
    artifact: str
    kind: str
    columns: tuple[str, ...] = ()
    values: tuple = ()


def rules_from_table(rows: DataFrame) -> list[Rule]:
    """Rules from a table (name, artifact, kind, columns array, values array); values that read as numbers are numbers."""

    def value(text: str):
        for kind in (int, float):
            try:
                return kind(text)
            except ValueError:
                continue
        return text

    told = rows.select("name", "artifact", "kind", "columns", "values").collect()  # a contract's rules, written by hand
    return [Rule(r["name"], r["artifact"], r["kind"], tuple(r["columns"] or ()), tuple(value(v) for v in r["values"] or ())) for r in told]


def _blank(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == ""


def _broken_row(rule: Rule) -> Column:
    c = rule.columns
    if rule.kind == "present":
        broken = _blank(c[0])
        for other in c[1:]:
            broken = broken | _blank(other)
        return broken
    if rule.kind == "finite":
        broken = ~is_finite(F.col(c[0]))
        for other in c[1:]:
            broken = broken | ~is_finite(F.col(other))
        return broken
    if rule.kind == "among":
        return F.coalesce(~F.col(c[0]).isin(*rule.values), F.lit(False))
    if rule.kind == "between":
        number = to_number(F.col(c[0]), None)
        return F.coalesce((number < rule.values[0]) | (number > rule.values[1]), F.lit(False))
    met = F.col(c[0]).eqNullSafe(F.lit(rule.values[0]))
    return met & ~F.col(c[1]).eqNullSafe(F.lit(rule.values[1]))


def _row_counts(frame: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, checked, violations) of all row rules and sizes, from one pass."""
    marks = [F.struct(F.lit(r.name).alias("rule"), F.count(F.lit(1)).alias("checked"), F.count_if(_broken_row(r)).alias("violations")) for r in rules if r.kind in ROW_KINDS]
    marks += [
        F.struct(F.lit(r.name).alias("rule"), F.count(F.lit(1)).alias("checked"), F.abs(F.count(F.lit(1)) - F.lit(int(r.values[0]))).cast("bigint").alias("violations"))
        for r in rules
        if r.kind == "rows"
    ]
    return frame.agg(F.array(*marks).alias("m")).select(F.inline("m"))


def _group_counts(frame: DataFrame, rule: Rule) -> DataFrame:
    keys = list(rule.columns)
    if rule.kind == "one_value":
        *keys, value = keys
        groups = frame.select(*keys, value).distinct().groupBy(*keys).count()
        broken = F.col("count") > 1
    else:
        rows = frame
        if rule.kind == "at_most" and len(rule.values) == 3:
            rows = rows.where(F.col(rule.values[1]) == rule.values[2])
        groups = rows.groupBy(*keys).count()
        broken = F.col("count") > (1 if rule.kind == "unique" else rule.values[0])
    if rule.kind == "distinct":
        off = F.abs(F.count(F.lit(1)) - F.lit(int(rule.values[0]))).cast("bigint")
        return groups.agg(F.lit(rule.name).alias("rule"), F.count(F.lit(1)).alias("checked"), off.alias("violations"))
    return groups.agg(F.lit(rule.name).alias("rule"), F.count(F.lit(1)).alias("checked"), F.count_if(broken).alias("violations"))


def _cross_counts(frame: DataFrame, other: DataFrame, rule: Rule) -> DataFrame:
    keys = list(rule.columns)
    if rule.kind == "equal_columns":
        *keys, value = keys
        right = other.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_value"))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        joined = frame.select(*keys, value).join(right, on)
        differs = ~F.col(value).eqNullSafe(F.col("_value"))
        return joined.agg(F.lit(rule.name).alias("rule"), F.count(F.lit(1)).alias("checked"), F.count_if(differs).alias("violations"))
    sides = frame.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).union(other.select(*keys, F.lit(0), F.lit(1)))
    seen = sides.groupBy(*keys).agg(F.max("_l").alias("l"), F.max("_r").alias("r"))
    broken = {
        "disjoint": (F.col("l") == 1) & (F.col("r") == 1),
        "contained": (F.col("l") == 1) & (F.col("r") == 0),
        "same_keys": F.col("l") != F.col("r"),
    }[rule.kind]
    mine = F.lit(True) if rule.kind == "same_keys" else F.col("l") == 1
    return seen.agg(F.lit(rule.name).alias("rule"), F.count_if(mine).alias("checked"), F.count_if(broken).alias("violations"))


def report(artifacts: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """``artifact, rule, kind, checked, violations`` of every rule; ``checked`` counts rows, groups or keys.

    A missing artifact or column is a violation of the rule that names it, not an
    error: such a rule has checked 0 and violations null.
    """
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise ValueError("rules of one report need different names")
    known = {*ROW_KINDS, *GROUP_KINDS, *CROSS_KINDS, *WHOLE_KINDS}
    strange = sorted({r.kind for r in rules} - known)
    if strange:
        raise ValueError(f"unknown kinds of rules: {strange}")

    def there(r: Rule) -> bool:
        needed = [r.artifact, *([r.values[0]] if r.kind in CROSS_KINDS else [])]
        columns = [*r.columns, *([r.values[1]] if r.kind == "at_most" and len(r.values) == 3 else [])]
        return all(a in artifacts and set(columns) <= set(artifacts[a].columns) for a in needed)

    ready = [r for r in rules if there(r)]
    counts = []
    for name, frame in artifacts.items():
        mine = [r for r in ready if r.artifact == name]
        simple = [r for r in mine if r.kind in ROW_KINDS or r.kind == "rows"]
        if simple:
            counts.append(_row_counts(frame, simple))
        counts += [_group_counts(frame, r) for r in mine if r.kind in GROUP_KINDS or r.kind == "distinct"]
        counts += [_cross_counts(frame, artifacts[r.values[0]], r) for r in mine if r.kind in CROSS_KINDS]
    spark = next(iter(artifacts.values())).sparkSession
    listed = spark.createDataFrame([(r.artifact, r.name, r.kind) for r in rules], "artifact string, rule string, kind string")
    found = spark.createDataFrame([], "rule string, checked bigint, violations bigint")
    for c in counts:
        found = found.union(c)
    out = listed.join(found, "rule", "left")
    return out.select("artifact", "rule", "kind", F.coalesce("checked", F.lit(0)).alias("checked"), "violations")


def require(artifacts: Mapping[str, DataFrame], rules: Sequence[Rule]) -> None:
    """Raise once, naming every broken rule and how often it is broken."""
    broken = report(artifacts, rules).where("violations is null or violations > 0").orderBy("artifact", "rule").collect()  # a row a rule
    if broken:
        told = [f"{r['artifact']}: {r['rule']} ({'cannot be checked' if r['violations'] is None else r['violations']})" for r in broken]
        raise RuntimeError("; ".join(told))


def scored_split_rules(artifact: str, max_candidates: int = 5) -> list[Rule]:
    """The contract of a scored split."""
    p = f"{artifact}_"
    return [
        Rule(p + "keys_present", artifact, "present", ("session_id", "Q1_row", "Q2_row", "edge_id")),
        Rule(p + "numbers_finite", artifact, "finite", ("edge_label", "stage1_pred_edge", "stage1_prob")),
        Rule(p + "labels", artifact, "among", ("edge_label",), (0, 1)),
        Rule(p + "predictions", artifact, "among", ("stage1_pred_edge",), (0, 1)),
        Rule(p + "probabilities", artifact, "between", ("stage1_prob",), (0.0, 1.0)),
        Rule(p + "edge_ids", artifact, "unique", ("edge_id",)),
        Rule(p + "target_candidates", artifact, "at_most", ("session_id", "Q2_row"), (max_candidates, "stage1_pred_edge", 1)),
        Rule(p + "one_split", artifact, "one_value", ("session_id", "split")),
    ]
