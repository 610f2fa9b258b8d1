"""Ontology schemas: compilation checks, links, actions, invariants, pressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 1
INPUT_KINDS = ("any", "null", "boolean", "number", "string", "array", "object")


def schema_violations(schema: dict) -> list[str]:
    """What is wrong with a schema: version, duplicate ids, unknown references."""
    out = []
    if schema.get("version") != VERSION:
        out.append("version")
    known: set[str] = set()
    for group in ("object_types", "link_types", "action_types", "invariants"):
        ids = [x["id"] for x in schema.get(group, [])]
        out += [f"{group}: duplicate {i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
        if group == "object_types":
            known = set(ids)
    for link in schema.get("link_types", []):
        for end in ("from_types", "to_types"):
            out += [f"link {link['id']}: unknown {t}" for t in link.get(end, []) if t not in known]
        if link.get("min_arity", 2) < 2 or link.get("max_arity", 2) < link.get("min_arity", 2):
            out.append(f"link {link['id']}: arity")
    for action in schema.get("action_types", []):
        kind = action.get("input_contract", "json-any").removeprefix("json-")
        if kind not in INPUT_KINDS:
            out.append(f"action {action['id']}: input {kind}")
    return out


def links(members: DataFrame, from_types: list[str], to_types: list[str], least: int = 2, most: int | None = None) -> DataFrame:
    """Each link judged: ``members`` has link_id and object_type. Reasons are listed."""
    count = lambda kinds: F.count_if(F.col("object_type").isin(kinds))
    n, unknown, other = F.count("*"), F.count_if(F.col("object_type").isNull()), F.count_if(~F.col("object_type").isin([*from_types, *to_types]))
    rules = [(n < least, "too_few"), (count(from_types) == 0, "no_source"), (count(to_types) == 0, "no_target"), (unknown > 0, "unknown_type"), (other > 0, "type_not_allowed")]
    if most is not None:
        rules.append((n > most, "too_many"))
    reasons = F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))
    return members.groupBy("link_id").agg(n.alias("arity"), reasons.alias("reasons")).withColumn("valid", F.size("reasons") == 0)


def json_kind(text: Column) -> Column:
    """The kind of a JSON text: null, boolean, number, string, array, object; null if it can't be read."""
    own = F.trim(text)
    return (
        F.when(F.try_parse_json(own).isNull() & (own != "null"), F.lit(None).cast("string")).when(own == "null", "null").when(own.isin("true", "false"), "boolean")
        .when(own.startswith('"'), "string").when(own.startswith("["), "array").when(own.startswith("{"), "object").otherwise("number")
    )


def action_allowed(payload: Column, contract: str) -> Column:
    kind = contract.removeprefix("json-")
    found = json_kind(payload)
    return found.isNotNull() if kind == "any" else F.coalesce(found == kind, F.lit(False))


def pressure(counts: DataFrame, most_basis_points: int) -> DataFrame:
    """Share of failing checks in whole basis points, and whether it is too high."""
    total = counts.agg(F.sum("failed").alias("failed"), F.sum("checked").alias("checked"))
    bp = F.when(F.col("checked") == 0, 0).otherwise(F.floor(F.col("failed") * 10000 / F.col("checked")))
    return total.select("failed", "checked", bp.alias("basis_points"), (bp > most_basis_points).alias("under_pressure"))


def enqueue(requests: DataFrame, contracts: dict[str, str]) -> DataFrame:
    """Action requests with their outcome and, where they are queued, their outbox payload.

    ``requests`` has action_id and input (JSON); ``contracts`` names each known
    action's input kind. Others are ``unknown_action`` or ``input``.
    """
    fits, known = F.lit(False), F.lit(False)
    for action, contract in contracts.items():
        own = F.col("action_id") == action
        known, fits = known | own, fits | (own & action_allowed(F.col("input"), contract))
    outcome = F.when(~known, "unknown_action").when(~F.coalesce(fits, F.lit(False)), "input").otherwise("queued")
    return requests.withColumn("outcome", outcome).withColumn("payload_json", F.when(F.col("outcome") == "queued", F.to_json(F.struct("action_id", "input"))))
