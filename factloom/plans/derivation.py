"""Rule registry: premise audits, forms that premises establish, and checked derivations.

A claim's premises are rows; an audit is one partial aggregate per claim, then only column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cues as Q

# Rules with their fields and concluded state, and roles that a composition needs for a form.
IDENTIFIER_RULE = "identifier_undefined_for_form"
COMPOSITION_RULE = "composition_implies_form"
RULES = (
    (IDENTIFIER_RULE, ("product_cas_number", "chemical_formula", "molecular_weight"), "NOT_APPLICABLE"),
    (COMPOSITION_RULE, ("substance_or_mixture",), "PRESENT"),
)
REQUIREMENTS = {
    "SUBSTANCE": (("sole_constituent", 1), ("completeness_statement", 1)),
    "MIXTURE": (("composition_header", 1), ("partial_constituent", 2)),
}
ROLES = ("form_declaration", "composition_header", "sole_constituent", "partial_constituent", "completeness_statement")


def audit(premises: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Per claim: how many spans fill each role (constituents by distinct registry number) and the declared forms."""
    # One exchange by claim; then registry numbers are told apart by a hash aggregate, without sets as values.
    read = Q.premise_rows(premises, keys, text).repartition(*keys)
    forms = sorted(Q.FORM_CUES)
    by_number = read.groupBy(*keys, "cas").agg(
        F.count("form").alias("form_declaration"), F.count_if("header").alias("composition_header"), F.count_if("complete").alias("completeness_statement"),
        F.bool_or("whole").alias("whole"), F.bool_or("partial").alias("partial"), *[F.bool_or(F.col("form") == f).alias(f"_{f}") for f in forms],
    )
    numbered = lambda c: F.count_if(F.col("cas").isNotNull() & F.col(c))
    grouped = by_number.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("form_declaration", "composition_header", "completeness_statement")],
        numbered("whole").alias("sole_constituent"), numbered("partial").alias("partial_constituent"),
        F.array_compact(F.array(*[F.when(F.bool_or(f"_{f}"), f) for f in forms])).alias("declared"),
    )
    return grouped.select(*keys, *ROLES, "declared")


def satisfied(form: str) -> Column:
    out = F.lit(True)
    for role, needed in REQUIREMENTS[form]:
        out = out & (F.col(role) >= needed)
    return out


def shortfall(form: str) -> Column:
    return sum((F.greatest(F.lit(0), F.lit(needed) - F.col(role)) for role, needed in REQUIREMENTS[form]), F.lit(0))


def established_form() -> Column:
    """Over an audit: the one declared form, else the one composition that is complete, else null."""
    whole = F.array_compact(F.array(*[F.when(satisfied(f), f) for f in sorted(REQUIREMENTS)]))
    return F.when(F.size("declared") == 1, F.col("declared")[0]).when(F.size("declared") > 1, None).when(F.size(whole) == 1, whole[0])


def closest_form() -> Column:
    """The form whose composition lacks least, ties by name."""
    return F.array_min(F.array(*[F.struct(shortfall(f).alias("lacks"), F.lit(f).alias("form")) for f in sorted(REQUIREMENTS)]))["form"]


def claimed_form(value: Column) -> Column:
    form = F.upper(F.regexp_replace(F.trim(value), r"\s+", "_"))
    return F.when(form.isin("SUBSTANCE", "MIXTURE", "ARTICLE", "UNDETERMINED"), form)


def default_rule(derivation: Column) -> Column:
    return F.when(derivation == "ONTOLOGY", IDENTIFIER_RULE).when(derivation == "COMPOSITION_IMPLIED", COMPOSITION_RULE)


def rule_applies(rule: Column, field: Column, state: Column) -> Column:
    out = F.lit(False)
    for name, fields, concluded in RULES:
        out = out | ((rule == name) & field.isin(*fields) & (state == concluded))
    return F.coalesce(out, F.lit(False))


def check_rule(rule: Column, field: Column, state: Column, value: Column, n_premises: Column) -> Column:
    """Over an audit joined to its claim: satisfied, violated or undecidable."""
    form, claim = established_form(), claimed_form(value)
    identifier = F.when(form.isNull() | (form == "UNDETERMINED"), "undecidable").when(form.isin("MIXTURE", "ARTICLE"), "satisfied").otherwise("violated")
    composition = F.when(claim.isNull() | (claim == "UNDETERMINED") | (F.col("form_declaration") > 0) | ~claim.isin(*REQUIREMENTS), "violated")
    for name, other in (("SUBSTANCE", "MIXTURE"), ("MIXTURE", "SUBSTANCE")):
        composition = composition.when((claim == name) & ~satisfied(name), "undecidable").when((claim == name) & satisfied(other), "violated")
    composition = composition.otherwise("satisfied")
    known = rule.isin(*[name for name, _, _ in RULES])
    return F.when(~F.coalesce(known, F.lit(False)) | ~rule_applies(rule, field, state) | (n_premises == 0), "violated").when(rule == IDENTIFIER_RULE, identifier).otherwise(composition)


def lacking(form: str) -> Column:
    """Over an audit: the roles that a form's composition is short of, as ``role have/needed``."""
    short = [F.when(F.col(r) < n, F.concat(F.lit(f"{r} "), F.col(r).cast("string"), F.lit(f"/{n}"))) for r, n in REQUIREMENTS[form]]
    return F.concat_ws(", ", *short)


def check_note(rule: Column, field: Column, state: Column, value: Column, n_premises: Column) -> Column:
    """Over an audit joined to its claim: why ``check_rule`` decides as it does."""
    form, claim, declared = established_form(), claimed_form(value), F.array_join("declared", ", ")
    short = lambda of: reduce(lambda out, f: out.when(of == f, lacking(f)), REQUIREMENTS, F)
    found = F.when(F.size("declared") > 0, F.concat(F.lit("premises declare "), declared)).otherwise(F.concat(F.lit("composition shows "), form))
    identifier = (
        F.when(F.size("declared") > 1, F.concat(F.lit("premises declare several forms: "), declared))
        .when(form.isNull(), F.concat(F.lit("no form established; "), closest_form(), F.lit(" lacks "), short(closest_form())))
        .when(form.isin("MIXTURE", "ARTICLE", "UNDETERMINED"), found)
        .otherwise(F.concat(found, F.lit("; identifiers are defined for it")))
    )
    composition = (
        F.when(claim.isNull() | (claim == "UNDETERMINED"), "the claim names no form")
        .when(F.col("form_declaration") > 0, F.concat(F.lit("premises declare the form themselves: "), declared))
        .when(~claim.isin(*REQUIREMENTS), F.concat(F.lit("no composition shows "), claim))
    )
    for name, other in (("SUBSTANCE", "MIXTURE"), ("MIXTURE", "SUBSTANCE")):
        composition = composition.when((claim == name) & ~satisfied(name), F.concat(F.lit(f"{name} lacks "), lacking(name)))
        composition = composition.when((claim == name) & satisfied(other), F.lit(f"the premises show {other} too"))
    composition = composition.otherwise(F.concat(F.lit("composition shows "), claim))
    known = F.coalesce(rule.isin(*[name for name, _, _ in RULES]), F.lit(False))
    return (
        F.when(~known, F.concat(F.lit("unknown rule "), F.coalesce(rule, F.lit("(none)"))))
        .when(~rule_applies(rule, field, state), F.concat(F.lit("the rule does not give "), field, F.lit(" "), state))
        .when(n_premises == 0, F.lit("no premise cited"))
        .when(rule == IDENTIFIER_RULE, identifier)
        .otherwise(composition)
    )


def required_roles(value: Column) -> Column:
    """Roles that a claimed form needs, as (role, needed)."""
    claim = claimed_form(value)
    out = None
    for form, roles in REQUIREMENTS.items():
        pairs = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(n).alias("needed")) for r, n in roles])
        out = F.when(claim == form, pairs) if out is None else out.when(claim == form, pairs)
    return out


def premise_groups(premises: DataFrame, keys: list[str], value: str, text: str = "text") -> DataFrame:
    """Spans by required role with the hits needed; claims of which a role is short have no rows."""
    rows = premises.select(*keys, text, F.explode(required_roles(F.col(value))).alias("r"), Q.premise_roles(F.col(text)).alias("roles"))
    flat = rows.select(*keys, text, F.col("r.role").alias("role"), F.col("r.needed").alias("needed"), F.array_contains("roles", F.col("r.role")).alias("fills"))
    found = flat.groupBy(*keys, "role", "needed").agg(F.count_if("fills").alias("spans"))
    short = found.where("spans < needed").select(*keys).distinct()
    return found.join(short, keys, "left_anti")


def gold_problems() -> Column:
    """Codes of what is wrong with a gold field (product_form, field, state, derivation, rule, value, n_evidence), sorted."""
    state, kind, field, form = F.col("state"), F.col("derivation"), F.col("field"), F.col("product_form")
    has_value, absent = F.coalesce(F.col("value") != "", F.lit(False)), state == "NOT_STATED"
    derived, defined = kind.isin("ONTOLOGY", "COMPOSITION_IMPLIED"), Q.field_defined(field, form)
    checks = (
        ("present_without_value", (state == "PRESENT") & ~has_value),
        ("value_without_present", (state != "PRESENT") & has_value),
        ("no_evidence", ~absent & (F.col("n_evidence") == 0)),
        ("evidence_on_not_stated", absent & (F.col("n_evidence") > 0)),
        ("not_stated_not_absent", absent & (kind != "ABSENT")),
        ("ontology_state", (kind == "ONTOLOGY") & (state != "NOT_APPLICABLE")),
        ("ontology_but_defined", (kind == "ONTOLOGY") & defined),
        ("present_but_undefined", (state == "PRESENT") & ~defined),
        ("rule_not_registered", derived & ~rule_applies(F.col("rule"), field, state)),
        ("rule_on_underived", ~derived & F.col("rule").isNotNull()),
        ("form_disagrees", (field == "substance_or_mixture") & (state == "PRESENT") & ~F.col("value").eqNullSafe(form)),
        ("form_not_stated", (field == "substance_or_mixture") & (state != "PRESENT") & (form != "UNDETERMINED")),
    )
    known = F.array_sort(F.array_compact(F.array(*[F.when(bad, code) for code, bad in checks])))
    return F.when(field.isin(*[name for name, *_ in Q.FIELDS]), known).otherwise(F.array(F.lit("unknown_field")))


def missing_fields(gold: DataFrame, document: str = "document") -> DataFrame:
    """``document, field`` of product fields that a document's gold lacks."""
    held = gold.groupBy(document).agg(F.collect_set(F.when(F.col("field").isin(*[n for n, *_ in Q.FIELDS]), F.col("field"))).alias("held"))
    return held.select(document, F.explode(F.array_except(F.array(*[F.lit(n) for n, *_ in Q.FIELDS]), "held")).alias("field"))
