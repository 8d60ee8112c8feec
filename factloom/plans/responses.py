"""Model responses: messages, the output schema, citations resolved on pages, breaches before repair, repaired claims.

``responses`` has ``document, content`` (null: the model gave nothing). ``pages`` is as in ``evaluation``; with ``words`` and
``row_words`` (arrays of start, end, box over ``text`` and ``row_text``) found quotes get a box too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cues as Q
from ..functions import geometry as G
from ..functions import text as T
from ..operators import contracts as K
from ..operators import search
from . import derivation as D
from . import evaluation as E

# States, the shape of an answer, codes of its breaches.
STATES = ("PRESENT", "NO_DATA", "NOT_APPLICABLE", "NOT_STATED")
CITATION = "struct<page: int, quote: string>"
FIELD = f"struct<state: string, value: string, derivation: string, rule: string, evidence: {CITATION}, premises: array<{CITATION}>>"
INGREDIENT = f"struct<name: string, cas_number: string, cas_state: string, concentration: string, citation: {CITATION}>"
ANSWER = "struct<" + ", ".join(f"{name}: {FIELD}" for name, *_ in Q.FIELDS) + f", ingredients_state: string, ingredients: array<{INGREDIENT}>>"
CODES = (
    "no_structured_output", "schema_invalid", "quote_not_verbatim", "state_carries_value", "present_without_value", "not_stated_with_citation", "claim_without_citation",
    "direct_with_rule_or_premises", "derived_without_rule", "derived_unknown_rule", "derived_without_premises", "derived_with_direct_evidence", "derived_premise_set_incomplete", "repair_failed",
)
KEYS = ["document", "field"]
SPAN = E.SPANS[6:-1]


def messages(pages: DataFrame, text: str = "text") -> DataFrame:
    """``document, system, user``: what to extract, and the document's pages in order under their numbers."""
    rules = "; ".join(f"{name} ({' or '.join(fields)} is {state})" for name, fields, state in D.RULES)
    system = (
        "Extract these fields of a safety data sheet as JSON: " + ", ".join(f"{name} ({kind})" for name, kind, *_ in Q.FIELDS) + ", ingredients_state and ingredients. "
        f"A state is one of {', '.join(STATES)}; only PRESENT has a value; NOT_STATED cites nothing. Quotes are verbatim and carry their page. "
        f"A DIRECT claim cites evidence; a DERIVED one names a rule and its premises. Rules: {rules}. Shape: {ANSWER}"
    )
    part = F.struct("page", F.concat(F.lit("[page "), F.col("page").cast("string"), F.lit("]\n"), F.coalesce(text, F.lit(""))).alias("text"))
    joined = pages.groupBy("document").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return joined.select("document", F.lit(system).alias("system"), F.concat(F.lit("Document: "), F.col("document").cast("string"), F.lit("\n"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")).alias("user"))


def judge_prompt(field: Column, description: Column, text: Column) -> Column:
    """The yes or no question whether a page holds what a field needs."""
    return F.concat(F.lit("Does this page hold what is needed to state the "), F.replace(field, F.lit("_"), F.lit(" ")), F.lit(" ("), description, F.lit(")? Answer yes or no.\n\n"), text)


def parsed(responses: DataFrame) -> DataFrame:
    """``document, answer, code``: the answer, or why there is none."""
    read = responses.select("document", "content", K.parse_json_response(F.col("content"), ANSWER).alias("answer"))
    states = [F.coalesce(F.col("answer")[name]["state"].isin(*STATES), F.lit(False)) for name, *_ in Q.FIELDS]
    kinds = [F.coalesce(F.col("answer")[name]["derivation"].isin("DIRECT", "DERIVED"), F.lit(False)) for name, *_ in Q.FIELDS]
    items = F.coalesce(F.forall(F.col("answer")["ingredients"], lambda i: F.coalesce(i["cas_state"].isin(*STATES), F.lit(False))), F.lit(False))
    sound = reduce(lambda a, b: a & b, [*states, *kinds, items, F.coalesce(F.col("answer")["ingredients_state"].isin(*STATES), F.lit(False))])
    code = F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "no_structured_output").when(~sound, "schema_invalid")
    return read.withColumn("code", code).select("document", F.when(F.col("code").isNull(), F.col("answer")).alias("answer"), "code")


def _found(text: Column, places: Column, words: Column | None, form: Column, quote: Column) -> Column:
    """Struct (text, box) of a quote's first place, or null."""

    def cut(at: Column) -> Column:
        start, end = F.get(places, at - 1), F.get(places, at + F.length(quote) - 2) + 1
        box = F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>")
        if words is not None:
            box = G.union(F.transform(F.filter(words, lambda w: (w["start"] < end) & (w["end"] > start)), lambda w: w["box"]))
        return F.struct(F.substring(text, start + 1, end - start).alias("text"), box.alias("box"))

    return F.when((quote != "") & F.contains(form, quote), T.let(F.position(quote, form), cut))


def resolved(cited: DataFrame, pages: DataFrame) -> DataFrame:
    """``cited`` (document, page, quote and others) with ``span`` and ``found``: the quote's first place on the page it
    names, in reading order, else in visual rows; a quote that is not there is kept without a box, on page 1 at least."""
    rest = [c for c in cited.columns if c not in ("document", "page")]
    one = cited.groupBy("document", "page").agg(F.collect_list(F.struct(*rest)).alias("cites"))
    held = pages.withColumn("page", F.col("page").cast("int"))
    held = held.select("document", "page", *[F.col(c).alias(f"_{c}") for c in held.columns if c in ("text", "row_text", "words", "row_words")])
    met = one.join(held, ["document", "page"], "left").withColumn("_f", T.search_form(F.col("_text"))).withColumn("_r", T.search_form(F.col("_row_text")))
    met = met.withColumn("_p", search.offsets(F.col("_text"))).withColumn("_q", search.offsets(F.col("_row_text")))
    words = lambda c: F.col(c) if c in met.columns else None

    def place(c: Column) -> Column:
        quote = T.search_form(c["quote"])
        hit = T.let(quote, lambda q: F.coalesce(_found(F.col("_text"), F.col("_p"), words("_words"), F.col("_f"), q), _found(F.col("_row_text"), F.col("_q"), words("_row_words"), F.col("_r"), q)))
        return T.let(hit, lambda h: F.struct(*[c[name].alias(name) for name in rest], F.struct(F.greatest(F.col("page"), F.lit(1)).alias("page"), F.coalesce(h["text"], c["quote"]).alias("text"), h["box"].alias("box")).cast(SPAN).alias("span"), h.isNotNull().alias("found")))

    return met.select("document", "page", F.inline(F.transform("cites", place)))


def claims(responses: DataFrame, pages: DataFrame) -> DataFrame:
    """``document, field, state, value, derivation, rule, evidence, premises, rationale, codes``: repaired claims of sound
    answers with the sorted codes of what the raw ones broke, one code for each quote that is not on its page."""
    fields = F.array(*[F.struct(F.lit(name).alias("field"), F.col("answer")[name].alias("raw")) for name, *_ in Q.FIELDS])
    raw = parsed(responses).where("answer is not null").select("document", F.inline(fields)).select(*KEYS, "raw.*")
    none = F.array().cast(f"array<{CITATION}>")
    listed = F.concat(F.when(F.col("evidence").isNotNull(), F.array(F.struct(F.lit(-1).alias("at"), "evidence.page", "evidence.quote"))).otherwise(F.array().cast("array<struct<at: int, page: int, quote: string>>")), F.transform(F.coalesce("premises", none), lambda c, i: F.struct(i.alias("at"), c["page"].alias("page"), c["quote"].alias("quote"))))
    cited = raw.select(*KEYS, F.inline(listed)).where("page is not null and trim(quote) <> ''")
    spans = resolved(cited, pages).groupBy(*KEYS).agg(
        F.max_by(F.when(F.col("at") < 0, F.col("span")), F.col("at") < 0).alias("e"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "span")))), lambda x: x["span"]).alias("p"),
        F.count_if(~F.col("found")).alias("lost"),
    )
    met = raw.join(spans, KEYS, "left").withColumn("p", E._spans(F.col("p"))).withColumn("lost", F.coalesce("lost", F.lit(0)).cast("int"))
    known = F.col("rule").isin(*[name for name, *_ in D.RULES])
    checked = E._audited(met.where((F.size("p") > 0) & known & (F.col("derivation") == "DERIVED")).select(*KEYS, "rule", "state", "value", "p"), KEYS, "p")
    checked = checked.select(*KEYS, D.check_rule(F.col("rule"), F.col("field"), F.col("state"), F.col("value"), F.size("p")).alias("checked"))
    met = met.join(checked, KEYS, "left")

    yes = lambda c: F.coalesce(c, F.lit(False))
    known, said, any_cited = yes(known), yes(F.col("value") != ""), F.col("e").isNotNull() | (F.size("p") > 0)
    ruled = yes(F.col("rule") != "")
    stated, derived, present = F.col("state") != "NOT_STATED", F.col("derivation") == "DERIVED", F.col("state") == "PRESENT"
    breaches = F.array(
        F.when(~stated & any_cited, "not_stated_with_citation"),
        F.when(stated & said & ~present, "state_carries_value"),
        F.when(present & ~said, "present_without_value"),
        F.when(stated & ~any_cited, "claim_without_citation"),
        F.when(stated & ~derived & (ruled | yes(F.size("premises") > 0)), "direct_with_rule_or_premises"),
        F.when(stated & derived & ~ruled, "derived_without_rule"),
        F.when(stated & derived & ruled & ~known, "derived_unknown_rule"),
        F.when(stated & derived & (F.size("p") == 0), "derived_without_premises"),
        F.when(stated & derived & F.col("evidence").isNotNull(), "derived_with_direct_evidence"),
        F.when(stated & derived & yes(F.col("checked") != "satisfied"), "derived_premise_set_incomplete"),
    )
    sound = stated & derived & known & (F.size("p") > 0)
    direct = F.when(derived, F.coalesce("e", F.get("p", 0))).otherwise(F.col("e"))
    return met.select(
        *KEYS, "state", F.when(present & said, F.col("value")).alias("value"), F.when(sound, "DERIVED").otherwise("DIRECT").alias("derivation"), F.when(sound, F.col("rule")).alias("rule"),
        F.when(stated & ~sound, direct).alias("evidence"), F.when(sound, F.col("p")).otherwise(F.array().cast(E.SPANS)).alias("premises"),
        F.when(stated & derived & ~sound, "derived without a known rule or premises: taken as direct").alias("rationale"),
        F.array_sort(F.concat(F.array_compact(breaches), F.array_repeat(F.lit("quote_not_verbatim"), F.col("lost")))).alias("codes"),
    )


def ingredient_claims(responses: DataFrame, pages: DataFrame) -> DataFrame:
    """``document, pos, name, cas, cas_state, concentration, evidence, codes`` of sound answers."""
    raw = parsed(responses).where("answer is not null").select("document", F.posexplode(F.col("answer.ingredients")).alias("pos", "i"))
    cited = raw.select("document", "pos", F.col("i.citation.page").alias("page"), F.col("i.citation.quote").alias("quote")).where("page is not null and trim(quote) <> ''")
    met = raw.join(resolved(cited, pages).select("document", "pos", "span", "found"), ["document", "pos"], "left")
    codes = F.when(~F.col("found"), F.array(F.lit("quote_not_verbatim"))).otherwise(F.array().cast("array<string>"))
    return met.select("document", "pos", "i.name", F.col("i.cas_number").alias("cas"), "i.cas_state", "i.concentration", F.col("span").alias("evidence"), codes.alias("codes"))


def breaches(responses: DataFrame, pages: DataFrame) -> DataFrame:
    """``document, field, code``, one row a breach; ``field`` is null for an answer that is missing or unsound."""
    whole = parsed(responses).where("code is not null").select("document", F.lit(None).cast("string").alias("field"), "code")
    fields = claims(responses, pages).select(*KEYS, F.explode("codes").alias("code"))
    items = ingredient_claims(responses, pages).select("document", F.format_string("ingredients[%d]", F.col("pos")).alias("field"), F.explode("codes").alias("code"))
    return whole.unionByName(fields).unionByName(items)


def breach_counts(found: DataFrame) -> DataFrame:
    """``code, n, documents`` of every code, those without a breach too."""
    table = found.sparkSession.createDataFrame([(c,) for c in CODES], "code string")
    counted = found.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("document").alias("documents"))
    return table.join(counted, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("documents", F.lit(0)).alias("documents"))
