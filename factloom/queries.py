"""Queries over the driver tables, one per operator group, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import cues as Q
from .functions import geometry as G
from .functions import text as T
from .functions import values as V
from .operators import contracts as K
from .operators import extract as X
from .operators import layout as L
from .operators import retrieval as R
from .operators import scoring as S
from .operators import search
from .plans import derivation as D
from .plans import evaluation as E
from .plans import extraction as P
from .plans import probes as B
from .plans import responses as M
from .registry import FORM as _FORM
from .registry import ORACLES, QUERIES, query, read
from .streaming.events import windowed_counts



@query(f"WITH d AS (SELECT doc_id, {_FORM} AS t FROM documents), b AS (SELECT item_id, {_FORM} AS q FROM benchmark) SELECT doc_id, item_id FROM d JOIN b ON q <> '' AND contains(t, q)")
def verbatim_passage(spark, sf_dir):
    return search.passages_in(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


@query(
    f"WITH d AS (SELECT doc_id, {_FORM} AS t FROM documents), b AS (SELECT item_id, {_FORM} AS q FROM benchmark), "
    "m AS (SELECT doc_id, item_id, t, q FROM d JOIN b ON q <> '' AND contains(t, q)), "
    "p AS (SELECT doc_id, item_id, unnest(range(1, length(t) - length(q) + 2)) AS i, t, q FROM m) "
    "SELECT doc_id, item_id, count(*) AS n_hits, min(i) - 1 AS first_offset FROM p WHERE substr(t, i, length(q)) = q GROUP BY ALL"
)
def passage_occurrences(spark, sf_dir):
    return search.passages_in(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query(f"SELECT doc_id, sha256({_FORM}) AS folded, length({_FORM}) AS n FROM documents")
def fold_search_text(spark, sf_dir):
    form = T.search_form(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(form, 256).alias("folded"), F.length(form).alias("n"))


@query("SELECT s_suppkey, true AS same, s_suppkey % 7 = 3 AS other FROM supplier")
def name_equality(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    noisy = F.concat(F.lit("  "), F.upper(F.col("s_name")), F.lit("  Inc.  ®"))
    plain = F.concat(F.lower(F.col("s_name")), F.lit(" inc"))
    other = F.concat(F.col("s_name"), F.when(F.col("s_suppkey") % 7 == 3, " Ltd.").otherwise(" Plc."))
    return s.select("s_suppkey", T.names_equal(noisy, plain).alias("same"), T.names_equal(other, F.concat(F.col("s_name"), F.lit(" ltd"))).alias("other"))


@query(
    "WITH k AS (SELECT o_orderkey, o_orderkey % 90000 + 10000 AS a, o_orderkey % 100 AS b, o_custkey % 10 AS c FROM orders), "
    "t AS (SELECT *, (b % 10) * 1 + (b // 10) * 2 + (a % 10) * 3 + (a // 10 % 10) * 4 + (a // 100 % 10) * 5 + (a // 1000 % 10) * 6 + (a // 10000) * 7 AS s FROM k) "
    "SELECT o_orderkey, s % 10 = c AS valid FROM t"
)
def cas_checksum(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    text = F.format_string(" %d – %02d-%d. ", F.col("o_orderkey") % 90000 + 10000, F.col("o_orderkey") % 100, F.col("o_custkey") % 10)
    return o.select("o_orderkey", T.cas_valid(text).alias("valid"))


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE ELSE round((p_size - 32) * 5.0 / 9.0, 6) END AS celsius, "
    "CASE p_partkey % 3 WHEN 0 THEN '=' WHEN 1 THEN '>=' ELSE '<' END AS comparator FROM part"
)
def temperature_parse(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    word = F.element_at(F.array(F.lit("Flash point: "), F.lit("not less than "), F.lit("below ")), (F.col("p_partkey") % 3 + 1).cast("int"))
    unit = F.when(F.col("p_partkey") % 2 == 0, " ºC").otherwise(" °F (closed cup)")
    met = p.select("p_partkey", V.parse_temperature(F.concat(word, F.col("p_size").cast("string"), unit)).alias("q"))
    return met.select("p_partkey", F.round("q.value", 6).alias("celsius"), "q.comparator")


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 OR 0.04 * (l_linenumber % 3) <= 0.05 AS same FROM lineitem")
def quantity_within_tolerance(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    a = F.concat(F.format_string("%.2f", F.col("l_quantity")), F.lit(" g/mol"))
    step = F.when(F.col("l_linenumber") % 2 == 0, F.lit(0.0)).otherwise(0.04 * (F.col("l_linenumber") % 3))
    b = F.concat(F.replace(F.format_string("%.2f", F.col("l_quantity") + step), F.lit("."), F.lit(",")), F.lit(" G / Mole"))
    texts = li.select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))
    return V.with_equality(texts, "quantity", "a", "b", "same", 0.05).select("l_orderkey", "l_linenumber", "same")


@query(
    "WITH v AS (SELECT l_orderkey, l_linenumber, round(l_discount * 100)::INT AS lo, round(l_discount * 100 + l_tax * 100 + 1)::INT AS hi, l_linenumber % 4 AS k FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN k IN (0, 1) THEN lo::DOUBLE WHEN k = 3 THEN lo::DOUBLE END AS low, "
    "CASE WHEN k IN (0, 1, 2) THEN hi::DOUBLE END AS high, k <> 3 AS low_inclusive, k <> 1 AS high_inclusive FROM v"
)
def concentration_interval(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    lo, hi = F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.round(F.col("l_discount") * 100 + F.col("l_tax") * 100 + 1).cast("int").cast("string")
    k = F.col("l_linenumber") % 4
    text = F.when(k == 0, F.concat(lo, F.lit(" % – "), hi, F.lit("% w/w"))).when(k == 1, F.concat(lo, F.lit(" - <"), hi, F.lit(" wt. %"))).when(k == 2, F.concat(F.lit("NMT "), hi)).otherwise(F.concat(F.lit("> "), lo, F.lit(" percent")))
    read_once = li.select("l_orderkey", "l_linenumber", V.parse_concentration(text).alias("c"))
    return read_once.select("l_orderkey", "l_linenumber", "c.low", "c.high", "c.low_inclusive", "c.high_inclusive")


@query("SELECT p_partkey, p_partkey % 3 <> 1 AS temperature, true AS name, p_size % 2 = 0 AS identifier FROM part")
def value_support_by_kind(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    value = F.concat(F.format_string("%.1f", size), F.lit(" °C"))
    span = F.concat(F.lit("flash point "), F.format_string("%.1f", size + F.when(F.col("p_partkey") % 3 == 1, 2.0).otherwise(0.5)), F.lit(" C, boiling 300 °C"))
    cas = F.format_string("%d-%02d-1", F.col("p_partkey") + 1000, F.col("p_size"))
    other = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("cas no. "), cas)).otherwise(F.lit("no number"))
    return p.select(
        "p_partkey",
        V.value_supported_by(value, span, "temperature").alias("temperature"),
        V.value_supported_by(F.upper("p_name"), F.concat(F.lit("Product: "), F.col("p_name"), F.lit(".")), "name").alias("name"),
        V.value_supported_by(cas, other, "identifier").alias("identifier"),
    )


@query(
    "WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 4 ELSE 3 END AS m, 4 AS g, CASE WHEN l_linenumber % 3 = 0 THEN 7 ELSE 4 END AS p FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, m AS matched, m / g::DOUBLE AS coverage, round(m / (g + p - m)::DOUBLE, 6) AS iou FROM t"
)
def span_overlap_lcs(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey").cast("string")
    gold = F.concat(F.lit("Flash Point: "), key, F.lit(" °C"))
    said = F.concat(F.lit("(flash  point "), key, F.when(F.col("l_linenumber") % 2 == 0, " °C)").otherwise(" degrees)"), F.when(F.col("l_linenumber") % 3 == 0, " and more text").otherwise(""))
    met = li.select("l_orderkey", "l_linenumber", T.span_overlap(said, gold).alias("o"))  # one column, or each field would compute it
    return met.select("l_orderkey", "l_linenumber", "o.matched", "o.coverage", F.round("o.iou", 6).alias("iou"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'NO_DATA' WHEN 1 THEN 'NOT_APPLICABLE' WHEN 2 THEN NULL WHEN 3 THEN 'NO_DATA' ELSE NULL END AS state FROM part")
def state_cue_class(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    tail = F.element_at(F.array(F.lit(": No applicable data available."), F.lit(" n/a"), F.lit(" 61 C"), F.lit(" : –"), F.lit(" naphthalene")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", Q.state_cue(F.concat(F.lit("Flash point"), tail)).alias("state"))


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'SUBSTANCE' WHEN 2 THEN 'MIXTURE' WHEN 3 THEN 'MIXTURE' WHEN 4 THEN 'MIXTURE' WHEN 5 THEN 'ARTICLE' WHEN 6 THEN 'SUBSTANCE' END AS form FROM part")
def form_cue_class(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    texts = ("3.1. Substances", "Substances or 3.2 Mixtures", "Mixtures Composition Comments: none", "Substance or preparation: Preparation", "3.1. Substances Not applicable", 'defined by OSHA as an "article."', "Substance/mixture : Substance", "not a hazardous substance or mixture")
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return p.select("p_partkey", Q.form_cue(text).alias("form"))


def _premises(spark, sf_dir):
    """Constituent rows per order: line k has a share below 100; order keys divisible by 4 say one constituent at 100."""
    li = read(spark, sf_dir, "lineitem")
    whole = F.col("l_orderkey") % 4 == 0
    row = F.format_string("part %d %d-%02d-%d %s %%", F.col("l_partkey"), F.col("l_linenumber") + 1000, F.lit(10), F.lit(1), F.when(whole, "100").otherwise((F.col("l_linenumber") * 10).cast("string")))
    base = li.select("l_orderkey", F.when(whole, F.lit("iron 7439-89-6 100 %")).otherwise(row).alias("text"))
    orders = li.select("l_orderkey").distinct()
    extra = F.when(F.col("l_orderkey") % 4 == 0, F.when(F.col("l_orderkey") % 8 == 0, "there are no impurities or stabilizers").otherwise("pure")).otherwise("Ingredient C.A.S. No. % by Wt")
    return base.unionByName(orders.select("l_orderkey", extra.alias("text")))


_PREMISES = (
    "WITH b AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), "
    "a AS (SELECT l_orderkey, l_orderkey % 4 = 0 AS whole, n, CASE WHEN l_orderkey % 8 = 0 THEN 'SUBSTANCE' WHEN l_orderkey % 4 <> 0 AND n >= 2 THEN 'MIXTURE' END AS form FROM b) "
)


@query(_PREMISES + "SELECT l_orderkey, (NOT whole)::BIGINT AS composition_header, whole::BIGINT AS sole_constituent, CASE WHEN whole THEN 0 ELSE n END AS partial_constituent, (l_orderkey % 8 = 0)::BIGINT AS completeness_statement, form FROM a")
def premise_audit_form(spark, sf_dir):
    a = D.audit(_premises(spark, sf_dir), ["l_orderkey"])
    return a.select("l_orderkey", "composition_header", "sole_constituent", "partial_constituent", "completeness_statement", D.established_form().alias("form"))


@query(
    _PREMISES + "SELECT l_orderkey, CASE WHEN form = 'MIXTURE' THEN 'satisfied' WHEN form IS NULL THEN 'undecidable' ELSE 'violated' END AS identifier, "
    "CASE WHEN form = 'MIXTURE' THEN 'satisfied' ELSE 'undecidable' END AS composition FROM a"
)
def check_rule_status(spark, sf_dir):
    a = D.audit(_premises(spark, sf_dir), ["l_orderkey"])
    n = F.lit(2)
    return a.select(
        "l_orderkey",
        D.check_rule(F.lit(D.IDENTIFIER_RULE), F.lit("chemical_formula"), F.lit("NOT_APPLICABLE"), F.lit(None).cast("string"), n).alias("identifier"),
        D.check_rule(F.lit(D.COMPOSITION_RULE), F.lit("substance_or_mixture"), F.lit("PRESENT"), F.lit("mixture"), n).alias("composition"),
    )


def _tokens(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    y = (F.col("l_linenumber") - 1) * 0.05
    x = (F.col("l_suppkey") % 17) * 0.05
    return li.select(F.col("l_orderkey").alias("page"), x.alias("x0"), (y + (F.col("l_partkey") % 3) * 0.001).alias("y0"), (x + 0.04).alias("x1"), (y + 0.012).alias("y1"), F.concat(F.lit("w"), F.col("l_linenumber").cast("string")).alias("text"))


@query("SELECT l_orderkey AS page, 'w' || l_linenumber AS text, (dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::INT AS row_no FROM lineitem")
def row_grouping(spark, sf_dir):
    return L.visual_rows(_tokens(spark, sf_dir), ["page"]).select("page", "text", "row_no")


@query("WITH l AS (SELECT l_orderkey, l_linenumber, string_agg('w' || l_linenumber, ' ') AS t FROM lineitem GROUP BY ALL) SELECT l_orderkey AS page, string_agg(t, chr(10) ORDER BY l_linenumber) AS text FROM l GROUP BY 1")
def page_text_spans(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line_no"), F.lit(0).alias("word_no"), F.concat(F.lit("w"), F.col("l_linenumber").cast("string")).alias("text"))
    return L.page_text(li, ["page"])


@query(
    "WITH b AS (SELECT l_orderkey, l_linenumber, l_discount AS ax0, l_tax AS ay0, l_discount + 0.2 AS ax1, l_tax + 0.1 AS ay1, 0.05::DOUBLE AS bx0, 0.02::DOUBLE AS by0, 0.15 + l_tax AS bx1, 0.1::DOUBLE AS by1 FROM lineitem), "
    "i AS (SELECT *, greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0)) AS o, (ax1 - ax0) * (ay1 - ay0) AS a, (bx1 - bx0) * (by1 - by0) AS g FROM b) "
    "SELECT l_orderkey, l_linenumber, round(o / (a + g - o), 6) AS iou, round(o / g, 6) AS coverage, round(a / g, 6) AS dilution, round((ay1 - ay0) / (by1 - by0), 6) AS height FROM i"
)
def bbox_iou_containment(spark, sf_dir):
    d, t = F.col("l_discount"), F.col("l_tax")
    a = G.box(d, t, d + 0.2, t + 0.1)
    b = G.box(F.lit(0.05), F.lit(0.02), 0.15 + t, F.lit(0.1))
    c = G.containment(a, b)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(G.iou(a, b), 6).alias("iou"), F.round(c["coverage"], 6).alias("coverage"), F.round(c["dilution"], 6).alias("dilution"), F.round(G.height_ratio(a, b), 6).alias("height"))


def _instances(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    status = lambda k: F.when(F.col("event_id") % k == 0, "violated").when(F.col("event_id") % (k + 4) == 1, "n/a").when(F.col("event_id") % (k + 9) == 2, "undecidable").otherwise("satisfied")
    return e.select("event_id", "event_type", *[status(3 + i).alias(a) for i, a in enumerate(S.AXES)])


_AXIS = [f"CASE WHEN event_id % {k} = 0 THEN 'violated' WHEN event_id % {k + 4} = 1 THEN 'n/a' WHEN event_id % {k + 9} = 2 THEN 'undecidable' ELSE 'satisfied' END" for k in range(3, 10)]
_CLAIMS = "WITH c AS (SELECT event_id, event_type, " + ", ".join(f"{x} AS {a}" for x, a in zip(_AXIS, S.AXES, strict=True)) + " FROM events) "
_OK = [f"{a} IN ('satisfied', 'n/a')" for a in S.AXES]


@query(_CLAIMS + f"SELECT event_id, {' AND '.join(_OK)} AS joint, {' OR '.join(f'{a} = $$undecidable$$' for a in S.AXES)} AS undecidable FROM c")
def axes_joint(spark, sf_dir):
    return _instances(spark, sf_dir).select("event_id", S.joint().alias("joint"), S.undecidable().alias("undecidable"))


@query(
    _CLAIMS + ", u AS (" + " UNION ALL ".join(f"SELECT '{a}' AS axis, {a} AS status FROM c" for a in S.AXES) + ") SELECT axis, count(*) FILTER (status = 'satisfied') AS satisfied, count(*) FILTER (status <> 'n/a') AS applicable, "
    "count(*) FILTER (status = 'undecidable') AS undecidable, round(count(*) FILTER (status = 'satisfied') / count(*) FILTER (status <> 'n/a')::DOUBLE, 6) AS rate FROM u GROUP BY axis"
)
def axis_rates(spark, sf_dir):
    return S.axis_rates(_instances(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(_CLAIMS + "SELECT count(*) AS n, " + ", ".join(f"round(avg(({' AND '.join(_OK[: i + 1])})::INT), 6) AS stage_{i + 1}_{a}" for i, a in enumerate(S.AXES)) + " FROM c")
def stage_conjunctions(spark, sf_dir):
    out = S.stage_rates(_instances(spark, sf_dir))
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


@query("SELECT quality, count(*) FILTER (toxic = 0) AS \"0\", count(*) FILTER (toxic = 1) AS \"1\", count(*) FILTER (toxic IS NULL) AS none FROM labels GROUP BY quality")
def state_confusion(spark, sf_dir):
    return S.confusion(read(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


@query("SELECT l_returnflag, (l_returnflag IS NULL)::TINYINT AS whole, count(*) AS n, sum((l_quantity > 25)::INT)::BIGINT AS ok, round(avg((l_quantity > 25)::INT), 6) AS rate FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag))")
def rates_by_group(spark, sf_dir):
    return S.rates_by(read(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_quantity") > 25).withColumn("rate", F.round("rate", 6))


@query(
    "WITH g AS (SELECT l_orderkey, l_linenumber AS pos, CASE WHEN l_partkey % 5 <> 0 THEN l_partkey END AS cas, l_suppkey AS name FROM lineitem), "
    "p AS (SELECT l_orderkey, l_linenumber + 10 AS pos, CASE WHEN l_partkey % 5 <> 0 AND l_linenumber % 3 <> 0 THEN l_partkey END AS cas, l_suppkey AS name FROM lineitem WHERE l_linenumber % 4 <> 1), "
    "g1 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, cas ORDER BY pos) AS n FROM g WHERE cas IS NOT NULL), p1 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, cas ORDER BY pos) AS n FROM p WHERE cas IS NOT NULL), "
    "m1 AS (SELECT l_orderkey, g1.pos AS gold_pos, p1.pos AS predicted_pos FROM g1 JOIN p1 USING (l_orderkey, cas, n)), "
    "g2 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, name ORDER BY pos) AS n FROM g WHERE (l_orderkey, pos) NOT IN (SELECT (l_orderkey, gold_pos) FROM m1)), "
    "p2 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, name ORDER BY pos) AS n FROM p WHERE (l_orderkey, pos) NOT IN (SELECT (l_orderkey, predicted_pos) FROM m1)) "
    "SELECT *, 'cas' AS matched_on FROM m1 UNION ALL SELECT l_orderkey, g2.pos, p2.pos, 'name' FROM g2 JOIN p2 USING (l_orderkey, name, n)"
)
def ingredient_match(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    cas = F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey"))
    gold = li.select("l_orderkey", F.col("l_linenumber").alias("pos"), cas.alias("cas"), F.col("l_suppkey").alias("name"))
    said = li.where("l_linenumber % 4 <> 1").select("l_orderkey", (F.col("l_linenumber") + 10).alias("pos"), F.when(F.col("l_linenumber") % 3 != 0, cas).alias("cas"), F.col("l_suppkey").alias("name"))
    return S.match_records(gold, said, ["cas", "name"], document="l_orderkey")


_UNITS = r"WITH u AS (SELECT conv_id, turn, role, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS n FROM conversations)"


@query(_UNITS + ", s AS (SELECT role, list_sort(list(n)) AS l FROM u GROUP BY role) SELECT role, len(l) AS units, l[1] AS least, median AS middle, l[least(len(l), floor(len(l) * 0.9)::INT + 1)] AS p90, l[len(l)] AS most FROM s JOIN (SELECT role, median(n) AS median FROM u GROUP BY role) USING (role)")
def units_tokens_stats(spark, sf_dir):
    u = read(spark, sf_dir, "conversations").withColumn("n", T.token_count(F.col("text")))
    sums = u.groupBy("role").agg(F.count("*").alias("units"), F.min("n").alias("least"), F.median("n").alias("middle"), F.max("n").alias("most"))
    return sums.join(R.percentile_row(u, ["role"], "n"), "role").select("role", "units", "least", "middle", "p90", "most")


def _bm25(spark, sf_dir):
    units = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text")).select(F.col("conv_id").alias("document"), F.col("turn").alias("unit"), "text")
    queries = spark.createDataFrame([(1, "the of and"), (2, "la de le de"), (3, "die und der the")], "query_id int, text string")
    return units, queries, R.bm25(units, queries)


_BM25 = r"""WITH c AS (SELECT conv_id, turn, string_agg(text, ' ' ORDER BY text) AS text FROM conversations GROUP BY ALL),
w AS (SELECT conv_id AS document, turn AS unit, unnest(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')) AS word FROM c),
q AS (SELECT query_id, unnest(string_split(t, ' ')) AS word FROM (VALUES (1, 'the of and'), (2, 'la de le de'), (3, 'die und der the')) v(query_id, t)),
tf AS (SELECT document, unit, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY ALL), dl AS (SELECT document, unit, count(*) FILTER (word <> '') AS dl FROM w GROUP BY ALL),
m AS (SELECT document, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY 1), df AS (SELECT document, word, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT document, unit, query_id, sum(ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN q USING (word) JOIN df USING (document, word) JOIN m USING (document) JOIN dl USING (document, unit) GROUP BY ALL) """


@query(_BM25 + "SELECT document, unit, query_id, round(score, 6) AS score FROM s")
def bm25_scores(spark, sf_dir):
    return _bm25(spark, sf_dir)[2].withColumn("score", F.round("score", 6))


_RANKS = _BM25 + ", a AS (SELECT c.conv_id AS document, c.turn AS unit, k.query_id, round(coalesce(score, 0), 6) AS score FROM c CROSS JOIN (SELECT DISTINCT query_id FROM q) k LEFT JOIN s ON s.document = c.conv_id AND s.unit = c.turn AND s.query_id = k.query_id), r AS (SELECT *, row_number() OVER (PARTITION BY document, query_id ORDER BY score DESC, unit) AS rank FROM a) "


def _ranks(spark, sf_dir):
    units, queries, scores = _bm25(spark, sf_dir)
    return units, R.ranked(R.all_scores(scores, units, queries).withColumn("score", F.round("score", 6)), ["document", "query_id"])


@query(_RANKS + "SELECT document, unit, query_id, rank FROM r")
def bm25_rank(spark, sf_dir):
    return _ranks(spark, sf_dir)[1].select("document", "unit", "query_id", "rank")


_EVIDENCE = ", e AS (SELECT document, query_id, unit FROM r WHERE (document + unit * 3 + query_id) % 4 = 0) "
_COMPLETE = _RANKS + _EVIDENCE + ", i AS (SELECT e.document, e.query_id, count(*) AS n_pieces, avg((rank <= 3)::INT) AS recall_3, sum((rank <= 3)::INT)::BIGINT AS hits_3, bool_and(rank <= 3) AS complete_3 FROM e JOIN r USING (document, query_id, unit) GROUP BY ALL) "


def _complete(spark, sf_dir):
    _, ranks = _ranks(spark, sf_dir)
    evidence = ranks.where((F.col("document") + F.col("unit") * 3 + F.col("query_id")) % 4 == 0).select("document", "query_id", "unit")
    return R.completeness(evidence, ranks, ["document", "query_id"])


@query(_COMPLETE + "SELECT document, query_id, n_pieces, round(recall_3, 6) AS recall_3, hits_3, complete_3 FROM i")
def complete_at_k(spark, sf_dir):
    return _complete(spark, sf_dir).select("document", "query_id", "n_pieces", F.round("recall_3", 6).alias("recall_3"), F.col("hits_3").cast("long").alias("hits_3"), "complete_3")


@query(
    _COMPLETE + ", x AS (SELECT 'all' AS slice, * FROM i UNION ALL SELECT 'single', * FROM i WHERE n_pieces = 1 UNION ALL SELECT 'multi', * FROM i WHERE n_pieces > 1) "
    "SELECT slice, count(*) AS n, round(avg(recall_3), 6) AS macro_recall, round(avg(complete_3::INT), 6) AS macro_complete, round(sum(hits_3) / sum(n_pieces)::DOUBLE, 6) AS micro_recall FROM x GROUP BY slice"
)
def macro_micro_slices(spark, sf_dir):
    named = {"all": F.lit(True), "single": F.col("n_pieces") == 1, "multi": F.col("n_pieces") > 1}
    out = R.slices(_complete(spark, sf_dir), named, 3)
    return out.select("slice", "n", *[F.round(c, 6).alias(c) for c in ("macro_recall", "macro_complete", "micro_recall")])


@query(_UNITS + ", r AS (SELECT conv_id, turn, n, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, n, role ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM u) SELECT conv_id, turn, used FROM r WHERE used <= 200")
def token_budget_prefix(spark, sf_dir):
    u = read(spark, sf_dir, "conversations").withColumn("n_tokens", T.token_count(F.col("text")))
    ranks = u.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "n_tokens", "role")))
    return R.within_budget(ranks, ["conv_id"], 200).select("conv_id", "turn", "used")


@query(
    "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT query_id, vec_id, round(list_cosine_similarity(a, embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings ON vec_id <> query_id), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM r) SELECT query_id, vec_id, score, rank FROM k WHERE rank <= 5"
)
def cosine_topk(spark, sf_dir):
    """Every vector whose id is divisible by 50 against all others, in blocks."""
    return R.nearest_by_cosine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query(
    f"WITH b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS nr, count(*) OVER () AS n, {_FORM} AS q FROM benchmark), d AS (SELECT doc_id, {_FORM} AS t FROM documents), "
    "m AS (SELECT doc_id AS document, q <> '' AND contains(t, q) AS held FROM d JOIN b ON doc_id % n = nr) "
    "SELECT document, held AS value_exact, held::INT AS n_pages, held AS value_on_gold_page, held AS span_exact, CASE WHEN held THEN '' ELSE 'value not found; span not found' END AS note FROM m"
)
def locate_oracle_flags(spark, sf_dir):
    """Gold of a document is one passage in turn, as value and as span; its one page is the document's text."""
    passages = read(spark, sf_dir, "benchmark").select("item_id", "text")
    n = passages.count()
    numbered = passages.select((F.row_number().over(Window.orderBy("item_id")) - 1).alias("nr"), F.col("text").alias("q"))  # a table of fixed size
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), "text")
    span = F.array(F.struct(F.lit(1).alias("page"), F.col("q").alias("text"), F.lit(None).alias("box")).cast(E.SPANS[6:-1]))
    gold = docs.select("document").join(numbered, F.col("document") % n == F.col("nr")).select("document", F.lit("product_name").alias("field"), F.lit("PRESENT").alias("state"), F.lit("EXPLICIT").alias("derivation"), F.lit(None).cast("string").alias("rule"), F.col("q").alias("value"), span.alias("evidence"), F.array().cast(E.SPANS).alias("premises"))
    pages = docs.select("document", F.lit(1).alias("page"), "text", F.col("text").alias("row_text"))
    flags = B.oracle_flags(gold, pages)
    return flags.select("document", "value_exact", F.size("value_pages").alias("n_pages"), "value_on_gold_page", "span_exact", "note")


@query("SELECT source, substr(sha256('engine' || chr(0) || 'layer=native' || chr(0) || 'split=' || source || (SELECT string_agg(chr(0) || x, '' ORDER BY x) FROM (SELECT doc_id::VARCHAR AS x FROM documents e WHERE e.source = d.source))), 1, 16) AS id FROM (SELECT DISTINCT source FROM documents) d")
def prediction_id(spark, sf_dir):
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.collect_list(F.col("doc_id").cast("string")).alias("names"))
    conf = F.create_map(F.lit("split"), F.col("source"), F.lit("layer"), F.lit("native"))
    return d.select("source", K.prediction_id(F.lit("engine"), conf, F.col("names")).alias("id"))


@query("SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def guard_document_sets(spark, sf_dir):
    return K.set_difference(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT conv_id, turn, sha256(role || chr(0) || text) AS key FROM conversations WHERE conv_id * 7 + turn NOT IN (SELECT vec_id FROM embeddings)")
def cache_miss_antijoin(spark, sf_dir):
    asked = read(spark, sf_dir, "conversations").withColumn("vec_id", F.col("conv_id") * 7 + F.col("turn"))
    return K.cache_misses(asked, read(spark, sf_dir, "embeddings"), "vec_id").select("conv_id", "turn", K.cache_key(F.col("role"), F.col("text")).alias("key"))


_CODES = ("value_without_present", "present_without_value", "citation_on_not_stated", "derived_without_rule", "derived_without_premise", "derived_with_evidence", "direct_with_rule", "direct_with_premises", "direct_without_evidence")
_CLAIM = "WITH c AS (SELECT CASE turn % 4 WHEN 0 THEN 'PRESENT' WHEN 1 THEN 'NO_DATA' WHEN 2 THEN 'NOT_STATED' ELSE 'NOT_APPLICABLE' END AS state, conv_id % 3 > 0 AS v, conv_id % 2 = 0 AS derived, conv_id % 5 > 0 AS r, conv_id % 4 AS p, (conv_id + turn) % 3 = 0 AS e FROM conversations) "
_BREACH = (
    "state <> 'PRESENT' AND v", "state = 'PRESENT' AND NOT v", "state = 'NOT_STATED' AND (e OR p > 0)", "state <> 'NOT_STATED' AND derived AND NOT r", "state <> 'NOT_STATED' AND derived AND p = 0",
    "state <> 'NOT_STATED' AND derived AND e", "state <> 'NOT_STATED' AND NOT derived AND r", "state <> 'NOT_STATED' AND NOT derived AND p > 0", "state <> 'NOT_STATED' AND NOT derived AND NOT e",
)


@query(_CLAIM + " UNION ALL ".join(f"SELECT '{c}' AS code, count(*) FILTER ({w}) AS n FROM c" for c, w in zip(_CODES, _BREACH, strict=True)))
def contract_violation_counts(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    conv = F.col("conv_id")
    claims = c.select(
        F.element_at(F.array(*map(F.lit, ("PRESENT", "NO_DATA", "NOT_STATED", "NOT_APPLICABLE"))), (F.col("turn") % 4 + 1).cast("int")).alias("state"),
        F.when(conv % 3 > 0, "x").alias("value"),
        F.when(conv % 2 == 0, "DERIVED").otherwise("DIRECT").alias("derivation"),
        F.when(conv % 5 > 0, "rule").alias("rule"),
        (conv % 4).alias("n_premises"),
        ((conv + F.col("turn")) % 3 == 0).alias("has_evidence"),
    )
    return K.breach_counts(claims, _CODES)


@query("SELECT s_suppkey AS document, 'PRESENT' AS state, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 90 || ' C' ELSE '> ' || s_suppkey % 90 || ' C' END AS value FROM supplier")
def extract_flash_point(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    temp = F.concat((F.col("s_suppkey") % 90).cast("string"), F.lit(" C"))
    texts = F.array(F.concat(F.lit("Product name: "), F.col("s_name")), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("9.1 Flash point: "), temp)).otherwise(F.lit("Flash point:")), F.when(F.col("s_suppkey") % 2 == 1, F.concat(F.lit("> "), temp)).otherwise(F.lit("Boiling point: 100 C")))
    rows = s.select(F.col("s_suppkey").alias("document"), F.lit(1).alias("page"), F.posexplode(texts).alias("row_no", "text"))
    return X.first_usable(X.candidates(rows, "flash_point"), "flash_point").select("document", "state", "value")


_IDENT = "'identifier_undefined_for_form'"


@query(
    "WITH p AS (SELECT p_partkey AS document, p_partkey % 4 AS kind, p_size, trim(regexp_replace(trim(p_name, ' :;,.'), '\\s+', ' ', 'g')) AS name FROM part), f AS (SELECT unnest(['product_name', 'supplier_name', 'substance_or_mixture', 'product_cas_number', 'chemical_formula', 'molecular_weight', 'flash_point']) AS field) "
    "SELECT document, field, "
    "CASE WHEN field = 'product_name' THEN 'PRESENT' WHEN field = 'flash_point' THEN CASE WHEN document % 3 = 0 THEN 'PRESENT' ELSE 'NO_DATA' END WHEN field = 'substance_or_mixture' AND kind <> 2 THEN 'PRESENT' "
    "WHEN field IN ('product_cas_number', 'chemical_formula', 'molecular_weight') AND kind < 2 THEN 'NOT_APPLICABLE' WHEN field = 'product_cas_number' AND kind = 3 OR field = 'chemical_formula' AND kind = 2 THEN 'PRESENT' ELSE 'NOT_STATED' END AS state, "
    "CASE WHEN field = 'product_name' THEN name WHEN field = 'flash_point' AND document % 3 = 0 THEN p_size || ' C' WHEN field = 'substance_or_mixture' AND kind < 2 THEN 'MIXTURE' WHEN field = 'substance_or_mixture' AND kind = 3 THEN 'SUBSTANCE' "
    "WHEN field = 'product_cas_number' AND kind = 3 THEN '7440-37-1' WHEN field = 'chemical_formula' AND kind = 2 THEN 'H2O' END AS value, "
    f"CASE WHEN field = 'substance_or_mixture' AND kind IN (1, 3) THEN 'composition_implies_form' WHEN field IN ('product_cas_number', 'chemical_formula', 'molecular_weight') AND kind < 2 THEN {_IDENT} END AS rule, "
    "CASE WHEN field = 'substance_or_mixture' AND kind = 3 THEN 2 WHEN field = 'substance_or_mixture' AND kind = 1 THEN 3 WHEN field IN ('product_cas_number', 'chemical_formula', 'molecular_weight') AND kind = 0 THEN 1 "
    "WHEN field IN ('product_cas_number', 'chemical_formula', 'molecular_weight') AND kind = 1 THEN 3 ELSE 0 END AS n_premises FROM p, f"
)
def extract_document_fields(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    section = lambda *rows: F.array(F.lit("SECTION 3: Composition"), *map(F.lit, rows), F.lit("SECTION 4: First aid"))
    shares = (
        F.when(kind == 0, F.array(F.lit("Chemical description: Mixture of substances")))
        .when(kind == 1, section("Ingredient C.A.S. No. % by Wt", "Aluminum 7429-90-5 1~10", "Copper 7440-50-8 1~15"))
        .when(kind == 2, F.array(F.lit("Molecular formula: H2O")))
        .otherwise(section("argon 7440-37-1 100", "There are no impurities or stabilizers", "CAS No.: 7440-37-1"))
    )
    flash = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" C"))).otherwise("no data available")
    texts = F.concat(F.array(F.concat(F.lit("Product name: "), F.col("p_name"))), shares, F.array(F.concat(F.lit("Flash point: "), flash)))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("document"), F.lit(1).alias("page"), F.posexplode(texts).alias("row_no", "text"))
    claims = P.extract_documents(rows)
    return claims.select("document", "field", "state", "value", "rule", F.coalesce(F.array_size("premises"), F.lit(0)).alias("n_premises"))


_SCORED = {
    # field: axes in order for a claim that is right, has another value or rule, another state or kind
    **dict.fromkeys(("flash_point", "product_name", "supplier_name", "product_cas_number", "molecular_weight", "substance_or_mixture"), ("+++++++", "+-++++-", "-----++")),
    "chemical_formula": ("+++++++", "+++++--", "+++++-?"),
}
#: Lines of the page, with a field's value and another one; %d is the product's size.
_LINES = {
    "product_name": ("Product name: Acid %d", "Acid %d", "Base %d"),
    "supplier_name": ("Supplier: Acme %d Ltd", "acme %d ltd.", "Other %d Ltd"),
    "product_cas_number": ("CAS No.: 7732-18-5 (%d)", "7732-18-5", "7440-37-1"),
    "molecular_weight": ("Molecular weight: %d g/mol", "%d,0 g/mol", "9%d g/mol"),
    "substance_or_mixture": ("Substance/mixture %d: Mixture", "MIXTURE", "SUBSTANCE"),
}
_ROW = {side: f"struct<field: string, state: string, derivation: string, rule: string, value: string, evidence: {E.SPANS if side == 'gold' else E.SPANS[6:-1]}, premises: {E.SPANS}>" for side in ("gold", "claim")}
_STATUS = {"+": "satisfied", "-": "violated", "?": "undecidable"}


@query(
    "SELECT p_partkey AS document, field, "
    + ", ".join(
        "CASE p_partkey % 4 WHEN 0 THEN 'violated' "
        + " ".join(f"WHEN {i + 1} THEN CASE field " + " ".join(f"WHEN '{f}' THEN '{_STATUS[v[i][a]]}'" for f, v in _SCORED.items()) + " END" for i in range(3))
        + f" END AS {axis}"
        for a, axis in enumerate(S.AXES)
    )
    + f", p_partkey % 4 = 1 AS joint FROM part, (VALUES {', '.join(f'({chr(39)}{f}{chr(39)})' for f in _SCORED)}) AS f(field)"
)
def evaluate_claims(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("document"), F.col("p_size").cast("int").alias("size"), (F.col("p_partkey") % 4).alias("kind"))
    k, none, no_spans = F.col("kind"), F.lit(None).cast("string"), F.array().cast(E.SPANS)
    flash, mixture, missing = F.format_string("Flash point: %d C", "size"), F.lit("Chemical description: Mixture of substances"), F.lit("Flash point: no data available")
    span = lambda n, text, y: F.struct(F.lit(n), text, F.struct(F.lit(0.1), F.lit(y), F.lit(0.9), F.lit(y + 0.1))).cast(E.SPANS[6:-1])
    rows = lambda kind, *values: parts.where("kind > 0" if kind == "claim" else "true").select("document", F.inline(F.array(*[F.struct(*v).cast(_ROW[kind]) for v in values])))
    text_of = lambda form: F.replace(F.lit(form), F.lit("%d"), F.col("size").cast("string"))
    lines = {f: (text_of(line), text_of(value), text_of(other), 0.5 + 0.04 * i) for i, (f, (line, value, other)) in enumerate(_LINES.items())}
    gold = rows(
        "gold",
        *[(F.lit(f), F.lit("PRESENT"), F.lit("EXPLICIT"), none, value, F.array(span(1, line, y)), no_spans) for f, (line, value, _, y) in lines.items()],
        (F.lit("flash_point"), F.lit("PRESENT"), F.lit("EXPLICIT"), none, F.format_string("%d C", "size"), F.array(span(1, flash, 0.1)), no_spans),
        (F.lit("chemical_formula"), F.lit("NOT_APPLICABLE"), F.lit("ONTOLOGY"), F.lit(D.IDENTIFIER_RULE), none, no_spans, F.array(span(1, mixture, 0.3))),
    )
    said, shown = F.format_string("%d C", F.col("size") + F.when(k == 2, 5).otherwise(0)), F.when(k == 3, span(2, missing, 0.1)).otherwise(span(1, flash, 0.1))
    claims = rows(
        "claim",
        *[(F.lit(f), F.when(k == 3, "NO_DATA").otherwise("PRESENT"), F.lit("DIRECT"), none, F.when(k == 1, value).when(k == 2, other), F.when(k == 3, span(2, missing, 0.1)).otherwise(span(1, line, y)), no_spans) for f, (line, value, other, y) in lines.items()],
        (F.lit("flash_point"), F.when(k == 3, "NO_DATA").otherwise("PRESENT"), F.lit("DIRECT"), none, F.when(k < 3, said), shown, no_spans),
        (F.lit("chemical_formula"), F.lit("NOT_APPLICABLE"), F.when(k == 3, "DIRECT").otherwise("DERIVED"), F.when(k == 1, D.IDENTIFIER_RULE).when(k == 2, D.COMPOSITION_RULE), none, F.when(k == 3, span(1, mixture, 0.3)), F.when(k < 3, F.array(span(1, mixture, 0.3))).otherwise(no_spans)),
    )
    texts = F.array(F.struct(F.lit(1).alias("page"), F.concat_ws("\n", flash, mixture, *[line for line, *_ in lines.values()]).alias("text")), F.struct(F.lit(2).alias("page"), missing.alias("text")))
    pages = parts.select("document", F.inline(texts)).withColumn("row_text", F.col("text"))
    return E.evaluate(gold, claims, pages).select("document", "field", *S.AXES, "joint")


@query(
    "WITH s AS (SELECT o_orderkey AS document, CASE o_orderkey % 3 WHEN 0 THEN 'EXPLICIT' WHEN 1 THEN 'ONTOLOGY' ELSE 'COMPOSITION_IMPLIED' END AS d, o_orderkey % 2 = 0 AS cross_page, greatest(o_orderkey * 7 % 10, o_orderkey % 11) / 10.0::DOUBLE AS best, least(o_orderkey * 7 % 10, o_orderkey % 11) / 10.0::DOUBLE AS worst FROM orders), "
    "t AS (SELECT CASE WHEN d = 'EXPLICIT' THEN CASE WHEN worst >= 0.5 THEN 'contrast' END WHEN best >= 0.5 THEN NULL WHEN d = 'COMPOSITION_IMPLIED' THEN 'composition_implied' WHEN cross_page THEN 'ontology_cross_page' ELSE 'ontology_same_page' END AS stratum, document, CASE WHEN d = 'EXPLICIT' THEN worst ELSE best END AS score FROM s), "
    "r AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY CASE WHEN stratum = 'contrast' THEN -score ELSE score END, CASE WHEN stratum = 'contrast' THEN -document ELSE document END) AS i FROM t WHERE stratum IS NOT NULL) "
    "SELECT stratum, n, document, score FROM r WHERE i = 1"
)
def judged_cases(spark, sf_dir):
    k = F.col("o_orderkey")
    scores = F.array((k * 7 % 10) / 10.0, (k % 11) / 10.0)
    kind = F.when(k % 3 == 0, "EXPLICIT").when(k % 3 == 1, "ONTOLOGY").otherwise("COMPOSITION_IMPLIED")
    scored = read(spark, sf_dir, "orders").select(k.alias("document"), F.lit("x").alias("field"), kind.alias("derivation"), (k % 2 == 0).alias("cross_page"), scores.alias("piece_scores"))
    return R.case_picks(scored).select("stratum", "n", "document", "score")


#: Last digits of the documents that break a rule; a derived claim that cites nothing breaks three.
_BROKEN = {
    "no_structured_output": (1,), "schema_invalid": (2,), "quote_not_verbatim": (3,), "state_carries_value": (4,), "present_without_value": (5,), "not_stated_with_citation": (6,),
    "claim_without_citation": (7, 9), "direct_with_rule_or_premises": (8,), "derived_without_rule": (9,), "derived_without_premises": (9,),
}


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS code, count(*) FILTER (s_suppkey % 10 IN ({', '.join(map(str, _BROKEN.get(c, (-1,))))})) AS n, n AS documents FROM supplier" for c in M.CODES)
)
def response_breach_counts(spark, sf_dir):
    """Answers that break the contract in one way each, by the document's last digit."""
    k = F.col("s_suppkey") % 10
    quote = F.to_json(F.struct(F.lit(1).alias("page"), F.concat(F.lit("Product name: "), F.when(k == 3, "other").otherwise(F.col("s_name"))).alias("quote")))
    state = F.when(k == 4, "NO_DATA").when(k == 6, "NOT_STATED").otherwise("PRESENT")
    kind, cited = F.when(k == 9, "DERIVED").otherwise("DIRECT"), F.when(k == 7, "null").otherwise(quote)
    cited = F.when(k == 9, "null").otherwise(cited)
    claim = F.concat(
        F.lit('{"state": "'), state, F.lit('", "value": '), F.when(k.isin(5, 6), "null").otherwise(F.concat(F.lit('"'), F.col("s_name"), F.lit('"'))), F.lit(', "derivation": "'), kind,
        F.lit('", "rule": '), F.when(k == 8, F.lit(f'"{D.IDENTIFIER_RULE}"')).otherwise("null"), F.lit(', "evidence": '), cited, F.lit(', "premises": []}'),
    )
    rest = ", ".join(f'"{name}": {{"state": "NOT_STATED", "value": null, "derivation": "DIRECT", "rule": null, "evidence": null, "premises": []}}' for name, *_ in Q.FIELDS[1:])
    answer = F.concat(F.lit('{"product_name": '), claim, F.lit(f', {rest}, "ingredients_state": "NOT_STATED", "ingredients": []}}'))
    docs = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document"), F.when(k == 2, "{}").when(k != 1, answer).alias("content"), F.concat(F.lit("Product name: "), F.col("s_name")).alias("text"))
    pages = docs.select("document", F.lit(1).alias("page"), "text", F.col("text").alias("row_text"))
    return M.breach_counts(M.breaches(docs.select("document", "content"), pages))


@query(
    "SELECT DISTINCT l_orderkey AS document, (l_linenumber + 1000) || '-10-' || (l_linenumber % 10) AS cas, 'material ' || chr((96 + l_linenumber)::INT) AS name, (l_linenumber * 10) || ' - ' || (l_linenumber * 10 + 5) || ' %' AS concentration FROM lineitem"
)
def extract_ingredients(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    line = F.concat(F.lit("material "), F.char(96 + n), F.lit(" CAS No. "), F.format_string("%d-10-%d", n + 1000, n % 10), F.format_string(" %d - %d %%", n * 10, n * 10 + 5))
    rows = li.select(F.col("l_orderkey").alias("document"), F.lit(1).alias("page"), (n * 2).alias("row_no"), line.alias("text"))
    orders = li.select("l_orderkey").distinct()
    more = F.array(*[F.struct(F.lit(at).alias("row_no"), F.lit(text).alias("text")) for at, text in ((1, "SECTION 3: Composition"), (90, "Section 4: First aid"), (91, "other 7439-89-6 50 %"))])
    rows = rows.unionByName(orders.select(F.col("l_orderkey").alias("document"), F.lit(1).alias("page"), F.inline(more)))
    return X.ingredient_rows(rows).select("document", "cas", "name", "concentration")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return windowed_counts(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 2))


@query()
def fuzzy_score(spark, sf_dir):
    """Every document and passage, as it is and with one character in forty altered (odd numbers), of likeness 95 or more: 100
    where it stands verbatim, less where not; rows only, compared with brute force in the tests."""
    b = read(spark, sf_dir, "benchmark")
    altered = b.select((F.col("item_id") * 2 + 1).alias("item_id"), F.regexp_replace("text", r"(?s)(.{39}).", "$1#").alias("text"))
    asked = b.select((F.col("item_id") * 2).alias("item_id"), "text").unionByName(altered)
    return search.near_passages(read(spark, sf_dir, "documents"), asked, least=95).withColumn("score", F.round("score", 6))


@query()
def nfkc_norm(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("digest"))


from . import plan_queries  # noqa: E402, F401

__all__ = ["ORACLES", "QUERIES"]
