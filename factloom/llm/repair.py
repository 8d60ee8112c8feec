"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``, by a native fold.

``repair`` flags faults with windows (blank, duplicate, truncated, adjacent roles that may not follow each other), collects a
conversation's rows as sorted structs and folds them with ``aggregate``. The fold carries four ``(cost, audit)`` structs, one
for each state of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn. A row is kept
(0), given the role user or assistant (3) or deleted (4, required for blank and duplicate rows), a missing turn inserted (3);
a truncated row that stays adds 3. ``least`` on the structs picks the cheapest way and, of equally cheap ones, the
ASCII-least audit. Two audits of one state and one cost are never prefixes of each other, as what the longer has beyond the
shorter would be inserts, which cost; so the least prefix stays least whatever follows, and four structs are enough.
The audit settles the repaired turns: roles of what stays follow from its place and from whether a system turn opens it.

All windows and the aggregate are keyed by ``conv_id``, so rows are shuffled once. A repaired conversation is one value of
the result (and its digest needs it whole), so a conversation must fit a row; no key is shared between conversations.

Defined results: a null role or text is one space, so it is blank or has an initial outside the grammar; an empty role
has no initial and is never kept; a null turn sorts first, and ties in turn go by role and text; repeated rows are duplicates;
a null ``conv_id`` is a conversation; a conversation without a row (all ``present`` false) has zeros, an empty audit and no turns;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a row of nothing but these holds is blank.
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_FAR = "1000000000000000L"  # cost of a state that no edits reach


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with seeded faults, ``present`` false where a row is dropped.

    crc32 of ``conv_id:turn`` modulo 20 decides (a null is one space): 0 drops the row, 1 empties its text, 2 removes its
    ``[.!?]``, 3 repeats it, 4 sets its role to user."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text, role = F.coalesce(F.col("text").cast("string"), blank), F.coalesce(F.col("role").cast("string"), blank)
    seeded = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("kind"))
    kind = F.col("kind")
    changed = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    columns = ("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"))
    return seeded.select(*columns, changed.alias("text"), (kind != 0).alias("present"), copies.alias("copy")).drop("copy")


def flag(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """Rows with their ``place``, ``initial``, ``fault`` (the first of blank, duplicate, truncated, or null), ``illegal`` and ``new_turn``."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("text", "role"))
    here = (F.lit(True) if present is None else present).alias("present")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, here)
    told = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.withColumns({"initial": F.substring("role", 1, 1), "blank": told == "", "cut": ~F.right(told, F.lit(1)).isin(".", "!", "?")})
    # The first window asks for the rows of a conversation together, and the second and the aggregate find them so.
    line = Window.partitionBy("conv_id").orderBy(F.desc("present"), F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({"place": F.row_number().over(line), "before": F.lag("initial").over(line), "turn_before": F.lag("turn").over(line)})
    same = Window.partitionBy("conv_id", "present", "role", "text").orderBy("place")
    fault = F.when(F.col("blank"), "blank").when(F.row_number().over(same) > 1, "duplicate").when(F.col("cut"), "truncated")
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    fresh = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    flags = (fault.alias("fault"), illegal.alias("illegal"), fresh.alias("new_turn"))
    return rows.select("conv_id", "turn", "place", "role", "text", "present", "initial", *flags)


def _with(state: str, cost: str, letter: str) -> str:
    return f"named_struct('cost', {state}.cost + {cost}, 'audit', concat({state}.audit, {letter}))"


def _states(*parts: str) -> str:
    return "named_struct(" + ", ".join(f"'e{i}', {p}" for i, p in enumerate(parts)) + ")"


def _fold() -> str:
    """The fold over ``turns``: each step lets a row go each way, then lets turns be inserted behind it."""
    state = "named_struct('cost', {}, 'audit', '{}')".format
    start = _states(state("0L", ""), state(_FAR, ""), state(f"{INSERT}L", "I"), state(f"{2 * INSERT}L", "II"))
    gone = [_with(f"s.e{i}", f"{DELETE}L", "'D'") for i in range(4)]

    def stays(source: str, initial: str) -> str:
        """To the state of ``initial``: kept if the row has it, else given its role."""
        cost, letter = f"if(r.initial = '{initial}', r.extra, r.extra + {REROLE}L)", f"if(r.initial = '{initial}', 'K', 'R')"
        return f"if(r.free, {_with(source, cost, letter)}, null)"

    system = f"if(r.free and r.initial = 's', {_with('s.e0', 'r.extra', chr(39) + 'K' + chr(39))}, null)"
    row = _states(gone[0], f"least({gone[1]}, {system})", f"least({gone[2]}, {stays('least(s.e0, s.e1, s.e3)', 'u')})", f"least({gone[3]}, {stays('s.e2', 'a')})")
    user = f"least(x.e2, {_with('least(x.e0, x.e1, x.e3)', f'{INSERT}L', chr(39) + 'I' + chr(39))})"
    filled = _states("x.e0", "x.e1", "x.e2", f"least(x.e3, {_with('x.e2', f'{INSERT}L', chr(39) + 'I' + chr(39))})")
    opened = _states("x.e0", "x.e1", user, "x.e3")
    steps = f"transform(transform(array({row}), x -> {opened}), x -> {filled})[0]"
    return f"aggregate(turns, {start}, (s, r) -> {steps}, s -> least(s.e0, s.e3))"


#: Rows and their edits side by side: what stays, with the turns inserted before it; a null role follows from the place.
_ITEMS = """
concat(flatten(zip_with(turns, regexp_extract_all(audit, '(I*[KRD])', 1), (r, e) -> concat(
    array_repeat(named_struct('role', cast(null as string), 'text', ''), length(e) - 1),
    if(right(e, 1) = 'D', array(), array(named_struct('role', if(right(e, 1) = 'K', r.role, null), 'text', r.text)))))),
  array_repeat(named_struct('role', cast(null as string), 'text', ''), length(regexp_extract(audit, '(I*)$', 1))))
"""
_LINES = """
array_join(transform(items, (x, i) -> concat(
    coalesce(x.role, if((i - if(startswith(items[0].role, 's'), 1, 0)) % 2 = 0, 'user', 'assistant')), ':', x.text)), '\n')
"""


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired`` for every conversation of ``turns``.

    Rows where ``present`` is false count as dropped: they only keep their conversation in the result."""
    rows = flag(turns, present)
    here = F.col("present")
    extra = F.when(F.col("fault") == "truncated", F.lit(TRUNCATED)).otherwise(F.lit(0)).cast("long")
    free = F.coalesce(F.col("fault") == "truncated", F.lit(True))
    turn = F.when(here, F.struct("place", "role", "text", "initial", free.alias("free"), extra.alias("extra")))
    number = F.when(here, F.col("turn"))
    counts = [F.count_if(here & (F.col("fault") == name)).alias(name) for name in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max(number) - F.min(number) + 1 - F.count_if(here & F.col("new_turn")), F.lit(0)).alias("gaps")
    seen = rows.groupBy("conv_id").agg(gaps, *counts, F.count_if(here & F.col("illegal")).alias("illegal"), F.sort_array(F.collect_list(turn)).alias("turns"))
    best = seen.withColumn("best", F.expr(_fold()))
    told = best.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "turns", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))
    lines = told.withColumn("items", F.expr(_ITEMS)).withColumn("repaired", F.when(F.size("items") > 0, F.expr(_LINES)).otherwise(F.lit("")))
    return lines.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) g(i)
), seeded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind
  FROM conversations, crc
), rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM seeded WHERE kind <> 0
), numbered AS (
  SELECT *, role[1] AS ini, lag(role[1]) OVER w AS before, row_number() OVER w AS k
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), flagged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault
  FROM numbered
), costs AS (
  SELECT *, coalesce(fault = 'truncated', true) AS free, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM flagged
), s AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, {'c': 0, 'a': ''} AS e0, {'c': 1000000, 'a': ''} AS e1, {'c': 3, 'a': 'I'} AS e2, {'c': 6, 'a': 'II'} AS e3
  FROM conversations
  UNION ALL
  SELECT conv_id, k, d0, d1, u, least(a, {'c': u.c + 3, 'a': u.a || 'I'}) FROM (
    SELECT *, least(d2, {'c': least(d0, d1, a).c + 3, 'a': least(d0, d1, a).a || 'I'}) AS u FROM (
      SELECT s.conv_id, r.k, {'c': e0.c + 4, 'a': e0.a || 'D'} AS d0,
        least({'c': e1.c + 4, 'a': e1.a || 'D'}, CASE WHEN free AND ini = 's' THEN {'c': e0.c + extra, 'a': e0.a || 'K'} END) AS d1,
        least({'c': e2.c + 4, 'a': e2.a || 'D'}, CASE WHEN free THEN {'c': least(e0, e1, e3).c + extra + CASE WHEN ini = 'u' THEN 0 ELSE 3 END,
          'a': least(e0, e1, e3).a || CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END} END) AS d2,
        least({'c': e3.c + 4, 'a': e3.a || 'D'}, CASE WHEN free THEN {'c': e2.c + extra + CASE WHEN ini = 'a' THEN 0 ELSE 3 END,
          'a': e2.a || CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END} END) AS a
      FROM s JOIN costs r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.k = s.k + 1))
), best AS (
  SELECT conv_id, arg_max(least(e0, e3), k) AS b FROM s GROUP BY conv_id
), edits AS (
  SELECT conv_id, b.a AS audit, i, b.a[i] AS edit, i - length(replace(b.a[1:i], 'I', '')) AS inserted FROM best, unnest(range(1, length(b.a) + 1)) u(i)
), kept AS (
  SELECT e.conv_id, e.edit, r.role, CASE WHEN e.edit = 'I' THEN '' ELSE r.text END AS text,
    row_number() OVER (PARTITION BY e.conv_id ORDER BY e.i) AS place
  FROM edits e LEFT JOIN costs r ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = e.i - e.inserted AND e.edit <> 'I' WHERE e.edit <> 'D'
), opened AS (
  SELECT *, coalesce(first_value(edit = 'K' AND role[1] = 's') OVER (PARTITION BY conv_id ORDER BY place), false)::INT AS shift FROM kept
), told AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - 1 - shift) % 2 = 0 THEN 'user' ELSE 'assistant' END
    || ':' || text, chr(10) ORDER BY place) AS repaired FROM opened GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM flagged GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, b.b.c::BIGINT AS cost, b.b.a AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN told t ON b.conv_id IS NOT DISTINCT FROM t.conv_id
"""
