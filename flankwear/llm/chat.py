"""Chat formatting by perspective rotation, DataFrame functions only.

For every participant of a dialogue the dialogue is rendered once with that speaker as the assistant and
all others as named users; only the assistant's own words (and the end mark after them) are to be learnt,
which the mask says as character spans of the rendered text.  System turns are rendered alike for all.

Turns are numbered in order of (turn, role, text) by a range sort that spreads a long dialogue over many
tasks.  Every participant of the dialogue gets the whole of it, whether they speak early, late or once; a
rendering is stored in parts of ``PART_TURNS`` turns, so one dialogue may hold any share of all rows.  Joined
in order of ``part``, a participant's parts are the rendering; ``first_turn`` and ``first_char`` say where in
it a part begins.

Markers inside a text are escaped (``<|`` becomes ``<\\|``), nothing else is changed; in a header a role's
``<|``, ``|>`` and line breaks are escaped too (``<\\|``, ``|\\>``, ``\\n``), so that no role forges a header.  Defined results: null
text is empty; a null role counts as the speaker ``unknown``; null turns come first; repeated rows are turns
of their own; a null conv_id is a dialogue like any other; a dialogue of system turns alone gives no row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flankwear.operators.ordering import _ns_join, with_position

PART_TURNS = 256
SYSTEM = ("system",)     # roles that are no participants
END = "<|end|>\n"


#: What a role's characters become in a header.
ESCAPES = (("<|", "<\\|"), ("|>", "|\\>"), ("\n", "\\n"))


def _header(role: Column, me: Column) -> Column:
    shown = role
    for plain, escaped in ESCAPES:
        shown = F.replace(shown, F.lit(plain), F.lit(escaped))
    return (F.when(role == me, F.lit("<|assistant|>\n"))
            .when(role.isin(*SYSTEM), F.concat(F.lit("<|"), role, F.lit("|>\n")))
            .otherwise(F.concat(F.lit("<|user name="), shown, F.lit("|>\n"))))


def _samples(rows: DataFrame) -> DataFrame:
    """Every part of a dialogue with each of its participants, and the characters of their rendering before the part;
    from counts and lengths only, no text."""
    cells = rows.groupBy("conv_id", "part", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text") + F.lit(len(END))).alias("chars"))
    other = F.length(_header(F.col("role"), F.lit(None).cast("string")))
    sizes = cells.groupBy("conv_id", "part").agg(
        F.sum(F.col("chars") + F.col("n") * other).alias("plain"),
        F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("own"))                     # PART_TURNS at most
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("plain", F.coalesce(F.sum("plain").over(earlier.partitionBy("conv_id")), F.lit(0)))
    speakers = cells.where(~F.col("role").isin(*SYSTEM)).select("conv_id", F.col("role").alias("participant")).distinct()
    grid = _ns_join(sizes, speakers, ["conv_id"], "inner").select(
        "conv_id", "part", "participant", "plain", F.coalesce(F.try_element_at("own", F.col("participant")), F.lit(0)).alias("n"))
    spoken = F.coalesce(F.sum("n").over(earlier.partitionBy("conv_id", "participant")), F.lit(0))
    me = F.col("participant")
    less = F.length(_header(me, me)) - F.length(_header(me, F.lit(None).cast("string")))
    return grid.select("conv_id", "part", "participant", (F.col("plain") + spoken * less).alias("first_char"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per dialogue part and participant of the dialogue: conv_id, part, participant, n_turns, n_own,
    rendered, spans (start and end of the characters to learn, ends exclusive, counted from the part's start), n_chars,
    n_learn, first_turn and first_char (turns and characters of the rendering before the part)."""
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
                        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("<\\|")).alias("text"))
    rows = with_position(rows, ["conv_id"], ["turn", "role", "text"], "pos")
    rows = rows.withColumn("part", F.floor(F.col("pos") / part_turns))
    parts = (rows.groupBy("conv_id", "part")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns")))    # PART_TURNS at most
    each = _ns_join(parts, _samples(rows), ["conv_id", "part"], "inner")
    me = F.col("participant")
    said = each.withColumn("said", F.transform("turns", lambda t: F.struct(
        (t["role"] == me).alias("own"), _header(t["role"], me).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"))))
    said = said.withColumn("rendered", F.array_join(F.transform("said", lambda x: F.concat(x["head"], x["body"])), ""))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["own"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    spans = F.aggregate("said", zero, step, lambda a: a["spans"])
    out = said.select("conv_id", "part", "participant", F.size("turns").alias("n_turns"), "rendered", spans.alias("spans"),
                      (F.col("part") * part_turns).alias("first_turn"), "first_char")
    return out.select("*", F.size("spans").alias("n_own"), F.length("rendered").alias("n_chars"),
                      F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"]).alias("n_learn"))


def oracle_sql(part_turns: int = PART_TURNS) -> str:
    """The query's digest of the same result in DuckDB text."""
    shown = "q.role"
    for plain, escaped in ESCAPES:
        shown = f"replace({shown}, {plain!r}, '{escaped}')" if plain != "\n" else f"replace({shown}, chr(10), '{escaped}')"
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<\\|') AS text, turn
           FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM t),
q AS (SELECT *, pos // {part_turns} AS part FROM n),
s AS (SELECT DISTINCT conv_id, role AS participant FROM q WHERE role <> 'system'),
r AS (SELECT s.conv_id, q.part, s.participant, q.pos, q.role = s.participant AS own,
             CASE WHEN q.role = s.participant THEN '<|assistant|>' WHEN q.role = 'system' THEN '<|system|>'
                  ELSE '<|user name=' || {shown} || '|>' END || chr(10) AS head, q.text || '<|end|>' || chr(10) AS body
      FROM s JOIN q ON s.conv_id IS NOT DISTINCT FROM q.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant ORDER BY pos) AS e FROM r)
SELECT conv_id, part::BIGINT AS part, participant, count(*)::BIGINT AS n_turns, count(*) FILTER (own)::BIGINT AS n_own,
       sum(length(head) + length(body))::BIGINT AS n_chars, coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS n_learn,
       coalesce(string_agg((e - length(body))::BIGINT || '-' || e::BIGINT, ',' ORDER BY pos) FILTER (own), '') AS spans,
       string_agg(head || body, '' ORDER BY pos) AS rendered
FROM o GROUP BY conv_id, part, participant"""
