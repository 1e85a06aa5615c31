"""Corrections of how goals are handed over, induced from a session's turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import goals as G
from ..functions import text as T
from . import ordered

_FIELDS = ["position", "artifact", "breaks_off", "shape", "correcting", "unfenced", "other_thing", "specific", "copying", "fenced", "thing_first", "said_key", "breaks"]


def goal_turns(turns: DataFrame) -> DataFrame:
    """User turns (session, position, said) with their signals, of sessions in which a goal is spoken of at all."""
    user = turns.filter("role = 'user'").select("session", "position", "text")
    spoken = user.filter(F.col("text").rlike(G.SIGNALS["artifact"])).select("session").distinct()
    raw = user.join(spoken, "session", "left_semi").withColumn("raw", G.bare(F.col("text")))
    flat = raw.withColumn("flat", T.compact_whitespace(T.normalize_memory_text(F.col("raw")))).filter("flat <> ''")
    said = flat.withColumn("may_correct", G.may_correct(F.col("raw"), F.col("flat"))).withColumn("said", T.clip(F.col("flat"), 240))
    return said.select("session", "position", "may_correct", "said", *(F.col("said").rlike(p).alias(k) for k, p in G.SIGNALS.items()), G.lasting(F.col("said")).alias("lasting"), G.is_break(F.col("said")).alias("breaks_off"), G.source_key(F.col("said")).alias("said_key"))


def _linked(window: Column, context: Column) -> Column:
    """Struct of a context's position, the corrections linked to it, in order, and whether they tell how to copy."""
    there = F.filter(window, lambda r: (r["position"] >= context["position"]) & (r["breaks"] == context["breaks"]) & r["shape"] & r["correcting"] & ~r["unfenced"] & ~(r["other_thing"] & ~r["artifact"]))
    start = F.struct(F.array().cast("array<long>").alias("found"), F.lit("").alias("first"), F.lit(False).alias("useful"))

    def step(at: Column, r: Column) -> Column:
        later = r["position"] > context["position"]
        take = r["artifact"] | r["specific"] | (later & (F.size(at["found"]) == 0)) | ((at["first"] != "") & (at["first"] == r["said_key"]))
        taken = F.struct(F.array_append(at["found"], r["position"]).alias("found"), F.when(later & (at["first"] == ""), r["said_key"]).otherwise(at["first"]).alias("first"), (at["useful"] | r["copying"] | r["fenced"]).alias("useful"))
        return F.when(take, taken).otherwise(at)

    got = F.aggregate(there, start, step)
    return F.struct(context["position"].alias("context"), got["found"].alias("found"), got["useful"].alias("useful"))


def induced_goal_preferences(turns: DataFrame, size: int = ordered.SIZE) -> DataFrame:
    """session, kind and supports (positions, in order) of sessions whose user turns induce the preference `G.PREFERENCE`.

    `turns` has session, position (a distinct number within it), role and text. A directive states it outright, for good, and
    the last one counts. Else a context (a turn about a goal) and two corrections linked to it within 12 turns that may correct,
    without a turn to another thing between, induce it; the latest window counts, with its context, last two corrections and
    last turn that asks for the thing first, four at most. A later turn that rejects code fences takes either back.
    Sessions of any length are worked on in blocks of `size` positions. Null texts say nothing.
    """
    every = ordered.running(goal_turns(turns), "session", "position", {"breaks": F.col("breaks_off").cast("long")}, {}, size)
    valid = every.filter("may_correct")
    last = F.when(F.col("artifact"), F.struct("position", "breaks"))
    known = ordered.running(valid, "session", "position", {}, {"goal": last}, size)
    before = F.col("breaks") - F.col("breaks_off").cast("long")
    active = F.coalesce(before == F.col("goal.breaks"), F.lit(False))
    rejects = F.col("unfenced") & F.col("shape") & (F.col("artifact") | F.col("lasting") | active) & ~F.col("other_thing")
    directs = F.col("artifact") & F.col("shape") & F.col("fenced") & (F.col("copying") | F.col("thing_first")) & F.col("lasting") & ~F.col("unfenced")
    told = known.groupBy("session").agg(F.max(F.when(rejects, F.col("position"))).alias("rejected"), F.max(F.when(directs, F.col("position"))).alias("directed"))
    window = F.col("window")
    seen = ordered.sliding(valid, "session", "position", F.struct(*_FIELDS), G.WINDOW, "window", size)
    worth = F.exists(window, lambda r: r["artifact"]) & (F.size(F.filter(window, lambda r: r["shape"] & r["correcting"])) >= 2)
    contexts = F.reverse(F.filter(window, lambda r: r["artifact"] & ~r["breaks_off"]))
    fitting = F.filter(F.transform(contexts, lambda c: _linked(window, c)), lambda x: (F.size(x["found"]) >= 2) & x["useful"])
    judged = seen.filter(worth).select("session", "position", F.get(fitting, F.lit(0)).alias("best"), F.transform(F.filter(window, lambda r: r["thing_first"]), lambda r: r["position"]).alias("firsts")).filter("best is not null")
    supports = F.array_sort(F.array_distinct(F.concat(F.array("best.context"), F.slice("best.found", -2, 2), F.when(F.size("firsts") > 0, F.slice("firsts", -1, 1)).otherwise(F.array().cast("array<long>")))))
    latest = judged.groupBy("session").agg(F.max(F.struct("position", F.element_at("best.found", -1).alias("corrected"), supports.alias("supports"))).alias("latest"))
    both = told.join(latest, "session", "left")
    directed = F.col("directed").isNotNull()
    late = F.coalesce(F.col("rejected") > F.coalesce(F.col("directed"), F.col("latest.corrected")), F.lit(False))
    found = both.filter((directed | F.col("latest").isNotNull()) & ~late)
    fitted = F.slice(F.reverse(F.col("latest.supports")), 1, G.SUPPORT)
    return found.select("session", F.when(directed, "directive").otherwise("corrections").alias("kind"), F.when(directed, F.array("directed")).otherwise(F.reverse(fitted)).alias("supports"))
