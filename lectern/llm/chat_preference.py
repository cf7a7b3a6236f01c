"""Preference formatting of chosen and rejected conversations, by DataFrame operations only.

Method.  The two sides' turns are aggregated by (pair, turn, role, text) with a flag for each side;
the first turn where the sides differ is the least turn of a row that only one side has.  Turns
before it are the common prefix, rendered once as the prompt; each side's turns from there on are
its completion.  Segments carry a loss mask: 1 for an assistant's turn in a completion, else 0.
Output has one row per segment, so a conversation of any length never meets in one task;
:func:`assemble` joins the segments of conversations that are known to fit a row.

Pairs come from the conversations: those with the same first turn are paired in order of id, range
by range (:func:`mates`), so that at most one of an opening is left over, whatever the ids; one left
over is paired with a copy of itself that ends in the last assistant's turn of a neighbour, another
conversation of its hash group, a usual contrast; one without such a neighbour is kept as a single,
whose completion has no rejected side.

Defined results: rows without conv_id belong to no conversation and are left out; a null turn
counts as -1, a null role as ``user``, a null text as empty; several rows of one turn stand
together, ordered by role and text, and exact repeats of a row count once; equal sides are all
prompt; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import staged, unstage

#: conversations are paired in groups of ``2**BITS`` at most
BITS = 10


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def turns_of(conversations: DataFrame) -> DataFrame:
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()


def mates(heads: DataFrame) -> DataFrame:
    """``(conv_id, mate)``: conversations of one opening paired in order of id, each in one pair at most.

    Ranges of ``2**BITS`` ids first, then what is left over (one a range at most) in ranges of
    ``2**(2 * BITS)``, and so on to all ids: whatever ids there are and however many
    conversations open alike, no group holds more than ``2**BITS`` rows.
    """
    several = heads.groupBy("opening").agg(F.count("*").alias("n")).filter("n > 1").select("opening")
    left, pairs, gone = staged(heads.select("opening", "conv_id").join(several, "opening", "left_semi"), "openings"), [], []
    for shift in range(BITS, 64 + BITS, BITS):
        part = F.shiftright("conv_id", shift) if shift < 64 else F.lit(0)
        same = Window.partitionBy("opening", "part").orderBy("conv_id")
        ranked = left.withColumn("part", part).withColumn("k", F.row_number().over(same)).withColumn("mate", F.lead("conv_id").over(same)).filter("k % 2 = 1")
        ranked = staged(ranked.select("opening", "conv_id", "mate"), "mates")
        gone += [left]
        pairs.append(ranked.filter("mate IS NOT NULL").select("conv_id", "mate"))
        left = ranked.filter("mate IS NULL").select("opening", "conv_id")
        if not left.groupBy("opening").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
            break
    unstage(*gone)
    return reduce(DataFrame.unionByName, pairs)


def neighbours(heads: DataFrame) -> DataFrame:
    """``(conv_id, next)``: to each conversation that has an assistant's turn another one, from its group.

    Groups are dealt by a hash of the id, some ``2**BITS / 2`` to a group; the next id of the group is
    the neighbour, after the last the first.
    """
    speaking = heads.filter("cut IS NOT NULL").select("conv_id")
    groups = -(-speaking.count() * 2 >> BITS)
    dealt = speaking.withColumn("part", F.pmod(F.conv(F.substring(F.md5(F.col("conv_id").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(max(1, groups))))
    near = Window.partitionBy("part").orderBy("conv_id")
    whole = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return dealt.select("conv_id", F.coalesce(F.lead("conv_id").over(near), F.first("conv_id").over(whole)).alias("next"))


def pair_up(turns: DataFrame) -> DataFrame:
    """``(chosen, rejected, kind, cut)``: kind ``shared`` (same first turn), ``contrast`` (``rejected`` lends its
    last assistant's turn, which replaces what follows turn ``cut``) or ``single``."""
    says = F.when(F.col("role") == "assistant", F.col("turn"))
    heads = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("h"), F.max(says).alias("cut"))
    heads = staged(heads.select("conv_id", "cut", F.md5(F.concat_ws("\n", "h.role", "h.text")).alias("opening")), "heads")
    paired = mates(heads)
    second = paired.select(F.col("mate").alias("conv_id"))
    odd = heads.join(second, "conv_id", "left_anti").join(paired, "conv_id", "left").join(neighbours(heads), "conv_id", "left")
    lent = F.col("mate").isNull() & F.col("cut").isNotNull() & (F.col("next") != F.col("conv_id"))
    return odd.select(
        F.col("conv_id").alias("chosen"),
        F.coalesce("mate", F.when(lent, F.col("next"))).alias("rejected"),
        F.when(F.col("mate").isNotNull(), "shared").when(lent, "contrast").otherwise("single").alias("kind"),
        F.when(lent, F.col("cut")).alias("cut"),
    )


def sides(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(pair_id, kind, side, turn, role, text)``; a pair's id is the chosen conversation's."""
    chosen = turns.join(pairs, turns["conv_id"] == pairs["chosen"]).select(F.col("chosen").alias("pair_id"), "kind", "cut", "turn", "role", "text")
    shared = pairs.filter("kind = 'shared'")
    other = turns.join(shared, turns["conv_id"] == shared["rejected"]).select(F.col("chosen").alias("pair_id"), "kind", "turn", "role", "text")
    contrast = pairs.filter("kind = 'contrast'")
    last = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("l"))
    lent = last.join(contrast, last["conv_id"] == contrast["rejected"]).select(F.col("chosen").alias("pair_id"), "kind", F.col("cut").alias("turn"), F.lit("assistant").alias("role"), F.col("l.text").alias("text"))
    kept = chosen.filter("kind = 'contrast' AND turn < cut").drop("cut")
    rejected = other.unionByName(kept).unionByName(lent).withColumn("side", F.lit("rejected"))
    return chosen.drop("cut").withColumn("side", F.lit("chosen")).unionByName(rejected)


def format_pairs(rows: DataFrame) -> DataFrame:
    """Segments of pairs: ``rows`` has (pair_id, kind, side, turn, role, text), side ``chosen`` or ``rejected``.

    Returns ``(pair_id, kind, segment, turn, role, rendered, loss, prompt_turns)``.
    """
    merged = rows.groupBy("pair_id", "kind", "turn", "role", "text").agg(
        F.max((F.col("side") == "chosen").cast("int")).alias("c"), F.max((F.col("side") == "rejected").cast("int")).alias("r")
    )
    both = (F.col("c") == 1) & (F.col("r") == 1)
    # A single has no other side to differ from: its last assistant's turn parts prompt and completion.
    single = F.col("kind") == "single"
    at = F.coalesce(F.min(F.when(~single & ~both, F.col("turn"))), F.max(F.when(single & (F.col("role") == "assistant"), F.col("turn"))))
    cuts = merged.groupBy("pair_id").agg(at.alias("cut"))
    cut = merged.join(cuts, "pair_id").withColumn("prompt", F.col("cut").isNull() | (F.col("turn") < F.col("cut")))
    sided = F.when(F.col("prompt"), F.array(F.lit("prompt"))).otherwise(F.filter(F.array(F.when(F.col("c") == 1, "chosen"), F.when(F.col("r") == 1, "rejected")), lambda s: s.isNotNull()))
    out = cut.select("*", F.explode(sided).alias("segment"))
    loss = (F.col("segment") != "prompt") & (F.col("role") == "assistant")
    return out.select("pair_id", "kind", "segment", "turn", "role", render(F.col("role"), F.col("text")).alias("rendered"), loss.cast("int").alias("loss"), "cut")


def assemble(segments: DataFrame) -> DataFrame:
    """One row per pair with prompt, chosen and rejected strings and, per completion, its (length, loss) runs.

    For conversations whose text fits a row.
    """
    rows = segments.groupBy("pair_id", "kind").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "rendered", "segment", "loss"))).alias("s"))

    def text(name: str) -> Column:
        return F.array_join(F.transform(F.filter("s", lambda x: x["segment"] == name), lambda x: x["rendered"]), "")

    def mask(name: str) -> Column:
        return F.transform(F.filter("s", lambda x: x["segment"] == name), lambda x: F.struct(F.length(x["rendered"]).alias("length"), x["loss"].alias("loss")))

    return rows.select("pair_id", "kind", text("prompt").alias("prompt"), text("chosen").alias("chosen"), mask("chosen").alias("chosen_mask"), text("rejected").alias("rejected"), mask("rejected").alias("rejected_mask"))


def preferences(conversations: DataFrame) -> DataFrame:
    turns = turns_of(conversations)
    return format_pairs(sides(turns, pair_up(turns)))
