"""Preference formatting of chat transcripts, in DataFrame operations only.

A pair of conversations is compared turn by turn; their longest common prefix is rendered once as the prompt, and what
follows on either side is emitted beside it as chosen and rejected completion with its loss mask. A pair is one row; one
of more than PART_TURNS turns goes on in further rows, so a conversation of any length is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import BROADCAST_ROWS, cut, pick

OPEN, CLOSE = "<|", "<|end|>"
PART_TURNS = 64


def clean_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text: one row per conversation and turn. Null roles and texts become empty, a null turn is
    turn -1; of several rows for one turn the least (role, text) is taken; rows without a conversation are left out."""
    named = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    return (
        named.filter("conv_id is not null")
        .select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"))
        .groupBy("conv_id", "turn")
        .agg(F.min("said").alias("said"))
        .select("conv_id", "turn", "said.role", "said.text")
    )


def pair_by_opening(turns: DataFrame, deal_rows: int = 4096) -> DataFrame:
    """pair_id, chosen, rejected for conversations that open with the same turn; every conversation is in one row, a
    left-over one with a null `rejected`.

    The conversations of one opening are dealt by the hash of conv_id into groups of about `deal_rows`, as many as the
    opening needs, and neighbours in order of conv_id are paired; what is left over (one per group at most) is paired in
    a second go, so a hot opening is never ordered in one task. Chosen is the side whose assistant says more, then the
    smaller conv_id.
    """
    heads = cut(
        turns.groupBy("conv_id").agg(
            F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)).alias("said"),
            F.min_by(F.sha2(F.concat_ws("\u0000", "role", "text"), 256), "turn").alias("opening"),
        )
    )
    hot = cut(heads.groupBy("opening").agg(F.count("*").alias("n")).filter(F.col("n") > deal_rows))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    deals = F.coalesce(F.ceil(F.col("n") / deal_rows), F.lit(1))

    def neighbours(rows: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("conv_id")
        return rows.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead(F.struct("conv_id", "said")).over(order)).filter("n % 2 = 1").drop("n")

    dealt = neighbours(heads.join(hot, "opening", "left").withColumn("deal", F.pmod(F.xxhash64("conv_id"), deals)).drop("n"), "opening", "deal")
    rest = neighbours(dealt.filter("next is null").drop("next"), "opening")
    both = dealt.filter("next is not null").select("conv_id", "said", "next").union(rest.select("conv_id", "said", "next"))
    first = F.col("next").isNull() | (F.col("said") >= F.col("next.said"))
    return both.select(F.col("conv_id").alias("pair_id"), F.when(first, F.col("conv_id")).otherwise(F.col("next.conv_id")).alias("chosen"), F.when(first, F.col("next.conv_id")).otherwise(F.col("conv_id")).alias("rejected"))


def other_answers(singles: DataFrame, deal_rows: int = 4096) -> DataFrame:
    """singles(pair_id, conv_id, turn, role, text): for each pair with an answer (an assistant turn), one of another text than
    its last: pair_id, conv_id (whose answer it is), turn (of the last answer of the pair), role, text.

    Pairs are dealt by the hash of pair_id into groups of about `deal_rows`, the different last answers of a deal stand in
    order of their digest, and each pair gets the next one, the last the first. Where a deal has only one answer, it is
    the latest earlier answer of the conversation itself; where there is none of another text either, nothing comes out.
    """
    answers = singles.filter("role = 'assistant'").withColumn("digest", F.sha2("text", 256))
    last = cut(answers.groupBy("pair_id").agg(F.max_by(F.struct("conv_id", "turn", "text", "digest"), "turn").alias("x")).select("pair_id", "x.*"))
    dealt = last.withColumn("deal", F.pmod(F.xxhash64("pair_id"), F.lit(max(1, last.count() // deal_rows))))
    firsts = dealt.groupBy("deal", "digest").agg(F.min_by(F.struct("conv_id", "text"), "pair_id").alias("said"))
    order = Window.partitionBy("deal").orderBy("digest")
    following = firsts.select("deal", "digest", F.coalesce(F.lead("said").over(order), F.first("said").over(order)).alias("next"), F.count("*").over(Window.partitionBy("deal")).alias("n")).filter("n > 1")
    lent = cut(dealt.select("pair_id", "turn", "deal", "digest").join(following, ["deal", "digest"]).select("pair_id", "next.conv_id", "turn", "next.text"))
    alone = last.join(lent.select("pair_id"), "pair_id", "left_anti").select("pair_id", F.col("digest").alias("taken"), F.col("turn").alias("place"))
    earlier = answers.join(alone, "pair_id").filter("digest <> taken").groupBy("pair_id", F.col("place").alias("turn")).agg(F.max_by(F.struct("conv_id", "text"), answers["turn"]).alias("x"))
    return lent.unionByName(earlier.select("pair_id", "x.conv_id", "turn", "x.text")).withColumn("role", F.lit("assistant"))


def with_other_ends(placed: DataFrame) -> DataFrame:
    """placed, where a conversation without a partner gets one: the same conversation up to its last answer, with another one's
    answer in that place. Both are then whole conversations of one pair, and which turns they share is for the prefix search."""
    placed = cut(placed)
    ends = cut(other_answers(placed.filter("single").select("pair_id", "conv_id", "turn", "role", "text")))
    known = placed.join(ends.select("pair_id", F.col("turn").alias("answered")), "pair_id", "left")
    ours = known.withColumn("single", F.col("single") & F.col("answered").isNull()).drop("answered")
    theirs = known.filter("turn < answered").drop("answered", "side", "single").unionByName(ends)
    return cut(ours.unionByName(theirs.withColumns({"side": F.lit("rejected"), "single": F.lit(False)})))


def format_preferences(conversations: DataFrame, pairs: DataFrame | None = None, reject_others: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per pair and part: pair_id, part, prompt, chosen, rejected, chosen_mask, rejected_mask, n_prompt, n_chosen,
    n_rejected (turns), prefix_turns, chosen_conv, rejected_conv.

    Part k has the turns numbered from 64 k on; a pair of usual length is one row. Prompt and completions are rendered turns
    joined (null where the part has none); a mask lists the spans [start, stop) of the completion, in characters of that
    row, that carry loss: its assistant turns. Turns are matched by their numbers.

    `pairs` gives pair_id, chosen and rejected; without it conversations are paired by their opening turn. The prompt is
    the longest common turn prefix, taken from the chosen side; where the whole of both is common there is nothing to
    prefer and only the prompt comes out. With `reject_others` a conversation without a partner is compared, in the same
    way, with a copy of itself that has another conversation's last answer in place of its own and ends there
    (`with_other_ends`); rejected_conv tells whose answer that is. What is still without a partner has as chosen
    completion its last run of turns from the last user turn on (with `reject_others`: from its last answer on, if any), all
    before it as prompt, and no rejected one. Null texts and roles are empty; an empty table gives an empty result; other
    columns of the input are ignored.
    """
    turns = cut(clean_turns(conversations, conv_col, turn_col, role_col, text_col))
    pairs = cut(pair_by_opening(turns) if pairs is None else pairs.select("pair_id", "chosen", "rejected"))
    members = pairs.select("pair_id", F.lit("chosen").alias("side"), F.col("chosen").alias("conv_id"), F.col("rejected").isNull().alias("single")).union(
        pairs.filter("rejected is not null").select("pair_id", F.lit("rejected").alias("side"), F.col("rejected").alias("conv_id"), F.lit(False).alias("single"))
    )
    placed = turns.join(members, "conv_id")
    if reject_others:
        placed = with_other_ends(placed)
    # the first turn at which the two sides differ, or that only one of them has
    said = F.sha2(F.concat_ws("\u0000", "role", "text"), 256)
    forks = (
        placed.filter("not single")
        .groupBy("pair_id", "turn")
        .agg(F.count("*").alias("sides"), F.min(said).alias("a"), F.max(said).alias("b"))
        .groupBy("pair_id")
        .agg(F.min(F.when((F.col("sides") < 2) | (F.col("a") != F.col("b")), F.col("turn"))).alias("fork"))
    )
    last_user = placed.filter("single").groupBy("pair_id").agg(F.max(F.when(F.col("role") != "assistant", F.col("turn"))).alias("asked"), F.min("turn").alias("opening")).select("pair_id", F.coalesce(F.col("asked") + 1, F.col("opening")).alias("fork"))
    if reject_others:
        answered = placed.filter("single and role = 'assistant'").groupBy("pair_id").agg(F.max("turn").alias("answered"))
        last_user = last_user.join(answered, "pair_id", "left").select("pair_id", F.coalesce("answered", "fork").alias("fork"))
    split = placed.join(forks.union(last_user), "pair_id").withColumn("common", F.col("fork").isNull() | (F.col("turn") < F.col("fork")))
    lengths = split.filter("common and side = 'chosen'").groupBy("pair_id").agg(F.count("*").alias("prefix_turns"))
    segment = F.concat(F.lit(OPEN), "role", F.lit("|>\n"), "text", F.lit("\n" + CLOSE + "\n"))
    rendered = split.filter("not common or side = 'chosen'").select(
        "pair_id",
        F.floor(F.col("turn") / PART_TURNS).cast("long").alias("part"),
        F.when(F.col("common"), F.lit("prompt")).otherwise(F.col("side")).alias("side"),
        "turn",
        "conv_id",
        segment.alias("segment"),
        (~F.col("common") & (F.col("role") == "assistant")).alias("loss"),
    )
    parts = rendered.groupBy("pair_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "side", "segment", "loss", "conv_id"))).alias("turns"))
    of = lambda side: F.filter("turns", lambda t: t["side"] == side)
    held = parts.select("pair_id", "part", *[of(side).alias(f"_{side}") for side in ("prompt", "chosen", "rejected")])
    text = lambda side: F.when(F.size(f"_{side}") > 0, F.array_join(F.transform(f"_{side}", lambda t: t["segment"]), "")).alias(side)

    def mask(side: str) -> Column:
        # at most 64 turns: where each begins is the sum of those before it
        starts = F.transform(f"_{side}", lambda t, i: F.struct(F.aggregate(F.slice(f"_{side}", 1, i), F.lit(0), lambda acc, x: acc + F.length(x["segment"])).alias("start"), F.length(t["segment"]).alias("size"), t["loss"].alias("loss")))
        return F.transform(F.filter(starts, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["size"]).alias("stop"))).alias(f"{side}_mask")

    return held.join(lengths, "pair_id", "left").select(
        "pair_id",
        "part",
        text("prompt"),
        text("chosen"),
        text("rejected"),
        mask("chosen"),
        mask("rejected"),
        *[F.size(f"_{side}").cast("long").alias(f"n_{side}") for side in ("prompt", "chosen", "rejected")],
        F.coalesce("prefix_turns", F.lit(0)).cast("long").alias("prefix_turns"),
        F.coalesce(F.get("_chosen", F.lit(0))["conv_id"], F.get("_prompt", F.lit(0))["conv_id"]).alias("chosen_conv"),
        F.get("_rejected", F.lit(0))["conv_id"].alias("rejected_conv"),
    )
