"""Preference pairs for training: the common start of two conversations as prompt, the rest as masked completions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The chat template.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """One more backslash between ``<`` and ``|``, so that no text can look like a mark of the template."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _packed(*sides: DataFrame) -> DataFrame:
    """One row per pair: the turns of each side in order as (turn, role, text, end, rendered, size), in columns a, b, c.

    ``end`` is the rendered length so far, the chosen turns first. All sides share one shuffle by pair_id.
    """
    names = ("pair_id", "turn", "role", "text")
    clean = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names[2:]]
    turns = [df.select(*names[:2], *clean, F.lit(side).alias("side")) for side, df in enumerate(sides)]
    both = reduce(DataFrame.unionByName, turns)
    rendered = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE), escaped(F.col("text")), F.lit(END + "\n"))
    so_far = Window.partitionBy("pair_id").orderBy("side", "turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("rendered", rendered).withColumn("size", F.char_length("rendered").cast("long"))
    row = F.struct("turn", "role", "text", "end", "rendered", "size")

    def side(k: int) -> Column:
        turns = F.sort_array(F.collect_list(F.when(F.col("side") == k, row)))
        return F.when(F.size(turns) > 0, turns)

    return both.withColumn("end", F.sum("size").over(so_far)).groupBy("pair_id").agg(*[side(k).alias("abc"[k]) for k in range(len(sides))])


def _rest(turns: Column, common: Column) -> Column:
    return F.slice(turns, common + 1, F.greatest(F.size(turns) - common, F.lit(0)))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: t["rendered"]), "")


def _spans(rest: Column, before: Column) -> Column:
    """[start, end) of what is trained on in a completion: the assistant's words and the end mark after them."""
    trained = F.filter(rest, lambda t: t["role"] == TRAINED)
    head = len(OPEN) + len(CLOSE) + len(TRAINED)
    return F.transform(
        trained,
        lambda t: F.struct((t["end"] - t["size"] - before + head).alias("start"), (t["end"] - before - 1).alias("end")),
    )


def preference_rows(chosen: DataFrame, rejected: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """Prompt and completions of every pair_id of two turn tables (pair_id, turn, role, text).

    Returns pair_id, status, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans. The longest common prefix
    of equal turns (role and text) is rendered once, as prompt; what follows in each conversation is its completion, of
    which only the spans (code points) of the assistant's turns are trained on. status is ``pair``; ``same`` if both
    completions are empty; ``prefix`` if only one is; ``unpaired`` if a side has no turns (its completion is NULL and the
    prompt is empty). Turns are ordered by number, equal numbers by role and text; NULL roles and texts count as empty;
    a NULL pair_id is a pair of its own.

    With ``after``, a third table of turns that belong to no completion, two more columns: n_after and after, those turns
    counted and rendered (turns without a number last). A pair_id that is only there has neither side.

    Work is by pair_id only: one shuffle a side, none by role or text, so a common opening or a conversation that is
    copied many times puts no extra rows into a task. A pair is one output row, so its turns meet in one task.
    """
    rows = _packed(chosen, rejected) if after is None else _packed(chosen, rejected, after)
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    common = F.when(F.col("a").isNull() | F.col("b").isNull(), 0).when(first > 0, first - 1).otherwise(F.size("a"))
    rows = rows.withColumn("n", common.cast("int"))
    rows = rows.withColumn("ra", _rest(F.col("a"), F.col("n"))).withColumn("rb", _rest(F.col("b"), F.col("n")))

    def before(side: str) -> Column:
        """Where the completion of a side begins."""
        return F.when(F.col("n") > 0, F.get(side, F.col("n") - 1)["end"]).otherwise(F.get(side, F.lit(0))["end"] - F.get(side, F.lit(0))["size"])

    status = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "unpaired")
        .when((F.size("ra") == 0) & (F.size("rb") == 0), "same")
        .when((F.size("ra") == 0) | (F.size("rb") == 0), "prefix")
        .otherwise("pair")
    )
    prompt = F.when(F.col("n") > 0, _text(F.slice("a", F.lit(1), F.col("n")))).otherwise(F.lit(""))
    more = []
    if after is not None:
        rest = F.coalesce("c", F.array().cast(rows.schema["c"].dataType))
        numbered, unnumbered = F.filter(rest, lambda t: t["turn"].isNotNull()), F.filter(rest, lambda t: t["turn"].isNull())
        more = [F.size(rest).cast("long").alias("n_after"), _text(F.concat(numbered, unnumbered)).alias("after")]
    return rows.select(
        "pair_id", status.alias("status"), F.col("n").cast("long").alias("n_common"), prompt.alias("prompt"),
        _text(F.col("ra")).alias("chosen"), _text(F.col("rb")).alias("rejected"),
        _spans(F.col("ra"), before("a")).alias("chosen_spans"), _spans(F.col("rb"), before("b")).alias("rejected_spans"), *more,
    )


def swapped_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from a table of single conversations (conv_id, turn, role, text).

    Chosen is each conversation up to its last assistant turn, rejected the same with that turn's text replaced by the
    last reply of its neighbour (the id that differs in the lowest bit). Conversations without an assistant turn have no
    chosen side, and those whose neighbour has no reply no rejected one.
    """
    replies = turns.filter(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    replies = replies.filter("conv_id IS NOT NULL")
    other = replies.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("reply"))
    known = replies.join(other.withColumn("has", F.lit(True)), "conv_id", "left").select("conv_id", F.col("last.turn").alias("at"), "reply", "has")
    rows = turns.select("conv_id", "turn", "role", "text").join(known, "conv_id").filter(F.col("turn") <= F.col("at"))
    chosen = rows.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    swap = (F.col("turn") == F.col("at")) & (F.col("role") == TRAINED)
    rejected = rows.filter("has").select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when(swap, F.col("reply")).otherwise(F.col("text")).alias("text"))
    return chosen, rejected


def every_turn(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``swapped_replies`` without a dropped row: chosen, rejected and the turns after, for ``preference_rows``.

    Every row of ``turns`` is in exactly one of chosen and after. A conversation's reply is its last numbered assistant
    turn. Chosen is each conversation up to its reply, or all its numbered turns if it has none; after is the rest: turns
    behind the reply and turns without a number. Rejected is chosen with the neighbour's reply, for conversations that
    have a reply and a neighbour with one; the others are unpaired. Turns with a NULL conv_id are one conversation, which
    has no neighbour.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    replies = rows.filter((F.col("role") == TRAINED) & F.col("turn").isNotNull())
    replies = replies.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = replies.filter("conv_id IS NOT NULL").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("reply"))
    known = replies.join(other.withColumn("has", F.lit(True)), "conv_id", "left")
    known = known.select(F.col("conv_id").alias("_id"), F.col("last.turn").alias("at"), "reply", "has")
    rows = rows.join(known, F.col("conv_id").eqNullSafe(F.col("_id")), "left").withColumnRenamed("conv_id", "pair_id")
    inside = F.col("turn").isNotNull() & (F.col("at").isNull() | (F.col("turn") <= F.col("at")))
    names = ("pair_id", "turn", "role", "text")
    swap = (F.col("turn") == F.col("at")) & (F.col("role") == TRAINED)
    rejected = rows.filter(inside & F.col("has")).select(*names[:3], F.when(swap, F.col("reply")).otherwise(F.col("text")).alias("text"))
    return rows.filter(inside).select(*names), rejected, rows.filter(~inside).select(*names)
