"""Conversation repair: cheapest edits to the turn grammar by a Viterbi pass over chunks that converge in rank.

A conversation should read ``(system? (user assistant)+)?`` by the initials of its roles. Costs to the end of a
conversation are a vector over four states of that grammar, and each turn is a min-plus matrix. Two vectors that differ
by a constant lead to the same edits, so vectors are kept with their least entry at zero.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import BLANKS, Scratch

BITS = 12  # a chunk has at most 2^12 turns
EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired turns so far end with
LETTERS = "sua"
KEEP = ({0: SYSTEM, 1: USER}, {1: USER}, {2: ASSISTANT}, {1: USER})  # per state, the letters it takes
NEXT = (USER, USER, ASSISTANT, USER)  # the turn that can be inserted, or a turn be relabelled to
ROLE = {USER: "user", ASSISTANT: "assistant"}
INSERT, DELETE, RELABEL, CUT = 2, 3, 2, 1  # costs; CUT is for a truncated turn that stays
GONE = 8  # code of a turn that has to go; others are the letter (3: any other), plus 4 if truncated
END = (0, 4, 2, 0)  # costs behind the last turn: inserts only
Vector = tuple[int, int, int, int]


@functools.cache
def step(after: Vector, code: int) -> tuple[Vector, tuple[tuple[str, int], ...]]:
    """From costs behind a turn: costs before it, and per state the least string of edits up to this turn and the state behind it."""
    row: list[dict[str, tuple[int, int]]] = []  # per state the edits of the turn itself: cost to the end and next state
    for q in range(4):
        ways = {"D": (DELETE + after[q], q)}
        if code != GONE:
            letter, cut = code % 4, CUT if code >= 4 else 0
            if letter in KEEP[q]:
                ways["K"] = (cut + after[KEEP[q][letter]], KEEP[q][letter])
            ways["R"] = (cut + RELABEL + after[NEXT[q]], NEXT[q])
        row.append(ways)
    before = [min(cost for cost, _ in ways.values()) for ways in row]
    for _ in range(3):
        before = [min(cost, INSERT + before[NEXT[q]]) for q, cost in enumerate(before)]
    told = []
    for q in range(4):
        edits, at = "", q
        while True:  # ties: D, I, K, R, as the letters are ordered
            best = [e for e in ("D", "K", "R") if e in row[at] and row[at][e][0] == before[at]]
            if best[:1] != ["D"] and before[NEXT[at]] + INSERT == before[at]:
                edits, at = edits + "I", NEXT[at]
                continue
            told.append((edits + best[0], row[at][best[0]][1]))
            break
    low = min(before)
    return tuple(c - low for c in before), tuple(told)


def backward(codes: bytes, after: Vector) -> Vector:
    for code in reversed(codes):
        after = step(after, code)[0]
    return after


def fix_up(codes: bytes, old: Vector, old_out: Vector, new: Vector) -> Vector:
    """Costs before the chunk from ``new`` costs behind it; stops where they fall in with those from ``old``."""
    for code in reversed(codes):
        if old == new:
            return old_out
        old, new = step(old, code)[0], step(new, code)[0]
    return new


def trace(codes: bytes, after: Vector, state: int, last: bool) -> tuple[list[str], int]:
    """Edits per turn (the last letter is the turn's own), inserts behind the last turn if ``last``, and the state reached."""
    tables = []
    for code in reversed(codes):
        after, told = step(after, code)
        tables.append(told)
    out = []
    for told in reversed(tables):
        edits, state = told[state]
        out.append(edits)
    if last:
        out.append("I" * (END[state] // INSERT))
    return out, state


def _vector(text: str) -> Vector:
    return tuple(map(int, text.split(",")))


def _text(vector: Vector) -> str:
    return ",".join(map(str, vector))


class _Chunks:
    """Views of the turns of a batch of chunks."""

    def __init__(self, batch: pa.RecordBatch):
        def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
            column = batch.column(name)
            return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)

        self.at, self.kinds = flat("kinds")
        _, self.rows = flat("rows")
        _, pos = flat("places")
        _, firsts = flat("firsts")
        self.letters, self.fault = self.kinds % 4, self.kinds // 4
        self.again = (self.fault != 2) & ~np.isin(pos, firsts)
        codes = np.where((self.fault == 2) | self.again, GONE, self.letters + 4 * self.fault).astype(np.uint8)
        self.codes = [codes[a:b].tobytes() for a, b in zip(self.at[:-1], self.at[1:], strict=True)]

    def sums(self, marks: np.ndarray) -> pa.Array:
        total = np.concatenate([[0], np.cumsum(marks)])
        return pa.array(total[self.at[1:]] - total[self.at[:-1]], pa.int64())

    def illegal(self) -> pa.Array:
        """Neighbours inside a chunk whose letters aren't su, ua or au."""
        a, b = self.letters[:-1], self.letters[1:]
        bad = ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))
        bad = np.concatenate([[False], bad]) if len(self.letters) else np.zeros(0, bool)
        bad[self.at[:-1][self.at[:-1] < len(bad)]] = False  # the first of a chunk has its neighbour elsewhere
        return self.sums(bad)


def repair_conversations(turns: DataFrame, bits: int = BITS, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """The report of each conversation and its repaired turns, for ``turns`` (conv_id, turn, role, text).

    Turns are ordered by turn (NULLs first), role, SHA-256 of the text. The first fault of a turn counts: *blank*
    (white space only), *duplicate* (role and text seen earlier), *truncated* (not ended by ``.``, ``!`` or ``?``).
    The edits Keep (0), Relabel to user or assistant (2), Delete (3; a must for blank and duplicate turns), Insert an empty
    user or assistant turn (2), and 1 for a truncated turn that stays, are chosen at the least cost so that the
    initials read ``(s?(ua)+)?``; of equal costs the least string of initials (D, I, K, R) wins.

    * report: conv_id, gaps (turn numbers missing between first and last), blank, duplicate, truncated, illegal
      (neighbouring initials other than su, ua, au), cost, audit (the edits' initials in order).
    * repaired: conv_id, chunk and seq (their order), turn (NULL if inserted), role, text, edit.

    NULL roles and texts count as one space. A NULL conv_id is a conversation, and repeated rows are duplicates. An empty
    table gives no rows; other columns are not read.

    Conversations may be of any length: turns are dealt by range, and pieces of at most ``2^bits`` of them are chunks. Every
    chunk takes the costs at the end of a conversation for those behind it, which is right for last chunks and a guess
    for others. Passes over the chunks whose guess was wrong go on until no costs differ by more than a constant.
    Then each chunk's map of states is known, the maps are chained (one row a chunk), and the edits are traced forward.
    """
    scratch = scratch or Scratch(turns.sparkSession, "conversations")
    space = F.lit(" ")
    base = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    base = scratch.keep(base.withColumn("row", F.monotonically_increasing_id()), "turns")
    body, first = F.rtrim("text", F.lit(BLANKS)), F.substring("role", 1, 1)
    fault = F.when(body == "", 2).when(F.substring(body, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    letter = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    key = F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)
    thin = base.select("conv_id", "turn", "role", key.alias("key"), "row", (letter + 4 * fault).alias("kind"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("key"), F.asc("row")]
    thin = thin.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    thin = scratch.keep(thin, "ordered")
    packed = scratch.keep(_packed(thin, bits), "packed")
    kind = dict(turns.dtypes)["conv_id"]

    several = packed.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("_conv"))
    long = packed.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    entries = _entries(scratch.keep(long, "long"), kind, scratch)
    entries = entries.select(F.col("conv_id").alias("_conv"), F.col("cell").alias("_cell"), "entry", "behind", "last", "border")
    known = packed.join(entries, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("cell") == F.col("_cell")), "left")
    known = known.select(
        *packed.columns, F.coalesce("entry", F.lit(EMPTY)).alias("entry"), F.coalesce("behind", F.lit(_text(END))).alias("behind"),
        F.coalesce("last", F.lit(True)).alias("last"), F.coalesce("border", F.lit(0)).alias("border"),
    )
    fields = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, told array<struct<seq:int,row:long,role:string,edit:string>>"
    traced = scratch.keep(known.mapInArrow(_traced, f"conv_id {kind}, cell long, border int, {fields}"), "traced")

    pieces = F.array_sort(F.collect_list(F.struct("cell", "audit")))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")]
    report = traced.groupBy("conv_id").agg(
        *sums, F.sum(F.col("illegal") + F.col("border")).alias("illegal"), F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit")
    )
    spread = thin.groupBy(F.col("conv_id").alias("_conv")).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    report = report.join(spread, F.col("conv_id").eqNullSafe(F.col("_conv")))
    report = report.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    told = traced.select("conv_id", F.col("cell").alias("chunk"), F.inline("told"))
    kept = told.filter("row IS NOT NULL").join(base.select("row", "turn", F.col("role").alias("own"), "text"), "row")
    kept = kept.select("conv_id", "chunk", "seq", "turn", F.coalesce("role", "own").alias("role"), "text", "edit")
    turn_type = dict(turns.dtypes)["turn"]
    added = told.filter("row IS NULL").select("conv_id", "chunk", "seq", F.lit(None).cast(turn_type).alias("turn"), "role", F.lit("").alias("text"), "edit")
    return report, kept.unionByName(added)


def _packed(thin: DataFrame, bits: int) -> DataFrame:
    """One row per conversation and chunk: rows, kinds and places of its turns in order, and the places of first occurrences.

    First occurrences are the least places of (conversation, role, text), added up before they move, so a turn that is
    repeated any number of times is no large group.
    """
    cell = F.shiftright("pos", bits).alias("cell")
    first = thin.filter("kind < 8").groupBy("conv_id", "role", "key").agg(F.min("pos").alias("pos"))
    turn, none = F.struct("pos", "kind", "row"), F.lit(None)
    both = thin.select("conv_id", cell, turn.alias("turn"), none.cast("long").alias("first"))
    both = both.unionByName(first.select("conv_id", cell, F.lit(None).cast("struct<pos:long,kind:int,row:long>").alias("turn"), F.col("pos").alias("first")))
    lists = both.groupBy("conv_id", "cell").agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.collect_list("first").alias("firsts"))
    return lists.select("conv_id", "cell", F.col("turns.pos").alias("places"), F.col("turns.kind").alias("kinds"), F.col("turns.row").alias("rows"), "firsts")


def _entries(long: DataFrame, kind: str, scratch: Scratch) -> DataFrame:
    """(conv_id, cell, entry, behind, last, border) of the chunks of conversations with several: fix-up passes, then the chain of states."""

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outs = [_text(backward(codes, END)) for codes in _Chunks(batch).codes]
            yield _batch(batch, behind=[_text(END)] * len(outs), before=outs)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            behind, before, new = (batch.column(c).to_pylist() for c in ("behind", "before", "follows"))
            outs = [
                _text(fix_up(codes, *map(_vector, x)))
                for codes, x in zip(_Chunks(batch).codes, zip(behind, before, new, strict=True), strict=True)
            ]
            yield _batch(batch, behind=new, before=outs)

    fields = f"conv_id {kind}, cell long, behind string, before string"
    state = scratch.keep(long.mapInArrow(guess, fields), "costs")
    by_conv = Window.partitionBy("conv_id").orderBy("cell")
    while True:
        seen = state.withColumn("follows", F.lead("before").over(by_conv))
        wrong = F.col("follows").isNotNull() & (F.col("follows") != F.col("behind"))
        stale = seen.filter(wrong)
        if stale.isEmpty():
            break
        s = stale.select(F.col("conv_id").alias("_conv"), F.col("cell").alias("_cell"), "behind", "before", "follows")
        redo = long.join(s, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("cell") == F.col("_cell"))).drop("_conv", "_cell")
        done = redo.mapInArrow(again, fields)
        old, state = state, scratch.keep(seen.filter(~wrong).drop("follows").unionByName(done), "costs")
        scratch.drop(old)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, behind = _Chunks(batch), batch.column("behind").to_pylist()
            ends = ["".join(str(trace(codes, _vector(v), q, False)[1]) for q in range(4)) for codes, v in zip(chunks.codes, behind, strict=True)]
            sides = [(int(chunks.letters[a]), int(chunks.letters[b - 1])) for a, b in zip(chunks.at[:-1], chunks.at[1:], strict=True)]
            yield _batch(batch, behind=behind, ends=ends, head=pa.array([a for a, _ in sides], pa.int32()), tail=pa.array([b for _, b in sides], pa.int32()), last=batch.column("last"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, letter = None, EMPTY, None
        for batch in batches:
            entry, border = [], []
            for conv, ends, head, tail in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ends", "head", "tail")), strict=True):
                if letter is None or conv != now:
                    now, state, letter = conv, EMPTY, None
                entry.append(state)
                border.append(int(letter is not None and (letter, head) not in ((0, 1), (1, 2), (2, 1))))
                state, letter = int(ends[state]), tail
            yield _batch(batch, entry=pa.array(entry, pa.int32()), behind=batch.column("behind"), last=batch.column("last"), border=pa.array(border, pa.int32()))

    seen = state.withColumn("last", F.lead("cell").over(by_conv).isNull())
    s = seen.select(F.col("conv_id").alias("_conv"), F.col("cell").alias("_cell"), "behind", "last")
    mapped = long.join(s, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("cell") == F.col("_cell"))).drop("_conv", "_cell")
    mapped = mapped.mapInArrow(maps, f"conv_id {kind}, cell long, behind string, ends string, head int, tail int, last boolean")
    mapped = mapped.repartition("conv_id").sortWithinPartitions("conv_id", "cell")  # one thin row a chunk
    return scratch.keep(mapped.mapInArrow(chain, f"conv_id {kind}, cell long, entry int, behind string, last boolean, border int"), "entries")


def _batch(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """conv_id and cell of ``batch`` with new columns of as many rows."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in columns.values()]
    return pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("cell"), *arrays], ["conv_id", "cell", *columns])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    told_type = pa.list_(pa.struct([("seq", pa.int32()), ("row", pa.int64()), ("role", pa.string()), ("edit", pa.string())]))
    for batch in batches:
        chunks = _Chunks(batch)
        audits, costs, told = [], [], []
        entries, behind, last = (batch.column(c).to_pylist() for c in ("entry", "behind", "last"))
        for k, codes in enumerate(chunks.codes):
            edits, _ = trace(codes, _vector(behind[k]), entries[k], last[k])
            state, cost, out, rows = entries[k], 0, [], chunks.rows[chunks.at[k] : chunks.at[k + 1]].tolist()
            for at, word in enumerate(edits):
                for edit in word:
                    if edit == "D":
                        cost += DELETE
                        continue
                    code = codes[at] if edit != "I" else 0
                    state = KEEP[state][code % 4] if edit == "K" else NEXT[state]
                    cost += {"K": 0, "R": RELABEL, "I": INSERT}[edit] + (CUT if code >= 4 else 0)
                    out.append({"seq": len(out), "row": rows[at] if edit != "I" else None, "role": None if edit == "K" else ROLE[state], "edit": edit})
            audits.append("".join(edits))
            costs.append(cost)
            told.append(out)
        fault, again = chunks.fault, chunks.again
        counts = {"blank": chunks.sums(fault == 2), "duplicate": chunks.sums(again), "truncated": chunks.sums((fault == 1) & ~again), "illegal": chunks.illegal()}
        yield _batch(batch, border=batch.column("border"), **counts, cost=pa.array(costs, pa.int64()), audit=audits, told=pa.array(told, told_type))


def conversation_digests(repaired: DataFrame, kind: str) -> DataFrame:
    """(conv_id, repaired_sha256) of the ``role:text`` of each conversation's turns, joined by line feeds.

    A hash of the whole goes through its text in order, so a conversation is hashed in one task; it is read as a sorted
    stream there and never held.
    """
    import hashlib

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None

        def out(conv, h) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([conv, pa.array([h.hexdigest()])], ["conv_id", "repaired_sha256"])

        for batch in batches:
            convs, roles, texts = batch.column("conv_id"), batch.column("role"), batch.column("text")
            for i, conv in enumerate(convs.to_pylist()):
                if running is None or conv != now[0]:
                    if running is not None:
                        yield out(now[1], running)
                    now, running = (conv, convs.slice(i, 1)), hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{roles[i].as_py()}:{texts[i].as_py()}".encode())
        if running is not None:
            yield out(now[1], running)

    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "seq").select("conv_id", "role", "text")
    return ordered.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")
