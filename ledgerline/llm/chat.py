"""Chat formatting: a hidden Markov model reads the turns and roles of a transcript, which are then rendered canonically.

A text is read line by line, a line as one symbol made of its speaker marker and
other features. A state is a role and whether the line starts a turn or goes on
with it; so a text can hold one turn or a whole transcript. A row starts a turn.
Start, transition and emission counts come from all labelled
conversations outside fold 0. Viterbi runs in segments: each segment of rows
gives the best score from every state before it to every state at its end, these
small tables are chained for each conversation, and every segment is then
decoded between its two known ends. So a very long conversation is decoded by
many tasks with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.runtime import cut, rank_within, small_batches
from ledgerline.llm.toxicity import fold

ROLES = ("system", "user", "assistant")
#: Speaker markers at the start of a turn, by role.
MARKERS = {
    "system": r"(?i)^\s*(?:[#*\[<|]*\s*)?(?:system|instructions?)\s*[\]>|*]*\s*:",
    "user": r"(?i)^\s*(?:[#*\[<|]*\s*)?(?:user|human|customer|q|question|me)\s*[\]>|*]*\s*:",
    "assistant": r"(?i)^\s*(?:[#*\[<|]*\s*)?(?:assistant|ai|bot|agent|a|answer|gpt|model)\s*[\]>|*]*\s*:",
}
#: Rows of a segment.
SEGMENT = 256
LENGTHS = 12
REST = LENGTHS * 2 * 2
SYMBOLS = 4 * 2 * REST
#: State 2 r starts a turn of role r, state 2 r + 1 goes on with it.
STATES = 2 * len(ROLES)
#: Counts before any is seen, besides a share of a role's turns: of markers that start turns, of lines that go on
#: without a marker, and of moves to a line that goes on.
PRIOR_MARKS, PRIOR_PLAIN, PRIOR_MOVES, PRIOR_SHARE = 4, 8, 3, 0.01
#: What each opening counts in each state before it is seen.
UNSEEN = 0.02


def symbol(line: Column, opens: Column, first: Column, whole: Column) -> Column:
    """Marker, whether the line opens its row, length, closing question mark, and whether it is the conversation's first, as one number.

    Length and question mark of a line that opens its row are those of the ``whole`` text, unless that holds more markers.
    """
    marker = F.lit(0)
    for k, role in enumerate(ROLES, 1):
        marker = F.when(line.rlike(MARKERS[role]), F.lit(k)).otherwise(marker)
    seen = F.when(opens, F.coalesce(whole, line)).otherwise(line)
    length = F.least(F.floor(F.log2(F.length(seen) + 1)), F.lit(LENGTHS - 1))
    asks = F.rtrim(seen).endswith("?").cast("int")
    return ((((marker * 2 + opens.cast("int")) * LENGTHS + length) * 2 + asks) * 2 + (opens & first).cast("int")).cast("int")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows with the symbols of their lines; a row without conversation or number is a conversation of its own."""
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    first = F.coalesce(F.col("turn") == 0, F.lit(False))
    lines = _lines(F.col("text"))
    later = F.exists(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.greatest(*[x.rlike(m) for m in MARKERS.values()]))
    whole = F.when(~later, F.coalesce(F.col("text"), F.lit("")))
    return conversations.select(
        "conv_id", "turn", "role", "text",
        F.when(alone, F.monotonically_increasing_id()).alias("alone"),
        F.transform(lines, lambda line, i: symbol(line, i == 0, first, whole)).alias("syms"),
    )


def fit(conversations: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities of starts, moves and symbols with smoothing; the tables of counts have a fixed size.

    A labelled row is one turn. A symbol's opening (marker, or none and the row's first line) and the rest of it are independent.
    """
    seen = _turns(conversations).filter(F.col("role").isin(*ROLES)).filter("alone is null").filter(fold(F.col("conv_id")) != 0)
    code = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1
    seen = seen.select("conv_id", "turn", code.alias("r"), "syms", F.size("syms").alias("n"))
    opening, rest = np.full((5, STATES), UNSEEN), np.ones((REST, STATES))
    lines = seen.select("r", F.posexplode("syms").alias("at", "sym")).groupBy("sym", "r", (F.col("at") > 0).alias("on")).count()
    for row in lines.collect():
        state = 2 * row["r"] + row["on"]
        opening[_opening(row["sym"]), state] += row["count"]
        rest[row["sym"] % REST, state] += row["count"]
    move, start = np.full((STATES, STATES), 0.0), np.zeros(STATES)
    move[:, ::2], start[::2] = 1, 1
    turns = opening[:, ::2].sum(0) - UNSEEN * len(opening)
    for r in range(len(ROLES)):
        share = PRIOR_SHARE * turns[r]
        opening[r + 1, 2 * r] += PRIOR_MARKS + share
        opening[0, 2 * r + 1] += PRIOR_PLAIN + share
        move[[2 * r, 2 * r + 1], 2 * r + 1] += PRIOR_MOVES + share
    on = seen.groupBy("r").agg(F.count_if(F.col("n") > 1).alias("one"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("more"))
    for row in on.collect():
        move[2 * row["r"], 2 * row["r"] + 1] += row["one"]
        move[2 * row["r"] + 1, 2 * row["r"] + 1] += row["more"]
    ends = (2 * F.col("r") + (F.col("n") > 1).cast("int")).alias("p")
    # of rows that share a turn number each goes before each of the next number; they are counted, not joined
    before = seen.groupBy("conv_id", (F.col("turn") + 1).alias("turn"), ends).agg(F.count(F.lit(1)).alias("n_p"))
    after = seen.groupBy("conv_id", "turn", "r").agg(F.count(F.lit(1)).alias("n_r"))
    for row in after.join(before, ["conv_id", "turn"]).groupBy("p", "r").agg(F.sum(F.col("n_p") * F.col("n_r")).alias("count")).collect():
        move[row["p"], 2 * row["r"]] += row["count"]
    for row in seen.filter("turn = 0").groupBy("r").count().collect():
        start[2 * row["r"]] += row["count"]
    with np.errstate(divide="ignore"):  # what cannot be has -inf
        opening, rest = np.log(opening / opening.sum(0)), np.log(rest / rest.sum(0))
        move, start = np.log(move / move.sum(1, keepdims=True)), np.log(start / start.sum())
    emit = np.array([opening[_opening(s)] + rest[s % REST] for s in range(SYMBOLS)])
    opens = np.arange(SYMBOLS) // REST % 2 == 1
    emit[np.ix_(opens, np.arange(1, STATES, 2))] = -np.inf  # a row starts a turn
    return {"emit": emit, "move": move, "start": start}


def _opening(sym: int) -> int:
    """The marker of a symbol; without one 4 for the first line of a row, else 0."""
    return sym // REST // 2 or 4 * (sym // REST % 2)


def segment_scores(model, syms, first: bool) -> np.ndarray:
    """Best log score from each state before the segment to each state at its end; only row 0 counts in a first segment."""
    best = np.where(np.eye(STATES) > 0, 0.0, -np.inf)
    for i, s in enumerate(syms):
        step = np.broadcast_to(model["start"], (STATES, STATES)) if first and i == 0 else model["move"]
        if first and i == 0:
            best = np.full((STATES, STATES), -np.inf)
            best[0] = step[0] + model["emit"][s]
        else:
            best = (best[:, :, None] + step[None]).max(1) + model["emit"][s]
    return best


def decode_segment(model, syms, first: bool, entry: int, end: int) -> list[int]:
    """The best states of a segment from the state before it (if any) to the state at its end."""
    score, back = None, []
    for i, s in enumerate(syms):
        if i == 0:
            score = (model["start"] if first else model["move"][entry]) + model["emit"][s]
            continue
        step = score[:, None] + model["move"]
        back.append(step.argmax(0))
        score = step.max(0) + model["emit"][s]
    path = [end]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def render(role: Column, text: Column) -> Column:
    """Canonical form of a turn: role header, text without its speaker marker, end mark."""
    bare = F.coalesce(text, F.lit(""))
    for r in ROLES:
        bare = F.when(bare.rlike(MARKERS[r]), F.regexp_replace(bare, MARKERS[r], "")).otherwise(bare)
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), F.trim(bare), F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Roles and canonical rendering of every turn: ``conv_id``, ``turn``, ``part``, ``role_pred``, ``rendered``.

    The turns that a row's text holds are numbered by ``part`` from 0. Roles and
    turns are read from order and text; the column ``role`` serves only to learn
    from conversations outside fold 0. Defined cases: a null or empty text is a
    turn with an empty body; a row without conv_id or turn is a conversation of
    its own; rows that repeat a turn number follow each other in the order of
    their texts; without labels only markers tell roles apart, and of equally
    likely ones the first named wins; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(conversations.sparkSession)
    model = model or fit(conversations)
    shared = conversations.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for syms, first in batches:
            yield pd.Series([segment_scores(shared.value, s, f).ravel() for s, f in zip(syms, first, strict=True)])

    @F.pandas_udf("array<struct<seg: long, entry: int, end: int>>")
    def chain(segs: pd.Series, tables: pd.Series) -> pd.Series:
        out = []
        for numbers, flat in zip(segs, tables, strict=True):
            tables_ = [np.asarray(t).reshape(STATES, STATES) for t in flat]
            score, back = tables_[0][0], []
            for t in tables_[1:]:
                step = score[:, None] + t
                back.append(step.argmax(0))
                score = step.max(0)
            ends = [int(score.argmax())]
            for b in reversed(back):
                ends.append(int(b[ends[-1]]))
            ends = ends[::-1]
            out.append([{"seg": int(n), "entry": e0, "end": e1} for n, e0, e1 in zip(numbers, [0, *ends[:-1]], ends, strict=True)])
        return pd.Series(out)

    @F.pandas_udf("array<array<int>>")
    def decode(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rows in batches:
            out = []
            for syms, sizes, first, entry, end in zip(*rows, strict=True):
                path = decode_segment(shared.value, syms, first, entry, end)
                at = np.cumsum([0, *sizes])
                out.append([path[i:j] for i, j in zip(at[:-1], at[1:], strict=True)])
            yield pd.Series(out)

    turns = cut(_turns(conversations))
    keys = ["c", "alone", "seg"]
    placed = turns.select(
        F.coalesce(F.when(F.col("alone").isNull(), F.col("conv_id")), F.lit(0)).alias("c"), F.coalesce("alone", F.lit(-1)).alias("alone"),
        F.struct("turn", "text", F.monotonically_increasing_id().alias("row"), "syms", "conv_id").alias("t"),
    )
    # segments are of rows as they follow each other, so that a turn number that many rows share is no segment of its own
    most = placed.groupBy("c", "alone").count().agg(F.max("count")).first()[0] or 0
    placed = rank_within(placed, ["c", "alone"], "t", "at", most).withColumn("seg", F.floor((F.col("at") - 1) / SEGMENT))
    segments = cut(placed.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("ts")))
    opening = segments.groupBy("c", "alone").agg(F.min("seg").alias("seg")).withColumn("first", F.lit(True))
    sizes = F.transform("ts", lambda t: F.size(t.syms)).alias("sizes")
    marked = segments.select(*keys, F.flatten("ts.syms").alias("syms"), sizes).join(opening, keys, "left")
    marked = cut(marked.withColumn("first", F.coalesce("first", F.lit(False))))
    tables = marked.select(*keys, scores("syms", "first").alias("m"))
    chains = tables.groupBy("c", "alone").agg(F.sort_array(F.collect_list(F.struct("seg", "m"))).alias("s"))
    ends = chains.select("c", "alone", F.explode(chain("s.seg", "s.m")).alias("e")).select("c", "alone", "e.*")
    states = marked.join(ends, keys).select(*keys, decode("syms", "sizes", "first", "entry", "end").alias("states"))
    whole = segments.join(states, keys).select(F.explode(F.arrays_zip("ts", "states")).alias("z"))
    rows = whole.select("z.ts.conv_id", "z.ts.turn", _lines(F.col("z.ts.text")).alias("lines"), F.col("z.states").alias("states"))
    # a turn goes from the line that starts it to the line before the next one
    starts = F.filter(F.transform("states", lambda s, i: F.when(s % 2 == 0, i)), lambda i: i.isNotNull())
    rows = rows.withColumn("starts", starts).select("*", F.posexplode("starts").alias("part", "at"))
    until = F.coalesce(F.get("starts", F.col("part") + 1), F.size("lines"))
    text = F.array_join(F.slice("lines", F.col("at") + 1, until - F.col("at")), "\n").alias("text")
    names = F.array(*map(F.lit, ROLES))
    role = F.element_at(names, F.floor(F.get("states", F.col("at")) / 2).cast("int") + 1).alias("role_pred")
    out = rows.select("conv_id", "turn", "part", role, text)
    return out.select("conv_id", "turn", "part", "role_pred", render(F.col("role_pred"), F.col("text")).alias("rendered"))
