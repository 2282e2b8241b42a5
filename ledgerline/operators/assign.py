"""One-to-one assignment of bank rows to company rows.

Bank rows choose in the order of their rank, each its best company row that is
still free. Rows of either side with the same values form a class; whether two
rows may meet, and how well they agree, is a matter of their classes, so classes
are compared and pairs of rows are never listed. Three ways lead to the outcome:

* Two classes that meet each other only: the first bank row takes the first
  company row, the second the second, and so on; ranked and joined.
* All other classes are settled group by group, a group being any set of classes
  that no edge leaves. One task takes many groups and makes the sequential pass
  over their rows in turn: each bank class keeps the heads of its company classes
  in a heap, so a row costs the logarithm of its classes.
* A group beyond a bound, up to SLICES times, is settled slice after slice: a slice is a stretch of its bank rows in their order, which
  one task passes over with the company rows that are left by the slices before it.
* A group beyond that is first cut into connected components. Components still beyond it are ranked and joined if
  every class meets every other equally well; else they are settled in rounds: since all company rows prefer the bank
  row of lower rank, the outcome is the one stable matching, and deferred acceptance finds it whatever the order of proposals.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.runtime import HOT_ROWS, rank_within, stored

#: Rows and class edges of a group that one task settles, and rows that a task takes of several groups.
GROUP_ROWS, GROUP_EDGES, TASK_ROWS = 400_000, 400_000, 50_000
#: Rounds in which labels of classes spread through a group beyond the bound.
LABEL_ROUNDS = 6
#: Slices in which a group beyond the bound is settled at most, one after another.
SLICES = 24
_PAIRS = "b_cls string, c_cls string, b_id string, c_id string"


def match_classes(bank: DataFrame, company: DataFrame, edges: DataFrame, group: Column, prefer: Column | None = None) -> DataFrame:
    """Pairs ``b_id``, ``c_id`` with the columns of their edge, as a sequential pass over bank rows would make them.

    ``bank`` has ``b_id``, ``b_ord`` (date, source_row, id) and ``b_cls``, ``company`` the same with ``c_``; ``edges`` has one row for each
    pair of classes (strings) that may meet, and the numbers of their rows, ``b_n`` and ``c_n`` (counted where absent). No edge leads from
    one ``group`` (a number) to another. A bank row takes the free company row of the highest ``prefer``, then of the first ``c_ord``.
    """
    for p, rows in (("b", bank), ("c", company)):
        if f"{p}_n" not in edges.columns:
            edges = edges.join(rows.groupBy(f"{p}_cls").agg(F.count(F.lit(1)).alias(f"{p}_n")), f"{p}_cls")
    met = lambda p: F.count(F.lit(1)).over(W.partitionBy(f"{p}_cls"))
    edges = edges.withColumns({"prefer": F.lit(0.0) if prefer is None else prefer, "group": group})
    edges = stored(edges.withColumn("b_met", met("b")).withColumn("c_met", met("c")))
    alone = (F.col("b_met") == 1) & (F.col("c_met") == 1)
    most = lambda where, c: F.max(F.when(where, F.col(c))).alias(c)
    known = edges.agg(most(alone, "b_n"), most(alone, "c_n"), F.count_if(~alone).alias("others")).first()
    named = edges.select("b_cls", "c_cls", "b_n", "c_n", "prefer", "group", "b_met", "c_met")
    pairs = _in_turn(bank, company, named.filter(alone), ["b_cls"], ["c_cls"], known.b_n or 0, known.c_n or 0)
    if known.others:
        pairs = pairs.unionByName(_settled(bank, company, named.filter(~alone)))
    return pairs.join(edges.drop("group", "b_met", "c_met"), ["b_cls", "c_cls"])


def _in_turn(bank: DataFrame, company: DataFrame, edges: DataFrame, b_keys: list[str], c_keys: list[str], b_most: int, c_most: int) -> DataFrame:
    """The k-th bank row of ``b_keys`` with the k-th company row of ``c_keys``, of the classes of ``edges``."""
    def ranked(rows: DataFrame, p: str, keys: list[str], most: int) -> DataFrame:
        own = list(dict.fromkeys([f"{p}_cls", *keys, *(c_keys if p == "b" else [])]))
        met = rows.join(edges.select(own).distinct() if b_keys == c_keys else edges.select(own), f"{p}_cls")
        return rank_within(met.select(*own, f"{p}_ord", f"{p}_id"), keys, f"{p}_ord", "turn", most)

    left, right = ranked(bank, "b", b_keys, b_most), ranked(company, "c", c_keys, c_most)
    return left.join(right, [*c_keys, "turn"]).select("b_cls", "c_cls", "b_id", "c_id")


def _weights(edges: DataFrame) -> DataFrame:
    """Class edges and rows of each group: a class stands in as many edges as it meets classes."""
    rows = F.sum(F.col("b_n") / F.col("b_met") + F.col("c_n") / F.col("c_met"))
    return edges.groupBy("group").agg(F.count(F.lit(1)).alias("edges"), rows.alias("rows"))


def _settled(bank: DataFrame, company: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of rows of ``edges`` (with ``group``, ``b_met``, ``c_met``), group by group where these are within the bound."""
    large = (F.col("edges") > GROUP_EDGES) | (F.col("rows") > GROUP_ROWS)
    sizes = _weights(edges)
    seen = sizes.agg(F.count_if(large).alias("large"), F.sum(F.when(~large, F.col("rows") + F.col("edges"))).alias("size")).first()
    if not seen.large:
        return _passes(bank, company, edges, seen.size or 0)
    sizes = stored(sizes)
    small = edges.join(sizes.filter(~large).select("group"), "group")
    slices = int(sizes.agg(F.max(F.ceil(F.greatest(F.col("edges") / max(1, GROUP_EDGES), F.col("rows") / max(1, GROUP_ROWS))))).first()[0])
    if slices <= SLICES:
        sliced = _in_slices(bank, company, edges.join(sizes.filter(large).select("group"), "group").select(small.columns), slices)
        if sliced is not None:
            return sliced.unionByName(_passes(bank, company, small, seen.size or 0))
    parts = stored(_components(edges.join(sizes.filter(large).select("group"), "group")))
    sizes = stored(_weights(parts).join(parts.groupBy("group").agg(F.max("open").alias("open")), "group"))
    large = large | F.col("open")
    closed = parts.join(sizes.filter(~large).select("group"), "group").select(small.columns)
    small = stored(small.unionByName(closed))
    out = _passes(bank, company, small, _weights(small).agg(F.sum(F.col("rows") + F.col("edges"))).first()[0] or 0)
    beyond = parts.join(sizes.filter(large).select("group"), "group").select(small.columns)
    return out if beyond.isEmpty() else out.unionByName(_beyond(bank, company, beyond))


def _in_slices(bank: DataFrame, company: DataFrame, edges: DataFrame, slices: int) -> DataFrame | None:
    """Pairs of rows of groups beyond the bound: their bank rows are passed over in ``slices`` stretches, each with the company rows that are
    left. None if a stretch has more than twice the bound of edges, as where classes of many rows meet many.

    Company rows of a class are taken in their order, so a number for each class tells what is left, and no more of them than the rows of a
    stretch can be taken.
    """
    edges = stored(edges)
    of_class = edges.groupBy("b_cls").agg(F.first("group").alias("group"), F.count(F.lit(1)).alias("edges"))
    ranked = rank_within(bank.join(of_class, "b_cls"), ["group"], "b_ord", "turn")
    last = of_class.join(bank, "b_cls").groupBy("group").agg(F.count(F.lit(1)).alias("last"))
    ranked = stored(ranked.join(last, "group").withColumn("slice", F.floor((F.col("turn") - 1) * slices / F.col("last")).cast("int")).drop("turn", "last"))
    per = ranked.groupBy("slice", "group", "b_cls").agg(F.count(F.lit(1)).alias("n"), F.first("edges").alias("edges"))
    sizes = stored(per.groupBy("slice", "group").agg(F.sum("n").alias("n"), F.sum("edges").alias("edges")))
    if sizes.agg(F.max("edges")).first()[0] > 2 * GROUP_EDGES:
        return None
    most = edges.agg(F.max("c_n")).first()[0]
    places = stored(rank_within(company.join(edges.select("c_cls", "group").distinct(), "c_cls"), ["c_cls"], "c_ord", "place", most))
    out, taken = None, None
    for k, size in sorted((r.slice, r.size) for r in sizes.groupBy("slice").agg(F.sum(F.col("n") + 2 * F.col("edges")).alias("size")).collect()):  # at most SLICES rows
        rows = ranked.filter(F.col("slice") == k)
        met = edges.join(rows.select("b_cls").distinct(), "b_cls", "left_semi")
        free = places.join(sizes.filter(F.col("slice") == k).select("group", "n"), "group").join(met.select("c_cls").distinct(), "c_cls", "left_semi")
        if taken is None:
            free = free.filter("place <= n")
        else:
            free = free.join(taken, "c_cls", "left").filter("place > coalesce(used, 0) and place <= coalesce(used, 0) + n")
        got = stored(_passes(rows.select(bank.columns), free.select(company.columns), met, size))
        out = got if out is None else out.unionByName(got)
        taken = stored(out.groupBy("c_cls").agg(F.count(F.lit(1)).alias("used")))
    return out


def _components(edges: DataFrame) -> DataFrame:
    """``edges`` with a ``group`` for each connected component, as far as labels come in LABEL_ROUNDS; ``open`` where they have not met."""
    label = stored(edges.withColumn("group", F.xxhash64("c_cls")))
    for _ in range(LABEL_ROUNDS):
        least = lambda p: F.min("group").over(W.partitionBy(f"{p}_cls"))
        label = stored(label.withColumn("group", least("b")).withColumn("group", least("c")))
        ends = lambda p: F.min("group").over(W.partitionBy(f"{p}_cls")) != F.max("group").over(W.partitionBy(f"{p}_cls"))
        label = stored(label.withColumn("open", ends("b")).withColumn("open", F.col("open") | ends("c")))
        if label.filter("open").isEmpty():
            break
        label = label.drop("open")
    return label if "open" in label.columns else label.withColumn("open", ends("b")).withColumn("open", F.col("open") | ends("c"))


def _passes(bank: DataFrame, company: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """Sequential passes: edges and rows of a group meet in one task, which takes about TASK_ROWS of them."""
    parts = max(1, int(size // TASK_ROWS) + 1)
    none = {"b_cls": "string", "c_cls": "string", "prefer": "double", "date": "date", "source_row": "long", "id": "string"}
    part = F.pmod(F.xxhash64("group"), F.lit(parts)).alias("part")
    shape = lambda df, **given: df.select(part, *[given[c].alias(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in none.items()])

    def rows(side: DataFrame, p: str) -> DataFrame:
        met = side.join(edges.select(f"{p}_cls", "group").distinct(), f"{p}_cls")
        return shape(met, **{f"{p}_cls": F.col(f"{p}_cls"), "date": F.col(f"{p}_ord.date"), "source_row": F.col(f"{p}_ord.source_row").cast("long"), "id": F.col(f"{p}_id")})

    links = shape(edges, **{c: F.col(c) for c in ("b_cls", "c_cls", "prefer")})
    return links.unionByName(rows(bank, "b")).unionByName(rows(company, "c")).groupBy("part").applyInArrow(_pass, _PAIRS)


def _pass(table: pa.Table) -> pa.Table:
    """One pass over the groups of a task. Rows have one class, edges two."""
    order: Callable = lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2])  # noqa: E731  null first, as in Spark
    wishes: dict[str, dict[float, list[str]]] = {}
    free: dict[str, list[tuple]] = {}
    rows: list[tuple] = []
    names = ("b_cls", "c_cls", "prefer", "date", "source_row", "id")
    for b, c, prefer, *place in zip(*(table[n].to_pylist() for n in names), strict=True):
        if b is not None and c is not None:
            wishes.setdefault(b, {}).setdefault(-prefer, []).append(c)
        elif b is not None:
            rows.append((order(place), b))
        else:
            free.setdefault(c, []).append(order(place))
    rows.sort()
    for places in free.values():
        places.sort(reverse=True)  # the head is the last
    tiers: dict[str, list[list[tuple]]] = {}
    out: list[tuple] = []
    for place, b in rows:
        if b not in tiers:
            tiers[b] = [[(free[c][-1], c) for c in cs if free.get(c)] for _, cs in sorted(wishes[b].items(), reverse=True)]
            for heads in tiers[b]:
                heapq.heapify(heads)
        left = tiers[b]
        while left:
            heads = left[-1]
            if not heads:
                left.pop()
                continue
            head, c = heads[0]
            places = free[c]
            if places and places[-1] == head:
                places.pop()
                out.append((b, c, place[-1], head[-1]))
                break
            if places:  # others have taken from this class
                heapq.heapreplace(heads, (places[-1], c))
            else:
                heapq.heappop(heads)
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table({n: pa.array(v, pa.string()) for n, v in zip(("b_cls", "c_cls", "b_id", "c_id"), columns, strict=True)})


def _beyond(bank: DataFrame, company: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of rows of groups beyond the bound: ranked and joined where every class meets every other equally well, else in rounds."""
    ends = [f(c).alias(f"{p}_{c}") for c in ("b_met", "c_met", "prefer") for p, f in (("lo", F.min), ("hi", F.max))]
    sizes = edges.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *ends, F.sum("b_n").alias("sum_b"), F.sum("c_n").alias("sum_c"))
    groups = stored(sizes.select(
        "group",
        # where all bank classes meet as many, and all company classes, every pair meets if the product is the number of edges
        F.expr("lo_b_met <> hi_b_met or lo_c_met <> hi_c_met or n <> hi_b_met * hi_c_met or lo_prefer <> hi_prefer").alias("mixed"),
        F.expr("sum_b div hi_b_met").alias("b_rows"), F.expr("sum_c div hi_c_met").alias("c_rows"),
    ))
    known = groups.agg(F.bool_or("mixed").alias("mixed"), *[F.max(F.expr(f"if(mixed, 0, {c})")).alias(c) for c in ("b_rows", "c_rows")]).first()
    whole = edges.join(groups.filter("not mixed").select("group"), "group")
    pairs = _in_turn(bank, company, whole, ["group"], ["group"], known.b_rows, known.c_rows)
    if not known.mixed:
        return pairs
    met = bank.join(edges.join(groups.filter("mixed").select("group"), "group"), "b_cls").join(company, "c_cls")
    won = priority_match(met.select(
        "b_cls", "c_cls", "b_id", "c_id", F.col("b_id").alias("b"), F.col("c_id").alias("c"), F.col("b_ord").alias("b_rank"),
        F.col("b_cls").alias("cls"), F.struct(-F.col("prefer"), F.col("c_ord")).alias("wish"),
    ))
    return pairs.unionByName(won.select(pairs.columns))


def priority_match(edges: DataFrame) -> DataFrame:
    """The pairs that a sequential pass over bank rows would make, in rounds.

    ``edges`` has ``b``, ``b_rank``, ``c``, ``wish`` (smaller is better for the bank row; unique for each ``b``) and ``cls``:
    bank rows of one ``cls`` have the same company rows and wishes. Each round every bank row proposes to its best remaining company row,
    and each company row holds the lowest rank that proposed; edges of higher ranks to a held row can never win and go.
    Of a class, each bank row ends at a later wish than the one before it, so it starts that much further on. Done when
    no edge goes.
    """
    turn = edges.select("cls", "b", "b_rank").distinct()
    turn = turn.select("b", F.row_number().over(W.partitionBy("cls").orderBy("b_rank")).alias("turn"))
    live = stored(edges.join(turn, "b").withColumn("pos", F.row_number().over(W.partitionBy("b").orderBy("wish"))))
    upto = W.partitionBy("cls").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    while True:
        at = live.groupBy("b").agg(F.min("pos").alias("at"), F.first("cls").alias("cls"), F.first("turn").alias("turn"))
        at = at.select("b", (F.max(F.col("at") - F.col("turn")).over(upto) + F.col("turn")).alias("from"))
        ahead = live.join(at, "b").withColumn("behind", F.col("pos") < F.col("from")).drop("from")
        best = ahead.filter("not behind").groupBy("b").agg(F.min_by(F.struct("c", "b_rank"), F.col("pos")).alias("p"))
        held = best.groupBy(F.col("p.c").alias("c")).agg(F.min("p.b_rank").alias("held_rank"))
        beaten = F.coalesce(F.col("b_rank") > F.col("held_rank"), F.lit(False))
        kept = stored(ahead.join(held, "c", "left").withColumn("lost", F.col("behind") | beaten).drop("behind", "held_rank"))
        if kept.filter("lost").isEmpty():
            return live.join(best.select("b", F.col("p.c").alias("c")), ["b", "c"]).drop("turn", "pos")
        live = kept.filter("not lost").drop("lost")


def priority_pairs(hyperedges: DataFrame) -> DataFrame:
    """As ``priority_match`` where a bank row takes two company rows at once.

    ``hyperedges`` has ``b``, ``b_rank``, ``c1``, ``c2`` and ``wish``. In each round a
    bank row takes its best live pair if no live bank row of lower rank has a
    live pair that touches either of its company rows; taken rows and their
    edges go. Exact, and each round takes at least the lowest rank.
    """
    live, done = stored(hyperedges), None
    while not live.isEmpty():
        best = live.groupBy("b").agg(F.min_by(F.struct("c1", "c2", "b_rank"), F.col("wish")).alias("p")).select("b", "p.*")
        ends = live.select(F.explode(F.array("c1", "c2")).alias("c"), "b_rank")
        first = ends.groupBy("c").agg(F.min("b_rank").alias("first_rank"))
        one = first.select(F.col("c").alias("c1"), F.col("first_rank").alias("r1"))
        two = first.select(F.col("c").alias("c2"), F.col("first_rank").alias("r2"))
        sure = stored(best.join(one, "c1").join(two, "c2").filter((F.col("b_rank") == F.col("r1")) & (F.col("b_rank") == F.col("r2"))).select("b", "c1", "c2"))
        won = live.join(sure, ["b", "c1", "c2"], "left_semi")
        done = won if done is None else done.unionByName(won)
        used = sure.select(F.explode(F.array("c1", "c2")).alias("u"))
        rest = live.join(sure.select("b"), "b", "left_anti")
        rest = rest.join(used, rest.c1 == used.u, "left_anti").join(used, rest.c2 == used.u, "left_anti")
        live = stored(rest)
    return live if done is None else done
