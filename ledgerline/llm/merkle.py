"""Merkle manifest of a dataset, with a proof for every row.

Rows are leaves; leaves of a group form a tree in the order of their ids, and the tops of the groups one more tree. In a
tree every two consecutive nodes become their digest, level by level; the last node of an odd level goes up alone.

The leaves are range-sorted, so that each partition holds stretches of whole groups' sequences. The numbers of rows by
partition and group give, summed up, the place of each stretch. Every partition then builds all subtrees that lie wholly
within it. What is left of it are its ragged nodes, at most two a level, which are shuffled by their coordinates (group,
level, index) and joined to the upper levels: in blocks where a group has many, until its top is reached. Their paths
return to the partition, which puts them under the paths of its own subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.runtime import cut

#: Leaves of a partition, and nodes of a group or block that one task joins; a block holds the nodes of 2 ** BLOCK_LEVELS partitions or less.
LEAVES, NODES, BLOCK_LEVELS = 50_000, 50_000, 8
_RAGGED = "pid int, g string, first long, total long, level int, index long, digest string"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def _width(total: int, level: int) -> int:
    """Nodes of a level above ``total`` leaves."""
    return (total + (1 << level) - 1) >> level


def _step(index: int, width: int, sibling: str | None) -> str:
    """How a proof goes on from a node: the sibling after the side it stands on, or no sibling."""
    return "-" if index ^ 1 >= width else f"{'L' if index & 1 else 'R'}{sibling}"


def _climb(leaves: list[str], first: int, total: int) -> Iterator[tuple[int, list[str], int, int]]:
    """Levels of the subtrees wholly within leaves ``first`` and following of ``total``: index of the first node, nodes, and
    the indexes between which nodes have their parent here."""
    nodes = leaves
    while True:
        end = first + len(nodes)
        low = (first + 1) // 2
        high = end // 2 if end < total else (total + 1) // 2
        if total == 1 or high <= low:
            yield first, nodes, first, first
            return
        yield first, nodes, 2 * low, min(2 * high, end)
        nodes = [_digest("".join(nodes[2 * j - first : 2 * j - first + 2])) for j in range(low, high)]
        first, total = low, (total + 1) // 2


def _stretches(rows: pa.Table) -> Iterator[tuple[str, int, int]]:
    """Groups of sorted rows: name, first row, end."""
    names, start = rows["g"].to_pylist(), 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[start]:
            yield names[start], start, i
            start = i


def _ragged(leaves: pa.Table, spans: pa.Table) -> pa.Table:
    """The nodes of a partition that have no parent within it."""
    leaves = leaves.sort_by("seq")
    place = {s["g"]: s for s in spans.to_pylist()}
    digests, out = leaves["leaf"].to_pylist(), []
    for g, start, end in _stretches(leaves):
        s = place[g]
        for level, (first, nodes, low, high) in enumerate(_climb(digests[start:end], s["first"], s["total"])):
            for i in (*range(first, low), *range(max(high, low), first + len(nodes))):
                out.append((s["pid"], g, s["first"], s["total"], level, i, nodes[i - first]))
    return _table(out, _RAGGED)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.table({n: pa.array(c, _TYPES[t]) for (n, t), c in zip(fields, columns, strict=True)})


_JOINED = "g string, level int, index long, up_level int, up_index long, up_digest string, steps array<string>"


def _join_up(nodes: pa.Table, upto: int) -> pa.Table:
    """Join the nodes of a block, which lie side by side, up to one node at level ``upto`` or the top; and the steps that lead there from each."""
    rows = nodes.to_pylist()
    total, known = rows[0]["total"], {(r["level"], r["index"]): r["digest"] for r in rows}
    top = min(max(upto, max(r["level"] for r in rows)), (total - 1).bit_length())
    by_level: dict[int, list[int]] = {}
    for level, index in known:
        by_level.setdefault(level, []).append(index)
    for level in range(min(by_level), top):
        width = _width(total, level)
        for i in by_level.get(level, []):
            if i % 2 == 0:
                pair = known[level, i] + (known[level, i + 1] if i + 1 < width else "")
                known[level + 1, i // 2] = _digest(pair)
                by_level.setdefault(level + 1, []).append(i // 2)
    out = []
    for r in rows:
        index, steps = r["index"], []
        for level in range(r["level"], top):
            steps.append(_step(index, _width(total, level), known.get((level, index ^ 1))))
            index //= 2
        out.append((r["g"], r["level"], r["index"], top, index, known[top, index], steps))
    return _table(out, _JOINED)


def _joiner(upto: int) -> Callable[[pa.Table], pa.Table]:
    return lambda nodes: _join_up(nodes, upto)


def _upper(ragged: DataFrame, rows: int, parts: int, most_nodes: int, block_levels: int) -> DataFrame:
    """``ragged`` with the ``steps`` from each node to the top of its group and the top's digest, ``up_digest``."""
    paths = ragged.withColumns({"up_level": F.col("level"), "up_index": F.col("index"), "up_digest": F.col("digest"), "steps": F.array().cast("array<string>")})
    level = (max(rows // max(parts, 1), 1)).bit_length()
    while True:
        nodes = paths.select("g", "total", F.col("up_level").alias("level"), F.col("up_index").alias("index"), F.col("up_digest").alias("digest"))
        nodes = nodes.dropDuplicates(["g", "level", "index"])
        most = nodes.groupBy("g").count().agg(F.max("count")).first()[0] or 0
        level = level + block_levels if most > most_nodes else 64
        upto = level
        block = F.when(F.col("level") >= upto, F.struct("level", "index")).otherwise(
            F.struct(F.lit(upto).alias("level"), F.expr(f"shiftright(index, {upto} - level)").alias("index"))) if upto < 64 else F.lit(0)
        joined = nodes.withColumn("block", block).groupBy("g", "block").applyInArrow(_joiner(min(upto, 63)), _JOINED)
        more = joined.select("g", F.col("level").alias("at_level"), F.col("index").alias("at_index"), F.struct("up_level", "up_index", "up_digest", "steps").alias("m"))
        met = paths.join(more, (paths.g == more.g) & (F.col("up_level") == F.col("at_level")) & (F.col("up_index") == F.col("at_index")))
        paths = cut(met.select(
            *[paths[c] for c in ragged.columns], F.col("m.up_level"), F.col("m.up_index"), F.col("m.up_digest"), F.concat(paths.steps, "m.steps").alias("steps")))
        if upto >= 64:
            return paths


def _prove(leaves: pa.Table, paths: pa.Table) -> pa.Table:
    """Add to the leaves of a partition their places and the steps from each to the top of all."""
    leaves = leaves.sort_by("seq")
    digests, position, steps, subroot, root = leaves["leaf"].to_pylist(), [], [], [], []
    place: dict[str, dict] = {}
    for p in paths.to_pylist():
        s = place.setdefault(p["g"], {**p, "up": {}})
        s["up"][p["level"], p["index"]] = p["steps"]
    for g, start, end in _stretches(leaves):
        s = place[g]
        levels = list(_climb(digests[start:end], s["first"], s["total"]))
        above: list[list[str]] = []
        for level in reversed(range(len(levels))):
            first, nodes, low, high = levels[level]
            width, own = _width(s["total"], level), []
            for i in range(first, first + len(nodes)):
                if low <= i < high:
                    sibling = nodes[(i ^ 1) - first] if i ^ 1 < width else None
                    own.append([_step(i, width, sibling), *above[i // 2 - levels[level + 1][0]]])
                else:
                    own.append(s["up"][level, i])
            above = own
        steps += above
        position += range(s["first"], s["first"] + end - start)
        subroot += [s["subroot"]] * (end - start)
        root += [s["root"]] * (end - start)
    out = leaves.drop_columns(["pid", "seq"])
    for name, values, kind in (("position", position, pa.int64()), ("subroot", subroot, pa.string()), ("root", root, pa.string()), ("steps", steps, pa.list_(pa.string()))):
        out = out.append_column(name, pa.array(values, kind))
    return out


def _grow(rows: DataFrame, order: list[str], leaves: int, most_nodes: int, block_levels: int) -> tuple[DataFrame, DataFrame]:
    """The trees over stored ``rows`` (``g``, ``leaf`` and others): rows dealt to partitions (``pid``, ``seq``), and the
    ragged nodes of each partition with their ``steps`` to the top of their group, ``up_digest``."""
    n = rows.count()
    parts = max(1, -(-n // leaves))
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(parts, "g", *order, "__row")
    dealt = dealt.sortWithinPartitions("g", *order, "__row").drop("__row")
    dealt = cut(dealt.withColumns({"pid": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}))
    counts = dealt.groupBy("g", "pid").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("g").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    spans = counts.select("pid", "g", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"), F.sum("n").over(W.partitionBy("g")).alias("total"))
    met = dealt.select("pid", "seq", "g", "leaf").groupBy("pid").cogroup(spans.groupBy("pid"))
    ragged = cut(met.applyInArrow(_ragged, _RAGGED))
    return dealt, _upper(ragged, n, parts, most_nodes, block_levels)


def _proofs(dealt: DataFrame, paths: DataFrame) -> DataFrame:
    """``dealt`` with ``position``, ``subroot``, ``root`` and ``steps``."""
    kinds = [f"`{c}` {t}" for c, t in dealt.dtypes if c not in ("pid", "seq")]
    schema = ", ".join([*kinds, "position long", "subroot string", "root string", "steps array<string>"])
    own = paths.select("pid", "g", "first", "total", "level", "index", "steps", "subroot", "root")
    return dealt.groupBy("pid").cogroup(own.groupBy("pid")).applyInArrow(_prove, schema)


def leaf_digest(*fields: Column) -> Column:
    """Digest of fields: each ``-`` if null, else its length in UTF-8 bytes, a colon and itself."""
    parts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts]), 256)


def manifest(
    rows: DataFrame, fields: list[str], group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None,
    leaves: int = LEAVES, most_nodes: int = NODES, block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """The manifest of ``rows``: one row for each, with its proof.

    Returns the ``order`` column, the columns of ``carry``, ``leaf`` (digest of ``fields``), ``position`` (in its group, from 0), ``subroot``, ``root``
    and ``steps``: of each level from the leaf to the root ``L`` or ``R`` (the side on which the sibling stands) and the
    sibling's digest, or ``-`` where a node goes up alone. Groups come in the order of their names as UTF-8 bytes, null first.
    Defined cases: a null id comes before all others; rows that share an id are ordered by their leaves, so equal rows stand side by
    side; a null field is told from an empty one; texts of any length are digested whole; a single row is its own
    subroot, and the only subroot the root, with no steps; an empty table has an empty manifest; other columns are not read.
    """
    name = F.when(F.col(group).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(group).cast("string")))
    stored = cut(rows.select(
        F.col(order).alias("__id"), *[c.alias(f"__carry_{n}") for n, c in (carry or {}).items()], name.alias("g"), leaf_digest(*[F.col(f) for f in fields]).alias("leaf"),
    ))
    dealt, paths = _grow(stored, ["__id", "leaf"], leaves, most_nodes, block_levels)
    tops = cut(paths.select("g", F.col("up_digest").alias("leaf")).dropDuplicates(["g"]))
    groups, upper = _grow(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "leaf"), ["name"], leaves, most_nodes, block_levels)
    upper = upper.withColumns({"subroot": F.lit(None).cast("string"), "root": F.col("up_digest")})
    of_groups = cut(_proofs(groups, upper)).select(F.col("name").alias("g"), F.col("leaf").alias("subroot"), "root", F.col("steps").alias("more"))
    paths = cut(paths.join(of_groups, "g").withColumn("steps", F.concat("steps", "more")))
    back = [F.col("__id").alias(order), *[F.col(f"__carry_{n}").alias(n) for n in (carry or {})]]
    return _proofs(dealt, paths).select(*back, "leaf", "position", "subroot", "root", "steps")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf gives by the steps of a proof."""
    other = lambda s: F.substr(s, F.lit(2))
    joined = lambda node, s: F.when(s == "-", node).when(F.startswith(s, F.lit("L")), F.concat(other(s), node)).otherwise(F.concat(node, other(s)))
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(joined(node, s), 256))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def prove_tampered(docs: DataFrame, **bounds: int) -> DataFrame:
    """Manifest of documents with digests of the proofs, and the root to which each proof leads when one of seven documents, by the checksum of its id,
    has one more in ``n_chars``: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = leaf_digest(*[F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS])
    made = manifest(docs, FIELDS, carry={"tampered": F.when(hit, tampered)}, **bounds)
    siblings = F.array_join(F.transform(F.filter("steps", lambda s: s != "-"), lambda s: F.substr(s, F.lit(2))), "")
    out = made.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_PART = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = lambda more: "sha256(" + " || ".join(_PART.format(f"({f}{more if f == 'n_chars' else ''})") for f in FIELDS) + ")"
#: A table of nodes by level: consecutive nodes become their digest until one is left.
_NODES = """{out} AS (
  SELECT {key} AS k, 0 AS level, i, n, d FROM {leaves}
  UNION ALL SELECT k, level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM {out} WHERE n > 1 GROUP BY k, level, i // 2)"""
#: The steps from each leaf to the top of its tree.
_STEPS = """{out} AS (
  SELECT l.row, list(CASE WHEN s.d IS NULL THEN '-' WHEN (l.i >> v.level) % 2 = 1 THEN 'L' || s.d ELSE 'R' || s.d END ORDER BY v.level) AS steps
  FROM (SELECT *, {key} AS k FROM {leaves}) l JOIN (SELECT DISTINCT k, level FROM {nodes} WHERE n > 1) v ON l.k = v.k
  LEFT JOIN {nodes} s ON s.k = v.k AND s.level = v.level AND s.i = xor(l.i >> v.level, 1::BIGINT)
  GROUP BY l.row)"""
SQL = f"""
WITH RECURSIVE
digests AS (SELECT doc_id, coalesce('v' || lang, 'n') AS g, {_LEAF('')} AS d, {_LEAF(' + 1')} AS other,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c:
    list_reduce(list_prepend(xor(a, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 7 = 0 AS hit
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS row FROM digests),
{_NODES.format(out='nodes', key='g', leaves='leaves')},
tops AS (SELECT k AS g, d, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n, row_number() OVER (ORDER BY k) AS row FROM nodes WHERE n = 1),
{_NODES.format(out='upper', key="''", leaves='tops')},
{_STEPS.format(out='own', key='g', leaves='leaves', nodes='nodes')},
{_STEPS.format(out='above', key="''", leaves='tops', nodes='upper')},
proofs AS (SELECT l.*, t.d AS subroot, (SELECT d FROM upper WHERE n = 1) AS root, list_concat(coalesce(own.steps, []), coalesce(above.steps, [])) AS steps
  FROM leaves l JOIN tops t USING (g) LEFT JOIN own ON own.row = l.row LEFT JOIN above ON above.row = t.row),
folded AS (SELECT *, list_reduce(list_prepend(CASE WHEN hit THEN other ELSE d END, steps), lambda a, s:
    CASE left(s, 1) WHEN '-' THEN sha256(a) WHEN 'L' THEN sha256(substr(s, 2) || a) ELSE sha256(a || substr(s, 2)) END) AS folded_root FROM proofs)
SELECT doc_id, d AS leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(steps, lambda s: s <> '-'), lambda s: substr(s, 2)), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified FROM folded"""
