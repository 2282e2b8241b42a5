"""Manifests against a plain tree, and the cases that the docstrings define."""

import hashlib
import random
import zlib

import duckdb
import pytest

from ledgerline.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(r):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], r[1])))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path_of(levels, i):
    out = []
    for nodes in levels[:-1]:
        out.append((nodes[i ^ 1] if i ^ 1 < len(nodes) else None, i & 1))
        i //= 2
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names, trees, out = sorted(groups, key=lambda g: (g is not None, (g or "").encode())), {}, []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = levels_of([leaf_of(r) for r in groups[g]])
    top = levels_of([trees[g][-1][0] for g in names])
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps, node = path_of(trees[g], i) + path_of(top, k), leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                node = leaf_of((*r[:4], r[4] + 1))
            for sibling, right in steps:
                node = digest(node if sibling is None else sibling + node if right else node + sibling)
            proof = digest("".join(s for s, _ in steps if s))
            out.append((r[0], leaf_of(r), trees[g][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def some_docs(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"text {i} é", rng.choice(["en", "en", "en", "fr", "ß", "zz", None]), rng.choice(["s", "", None]), rng.choice([None, i])) for i in range(n)]
    rows += [(2**60 + 1, None, "en", None, 5), (2**60 + 1, "", "en", None, 5), (None, "x", "en", "s", 1), (None, "y" * 300_000, "one", "s", 1), (-5, "n", "en", "s", 0)]
    return rows + [(9, "same", "fr", "s", 4)] * 40


@pytest.mark.parametrize("bounds", [{}, {"leaves": 40, "most_nodes": 12, "block_levels": 2}, {"leaves": 7, "most_nodes": 3, "block_levels": 1}])
def test_proofs_whatever_the_partitions(spark, bounds):
    rows = some_docs(230)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS).repartition(5)
    got = merkle.prove_tampered(docs, **bounds)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_small_tables(spark):
    full = lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], DOCS)
    for rows in ([(1, "a", "en", "s", 1)], [(1, "a", None, "s", 1), (2, "b", "", "s", 1)], some_docs(0)[:3]):
        assert sorted(map(tuple, merkle.prove_tampered(full(rows)).collect()), key=str) == brute(rows)
    assert merkle.prove_tampered(full(some_docs(1)).filter("false")).count() == 0


def test_steps_and_places(spark):
    rows = [(i, str(i), "en", "s", i) for i in range(11)]
    made = merkle.manifest(spark.createDataFrame([(*r, "c") for r in rows], DOCS), merkle.FIELDS, leaves=3).orderBy("doc_id").collect()
    assert [r.position for r in made] == list(range(11))
    assert [s[:1] for s in made[10].steps] == ["-", "L", "-", "L"] and made[10].root == made[0].subroot


def test_sql_agrees(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(some_docs(150, 7)) if len(r[1] or "") < 1000]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(merkle.SQL).fetchall(), key=str) == brute(rows)
