"""The manifest against trees built level by level over plain lists."""

import hashlib
import random
import zlib

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from fixwright.llm import merkle, queries

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, extra string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def grown(leaves):
    """The root, and for each leaf its steps (left, right)."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // 3 * 3
            steps[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 3])))
            at[i] = p // 3
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], steps


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = own, *grown([leaf_of(r) for r in own])
    root, tops = grown([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        own, subroot, steps = trees[s]
        out += [(r[0], leaf_of(r), subroot, root, tuple(p + top)) for r, p in zip(own, steps)]
    return sorted(out, key=str)


def read(found):
    rows = found.select("doc_id", "leaf", "subroot", "root", "proof").collect()
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, tuple((p.left, p.right) for p in r.proof)) for r in rows], key=str)


@pytest.mark.parametrize("power", [1, 2])
@pytest.mark.parametrize("sizes", [(1,), (7,), (1, 1, 1, 1), (100, 3, 28, 1), (82, 10, 9, 2)])
def test_proofs_equal_whole_trees(spark, power, sizes):
    rng = random.Random(sum(sizes) + power)
    names = [None, "b", "Ä", "a", "aa"]
    rows = [(i * 7 + k, names[k], "en", i, rng.choice(["x\ny", "", None, "Grüße"]), "z") for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    found = merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(3), power=power)
    assert read(found) == expected(rows)
    bad = found.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root"))
    assert bad.count() == 0


def test_edge_cases(spark):
    rows = [(1, None, None, None, None, "p"), (1, None, None, None, None, "q"), (None, "s", "en", 3, "", None), (None, "s", "en", 3, None, None)]
    rows += [(2, "s", "en", 3, "wort " * 200_000, None)] * 2 + [(i, "hot", "de", 0, "same", None) for i in range(40)]
    named = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"extra": "Leaf"}).withColumns({"root": F.lit(1), "tree": F.lit(2), "block": F.lit("x")})
    found = merkle.manifest(named, power=1)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof"] and read(found) == expected(rows)
    assert merkle.manifest(named.limit(0), power=1).count() == 0


def test_any_key_and_kept_columns(spark):
    rows = spark.createDataFrame([("k2", "s", "b"), ("k1", "s", "a"), ("k3", None, None)], "id string, source string, body string")
    found = merkle.manifest(rows, key="id", columns=("id", "body"), keep={"n": F.length("body"), "leaf of": F.col("source")})
    assert {(r.id, r.n, r["leaf of"]) for r in found.collect()} == {("k1", 1, "s"), ("k2", 1, "s"), ("k3", None, None)}


def test_query_finds_what_was_tampered_with(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    whole = expected([tuple(r[c] for c in merkle.COLUMNS) for r in docs.values()])
    got = {r.doc_id: r for r in queries.QUERIES["op12_merkle_manifest"](spark, SMALL).collect()}
    assert len(got) == len(docs) == len(whole)
    changed = 0
    for key, leaf, subroot, root, proof in whole:
        text = docs[key].text
        cut = zlib.crc32(str(key).encode()) % 2 == 0 and text is not None and "\n" in text
        at = leaf_of([docs[key][c] if c != "text" else text.replace("\n", "") if cut else text for c in merkle.COLUMNS])
        for left, right in proof:
            at = sha(left + at + right)
        r = got[key]
        assert (r.leaf, r.subroot, r.root, r.folded_root) == (leaf, subroot, root, at)
        assert r.proof_sha256 == sha("".join(a + b for a, b in proof)) and r.verified == (not cut)
        changed += cut
    assert changed
