"""A manifest of a dataset: hash trees over its rows, with a proof for every row.

A row's leaf is the SHA-256 of its columns. The rows of one source, in key order, are
the leaves of that source's tree; the roots of the sources' trees, in source order, are
the leaves of one more tree, whose root stands for the dataset. In both, every
``FANOUT`` neighbours become one node, the last of a level maybe from fewer, until one
node is left. A row's proof is what a reader needs to get from its leaf to the root:
for every level the digests left and right of its own.

The upper part of a tree is built by a butterfly exchange. The leaves are cut into
blocks of ``FANOUT ** power`` neighbours, aligned, so that a block is a subtree; a block
hashes its own levels from one row. Then blocks swap: in round r the aligned groups of
``FANOUT ** (r + 1)`` blocks consist of ``FANOUT`` subtrees, every block sends the root
of its subtree to the block with the same offset in each of the other subtrees, and
every block hashes the parent for itself. After as many rounds as there are levels each
block knows the root and its own whole upper proof; no second pass goes down the tree.
A last subtree may be shorter than its neighbours; its blocks then serve every offset
equal to theirs modulo its length, so nobody goes without and nobody gets anything twice.

One round is one shuffle of a row for each block and message. Positions come from a
range partitioning and the row counts of its partitions, so no source's rows meet in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixwright.sources.staging import written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
POWER = 6  # 729 leaves in a block


def digest(*values: Column) -> Column:
    """The SHA-256, in hex, of the values: ``-`` for a null, else byte count, colon, text."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _joined(digests: Column) -> Column:
    return F.concat_ws("", digests)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof in one text, level by level, left to right."""
    return _joined(F.transform(proof, lambda step: F.concat(step["left"], step["right"])))


def manifest(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    columns: tuple[str, ...] = COLUMNS,
    keep: dict[str, Column] | None = None,
    power: int = POWER,
) -> DataFrame:
    """Rows (key, leaf, subroot, root, proof) and the columns of ``keep``, one for each input row.

    ``keep`` names small columns to carry along, as expressions over the input. Leaves of a
    source ascend by key, null keys first, equal keys by leaf; rows equal in all of
    ``columns`` have equal leaves, and each has its own place among them. Null sources are
    a source of their own and stand first; sources are in order of their UTF-8 bytes. A null
    column counts as ``-``, which no value does; an empty text as ``0:``. A source with one
    row has that leaf as its subroot, a table with one source has that subroot as its root,
    and proofs are shorter by these levels, maybe empty. An empty table gives an empty result.
    Other columns are neither read nor replaced; the result has only the named ones.
    """
    keep = keep or {}
    row = F.struct(F.col(f"`{key}`").alias("key"), F.struct(*[c.alias(n) for n, c in keep.items()] or [F.lit(0).alias("none")]).alias("kept"))
    leaves = docs.select(
        F.col(f"`{source}`").alias("tree"),
        F.col(f"`{key}`").alias("order"),
        digest(*[F.col(f"`{c}`") for c in columns]).alias("leaf"),
        row.alias("row"),
    )
    packed, of_block = forest(leaves, power)
    roots = written(of_block.where("block = 0").select("tree", "root"), "subroots")
    single = F.lit(0).alias("tree")
    top, of_top = forest(roots.select(single, F.col("tree").alias("order"), F.col("root").alias("leaf"), F.struct("tree").alias("row")), power)
    sources = written(
        proven(top, of_top).select(F.col("row.tree").alias("s"), F.col("root").alias("top"), F.col("proof").alias("upper")), "sources"
    )
    of_block = of_block.join(sources, F.col("tree").eqNullSafe(F.col("s"))).drop("s")
    found = proven(packed, of_block, "top", "upper")
    kept = [F.col(f"row.kept.`{n}`").alias(n) for n in keep]
    proof = F.concat("proof", "upper")
    return found.select(
        F.col("row.key").alias(key), "leaf", F.col("root").alias("subroot"), F.col("top").alias("root"), proof.alias("proof"), *kept
    )


def forest(leaves: DataFrame, power: int) -> tuple[DataFrame, DataFrame]:
    """The trees over rows (tree, order, leaf, row): blocks with their own levels, and each block's way up.

    The first table is (tree, block, rows, levels), the second (tree, block, root, steps).
    """
    size = FANOUT**power
    placed = positions(leaves)
    packed = (
        placed.withColumn("block", F.expr(f"position div {size}"))
        .groupBy("tree", "block", F.expr(f"(total + {size - 1}) div {size}").alias("blocks"))
        .agg(F.array_sort(F.collect_list(F.struct("position", "leaf", "row"))).alias("rows"))
    )
    packed = packed.select("tree", "block", "blocks", "rows", _levels(F.col("rows.leaf"), F.col("blocks") > 1, power).alias("levels"))
    packed = written(packed, "blocks")
    node = F.element_at(F.element_at("levels", -1), 1)
    return packed.drop("blocks"), exchanged(packed.select("tree", "block", "blocks", node.alias("node")))


def positions(leaves: DataFrame) -> DataFrame:
    """The rows with their ``position`` in their tree, from 0, and the tree's row count ``total``."""
    order = ["tree", "order", "leaf", "tie"]
    tied = written(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    # an id after the sort holds the partition above bit 33 and the row's place in it below
    dealt = tied.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()).drop("tie", "order"), "ordered")
    runs = dealt.groupBy("tree", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(
        F.col("tree").alias("t"), "part", (F.col("first") - before).alias("zero"), F.sum("n").over(whole).alias("total")
    )
    runs = written(runs, "runs")
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.shiftright("at", 33) == F.col("part"))
    return dealt.join(runs, same).select("tree", "leaf", "row", (F.col("at") - F.col("zero")).alias("position"), "total")


def _levels(leaves: Column, whole: Column, power: int) -> Column:
    """A block's levels from its leaves up: all ``power`` of them if the tree is larger (``whole``), else up to one node."""

    def parents(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int"))
        return F.transform(runs, lambda i: F.sha2(_joined(F.slice(level, i * FANOUT + 1, FANOUT)), 256))

    def up(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        return F.when(whole | (F.size(last) > 1), F.concat(levels, F.array(parents(last)))).otherwise(levels)

    return F.aggregate(F.sequence(F.lit(1), F.lit(power)), F.array(leaves), up)


def exchanged(blocks: DataFrame) -> DataFrame:
    """Rows (tree, block, root, steps) from rows (tree, block, blocks, node): the butterfly.

    ``steps`` is the block's proof from its own root to its tree's.
    """
    none = F.array().cast("array<struct<left:string,right:string>>")
    state = blocks.withColumn("steps", none)
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    width = 1
    while width < most:
        state = written(_swapped(state, width), "swapped")
        width *= FANOUT
    return state.select("tree", "block", F.col("node").alias("root"), "steps")


def _swapped(state: DataFrame, width: int) -> DataFrame:
    """One round: subtrees of ``width`` blocks, ``FANOUT`` of them in a group."""
    place = F.expr(f"cast((block div {width}) % {FANOUT} as int)")
    first = F.expr(f"(block div {width}) * {width}")
    length = F.least(F.lit(width), F.col("blocks") - first)
    group = F.expr(f"(block div {width * FANOUT}) * {width * FANOUT}")

    def receivers(sibling: Column) -> Column:
        """The blocks of a sibling subtree whose offset is the sender's, modulo the sender's length."""
        begin = group + sibling * width + (F.col("block") - first)
        end = F.least(group + (sibling + 1) * width, F.col("blocks")) - 1
        there = (sibling != place) & (begin <= end)
        return F.when(there, F.sequence(begin, F.greatest(begin, end), length)).otherwise(F.array().cast("array<bigint>"))

    to = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), receivers))
    going = state.where(F.col("blocks") > width)
    sent = going.select("tree", F.explode(to).alias("block"), F.struct(place.alias("place"), "node").alias("message"))
    own = going.select("tree", "block", F.struct(place.alias("place"), "node").alias("message"), "blocks", "steps")
    met = (
        own.unionByName(sent, allowMissingColumns=True)
        .groupBy("tree", "block")
        .agg(F.max("blocks").alias("blocks"), F.first("steps", ignorenulls=True).alias("steps"), F.array_sort(F.collect_list("message")).alias("run"))
    )

    def part(test) -> Column:
        return _joined(F.transform(F.filter("run", test), lambda m: m["node"]))

    step = F.struct(part(lambda m: m["place"] < place).alias("left"), part(lambda m: m["place"] > place).alias("right"))
    after = met.select("tree", "block", "blocks", F.sha2(_joined(F.col("run.node")), 256).alias("node"), F.concat("steps", F.array(step)).alias("steps"))
    return after.unionByName(state.where(F.col("blocks") <= width))


def proven(packed: DataFrame, of_block: DataFrame, *carried: str) -> DataFrame:
    """Every row of the blocks with its leaf, its tree's root and its proof, and what its block carries."""
    upper = of_block.select(F.col("tree").alias("t"), F.col("block").alias("b"), "root", "steps", *carried)
    met = packed.join(upper, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b")))
    ids = F.sequence(F.lit(0), F.size("levels") - 1)

    def steps(i: Column) -> Column:
        def step(level: Column) -> Column:
            nodes = F.element_at("levels", level + 1)
            at = F.floor(i / F.pow(F.lit(FANOUT), level)).cast("int")
            place = at % FANOUT
            left = F.slice(nodes, at - place + 1, place)
            right = F.slice(nodes, at + 2, F.lit(FANOUT - 1) - place)
            return F.struct(_joined(left).alias("left"), _joined(right).alias("right"))

        return F.transform(F.slice(ids, F.lit(1), F.size("levels") - 1), step)

    each = F.transform("rows", lambda r, i: F.struct(r["row"].alias("row"), r["leaf"].alias("leaf"), steps(i).alias("own")))
    out = met.select("root", "steps", *carried, F.explode(each).alias("r"))
    return out.select("r.row", "r.leaf", "root", F.concat("r.own", "steps").alias("proof"), *carried)


def sql() -> str:
    """The query's result in SQL: the same trees, level by level."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]

    def leaf(text: str) -> str:
        parts = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in fields]
        return "sha256(" + " || ".join(f"CASE WHEN {p} IS NULL THEN '-' ELSE strlen({p}) || ':' || {p} END" for p in parts) + ")"

    shift = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    octets = "list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {shift}), 4294967295::BIGINT)"

    def tree(name: str, leaves: str) -> str:
        run = "OVER (PARTITION BY tree, level, pos // 3 ORDER BY pos ROWS BETWEEN"
        return f"""
        {name}_nodes(tree, level, pos, n, h) AS (
            SELECT tree, 0, pos, count(*) OVER (PARTITION BY tree), leaf FROM {leaves}
            UNION ALL
            SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
            FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, pos // 3, n
        ),
        {name}_steps AS (
            SELECT tree, level, pos, n, h,
                coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM {name}_nodes
        ),
        {name}_folds(id, tree, pos, level, h, proof) AS (
            SELECT id, tree, pos, 0, changed, proof FROM {leaves}
            UNION ALL
            SELECT f.id, f.tree, f.pos // 3, f.level + 1, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
            FROM {name}_folds f JOIN {name}_steps s
                ON s.tree IS NOT DISTINCT FROM f.tree AND s.level = f.level AND s.pos = f.pos AND s.n > 1
        ),
        {name}_roots AS (SELECT tree, h FROM {name}_nodes WHERE n = 1),
        {name}_ends AS (SELECT id, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM {name}_folds GROUP BY id)"""

    plain = leaf("text")
    return f"""
    WITH RECURSIVE docs AS (SELECT *, CAST(doc_id AS VARCHAR) AS k FROM documents),
    told AS (SELECT *, {plain} AS leaf, {leaf("replace(text, chr(10), '')")} AS cut, {crc} % 2 = 0 AS hit FROM docs),
    leaves AS (
        SELECT row_number() OVER () AS id, doc_id, source AS tree, leaf, CASE WHEN hit THEN cut ELSE leaf END AS changed, '' AS proof,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
        FROM told
    ),{tree("low", "leaves")},
    tops AS (SELECT row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, tree AS source, h AS leaf FROM low_roots),
    upper_leaves AS (
        SELECT l.id, 0 AS tree, t.pos, e.h AS changed, e.proof, NULL AS leaf
        FROM low_ends e JOIN leaves l USING (id) JOIN tops t ON t.source IS NOT DISTINCT FROM l.tree
    ),
    top_nodes(level, pos, n, h) AS (
        SELECT 0, pos, count(*) OVER (), leaf FROM tops
        UNION ALL
        SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top_nodes WHERE n > 1 GROUP BY level, pos // 3, n
    ),
    top_steps AS (
        SELECT level, pos, n,
            coalesce(string_agg(h, '') OVER (PARTITION BY level, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(h, '') OVER (PARTITION BY level, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM top_nodes
    ),
    top_folds(id, pos, level, h, proof) AS (
        SELECT id, pos, 0, changed, proof FROM upper_leaves
        UNION ALL
        SELECT f.id, f.pos // 3, f.level + 1, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
        FROM top_folds f JOIN top_steps s ON s.level = f.level AND s.pos = f.pos AND s.n > 1
    ),
    ends AS (SELECT id, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM top_folds GROUP BY id),
    root AS (SELECT h FROM top_nodes WHERE n = 1)
    SELECT l.doc_id, l.leaf, s.h AS subroot, root.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
    FROM leaves l JOIN ends e USING (id) JOIN low_roots s ON s.tree IS NOT DISTINCT FROM l.tree, root
    """
