"""A Merkle manifest of a dataset: levels of nodes as DataFrames, and a proof for every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .numbering import numbered

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_PROOF = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of values joined: each `-` if null, else its UTF-8 byte count, a colon, the value."""
    said = (F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values)
    return F.sha2(F.concat(*said), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give: the siblings of each level put around the digest and hashed."""
    return F.aggregate(proof, leaf, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """(levels of parents, from the lowest; tops) of nodes (tree, idx, n, node, and what a leaf carries).

    A parent row is (tree, idx, n, node, kids): its children, `fanout` at most, in their order. Trees go on as long
    as they have several nodes; tops are (tree, node, height).
    """
    levels, tops, height = [], [], 0
    widest = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        tops.append(nodes.where("n = 1").select("tree", "node", F.lit(height).alias("height")))
        if widest <= 1:
            break
        carried = [c for c in nodes.columns if c not in ("tree", "n", "kids", "idx")]
        grouped = nodes.where("n > 1").groupBy("tree", F.expr(f"idx div {fanout}").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"))
        up = grouped.agg(F.sort_array(F.collect_list(F.struct("idx", *carried))).alias("kids"))
        nodes = materialize(up.withColumn("node", F.sha2(F.array_join("kids.node", ""), 256)))
        levels.append(nodes)
        widest, height = -(-widest // fanout), height + 1
    found = tops[0]
    for t in tops[1:]:
        found = found.unionByName(t)
    return levels, found


def _descend(levels: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """(proof, said of the tree, the leaf's carried columns) of all leaves that have a parent.

    From the root's level down, every level is joined with its nodes' proofs on (tree, idx), and each child's
    siblings are put before them: a join has a third of the rows of the one below it, and leaves meet no join. tops
    are (tree, height, proof, and what is said of a tree).
    """
    said = [c for c in tops.columns if c not in ("height", "proof")]
    known = None
    for height in range(len(levels), 0, -1):
        ended = tops.where(F.col("height") == height).select(*said, F.lit(0).cast("long").alias("idx"), "proof")
        known = ended if known is None else known.unionByName(ended)
        rows = levels[height - 1].select("tree", "idx", "kids").join(known, ["tree", "idx"])
        rows = rows.select(*said, "proof", "kids", F.posexplode("kids").alias("at", "kid"))
        left, right = F.array_join(F.expr("slice(kids.node, 1, at)"), ""), F.array_join(F.expr("slice(kids.node, at + 2, size(kids))"), "")
        own = [F.col(f"kid.{c}") for c in carried] if height == 1 else []
        known = rows.select(*said, F.col("kid.idx").alias("idx"), F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "proof").alias("proof"), *own)
    return known


def manifest(leaves: DataFrame, tree: str = "source", order: tuple[str, ...] = ("doc_id", "leaf"), fanout: int = 3) -> DataFrame:
    """`leaves` (leaf, the column `tree`, what else there is) with subroot, root and proof.

    The leaves of each tree, in `order`, are numbered; runs of `fanout` consecutive nodes (the last run may be shorter,
    even one node) become their hash, level by level, until one node, the subroot, remains; a lone leaf is its own.
    The subroots in order of `tree` (null first, then by bytes) give the root likewise. `proof` has a (left, right)
    for each level up to the root: the digests of a node's siblings before and behind it, joined; with `folded` it
    gives the root again. A tree of any size is spread over all tasks; no task or driver holds more than a run.

    Repeated rows are leaves each; of equal ones it does not matter which comes first. Null keys come first. An empty
    table gives no rows. Columns must not be named tree, tree_key, idx, n, node, kids, height, at, kid, tie or part.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-"))  # "-" comes before "="
    rows = numbered(leaves.withColumn("tree_key", key), ["tree_key"], [F.col(c).asc_nulls_first() for c in order])
    nodes = rows.withColumnRenamed("tree_key", "tree").withColumn("node", F.col("leaf"))
    carried = [c for c in nodes.columns if c not in ("tree", "idx", "n", "node")]
    levels, tops = _climb(nodes, fanout)
    forest = numbered(tops.withColumnRenamed("tree", "name"), [], [F.col("name")]).withColumn("tree", F.lit(0))
    upper, top = _climb(forest.select("tree", "idx", "n", "node", "name", "height"), fanout)
    top = top.select("tree", "height", F.col("node").alias("root"), F.expr(f"cast(array() as {_PROOF})").alias("proof"))
    if upper:
        subs = _descend(upper, top, ["node", "name", "height"]).select(F.col("name").alias("tree"), "height", "proof", F.col("node").alias("subroot"), "root")
    else:  # one tree at most: its subroot is the root
        subs = forest.select(F.col("name").alias("tree"), "height", F.expr(f"cast(array() as {_PROOF})").alias("proof"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    subs = materialize(subs)
    alone = nodes.where("n = 1").join(subs.where("height = 0"), "tree").select(*carried, "subroot", "root", "proof")
    found = alone
    if levels:
        found = alone.unionByName(_descend(levels, subs, carried).select(*carried, "subroot", "root", "proof"))
    return found


def audit(docs: DataFrame, tampered: Column, altered: dict[str, Column], fanout: int = 3) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each row's proof, checked on its tampered self.

    Where `tampered` holds (null: it does not), the leaf is hashed anew with the columns in `altered` replaced; the
    proof is the original one. Nulls in any column are hashed as such; extra columns are ignored.
    """
    own = {f: F.col(f) for f in FIELDS}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), digest(*own.values()).alias("leaf"), F.when(tampered, digest(*(own | altered).values())).alias("other"))
    found = manifest(rows, "source", ("doc_id", "leaf"), fanout)
    shown = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("proof")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
