"""Operator 11: Merkle manifest of a dataset, with an inclusion proof for every row.

A row is a leaf: the SHA-256 of its fields. The leaves of a group (a source) ascend by id; runs of
``RUN`` consecutive digests are hashed to their parent until one is left, the subroot; subroots in group
order are folded to the root in the same way.

Concatenated-level strings: an aligned block of ``BLOCK`` digests keeps each of its levels as one hex
string. Parents are hashes of fixed-width substrings of the level below, a node's siblings the substrings
flanking it in its run. Blocks become the digests of the next, ``BLOCK`` times shorter stage; what is left
of every group becomes the one group of the subroots. Proofs are handed down the same way, one row per
block, and reach the leaves inside their block: no row is joined to more than its own block, and no block
holds more than ``BLOCK`` digests whatever the size of its group.

Defined results: a null field is hashed as ``-``, an empty one as ``0:``; null groups are one group, the
first; null ids come first in their group and are never tampered with; rows with one id are ordered by
leaf, and equal rows are equal leaves side by side; texts of any length are hashed whole; other columns,
whatever their names, are not read; an empty table has no rows and no root.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duocount.operators.ranges import group_key, number_rows
from duocount.session import cut_lineage

RUN, WIDTH = 16, 64                 # digests hashed into one; hex characters of a digest
BLOCK = RUN * RUN                   # digests of a block: two levels
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<l:string,r:string>>"
RESULT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")


def digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each as its UTF-8 length, a colon and its text, or ``-``."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
                             for t in texts]), 256)


def _parents(level: str) -> str:
    """SQL: the level above, from the runs of a level."""
    run = RUN * WIDTH
    return (f"array_join(transform(sequence(0, cast((length({level}) - 1) div {run} as int)), "
            f"i -> sha2(substring({level}, i * {run} + 1, {run}), 256)), '')")


def _flanks(level: str, i: str) -> str:
    """SQL: the siblings left and right of digest ``i`` of a level, within its run."""
    at = f"({i} % {RUN})"
    first = f"({i} - {at}) * {WIDTH} + 1"
    return (f"named_struct('l', substring({level}, {first}, {at} * {WIDTH}), "
            f"'r', substring({level}, ({i} + 1) * {WIDTH} + 1, ({RUN - 1} - {at}) * {WIDTH}))")


def _own_path(i: str) -> str:
    """SQL: flanks of digest ``i`` on the levels that its block folds."""
    parent = f"cast({i} div {RUN} as int)"
    return (f"case depth when 2 then array({_flanks('l0', i)}, {_flanks('l1', parent)}) "
            f"when 1 then array({_flanks('l0', i)}) else cast(array() as {PATH}) end")


def _blocks(nodes: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Nodes (_g, pos, total, digest, payload) by block: level strings, what they fold to, payload by position."""
    cell = F.array_sort(F.collect_list(F.struct("pos", "digest", *payload)))
    out = nodes.groupBy("_g", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.first("total").alias("total"), cell.alias("cell"))
    out = out.select("_g", "block", "total", F.expr("array_join(transform(cell, x -> x.digest), '')").alias("l0"),
                     F.expr(f"case when total > {RUN} then 2 when total > 1 then 1 else 0 end").alias("depth"),
                     *[F.col("cell").getField(c).alias(c) for c in payload])
    out = out.withColumn("l1", F.expr(f"case when depth > 0 then {_parents('l0')} end"))
    out = out.withColumn("top", F.expr(f"case depth when 2 then {_parents('l1')} when 1 then l1 else l0 end"))
    return cut_lineage(out, "blocks")


def _climb(nodes: DataFrame, payload: Sequence[str]) -> list[DataFrame]:
    """The stages of a forest: blocks, blocks of their digests, and so on until every group is one block."""
    stages = [_blocks(nodes, payload)]
    left = stages[0].agg(F.max("total")).first()[0]
    while left is not None and left > BLOCK:
        left = -(-left // BLOCK)
        up = stages[-1].select("_g", F.col("block").alias("pos"), F.expr(f"ceil(total / {BLOCK})").alias("total"),
                               F.col("top").alias("digest"))
        stages.append(_blocks(up, []))
    return stages


def _descend(stages: list[DataFrame], above: DataFrame) -> DataFrame:
    """Lowest blocks with ``above`` (_g, path, ...): the path of a group's root extended down to each block."""
    others = [c for c in above.columns if c not in ("_g", "path")]
    paths = above.withColumn("block", F.lit(0).cast("long"))
    for stage in reversed(stages[1:]):
        here = stage.join(paths, ["_g", "block"]).withColumn("n", F.expr(f"cast(length(l0) div {WIDTH} as int)"))
        nodes = F.explode(F.expr(f"transform(sequence(0, n - 1), i -> named_struct('i', i, 'path', concat({_own_path('i')}, path)))"))
        paths = cut_lineage(here.select("_g", (F.col("block") * BLOCK).alias("first"), *others, nodes.alias("x")).select(
            "_g", (F.col("first") + F.col("x.i")).alias("block"), F.col("x.path").alias("path"), *others), "paths")
    return stages[0].join(paths, ["_g", "block"])


def manifest(rows: DataFrame, group: str, row_id: str, leaf: Column, changed: Column) -> DataFrame:
    """(row_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``leaf`` is the row's digest, ``changed`` the digest of the row to be checked against the manifest (null:
    the row as it was). ``folded_root`` folds that with the row's siblings; ``verified`` says whether it is the root."""
    spark = rows.sparkSession
    leaves = rows.select(F.col(group).alias("_group"), F.col(row_id).alias("_id"), leaf.alias("digest"), changed.alias("_changed"),
                         F.monotonically_increasing_id().alias("_tie"))
    nodes = number_rows(leaves, ["_group"], ["_id", "digest", "_tie"], "pos", "total").withColumn("_g", group_key(["_group"]))
    trees = _climb(nodes, ["_id", "_changed"])
    roots = trees[-1].where("block = 0").select(F.col("_g._group").alias("_group"), F.col("top").alias("digest"))
    numbered = number_rows(roots, [], ["_group"], "pos", "total").withColumn("_g", group_key([]))
    crown = _climb(numbered, ["_group"])
    root = crown[-1].select("top").first()
    if root is None:
        return spark.createDataFrame([], RESULT.replace("doc_id", row_id, 1))
    start = crown[-1].select("_g", F.expr(f"cast(array() as {PATH})").alias("path"))
    tops = _descend(crown, start).select(F.explode(F.expr(
        f"transform(sequence(0, size(_group) - 1), i -> named_struct('_group', _group[i], 'subroot', substring(l0, i * {WIDTH} + 1, {WIDTH}), "
        f"'path', concat({_own_path('i')}, path)))")).alias("x")).select(
            F.struct(F.col("x._group").alias("_group")).alias("_g"), F.col("x.path").alias("path"), F.col("x.subroot").alias("subroot"))
    low = _descend(trees, cut_lineage(tops, "subroots"))
    proof = "sha2(array_join(transform(p, y -> concat(y.l, y.r)), ''), 256)"
    fold = "aggregate(p, start, (a, y) -> sha2(concat(y.l, a, y.r), 256))".replace(
        "start", f"coalesce(_changed[i], substring(l0, i * {WIDTH} + 1, {WIDTH}))")
    leaf_rows = F.explode(F.expr(
        f"transform(sequence(0, size(_id) - 1), i -> transform(array(concat({_own_path('i')}, path)), p -> named_struct("
        f"'id', _id[i], 'leaf', substring(l0, i * {WIDTH} + 1, {WIDTH}), 'proof', {proof}, 'folded', {fold}))[0])"))
    out = low.select("subroot", leaf_rows.alias("x"))
    return out.select(F.col("x.id").alias(row_id), F.col("x.leaf").alias("leaf"), "subroot", F.lit(root["top"]).alias("root"),
                      F.col("x.proof").alias("proof_sha256"), F.col("x.folded").alias("folded_root"),
                      (F.col("x.folded") == F.lit(root["top"])).alias("verified"))


def document_manifest(docs: DataFrame, every: int = 5) -> DataFrame:
    """The manifest of ``documents`` by source, checked against a copy in which the texts of rows whose
    ``crc32(doc_id)`` ``every`` divides have A-Z in lower case."""
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return manifest(docs, "source", "doc_id", digest(*row, F.col("text")),
                    F.when(hit, digest(*row, F.translate("text", UPPER, LOWER))))
