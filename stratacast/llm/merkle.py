"""A Merkle manifest of a table, with inclusion proofs, by checkpoint-and-recompute.

Every row is a leaf: H of its fields, each `-` if null, else `<UTF-8 bytes>:<value>`.
Per group (here `lang`) leaves ascend by a key; while several nodes remain, every two
consecutive ones become H(left || right) (hex text); a run of one at the end of a level
becomes H(itself); a lone node is the group's root. The group roots, in group order,
make the top tree the same way.

Nodes are kept as their 32 bytes and turned into hex text only where they are hashed or
returned. Only every `C`-th level is written. A stored level is made from the one below it by
aligned blocks of 2**C nodes: one group of at most 2**C rows rebuilds the C levels in
between (higher-order array functions, no Python) and keeps only its top node. Proofs
come from the same blocks: each block regenerates its interior nodes from the stored
descendants, emits the siblings of each of its nodes level by level and drops them.
No step holds more than 2**C nodes in one row, so a group of any size is spread over
as many tasks as its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacast.llm.common import Scratch

#: Levels between two stored ones; a block holds 2**LEVELS nodes.
LEVELS = 4


def field(value: Column) -> Column:
    """`-` for null, else byte count, `:`, value (integers in decimal)."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """H of the concatenated text, kept as its 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def text(node: Column) -> Column:
    """A node as the lowercase hex text that enters its parent's H."""
    return F.lower(F.hex(node))


def _group_key(column: Column) -> Column:
    """A non-null key per group value; null and every string stay apart."""
    return F.when(column.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), column))


def _height(count: Column) -> Column:
    """Levels above the leaves: ceil(log2(count)), 0 for one node."""
    return F.when(count > 1, F.length(F.bin(count - 1))).otherwise(F.lit(0))


def _up(level: Column) -> Column:
    """The level above: H(pair) for each pair, H(node) for a run of one."""
    return F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(level) / 2).cast("int") - 1),
        lambda k: digest(text(F.get(level, 2 * k)), F.coalesce(text(F.get(level, 2 * k + 1)), F.lit(""))),
    )


def _blocks(nodes: DataFrame, base: int) -> DataFrame:
    """One row per aligned block of `nodes` (grp, idx, h, height) at level `base`.

    Returns grp, block, height, levels: the node arrays of levels base .. base+C of the
    block, a level above the group's height left as it is.
    """
    block = nodes.groupBy("grp", F.shiftright("idx", LEVELS).alias("block")).agg(
        F.first("height").alias("height"),
        F.sort_array(F.collect_list(F.struct("idx", "h"))).getField("h").alias("l0"),
    )
    arrays = [F.col("l0")]
    for step in range(LEVELS):
        arrays.append(F.when(F.col("height") > base + step, _up(arrays[-1])).otherwise(arrays[-1]))
    return block.select("grp", "block", "height", F.array(*arrays).alias("levels"))


def _siblings(blocks: DataFrame, base: int) -> DataFrame:
    """grp, idx (at level `base`), path: per level of the block, (right, sibling) of the node."""
    expanded = blocks.select(
        "grp", "block", "height", "levels", F.posexplode(F.col("levels")[0]).alias("at", "h")
    )
    def above(t: Column) -> Column:
        return (F.col("at") / F.pow(F.lit(2), t)).cast("int")

    steps = F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)),
        lambda t: F.struct(
            (base + t < F.col("height")).alias("live"),
            (above(t) % 2 == 1).alias("right"),
            F.get(F.get(F.col("levels"), t), above(t).bitwiseXOR(F.lit(1))).alias("sibling"),
        ),
    )
    path = F.filter(steps, lambda s: s["live"])
    return expanded.select(
        "grp",
        (F.shiftleft("block", LEVELS) + F.col("at")).alias("idx"),
        F.transform(path, lambda s: F.struct(s["right"].alias("right"), s["sibling"].alias("sibling"))).alias("path"),
    )


def tree(nodes: DataFrame, scratch: Scratch, label: str) -> tuple[DataFrame, DataFrame]:
    """Roots and proofs of the trees of `nodes` (grp, idx, h), idx gapless from 0 per grp.

    Returns (grp, root) and (grp, idx, path), path the (right, sibling) steps from the
    node to its group's root, sibling null where the node's run has no other member.
    """
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n")).select("grp", _height(F.col("n")).alias("height"))
    sizes = scratch.save(sizes, f"{label}-sizes")
    top = sizes.agg(F.max("height")).first()[0] or 0
    level = scratch.save(nodes.join(sizes, "grp"), f"{label}-0")
    paths, roots = [], []
    base = 0
    while True:
        roots.append(level.filter(F.col("height") <= base).select("grp", F.col("h").alias("root")))
        blocks = _blocks(level, base)
        paths.append(_siblings(blocks, base).withColumn("base", F.lit(base)))
        if base >= top:
            break
        above = blocks.select(
            "grp", F.col("block").alias("idx"), F.element_at("levels", -1)[0].alias("h"), "height"
        ).filter(F.col("height") > base)
        base += LEVELS
        level = scratch.save(above, f"{label}-{base}")
    root = roots[0]
    for more in roots[1:]:
        root = root.unionByName(more)
    parts = paths[0].select("grp", "idx", F.lit(0).alias("base"), "path")
    for part in paths[1:]:
        parts = parts.unionByName(part.select("grp", "idx", "base", "path"))
    # written once (32-byte siblings): the proofs below read it instead of the plans
    # of every level, which keeps the driver's plans small
    parts = scratch.save(parts, f"{label}-paths")
    wanted = nodes.select("grp", "idx").join(sizes, "grp").select(
        "grp", F.col("idx").alias("leaf"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.col("height") - 1, F.lit(0)), F.lit(LEVELS))).alias("wbase"),
    )
    joined = wanted.join(parts, (wanted.grp == parts.grp) & (parts.idx == F.expr("shiftright(leaf, wbase)"))
                         & (F.col("wbase") == parts.base)).select(wanted.grp, "leaf", parts.base, "path")
    proofs = joined.groupBy("grp", "leaf").agg(
        F.flatten(F.sort_array(F.collect_list(F.struct("base", "path"))).getField("path")).alias("path")
    )
    return root, proofs.withColumnRenamed("leaf", "idx")


def numbered(frame: DataFrame, group: str, order: list, scratch: Scratch, name: str) -> DataFrame:
    """`frame` with idx, its place from 0 within `group` by `order`, gapless.

    One range-partitioned sort of all rows, then offsets from a table of counts per
    group and partition: a group of any size spreads over many tasks, never one.
    """
    sorted_rows = frame.orderBy(F.col(group), *order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_mid"))
    sorted_rows = scratch.save(sorted_rows, f"{name}-sorted")
    counts = sorted_rows.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    out = sorted_rows.join(counts, [group, "_part"]).withColumn("idx", F.col("_offset") + F.col("_mid") - F.col("_first"))
    return out.drop("_part", "_mid", "_first", "_offset")


def _fold(start: Column, path: Column) -> Column:
    """The root reached from `start` by the steps of `path`."""
    return F.aggregate(
        path, start,
        lambda acc, s: F.when(s["sibling"].isNull(), digest(text(acc)))
        .when(s["right"], digest(text(s["sibling"]), text(acc)))
        .otherwise(digest(text(acc), text(s["sibling"]))),
    )


def manifest(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Leaf, subroot, root, proof and a tamper check for every row of `docs`.

    Columns read: doc_id, source, lang, n_chars, text; other columns are ignored. Leaves
    of one lang ascend by doc_id (nulls first), then by leaf; rows that repeat give equal
    leaves side by side. Langs order null first, then by UTF-8 bytes. A row is tampered
    where 7 divides the unsigned crc32 of its decimal doc_id (null doc_id: never): n_chars
    + 1, a null n_chars stays null. Returns doc_id, lang, leaf, subroot, root,
    proof_sha256 (H of all siblings, leaf level first, each level left to right; H of ''
    without siblings), tampered, folded_root (the root recomputed from the tampered leaf
    and the original siblings) and verified (folded_root = root). An empty table gives
    no rows.
    """
    def leaf(n_chars: Column) -> Column:
        return digest(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(n_chars),
                      field(F.col("text")))

    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        _group_key(F.col("lang").cast("string")).alias("grp"),
        leaf(F.col("n_chars")).alias("leaf"),
        tampered.alias("tampered"),
        leaf(F.col("n_chars") + 1).alias("changed"),
    )
    rows = numbered(rows, "grp", [F.col("doc_id").asc_nulls_first(), "leaf", "changed"], scratch, "leaves")
    sub_roots, sub_proofs = tree(rows.select("grp", "idx", F.col("leaf").alias("h")), scratch, "lang")
    subs = sub_roots.select(F.lit("t").alias("top"), F.col("grp").alias("lang_grp"), F.col("root").alias("subroot"))
    subs = numbered(subs, "top", [F.col("lang_grp").cast("binary")], scratch, "subroots").withColumnRenamed("idx", "place")
    roots, top_proofs = tree(subs.select(F.col("top").alias("grp"), F.col("place").alias("idx"),
                                         F.col("subroot").alias("h")), scratch, "top")
    upper = (
        subs.join(top_proofs.withColumnRenamed("idx", "place").withColumnRenamed("grp", "top"), ["top", "place"])
        .join(roots.withColumnRenamed("grp", "top"), "top")
        .select("lang_grp", "subroot", "root", F.col("path").alias("upper"))
    )
    joined = (rows.join(sub_proofs.withColumnRenamed("path", "lower"), ["grp", "idx"], "left")
              .join(upper.withColumnRenamed("lang_grp", "grp"), "grp"))
    path = F.concat(F.coalesce(F.col("lower"), F.array().cast(joined.schema["upper"].dataType)), F.col("upper"))
    start = F.when(F.col("tampered"), F.col("changed")).otherwise(F.col("leaf"))
    folded = _fold(start, path)
    return joined.select(
        "doc_id", "lang", text(F.col("leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"),
        text(F.col("root")).alias("root"),
        F.sha2(F.array_join(F.transform(path, lambda s: text(s["sibling"])), ""), 256).alias("proof_sha256"),
        "tampered",
        text(folded).alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
    )
