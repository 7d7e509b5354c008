"""Merkle manifest of a dataset: hash trees over its rows, stored as blocks in van Emde Boas layout.

Rows are leaves; per group (a language) they ascend by key, and the group's tree pairs neighbours up to one
subroot; the subroots, ordered by group, are the leaves of one more tree, whose root names the dataset.

A tree is stored in aligned blocks of ``HEIGHT`` levels above their leaves: 2^HEIGHT leaves and all nodes
over them are one array, laid out by splitting the block's levels in half again and again (the top half's
subtree first, then each bottom subtree, every one laid out alike).  ``address`` computes a node's place in
that array from the block's levels, the node's depth and its index; construction writes through it and
sibling retrieval reads through it, so a path touches few distinct pages of an array whatever the page size.
The roots of blocks are the leaves of the next tier, until a group has one block.  Only the last block of a
tier may be short; absent nodes are zeros.

Spark hashes texts where they lie; digests alone are sorted (``with_position``: range slices, so one group may
hold all rows) and shuffled by (group, block), 2^HEIGHT to a task's group.  Paths come top down: a block's
path to the root is appended to its children's paths inside the block.  Every tier is a written table.

Defined results: a null value hashes as ``-``; a null group is a group and comes first; null keys come first;
equal keys are ordered by their leaf's digest; repeated rows are leaves of their own; an empty table gives no
rows; extra columns are left out of everything but the leaves that name them.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flankwear.llm.common import stage
from flankwear.operators.ordering import with_position

HEIGHT = 10            # levels of a block above its leaves: 1,024 leaves, 64 KB of nodes
BLOCK = "grp string, block long, n long, levels int, nodes binary, top string"
PATH = "sides string, siblings string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Digest of a row's values: ``-`` for null, else byte count, colon and value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]), 256)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places, in a block of ``levels`` levels, of the nodes ``index`` at ``depth`` (the block's root has depth 0)."""
    if levels == 1:
        return np.zeros_like(index)
    above = levels // 2
    below = levels - above
    if depth < above:
        return address(above, depth, index)
    rest = depth - above
    subtree = index >> rest
    return (1 << above) - 1 + subtree * ((1 << below) - 1) + address(below, rest, index & ((1 << rest) - 1))


def _widths(n: int, levels: int) -> list[int]:
    """Nodes at each depth over ``n`` leaves at the deepest one."""
    return [-(-n >> (levels - 1 - d)) if d < levels - 1 else n for d in range(levels)]


def build_block(leaves: Sequence[str], levels: int) -> bytes:
    """All nodes over ``leaves`` in van Emde Boas order, 32 bytes each."""
    nodes = np.zeros(((1 << levels) - 1, 32), np.uint8)
    row = list(leaves)
    for depth in range(levels - 1, -1, -1):
        nodes[address(levels, depth, np.arange(len(row)))] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
        row = [digest(*row[k:k + 2]) for k in range(0, len(row), 2)]
    return nodes.tobytes()


def block_paths(nodes: bytes, levels: int, n: int, index: np.ndarray) -> tuple[list[str], list[str]]:
    """Per leaf the sides on which its siblings stand (L, R, or N for none), leaf first, and the siblings' digests."""
    table = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    sides, siblings = [""] * len(index), [""] * len(index)
    widths = _widths(n, levels)
    for depth in range(levels - 1, 0, -1):
        at = index >> (levels - 1 - depth)
        other = at ^ 1
        found = table[address(levels, depth, np.where(other < widths[depth], other, 0))]
        for k, (a, o) in enumerate(zip(at.tolist(), other.tolist())):
            if o >= widths[depth]:
                sides[k] += "N"
            else:
                sides[k] += "L" if o < a else "R"
                siblings[k] += found[k].tobytes().hex()
    return sides, siblings


def fold(leaf: str, sides: str, siblings: str) -> str:
    """Root recomputed from a leaf and its siblings."""
    at = 0
    for side in sides:
        if side == "N":
            leaf = digest(leaf)
            continue
        other, at = siblings[at:at + 64], at + 64
        leaf = digest(other, leaf) if side == "L" else digest(leaf, other)
    return leaf


def _tier(nodes: DataFrame, height: int) -> DataFrame:
    """Blocks over nodes (grp, pos, n, digest): n becomes the group's number of blocks; ``top`` is the block's root."""
    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n = int(rows["n"].iloc[0])
        m = len(rows)
        levels = (height if n > 1 << height else (n - 1).bit_length()) + 1
        data = build_block(rows["digest"].tolist(), levels)
        return pd.DataFrame({"grp": [key[0]], "block": [int(key[1])], "n": [-(-n >> height)], "levels": [levels],
                             "nodes": [data], "top": [data[:32].hex()]}).assign(m=m)[
                                 ["grp", "block", "n", "levels", "nodes", "top", "m"]]

    cut = F.shiftright(F.col("pos"), height).alias("block")
    return nodes.select("grp", "pos", "n", "digest", cut).groupBy("grp", "block").applyInPandas(block, BLOCK + ", m int")


def _tiers(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Stored tiers of the trees over nodes (grp, pos, n, digest), leaves' blocks first, until every group has one block.

    A group that ends in an earlier tier takes no part in later ones."""
    out = [stage(_tier(nodes, height))]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        roots = out[-1].where(F.col("n") > 1).select("grp", F.col("block").alias("pos"), "n", F.col("top").alias("digest"))
        out.append(stage(_tier(roots, height)))
    return out


def _descend(children: DataFrame, blocks: DataFrame, height: int, keep: Sequence[str]) -> DataFrame:
    """Children (grp, pos, the columns ``keep``) with their paths: inside their block, then their block's own path.

    ``blocks`` holds the blocks with their paths and roots."""
    types = {f.name: f.dataType.simpleString() for f in children.schema}
    schema = f"grp string, pos long, {''.join(f'{c} {types[c]}, ' for c in keep)}{PATH}, subroot string, root string"
    names = ["grp", "pos", *keep, "sides", "siblings", "subroot", "root"]

    def paths(rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or block.empty:
            return pd.DataFrame({c: [] for c in names})
        b = block.iloc[0]
        index = rows["pos"].to_numpy(np.int64) & ((1 << height) - 1)
        sides, siblings = block_paths(b["nodes"], int(b["levels"]), int(b["m"]), index)
        return rows.assign(sides=[s + b["sides"] for s in sides], siblings=[s + b["siblings"] for s in siblings],
                           subroot=b["subroot"], root=b["root"])[names]

    cut = F.shiftright(F.col("pos"), height).alias("block")
    left = children.select("grp", "pos", *keep, cut).groupBy("grp", "block")
    return left.cogroup(blocks.groupBy("grp", "block")).applyInPandas(paths, schema)


def manifest(rows: DataFrame, group: str, key: str, columns: Sequence[str], height: int = HEIGHT,
             extra: dict[str, Column] | None = None) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """The dataset's trees: its leaves (grp, pos, n, key, digest and ``extra`` columns), the tiers of the groups' trees
    and those of the tree over subroots.  grp is ``0`` for a null group, else ``1`` before its name."""
    c = F.col(group).cast("string")
    base = rows.select(F.coalesce(F.concat(F.lit("1"), c), F.lit("0")).alias("grp"), F.col(key).alias("key"),
                       leaf_digest([F.col(x) for x in columns]).alias("digest"), *[v.alias(k) for k, v in (extra or {}).items()])
    leaves = stage(with_position(base, ["grp"], ["key", "digest"], "pos", "n"))
    tiers = _tiers(leaves, height)
    roots = _ends(tiers).select(F.lit("").alias("all"), "grp", F.col("top").alias("digest"))
    over = stage(with_position(roots, ["all"], ["grp"], "pos", "n"))
    forest = over.select(F.lit("").alias("grp"), "pos", "n", "digest", F.col("grp").alias("of"))
    return leaves, tiers, [forest, *_tiers(forest, height)]


def _ends(tiers: list[DataFrame]) -> DataFrame:
    """The one top block of every group."""
    out = tiers[0].where("n = 1")
    for t in tiers[1:]:
        out = out.unionByName(t.where("n = 1"))
    return out


def proofs(leaves: DataFrame, tiers: list[DataFrame], forest: list[DataFrame], height: int = HEIGHT,
           keep: Sequence[str] = ("key", "digest")) -> DataFrame:
    """Leaves with their paths to the root (sides and siblings), subroot and root, read from the stored blocks."""
    subroots, *upper = forest
    none = [F.lit("").alias("sides"), F.lit("").alias("siblings")]
    # the tree over subroots; a path's subroot is filled in below it
    known = upper[-1].select("grp", "block", "levels", "nodes", "m", *none, F.lit("").alias("subroot"), F.col("top").alias("root"))
    for below in upper[-2::-1]:
        known = _with_paths(below, known, height)
    tops = _descend(subroots, known, height, ["of", "digest"]).select(
        F.col("of").alias("grp"), "sides", "siblings", F.col("digest").alias("subroot"), "root")
    known = None
    for t in reversed(tiers):
        ends = t.where("n = 1").join(tops, "grp").select("grp", "block", "levels", "nodes", "m", "sides", "siblings", "subroot", "root")
        known = ends if known is None else ends.unionByName(_with_paths(t.where("n > 1"), known, height))
    return _descend(leaves, known, height, list(keep))


def _with_paths(tier: DataFrame, parents: DataFrame, height: int) -> DataFrame:
    """A tier's blocks with their paths, from those of the tier above."""
    kids = tier.select("grp", F.col("block").alias("pos"), "levels", "nodes", "m")
    return stage(_descend(kids, parents, height, ["levels", "nodes", "m"]).withColumnRenamed("pos", "block"))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def tamper_check(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Every document's leaf, subroot, root and proof digest; and the root folded from its leaf after tampering
    (n_chars + 1 where 7 divides the CRC-32 of the id's text) with the stored siblings, equal to the root or not."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    forged = leaf_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    trees = manifest(docs, "lang", "doc_id", COLUMNS, height, {"forged": F.when(hit, forged)})
    rows = proofs(*trees, height, keep=("key", "digest", "forged"))

    def folded(batches):
        for b in batches:
            leaf = b["forged"].where(b["forged"].notna(), b["digest"])
            ends = [fold(x, s, p) for x, s, p in zip(leaf, b["sides"], b["siblings"])]
            yield b[["key", "digest", "subroot", "root"]].assign(proof=[digest(p) for p in b["siblings"]], folded_root=ends)

    key = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInPandas(folded, f"key {key}, digest string, subroot string, root string, proof string, folded_root string")
    return out.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
                      F.col("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle_sql() -> str:
    """``tamper_check`` in DuckDB text: levels by recursion, CRC-32 from its polynomial."""
    def leaf(n_chars: str) -> str:
        texts = [f"({n_chars if c == 'n_chars' else c})::VARCHAR" for c in COLUMNS]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({t})) || ':' || {t}, '-')" for t in texts) + ")"
    return f"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
crc AS (SELECT doc_id AS id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
               lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS crc FROM (SELECT DISTINCT doc_id FROM documents), tab),
d AS (SELECT row_number() OVER () AS r, d.doc_id, coalesce('1' || lang, '0') AS g, {leaf("n_chars")} AS leaf,
             CASE WHEN crc % 7 = 0 THEN {leaf("n_chars + 1")} END AS forged
      FROM documents d LEFT JOIN crc ON id = d.doc_id),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM d),
node AS (
  SELECT 0 AS l, g, p, leaf AS h, n FROM p
  UNION ALL SELECT l + 1, g, p // 2, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 1) // 2 FROM node WHERE n > 1 GROUP BY l, g, p // 2),
s AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS p, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (
  SELECT 0 AS l, p, h, n FROM s
  UNION ALL SELECT l + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY l, p // 2),
steps AS (
  SELECT p.r, 0 AS t, a.l, a.p % 2 AS odd, b.h FROM p JOIN node a ON a.g = p.g AND a.n > 1 AND a.p = p.p >> a.l
    LEFT JOIN node b ON b.g = a.g AND b.l = a.l AND b.p = xor(a.p, 1)
  UNION ALL SELECT p.r, 1, a.l, a.p % 2, b.h FROM p JOIN s ON s.g = p.g JOIN top a ON a.n > 1 AND a.p = s.p >> a.l
    LEFT JOIN top b ON b.l = a.l AND b.p = xor(a.p, 1)),
path AS (SELECT r, string_agg(h, '' ORDER BY t, l) AS siblings,
                list(CASE WHEN h IS NULL THEN 'N' WHEN odd = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY t, l) AS steps FROM steps GROUP BY r),
o AS (SELECT p.doc_id, p.leaf, s.h AS subroot, top.h AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
             list_reduce(list_prepend(coalesce(forged, leaf), coalesce(steps, [])), lambda c, x: sha256(CASE x[1]
               WHEN 'N' THEN c WHEN 'L' THEN x[2:] || c ELSE c || x[2:] END)) AS folded_root
      FROM p JOIN s ON s.g = p.g JOIN top ON top.n = 1 LEFT JOIN path ON path.r = p.r)
SELECT *, folded_root = root AS verified FROM o"""
