"""A Merkle manifest of a table: one root for all rows, and a proof for each row, by blocks and a small upper tree.

Rows are leaves of one tree for each group, and the groups' roots are leaves of one tree above. Leaves are numbered by a
range sort and counts of its parts, never in one task. Then come blocks of 2**height consecutive leaves of one group, each
reduced by one task to its root. The upper tree over the blocks' roots is small: the driver builds it and broadcasts each
block's suffix, the siblings from the block's root to the top. Executors finish the rows' proofs and fold them.

The height grows with the count, so that groups of more than one block have 2 * TOP blocks at most. Groups of one block
have no such bound; beyond TOP groups their roots are the leaves of a manifest of their own, and suffixes are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import core

#: Leaves of a block are 2**HEIGHT at least; the driver's tree starts from 2 * TOP nodes at most.
HEIGHT, TOP = 10, 1 << 15
#: Rows of one part of the sort, about.
PART = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a step of a path says of the node's sibling: it is to the right, to the left, or there is none.
RIGHT, LEFT, ALONE = 0, 1, 2
STEP = 33


def parent(left: bytes, right: bytes = b"") -> bytes:
    """The hash of one or two nodes; nodes are hex text."""
    return hashlib.sha256(left + right).hexdigest().encode()


def levels(nodes: list[bytes], height: int | None) -> list[list[bytes]]:
    """All levels from the leaves up: `height` of them above the leaves, or until one node remains."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        low = out[-1]
        out.append([parent(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return out


def steps(tree: list[list[bytes]], at: int) -> list[tuple[int, bytes]]:
    """The siblings of leaf `at`, level by level."""
    out = []
    for level in tree[:-1]:
        other = at ^ 1
        out.append((LEFT if at & 1 else RIGHT, level[other]) if other < len(level) else (ALONE, b""))
        at >>= 1
    return out


def fold(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    for side, sibling in path:
        node = parent(sibling, node) if side == LEFT else parent(node, sibling)
    return node


def spell(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + (bytes.fromhex(x.decode()) if x else bytes(32)) for side, x in path)


def unspell(data: bytes) -> list[tuple[int, bytes]]:
    return [(data[i], b"" if data[i] == ALONE else data[i + 1 : i + STEP].hex().encode()) for i in range(0, len(data), STEP)]


def leaf(fields: list[Column]) -> Column:
    """The hash of a row: of each field `-` if null, else its count of UTF-8 bytes, `:`, and its text."""
    text = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text)), 256)


def numbered(rows: DataFrame, order: tuple[str, ...], total: int) -> DataFrame:
    """rows (g, order ...) with `rank`, from 0 in each g by `order` (nulls first), and `n`, the rows of g."""
    names = rows.columns
    by = [F.col("g"), *(F.col(x).asc_nulls_first() for x in order)]
    sorted_rows = rows.repartitionByRange(core.parts(total, PART), *by).sortWithinPartitions(*by)
    at = names.index("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g, own, i = batch.column(at), [], 0
            changes = pc.indices_nonzero(pc.not_equal(g.slice(1), g.slice(0, len(g) - 1))).to_pylist() if len(g) > 1 else []
            for j in [*(c + 1 for c in changes), len(g)]:
                if g[i].as_py() != last:
                    last, seen = g[i].as_py(), 0
                own.extend(range(seen, seen + j - i))
                seen, i = seen + j - i, j
            yield pa.record_batch([*batch.columns, pa.array([part] * len(g), pa.int32()), pa.array(own, pa.int64())], [*names, "part", "own"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = core.kept(sorted_rows.mapInArrow(run, f"{kinds}, part int, own long"))
    counts = placed.groupBy("part", "g").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("g")
    counts = counts.select("part", "g", (F.sum("c").over(whole.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(whole).alias("n"))
    return placed.join(counts, ["part", "g"]).select(*names, (F.col("before") + F.col("own")).alias("rank"), "n")


def blocks(rows: DataFrame, order: tuple[str, ...], total: int, least: int = HEIGHT, top: int = TOP) -> tuple[DataFrame, int]:
    """A row for each block (g, n, block, root, and every column of rows as an array), and the blocks' height."""
    height = max(least, (-(-total // top) - 1).bit_length())
    names = [x for x in rows.columns if x != "g"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(group: pa.Table) -> pa.Table:
        core.frugal()
        group = group.sort_by("rank").combine_chunks()
        n, block = group["n"][0].as_py(), group["rank"][0].as_py() >> height
        tree = levels([x.hex().encode() for x in group["leaf"].to_pylist()], height if n > 1 << height else None)
        lists = [pa.ListArray.from_arrays(pa.array([0, group.num_rows], pa.int32()), c.chunk(0) if (c := group[x]).num_chunks else c.combine_chunks()) for x in names]
        return pa.table([group["g"].slice(0, 1), pa.array([n], pa.int64()), pa.array([block], pa.int64()), pa.array([bytes.fromhex(tree[-1][0].decode())], pa.binary()), *lists], ["g", "n", "block", "root", *names])

    dealt = numbered(rows, order, total).withColumn("_block", F.shiftright("rank", height))
    schema = ", ".join(["g string, n long, block long, root binary", *(f"{x} array<{kinds[x]}>" for x in names)])
    return core.kept(dealt.groupBy("g", "_block").applyInArrow(lambda _, t: run(t), schema)), height


def upper(spark: SparkSession, made: DataFrame, height: int, least: int = HEIGHT, top: int = TOP) -> DataFrame:
    """(g, block, subroot, root, suffix) of every block; a broadcast where it is small.

    What the driver takes is bounded: the blocks of groups with several (2 * top at most) and, where there are no more
    than `top` groups, a root for each.
    """
    several = made.where(F.col("n") > (1 << height)).select("g", "block", "root")
    found: dict[str, list[tuple[int, bytes]]] = {}
    for g, block, root in several.collect():
        found.setdefault(g, []).append((block, bytes(root).hex().encode()))
    subroots, inner = [], []
    for g, nodes in found.items():
        nodes.sort()
        tree = levels([x for _, x in nodes], None)
        subroots.append((g, bytes.fromhex(tree[-1][0].decode())))
        inner += [(g, block, spell(steps(tree, i))) for i, (block, _) in enumerate(nodes)]
    single = made.where(F.col("n") <= (1 << height)).select("g", "root")
    inner_rows = spark.createDataFrame(inner, "g string, block long, inner binary").unionByName(single.select("g", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("inner")))
    groups = spark.createDataFrame(subroots, "g string, root binary").unionByName(single)
    total = len(subroots) + single.count()
    if total <= top:
        nodes = sorted((g.encode(), bytes(root).hex().encode()) for g, root in groups.collect())
        tree = levels([x for _, x in nodes], None)
        outer = [(g.decode(), bytes.fromhex(x.decode()), bytes.fromhex(tree[-1][0].decode()), spell(steps(tree, i))) for i, (g, x) in enumerate(nodes)]
        outer_rows = F.broadcast(spark.createDataFrame(outer, "g string, subroot binary, root binary, outer binary"))
    else:
        over = groups.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("leaf"))
        above, h = blocks(over, ("name",), total, least, top)
        outer_rows = _paths(above, h, upper(spark, above, h, least, top))
    suffix = inner_rows.join(outer_rows, "g").select("g", "block", "subroot", "root", F.concat("inner", "outer").alias("suffix"))
    return F.broadcast(suffix) if total <= top else suffix


def _paths(made: DataFrame, height: int, suffixes: DataFrame) -> DataFrame:
    """(g, subroot, root, outer) of every leaf of a manifest over groups' roots; its leaves' `name` is their g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = levels([x.hex().encode() for x in row["leaf"]], row["height"])
                paths = [spell(steps(tree, i)) + row["suffix"] for i in range(len(row["leaf"]))]
                yield pa.record_batch([pa.array(row["name"], pa.string()), pa.array(row["leaf"], pa.binary()), pa.array([row["top"]] * len(paths), pa.binary()), pa.array(paths, pa.binary())], ["g", "subroot", "root", "outer"])

    return _with_suffix(made, height, suffixes, "name").mapInArrow(run, "g string, subroot binary, root binary, outer binary")


def _with_suffix(made: DataFrame, height: int, suffixes: DataFrame, *more: str) -> DataFrame:
    """A block's leaves and `more`, its suffix, its group's subroot, the root as `top`, and the levels of its tree.

    A block of a larger group is reduced as many levels as its full neighbours, whatever it holds itself.
    """
    own = made.select("g", "block", F.when(F.col("n") > (1 << height), F.lit(height)).alias("height"), "leaf", *more)
    return own.join(suffixes.withColumnRenamed("root", "top"), ["g", "block"])


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", changed: list[Column] | None = None, when: Column | None = None, spelled: bool = True, least: int = HEIGHT, top: int = TOP) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified), and where `spelled` siblings and sides, of every row.

    A row's leaf is the hash of its fields. Leaves of one `group` (null is one, and first) ascend by `key` (nulls first; rows
    of one key by their leaf, so repeated rows each have a leaf and their order doesn't matter). `siblings` are the proof, from
    the leaf to the root, `sides` has for each level `>` (sibling to the right), `<` or `-` (none). Rows where `when` holds
    are folded from the hash of `changed` in place of their fields, all others from their leaf; `verified` is whether the
    fold gives the root. Columns beyond fields, group and key are ignored. An empty table has no rows; a single row is its own root,
    with the hash of nothing as its proof. Texts of any length are hashed whole, in the JVM.
    """
    spark = docs.sparkSession
    core.ship(spark)
    plain, other = leaf([F.col(x) for x in fields]), leaf(changed) if changed else F.lit(None).cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),
        F.col(key).alias("key"),
        F.unhex(plain).alias("leaf"),
        F.unhex(F.when(when, other) if when is not None else other).alias("other"),
    )
    rows = core.kept(rows)
    total = rows.count()
    made, height = blocks(rows, ("key", "leaf"), total, least, top)
    suffixes = upper(spark, made, height, least, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core.frugal()
        for batch in batches:
            for b in range(batch.num_rows):
                row = {name: batch.column(name)[b] for name in ("key", "leaf", "other")}
                subroot, top_root, suffix, h = (batch.column(name)[b].as_py() for name in ("subroot", "top", "suffix", "height"))
                leaves = [x.hex().encode() for x in row["leaf"].as_py()]
                tree, rest, root = levels(leaves, h), unspell(suffix), top_root.hex()
                tail = b"".join(x for _, x in rest)
                out: list[list] = [[], [], [], []]
                for i, (own, new) in enumerate(zip(leaves, row["other"].as_py(), strict=True)):
                    path = steps(tree, i)
                    out[0].append(hashlib.sha256(b"".join(x for _, x in path) + tail).hexdigest())
                    out[1].append(fold(fold(own if new is None else new.hex().encode(), path), rest).decode())
                    if spelled:
                        out[2].append([x.decode() for _, x in path + rest if x])
                        out[3].append("".join("><-"[s] for s, _ in path + rest))
                n = len(leaves)
                cols = [row["key"].values, pa.array([x.decode() for x in leaves]), pa.array([subroot.hex()] * n), pa.array([root] * n), pa.array(out[0]), pa.array(out[1]), pa.array([x == root for x in out[1]])]
                if spelled:
                    cols += [pa.array(out[2], pa.list_(pa.string())), pa.array(out[3])]
                yield pa.record_batch(cols, names)

    names = [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["siblings", "sides"] if spelled else [])]
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", siblings array<string>, sides string" if spelled else "")
    return _with_suffix(made, height, suffixes, "key", "other").mapInArrow(run, schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof; n_chars is one more where 7 divides the crc32 of doc_id's decimal text."""
    docs = core.table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    more = [F.col(x) if x != "n_chars" else F.col(x).cast("decimal(20,0)") + 1 for x in FIELDS]
    return manifest(docs, changed=more, when=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, spelled=False)


#: Levels of the trees by recursion; the crc32 bit by bit. `list_reduce` folds a path.
ORACLE = """
WITH RECURSIVE field AS (
  SELECT doc_id, lang, n_chars,
    [coalesce(octet_length(encode(x))::VARCHAR || ':' || x, '-') FOR x IN [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text]] AS f,
    coalesce(octet_length(encode((n_chars + 1)::VARCHAR))::VARCHAR || ':' || (n_chars + 1)::VARCHAR, '-') AS more
  FROM documents),
bits AS (
  SELECT doc_id, 4294967295::BIGINT AS crc, 0 AS i, doc_id::VARCHAR AS d FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, CASE WHEN i % 9 = 0 THEN xor(crc, ascii(substr(d, i // 9 + 1, 1))::BIGINT) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END, i + 1, d FROM bits WHERE i < 9 * length(d)),
sums AS (SELECT doc_id, xor(crc, 4294967295) AS crc FROM bits WHERE i = 9 * length(d)),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(array_to_string(f, '')) AS leaf,
    sha256(f[1] || f[2] || f[3] || CASE WHEN crc % 7 = 0 THEN more ELSE f[4] END || f[5]) AS other
  FROM field LEFT JOIN sums USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
low AS (
  SELECT 0 AS lv, g, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL
  SELECT lv + 1, g, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM low WHERE n > 1 GROUP BY lv, g, pos // 2),
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lv, pos, subroot AS h, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT lv + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM high WHERE n > 1 GROUP BY lv, pos // 2),
path AS (
  SELECT p.g, p.pos, l.lv AS step, (p.pos >> l.lv) & 1 AS is_right, s.h AS sibling
  FROM placed p JOIN (SELECT DISTINCT g, lv FROM low WHERE n > 1) l ON l.g = p.g LEFT JOIN low s ON s.g = p.g AND s.lv = l.lv AND s.pos = xor(p.pos >> l.lv, 1)
  UNION ALL
  SELECT p.g, p.pos, 1000 + l.lv, (b.pos >> l.lv) & 1, s.h
  FROM placed p JOIN subs b ON b.g = p.g CROSS JOIN (SELECT DISTINCT lv FROM high WHERE n > 1) l LEFT JOIN high s ON s.lv = l.lv AND s.pos = xor(b.pos >> l.lv, 1)),
paths AS (
  SELECT g, pos, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256,
    list(CASE WHEN is_right = 1 THEN '<' ELSE '>' END || coalesce(sibling, '') ORDER BY step) AS steps
  FROM path GROUP BY g, pos),
rows_ AS (SELECT p.*, coalesce(proof_sha256, sha256('')) AS proof_sha256, coalesce(steps, []) AS steps FROM placed p LEFT JOIN paths USING (g, pos)),
folded AS (
  SELECT r.*, list_reduce([other] || steps, lambda a, b: CASE WHEN b[1] = '<' THEN sha256(b[2:] || a) ELSE sha256(a || b[2:]) END) AS folded_root FROM rows_ r)
SELECT f.doc_id, leaf, subroot, t.h AS root, proof_sha256, folded_root, folded_root = t.h AS verified
FROM folded f JOIN subs USING (g) CROSS JOIN (SELECT h FROM high WHERE n = 1) t
"""
