import hashlib
import zlib

import pytest

from tests.llm import brute
from tidegrid.llm import manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def spelled(r, more=0):
    fields = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def climb(nodes, at):
    """Root and siblings with their sides by whole levels."""
    out = []
    while len(nodes) > 1:
        run = at // 2 * 2
        out.append((at % 2, nodes[run : run + 2][: at % 2] + nodes[run : run + 2][at % 2 + 1 :]))
        nodes, at = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], at // 2
    return nodes[0], out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, spelled(r)))
    leaves = {g: [spelled(r) for r in groups[g]] for g in order}
    subroots, out = [climb(leaves[g], 0)[0] for g in order], []
    for k, g in enumerate(order):
        root, above = climb(subroots, k)
        for i, r in enumerate(groups[g]):
            path = climb(leaves[g], i)[1] + above
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = spelled(r, 1) if hit else leaves[g][i]
            for side, sibling in path:
                node = digest(*(sibling + [node] if side else [node] + sibling))
            out.append((r[0], leaves[g][i], subroots[k], root, digest(*(x for _, s in path for x in s)), node, node == root))
    return out


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    from pyspark.sql import functions as F

    changed = [F.col(x) if x != "n_chars" else F.col(x) + 1 for x in manifest.FIELDS]
    return manifest.manifest(docs, changed=changed, when=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, **more)


@pytest.mark.parametrize(("least", "top"), [(10, 1 << 15), (2, 1000), (1, 4), (0, 1)])
def test_plain(spark, least, top):
    """The same rows whatever the blocks' height, with upper trees on the driver and, beyond `top` groups, on executors."""
    rows = [*brute.awkward(12), *((1000 + i, "long " * 50_000 if i == 3 else f"t{i}", f"lang{i % 9}" if i < 40 else "big", "s", i, None, None) for i in range(75))]
    got = run(spark, rows, least=least, top=top).collect()
    assert brute.ordered([tuple(r)[:7] for r in got]) == brute.ordered(plain(rows))
    for r in got:
        node = spelled_fold(r)
        assert node == r.root
        assert digest(*r.siblings) == r.proof_sha256


def spelled_fold(r):
    node, siblings = r.leaf, list(r.siblings)
    for side in r.sides:
        node = digest(node) if side == "-" else digest(siblings.pop(0), node) if side == "<" else digest(node, siblings.pop(0))
    assert not siblings
    return node


def test_small_tables(spark):
    assert run(spark, []).count() == 0
    one = run(spark, [(7, None, None, None, None, None, None)]).collect()
    assert [tuple(r)[:7] for r in one] == plain([(7, None, None, None, None, None, None)])
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].siblings == []


def test_hot_group_and_repeated_rows(spark):
    """Most rows in one group, a third of them alike."""
    rows = [(i if i % 3 else 0, "t" if i % 3 == 0 else str(i), "en" if i % 10 else None, "s", i % 3, None, None) for i in range(3000)]
    assert brute.ordered([tuple(r)[:7] for r in run(spark, rows, least=4).collect()]) == brute.ordered(plain(rows))
