import hashlib
import random
import zlib

from pyspark.sql import functions as F

from lodestone.llm import merkle, queries

from . import data


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(row):
    return h(*map(field, row))


def climb(nodes):
    """(root, the siblings on each level of every node)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    proofs = []
    for i in range(len(nodes)):
        steps = []
        for level in levels[:-1]:
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            steps.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            i //= 3
        proofs.append(steps)
    return levels[-1][0], proofs


def brute(rows):
    """(leaf, subroot, root, proof digest, folded root of the row without line ends) of (doc_id, text, lang, source, n_chars) rows."""
    key = lambda x: (x is not None, b"" if x is None else str(x).encode())
    leaves = {}
    for i, t, lang, source, n in rows:
        leaf = leaf_of((i, source, lang, n, t))
        tampered = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        changed = leaf_of((i, source, lang, n, t.replace("\n", ""))) if tampered and t is not None else leaf
        leaves.setdefault(source, []).append((i is not None, i or 0, leaf, changed))
    sources = sorted(leaves, key=key)
    trees = {s: (sorted(leaves[s]), *climb([x[2] for x in sorted(leaves[s])])) for s in sources}
    root, tops = climb([trees[s][1] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        rows_of, subroot, proofs = trees[s]
        for (known, i, leaf, changed), steps in zip(rows_of, proofs, strict=True):
            steps, at = steps + top, changed
            for before, after in steps:
                at = h(before, at, after)
            out.append((i if known else None, leaf, subroot, root, h(*[a + b for a, b in steps]), at, at == root))
    return sorted(out, key=repr)


def run(spark, rows, tmp_path, **more):
    data.frame(spark, rows, **more).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle(spark, str(tmp_path))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)


def test_awkward_documents(spark, tmp_path):
    assert run(spark, data.documents(), tmp_path) == brute(data.documents())


def test_many_leaves_of_one_source_and_lone_ones(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, data.text(rnd, 3), "en", "hot" if i % 10 else f"s{i}", i) for i in range(700)] + [(5000, "a\nb", None, "é", 3), (5001, "x", "en", None, 1)]
    rnd.shuffle(rows)
    got = run(spark, rows, tmp_path, clash=False)
    assert got == brute(rows) and any(not r[-1] for r in got)


def test_one_row_and_none(spark, tmp_path):
    row = [(1, "text", "en", "s", 4)]
    assert run(spark, row, f"{tmp_path}/a") == brute(row)
    assert run(spark, row, f"{tmp_path}/a2")[0][1] == leaf_of((1, "s", "en", 4, "text"))
    assert run(spark, [], f"{tmp_path}/b") == []


def test_a_dotted_column(spark):
    df = spark.createDataFrame([(1, "a", "g"), (2, "b", "g")], "`i.d` long, `t.x` string, `g.p` string")
    got = merkle.manifest(df, "i.d", "g.p", ["i.d", "t.x"])
    assert got.select(F.size("steps")).collect()[0][0] == 1
