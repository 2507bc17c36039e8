import random
import re

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash
from lodestone.llm.components import connected_components

from . import data


def brute_print(text):
    t = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (7, 6), (7, 6), (2000, 2001), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("dense", [8192, 40, 4])
def test_links_reach_what_all_pairs_reach(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rnd = random.Random(dense)
    prints = set()
    for base in (rnd.getrandbits(64), 0, (1 << 64) - 1):
        for _ in range(150):
            x = base
            for _ in range(rnd.randint(0, 6)):
                x ^= 1 << rnd.randint(0, 63)
            prints.add(x)
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in prints], "fp long").repartition(3)).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    wanted = components(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    assert components(prints, found) == wanted


def test_documents_against_all_pairs(spark):
    rows = data.documents()
    got = sorted(((-1 if r["id"] is None else r["id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(data.frame(spark)).collect())
    prints = [brute_print(r[1]) for r in rows]
    groups = components(set(prints), [(a, b) for a in set(prints) for b in set(prints) if (a ^ b).bit_count() <= 3])
    least = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[groups[p]] = min(least.get(groups[p], r[0]), r[0])
    assert got == sorted(((-1 if r[0] is None else r[0]), f"{p:016x}", least.get(groups[p])) for r, p in zip(rows, prints))
    assert simhash.near_duplicates(data.frame(spark).limit(0)).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) >= 0.8 * len(x | y)


def near_copies():
    """Documents, and copies with one word in forty changed, of which some have a similarity of 0.8 and some less."""
    rnd = random.Random(21)
    rows = [list(r) for r in data.documents()]
    for i in range(200, 260):
        base = "".join(rnd.choice("abcdefgh") + rnd.choice(["a", "o", "e ", "u "]) for _ in range(900)).split(" ")
        rows.append([i * 10, " ".join(base), "en", "s", 0])
        for j in range(1, 1 + i % 4):
            rows.append([i * 10 + j, " ".join(w if rnd.random() > 0.012 * j else w + "x" for w in base).upper() + "\n", "en", "s", 0])
    return [tuple(r) for r in rows]


def test_similar_documents_against_all_pairs(spark, monkeypatch):
    rows = near_copies()
    texts = sorted({r[1] or "" for r in rows})
    pairs = [(a, b) for n, a in enumerate(texts) for b in texts[:n] if alike(a, b)]
    group = components(texts, pairs)
    own = simhash.similar_documents(data.frame(spark, rows)).collect()
    assert len(own) == len(rows)
    of = {}
    for r, t in [(r, t) for r in own for t in {x[1] or "" for x in rows if x[0] == r["id"]}]:
        of.setdefault(t, set()).add(r["component_id"])
    found = [(a, b) for a, b in pairs if of[a] & of[b]]
    assert len(pairs) > 60 and len(found) >= 0.95 * len(pairs)
    # nothing is linked that no chain of similar documents links
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least.setdefault(group[t or ""], set()).add(i)
    for r in own:
        for t in {x[1] or "" for x in rows if x[0] == r["id"]}:
            assert r["component_id"] is None or any(r["component_id"] in v for v in least.values() if r["id"] is None or r["id"] in v)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    cut = simhash.similar_documents(data.frame(spark, rows)).collect()
    assert sorted(map(repr, cut)) == sorted(map(repr, own))
    assert simhash.similar_documents(data.frame(spark, rows).limit(0)).count() == 0


def test_nearest_forest_spans_what_all_pairs_span():
    rng = random.Random(5)
    prints = []
    for _ in range(4):
        base = rng.getrandbits(128)
        prints += [base ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 9))) for _ in range(25)]
    words = np.array([[x & (1 << 64) - 1, x >> 64] for x in prints], np.uint64)
    edges = simhash._nearest_forest(words, 12)
    assert all((prints[a] ^ prints[b]).bit_count() <= 12 for a, b in edges)
    nodes = range(len(prints))
    assert components(nodes, edges) == components(nodes, [(a, b) for a in nodes for b in nodes if a < b and (prints[a] ^ prints[b]).bit_count() <= 12])


def test_one_of_each_group_stays(spark):
    df = data.frame(spark)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    groups = {r["id"]: r["component_id"] for r in simhash.similar_documents(df).collect() if r["id"] is not None}
    assert sorted(i for i in ids if i is not None) == sorted(set(groups.values())) and ids.count(None) == 2
    # equal and near copies are one group, and empty texts are
    assert groups[2] == groups[8] == groups[9] and groups[10] == groups[11] and groups[3] == groups[4] == groups[5]
    assert len(set(groups.values())) > 50


def test_different_texts_with_one_id_both_stay(spark):
    a, b = "one two three four five six seven eight nine ten", "red orange yellow green blue indigo violet black white grey"
    rows = [(1, a), (1, b), (1, b), (2, a), (3, "alone in the world with these few words here"), (None, a)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, a), (1, b), (3, rows[4][1]), (None, a)]))
