import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import suffixes

from . import data


def brute(rows, threshold):
    """Per (id, text): kept bytes and maximal removed runs, by a dictionary of all windows in order."""
    docs = sorted({((-1 << 62) if i is None else i, t or "") for i, t in rows}, key=lambda x: x[0])
    seen, out = {}, {}
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - threshold + 1):
            if seen.setdefault(b[p : p + threshold], (i, t, p)) != (i, t, p):
                gone[p : p + threshold] = b"\1" * threshold
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, t] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def run(spark, rows, threshold, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit(1) for c in data.CLASHES})
    out = suffixes.remove_repeats(df, threshold=threshold, digest=True, **more).collect()
    return sorted((-1 << 62 if r["id"] is None else r["id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), bytes(r["kept"]).decode()) for r in out)


def expected(rows, threshold):
    found = brute(rows, threshold)
    return sorted((-1 << 62 if i is None else i, *found[-1 << 62 if i is None else i, t or ""]) for i, t in rows)


@pytest.mark.parametrize("dense", [1024, 12, 2])
def test_awkward_documents(spark, monkeypatch, dense):
    monkeypatch.setattr(suffixes, "DENSE", dense)
    # texts of one id have no order by contract, so null ids keep one text here
    rows = [(r[0], r[1]) for r in data.documents() if r[0] is not None] + [(None, data.documents()[15][1])]
    assert run(spark, rows, 100) == expected(rows, 100)


@pytest.mark.parametrize("threshold,chunk", [(33, 3 << 20), (40, 200), (100, 150)])
def test_random_copies_and_small_chunks(spark, monkeypatch, threshold, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rnd = random.Random(threshold)
    base = "".join(rnd.choice("abcé \n") for _ in range(900))
    rows = []
    for i in range(25):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            a = rnd.randint(0, 700)
            parts.append(base[a : a + rnd.randint(1, 250)] if rnd.random() < 0.7 else "".join(rnd.choice("xyz ") for _ in range(rnd.randint(1, 200))))
        rows.append((i, "".join(parts)))
    rows.append((100, "a" * 500))
    rows.append((101, "a" * 99 + "b" + "a" * 120))
    assert run(spark, rows, threshold) == expected(rows, threshold)


def test_empty_table(spark):
    assert run(spark, [], 100) == []


def test_equal_groups_are_the_repeated_rows():
    rng = np.random.default_rng(3)
    for depth in (1, 8, 33, 100):
        rows = rng.integers(97, 100, (300, depth)).astype(np.uint8)
        rows[rng.integers(0, 300, 150)] = rows[rng.integers(0, 300, 150)]
        found, group = suffixes.equal_groups(rows)
        places = {}
        for i, r in enumerate(rows):
            places.setdefault(r.tobytes(), []).append(i)
        # in the order of their bytes
        wanted = [sorted(v) for _, v in sorted(places.items()) if len(v) > 1]
        assert [sorted(found[group == g].tolist()) for g in dict.fromkeys(group.tolist())] == wanted
    assert [len(x) for x in suffixes.equal_groups(np.zeros((0, 100), np.uint8))] == [0, 0]


def test_thresholds_that_runs_cannot_hold_are_refused(spark):
    for threshold in (32, 159):
        with pytest.raises(ValueError):
            run(spark, [(1, "x")], threshold)
    assert run(spark, [(1, "ab" * 300), (2, "ab" * 300)], 158) == expected([(1, "ab" * 300), (2, "ab" * 300)], 158)


def test_parts_of_runs_hold_each_suffix_once_and_equal_suffixes_meet():
    rnd = random.Random(2)
    for threshold in (40, 100, 158):
        passage = rnd.randbytes(threshold + 30)
        keys = {}
        for _ in range(12):
            text = rnd.randbytes(rnd.randint(0, 90)) + passage + rnd.randbytes(rnd.randint(0, 90))
            first, last, pivot = suffixes._runs(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]), threshold, suffixes.GRAM)
            for a, z, h in zip(first.tolist(), last.tolist(), pivot.view(np.int64).tolist()):
                parts = suffixes.refined(text[a : z + threshold], z - a + 1, h, threshold)
                assert [p for p, m, _ in parts for p in range(p, p + m)] == list(range(z - a + 1))
                for p, m, key in parts:
                    for i in range(a + p, a + p + m):
                        keys.setdefault(text[i : i + threshold], set()).add(key)
        assert all(len(k) == 1 for k in keys.values())


def test_many_texts_without_an_id(spark):
    """Null ids come first, by 62 bits of their texts' hashes, and never take another's marks."""
    rnd = random.Random(9)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(110))
    texts = sorted({"".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(100, 112))) + (shared if rnd.random() < 0.02 else "") for _ in range(20_000)}, key=lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 2)
    rows = [(None, t) for t in texts] + [(i, shared + str(i)) for i in range(3)]
    numbered = [(n - len(texts), t) for n, (_, t) in enumerate(rows)]
    found = brute(numbered, 100)
    out = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), digest=True).collect()
    assert sorted((r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), bytes(r["kept"]).decode()) for r in out) == sorted(found[i, t] for i, t in numbered)


def test_ids_below_the_least_are_refused(spark):
    with pytest.raises(Exception, match="ids must be"):
        suffixes.remove_repeats(spark.createDataFrame([(-(1 << 63), "a" * 200)], "doc_id long, text string")).collect()
