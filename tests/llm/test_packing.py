import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing, tokens

from . import data

PATH = tokens.vocabulary()


def test_word_encoder_equals_the_library():
    whole, own = Tokenizer.from_file(PATH), tokens.WordEncoder(PATH)
    rnd = random.Random(3)
    letters = [*"abcXYZ019 '\t\n\r\x0b\x0c\x1c\x1f\x00\x7f\x85\xa0éÉßΣςİıſﬁ中ñ́̈​ 　🙂.,!?-_<|>", "<|endoftext|>", "'s", "'LL", "é", " the"]
    for _ in range(3000):
        x = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(own.encode(x), "<u4").tolist() == whole.encode(x, add_special_tokens=False).ids, repr(x)


@pytest.mark.parametrize("n", [1, 2, 7, 63, 64, 65, 500, 819, 1024, 2047, 2048, 3000, 4095, 4096, 4097, 12345])
def test_cut_covers_a_document(n):
    at = 0
    for start, length, k in packing.cut(n):
        assert start == at and 0 < length <= packing.CAPACITY // k
        assert packing.CAPACITY // k - length <= max(packing.SLACK, length // packing.SLACK_SHARE)
        at += length
    assert at == n


@pytest.mark.parametrize("with_ids", [True, False])
def test_pieces_and_sequences(spark, with_ids):
    rows = data.documents()
    whole = Tokenizer.from_file(PATH)
    got = packing.pack(data.frame(spark), with_ids=with_ids).collect()
    wanted = sorted((*whole.encode(t or "", add_special_tokens=False).ids, packing.END_ID) for _, t, *_ in rows)
    if with_ids:
        docs = {}
        for r in got:
            docs.setdefault((r["id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        for (i, _), parts in docs.items():
            copies = sum(1 for x in rows if x[0] == i) if i is not None else 1
            parts.sort()
            for (a, ids), (b, _) in zip(parts[::copies], parts[copies::copies]):
                assert a + len(ids) == b
        assert sum(len(np.frombuffer(r["ids"], "<u4")) for r in got) == sum(map(len, wanted))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(r["length"] for r in got) == sum(map(len, wanted))


def test_small_capacity_packs_tightly_and_empty_table(spark):
    df = data.frame(spark, clash=False)
    got = packing.assign(packing.common.stage(packing.pieces(df, capacity=64), "pieces"), capacity=64).groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in got) <= 64
    assert packing.pack(df.limit(0)).count() == 0
