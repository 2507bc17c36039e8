"""Small documents with every awkward case: nulls, empty and long texts, copies, repeated rows, clashing column names."""

import pathlib
import random
import re

from lodestone import llm

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
#: Plain names that the operators use inside, as columns of the caller.
PLAIN = ["id", "fp", "k", "g", "doc", "pos", "rank", "n", "pivot", "at", "model", "key", "h1", "h2", "p", "th", "tag", "packed", "length", "start", "level", "kept", "distance2"]
#: What operators add to a frame, and names that look like their private ones.
ADDED = ["n_lines", "n_dropped", "keep_bitmap", "mix_source", "mix_block", "mix_slot", "mix_position", "fingerprint", "component_id", "n_words", "base_failed", "sequence_id", "offset", "edits"]


def _private() -> list[str]:
    """Every name with leading underscores that the operators' code writes, as they are and as ``Names`` makes them."""
    found: set[str] = set()
    for path in sorted(pathlib.Path(llm.__file__).parent.glob("*.py")):
        code = path.read_text()
        found |= set(re.findall(r"[\"'`](__\w+)", code))
        found |= {f"__{x}" for x in re.findall(r"own\(\"(\w+)\"\)", code)}
    return sorted(found)


CLASHES = [*PLAIN, *ADDED, *_private()]


def text(rnd: random.Random, words: int) -> str:
    out = []
    for _ in range(words):
        out.append(rnd.choice(WORDS) + rnd.choice(["", "", "s", "ly", "é", "ß"]))
        if rnd.random() < 0.1:
            out.append(".\n" if rnd.random() < 0.6 else ",")
    return " ".join(out).replace(" .", ".").replace(". \n", ".\n")


def documents(seed: int = 7, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars)."""
    rnd = random.Random(seed)
    shared = text(rnd, 40)
    line = "This Line Is Common To Many Documents And Is Long"
    rows = []
    for i in range(n):
        t = text(rnd, rnd.randint(1, 120))
        if i % 7 == 0:
            t += "\n" + shared
        if i % 5 == 0:
            t = f"  {line if i % 2 else line.upper()}\t\n{t}"
        rows.append([i, t, rnd.choice(["en", "de", None]), rnd.choice(["src0", "src0", "src1", "other", None])])
    rows[3][1] = None
    rows[4][1] = ""
    rows[5][1] = " \t\n\x0b "
    rows[8][1] = rows[9][1] = rows[2][1]
    rows[10][1] = text(rnd, 6000)
    rows[11][1] = rows[10][1].replace("alpha", "omega", 3)
    rows[12][1] = "word " * 500
    rows[13][1] = "ab" * 400
    rows.append(list(rows[2]))
    rows.append(list(rows[14]))
    rows.append([None, rows[15][1], "en", "src0"])
    rows.append([None, None, None, None])
    return [(*r, len(r[1] or "")) for r in rows]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows=None, clash: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}) if clash else df
