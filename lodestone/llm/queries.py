"""The corpus operators as queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, collocations, common, compaction, lines, media, merkle, mixing, packing, preference, quality, simhash, suffixes, token_counts


def _read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store_texts(_read(spark, sf_dir))).withColumnRenamed("id", "doc_id")


#: Target weights of the sources: the first five count more, others together (OTHER) little.
WEIGHTS = {"src0": 24, "src1": 12, "src2": 8, "src3": 8, "src4": 8, **{f"src{i}": 4 for i in range(5, 20)}, mixing.OTHER: 1}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir).select("doc_id", "source")
    done = mixing.schedule(docs, WEIGHTS, "source", ["doc_id"])
    return done.select("doc_id", "source", "mix_source", "mix_block", "mix_slot", "mix_position")


def op3_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    store = compaction.ShardStore(spark, common.new_path(spark, "shards"))
    arrival = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3))
    store.append(docs.where(arrival == 0))
    first = store.append(docs.where(arrival == 1))
    # the last arrival brings a column that the others lack
    wider = docs.where(arrival == 2).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    store.append(wider)
    store.compact()
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    shown = ["doc_id", "lang", "source", "n_chars"]
    now = store.read(wider.schema).select(*shown, "n_bytes", digest, F.lit("now").alias("version"))
    # an older version is what it was, before the last arrival and the merge
    return now.unionByName(store.read(docs.schema, first).select(*shown, F.lit(None).cast("bigint").alias("n_bytes"), digest, F.lit("before").alias("version")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = packing.pack(_read(spark, sf_dir), with_ids=False).withColumnRenamed("id", "doc_id")
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("k").alias("class"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = preference.format_pairs(preference.pairs_by_number(_read(spark, sf_dir, "conversations")))
    return done.withColumns({c: preference.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(_read(spark, sf_dir), digest=True)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.col("kept").cast("string").alias("kept_sha256"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.keep_bitmaps(_read(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(lines.kept_text().cast("binary"), 256).alias("kept_sha256"))


def _edits():
    """Three edits from a document's id: a word set in, a few characters replaced, a stretch cut out."""

    def place(i: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.char_length(F.coalesce("text", F.lit(""))), F.lit(1)))

    def edit(start, length: int, text: str):
        return F.struct(start.alias("start"), (start + length).alias("end"), F.lit(text).alias("text"))

    return F.array(edit(place(1), 0, " revised"), edit(place(2), 5, "corrected text, "), edit(place(3), 40, ""))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir).withColumn("edits", _edits())
    trees = common.stage(token_counts.build(docs, "doc_id", "text", keep=("edits",)), "trees", codec="zstd")
    return token_counts.apply_edits(trees, "edits").withColumnRenamed("id", "doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir)).withColumnRenamed("id", "doc_id").drop("distance2", "share")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    changed = {"text": F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    done = merkle.manifest(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], changed)
    folded = done.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), merkle.fold(F.col("changed_leaf"), F.col("steps")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir), "lang", "text").withColumnRenamed("grp", "lang")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = byte_bpe.encode(_read(spark, sf_dir), "doc_id", "text", decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return done.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


#: The schedule slot by slot: of the sources with blocks left, those released, the one due first; a source that ends starts a new phase.
OP2_SQL = f"""
WITH RECURSIVE weights AS (
  SELECT * FROM (VALUES {", ".join(f"('{s}', {w})" for s, w in WEIGHTS.items())}) AS x(s, w)),
named AS (
  SELECT doc_id, source, coalesce(w.s, '{mixing.OTHER}') AS mix_source
  FROM documents d LEFT JOIN weights w ON d.source = w.s AND w.s <> '{mixing.OTHER}'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY mix_source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r,
         count(*) OVER (PARTITION BY mix_source) AS n
  FROM named),
blocks AS (
  SELECT list({{'s': s, 'w': w, 'n': b, 'k': 0}} ORDER BY s) AS sources
  FROM (SELECT s, w, (count(*) + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS b FROM placed JOIN weights ON mix_source = s GROUP BY s, w)),
steps AS (
  SELECT CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS begun, list_transform(sources, lambda x: {{'s': x.s, 'w': CAST(x.w AS BIGINT), 'n': CAST(x.n AS BIGINT), 'k': CAST(0 AS BIGINT)}}) AS alive,
         CAST('' AS VARCHAR) AS taken FROM blocks
  UNION ALL
  SELECT slot + 1, CASE WHEN len(after) < len(alive) THEN slot + 1 ELSE begun END,
         CASE WHEN len(after) < len(alive) THEN list_transform(after, lambda x: {{'s': x.s, 'w': x.w, 'n': x.n, 'k': CAST(0 AS BIGINT)}}) ELSE after END, chosen
  FROM (
    SELECT *, list_filter(list_transform(alive, lambda x: CASE WHEN x.s = chosen THEN {{'s': x.s, 'w': x.w, 'n': x.n - 1, 'k': x.k + 1}} ELSE x END), lambda x: x.n > 0) AS after
    FROM (
      SELECT *, list_sort(list_transform(list_filter(alive, lambda x: x.k * total // x.w <= slot - begun),
                                         lambda x: {{'due': ((x.k + 1) * total + x.w - 1) // x.w, 's': x.s}}))[1].s AS chosen
      FROM (SELECT *, CAST(list_sum(list_transform(alive, lambda x: x.w)) AS BIGINT) AS total FROM steps WHERE len(alive) > 0)))),
slots AS (
  SELECT taken AS s, slot - 1 AS mix_slot, row_number() OVER (PARTITION BY taken ORDER BY slot) - 1 AS b FROM steps WHERE slot > 0),
sized AS (
  SELECT s, b, mix_slot, coalesce(sum(size) OVER (ORDER BY mix_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT s.*, least({mixing.BLOCK}, n - b * {mixing.BLOCK}) AS size FROM slots s JOIN (SELECT DISTINCT mix_source, n FROM placed) p ON p.mix_source = s.s))
SELECT doc_id, source, mix_source, CAST(r // {mixing.BLOCK} AS BIGINT) AS mix_block, CAST(mix_slot AS BIGINT) AS mix_slot,
       CAST(before + r % {mixing.BLOCK} AS BIGINT) AS mix_position
FROM placed p JOIN sized z ON p.mix_source = z.s AND p.r // {mixing.BLOCK} = z.b
"""

OP3_SQL = """
SELECT doc_id, lang, source, n_chars, CASE WHEN doc_id % 3 = 2 THEN octet_length(encode(text)) END AS n_bytes, sha256(text) AS text_sha256, 'now' AS version FROM documents
UNION ALL SELECT doc_id, lang, source, n_chars, NULL, sha256(text), 'before' FROM documents WHERE doc_id % 3 < 2
"""

OP6_SQL = """
WITH turns AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
pairs AS (
  SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair,
         coalesce(max(t) FILTER (WHERE conv_id % 2 = 0), []) AS a, coalesce(max(t) FILTER (WHERE conv_id % 2 <> 0), []) AS b
  FROM turns GROUP BY 1),
cut AS (
  SELECT pair, a, b, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false) - 1,
                              least(len(a), len(b))) AS n FROM pairs),
shown AS (
  SELECT pair, n, a[1:n] AS p, a[n + 1:] AS a, b[n + 1:] AS b FROM cut),
drawn AS (
  SELECT pair, n, a, b,
         list_transform(p, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS tp,
         list_transform(a, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS ta,
         list_transform(b, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS tb
  FROM shown)
SELECT pair, CAST(n AS BIGINT) AS n_prompt_turns, array_to_string(tp, '') AS prompt,
       array_to_string(ta, '') AS chosen_completion,
       array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: a[i].role = 'assistant'),
         lambda i: CAST(length(array_to_string(ta[1:i - 1], '')) + 22 AS VARCHAR) || '-' || CAST(length(array_to_string(ta[1:i], '')) AS VARCHAR)), ',') AS chosen_mask,
       array_to_string(tb, '') AS rejected_completion,
       array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda i: b[i].role = 'assistant'),
         lambda i: CAST(length(array_to_string(tb[1:i - 1], '')) + 22 AS VARCHAR) || '-' || CAST(length(array_to_string(tb[1:i], '')) AS VARCHAR)), ',') AS rejected_mask
FROM drawn
"""

OP7_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunks AS (
  SELECT doc_id, c, substr(h, 1000 * c + 1, 1198) AS s
  FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 1000 + 1 AS BIGINT))) AS c FROM docs)),
places AS (
  SELECT doc_id, 1000 * c + p AS p, hash(substr(s, p, 200)) AS k
  FROM (SELECT doc_id, c, s, unnest(range(1, least(1001, CAST(length(s) AS BIGINT) - 198), 2)) AS p FROM chunks)),
marked AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM places)
  WHERE nth > 1),
opened AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER w + 200 THEN 0 ELSE 1 END AS opens
  FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
numbered AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM opened),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 200 AS z FROM numbered GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, span, a, z, coalesce(lag(z) OVER w, 1) AS kept_from FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
pieces AS (
  SELECT g.doc_id, CAST(sum(z - a) / 2 AS BIGINT) AS n_removed, count(*) AS n_spans, max(z) AS rest,
         string_agg(substr(h, kept_from, a - kept_from), '' ORDER BY a) AS head
  FROM gaps g JOIN docs d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, rest) END)) AS kept_sha256
FROM docs d LEFT JOIN pieces x ON d.doc_id = x.doc_id
"""


#: CRC-32 bit by bit over the digits; nodes level by level; then each leaf's siblings on every level, folded with a list.
OP11_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, lang, n_chars, text,
         (list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda crc, c: list_reduce(list_prepend(xor(crc, c), list_transform(range(8), lambda i: CAST(0 AS BIGINT))),
             lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r >> 1, CAST(3988292384 AS BIGINT)) ELSE r >> 1 END)) % 2) = 1 AS tampered
  FROM documents),
fields AS (
  SELECT doc_id, source, tampered, text,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head
  FROM docs),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(head || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-'))
              ELSE sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) END AS changed
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (
  SELECT source, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY source, level, i // 3, n),
subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, i, n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3, n),
root AS (SELECT h AS root FROM top WHERE n = 1),
climbed AS (
  SELECT s.source, s.h AS subroot, t.level, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i < s.i // CAST(pow(3, t.level) AS BIGINT)), '') AS before,
         coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i > s.i // CAST(pow(3, t.level) AS BIGINT)), '') AS after
  FROM subroots s JOIN (SELECT DISTINCT level FROM top WHERE n > 1) t ON true
  JOIN top x ON x.level = t.level AND x.i // 3 = s.i // CAST(pow(3, t.level + 1) AS BIGINT) GROUP BY s.source, s.h, t.level, s.i),
upper AS (SELECT source, subroot, list({'before': before, 'after': after} ORDER BY level) AS steps FROM climbed GROUP BY source, subroot),
lower_steps AS (
  SELECT p.doc_id, p.source, p.i, list({'before': before, 'after': after} ORDER BY level) AS steps
  FROM (SELECT p.doc_id, p.source, p.i, x.level, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i < p.i // CAST(pow(3, x.level) AS BIGINT)), '') AS before,
               coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i > p.i // CAST(pow(3, x.level) AS BIGINT)), '') AS after
        FROM placed p JOIN tree x ON x.source IS NOT DISTINCT FROM p.source AND x.n > 1 AND x.i // 3 = p.i // CAST(pow(3, x.level + 1) AS BIGINT)
        GROUP BY p.doc_id, p.source, p.i, x.level) p
  GROUP BY p.doc_id, p.source, p.i),
proved AS (
  SELECT p.doc_id, p.leaf, p.changed, s.h AS subroot, coalesce(l.steps, []) || coalesce(u.steps, []) AS steps
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
  LEFT JOIN upper u ON u.source IS NOT DISTINCT FROM p.source
  LEFT JOIN lower_steps l ON l.source IS NOT DISTINCT FROM p.source AND l.i = p.i),
folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.before || s.after), '')) AS proof_sha256,
         list_reduce(list_prepend({'before': changed, 'after': ''}, steps), lambda a, s: {'before': sha256(s.before || a.before || s.after), 'after': ''}).before AS folded_root
  FROM proved, root)
SELECT *, folded_root = root AS verified FROM folded
"""


OP12_SQL = """
WITH pieces AS (
  SELECT doc_id, lang, row_number() OVER () AS piece, words FROM (
    SELECT doc_id, coalesce(lang, 'und') AS lang,
           regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS words
    FROM documents) WHERE len(words) > 0),
words AS (SELECT lang, piece, unnest(words) AS w, unnest(range(len(words))) AS i FROM pieces),
runs AS (
  SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
longer AS (
  SELECT lang, u, v, max(f) AS f FROM (SELECT lang, w1 AS u, w2 AS v, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
cut AS (
  SELECT x.lang, x.w1 || ' ' || x.w2 AS phrase, x.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 x JOIN f1 l ON l.lang = x.lang AND l.w1 = x.w1 JOIN f1 r ON r.lang = x.lang AND r.w1 = x.w2
  LEFT JOIN longer g ON g.lang = x.lang AND g.u = x.w1 AND g.v = x.w2 WHERE coalesce(100 * g.f < 50 * x.f, true)
  UNION ALL
  SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 1, l.f, r.f
  FROM f3 x JOIN f1 l ON l.lang = x.lang AND l.w1 = x.w1 JOIN f2 r ON r.lang = x.lang AND r.w1 = x.w2 AND r.w2 = x.w3
  UNION ALL
  SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 2, l.f, r.f
  FROM f3 x JOIN f2 l ON l.lang = x.lang AND l.w1 = x.w1 AND l.w2 = x.w2 JOIN f1 r ON r.lang = x.lang AND r.w1 = x.w3),
scored AS (SELECT *, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS score FROM cut),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM least)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM placed JOIN totals USING (lang) WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_mixing, op3_compaction, op4_packing, op5_simhash, op6_preference, op7_suffixes, op8_lines, op9_token_counts, op10_quality, op11_merkle, op12_collocations, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op3_compaction": OP3_SQL, "op6_preference": OP6_SQL, "op7_suffixes": OP7_SQL, "op8_lines": OP8_SQL, "op11_merkle": OP11_SQL, "op12_collocations": OP12_SQL}
