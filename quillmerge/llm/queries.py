"""The registered queries of this subpackage: one thin query for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmerge.llm import bitplanes, decontam, line_dedup, lm, merkle, minhash, multiset, pieces, simhash, substrings, surrogates, toxicity, turns
from quillmerge.sources.scratch import materialise

#: Base of the vocabulary paths; a parameter of the operators.
PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(_table(spark, sf_dir, "documents"), key=spark.conf.get("quillmerge.surrogate.key", "not a secret"))


def op3_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bitplanes.write_tokens(_table(spark, sf_dir, "documents"), vocabulary(WORDS), end_id=1)
    return bitplanes.read_documents(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.compare_with_edits(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, tau=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_held_out(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(_table(spark, sf_dir, "documents"), length=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_frequent_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pieces.Pieces.load(vocabulary(PIECES))
    trip = pieces.round_trip(_table(spark, sf_dir, "documents"), table)
    return trip.select("doc_id", "n_pieces", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "exact")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, toxicity.Settings())
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def merkle_audit(docs: DataFrame, step: int = merkle.LEVELS) -> DataFrame:
    """The tree of all rows, and what it tells of texts that lost their line breaks where the id's crc32 is even."""
    own = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf(*map(F.col, own[:-1]), F.translate("text", "\n", "")))
    tree = merkle.manifest(docs, merkle.leaf(*map(F.col, own)), tampered, id_col="doc_id", group_col="source", step=step)
    proof = F.sha2(F.translate("path", "|,", ""), 256)
    return tree.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_audit(_table(spark, sf_dir, "documents"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.damaged(_table(spark, sf_dir, "conversations"))
    return turns.digests(rows, materialise(turns.plans(rows), "plans"))


def queries() -> dict:
    import corpus_pipeline

    own = [op1_decontaminate, op2_surrogates, op3_bitplanes, op4_multiset_hash, op5_simhash, op6_language_model, op7_substring_dedup, op8_line_dedup, op9_sentencepiece, op10_toxicity, op11_merkle, op12_minhash, op13_conversation_repair]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": LINE_DEDUP_SQL, "op11_merkle": MERKLE_SQL, "op12_minhash": MINHASH_SQL, "op13_conversation_repair": REPAIR_SQL}


#: chr(9) to chr(13) and the blank are stripped; translate lowers A-Z only.
LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), hot AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot ON keyed.k = hot.k
GROUP BY doc_id
"""

#: Every pair that shares a shingle is counted; links are followed until nothing new is reached.
MINHASH_SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM split
), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS src, b.doc_id AS dst FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT reach.doc_id, dst FROM reach JOIN links ON other = src
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""

#: crc32 of an ASCII string, bit by bit.
CRC32 = """xor(list_reduce([4294967295] || list_transform(range(1, 1 + length({0})), lambda i: ascii({0}[i])::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

#: The cheapest edits by state (0 nothing yet, 1 system, 2 user, 3 assistant), row by row; at most two insertions before a row can pay.
REPAIR_SQL = f"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), draws AS (SELECT *, {CRC32.format("k")} % 20 AS d FROM drawn
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM draws WHERE d <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         role[1] || lead(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS pair FROM placed
), facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
), made_up(s, t, price, letters, lines) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'),
         (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), edits(letter, s, initial, t, price) AS (
  SELECT 'D', s, NULL::VARCHAR, s, 2 FROM range(4) AS r(s)
  UNION ALL SELECT 'R', s, NULL::VARCHAR, CASE WHEN s = 2 THEN 3 ELSE 2 END, 1 FROM range(4) AS r(s)
  UNION ALL SELECT 'K', * FROM (VALUES (0, 's', 1, 0), (0, 'u', 2, 0), (1, 'u', 2, 0), (2, 'a', 3, 0), (3, 'u', 2, 0))
), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0::BIGINT AS s, {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} AS way FROM conversations
  UNION ALL
  SELECT best.conv_id, j.pos, e.t, min({{'cost': way.cost + m.price + e.price + CASE WHEN j.fault = 'truncated' AND e.letter <> 'D' THEN 5 ELSE 0 END, 'audit': way.audit || m.letters || e.letter,
         'lines': way.lines || m.lines || CASE e.letter WHEN 'K' THEN chr(10) || j.role || ':' || j.text WHEN 'R' THEN chr(10) || CASE WHEN e.t = 3 THEN 'assistant' ELSE 'user' END || ':' || j.text ELSE '' END}})
  FROM best JOIN judged j ON j.conv_id IS NOT DISTINCT FROM best.conv_id AND j.pos = best.pos + 1 JOIN made_up m ON m.s = best.s
  JOIN edits e ON e.s = m.t AND (e.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate') AND (e.initial IS NULL OR e.initial = j.role[1]))
  GROUP BY best.conv_id, j.pos, e.t
), ended AS (
  SELECT best.conv_id, min({{'cost': way.cost + m.price, 'audit': way.audit || m.letters, 'lines': way.lines || m.lines}}) AS way
  FROM best LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM best.conv_id JOIN made_up m ON m.s = best.s
  WHERE pos = coalesce(n, 0) AND m.t IN (0, 3) GROUP BY best.conv_id
)
SELECT ended.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       way.cost AS cost, way.audit AS audit, sha256(substr(way.lines, 2)) AS repaired_sha256
FROM ended LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ended.conv_id
"""

#: As a leaf has it: byte count, colon, value.
FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"

#: Trees level by level; each leaf then climbs its own group's tree and the one over the groups.
MERKLE_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {FIELD.format("doc_id")} || {FIELD.format("source")} || {FIELD.format("lang")} || {FIELD.format("n_chars")} AS head, text,
         coalesce({CRC32.format("(doc_id::VARCHAR)")} % 2 = 0, false) AS bad FROM documents
), leaves AS (
  SELECT doc_id, g, sha256(head || {FIELD.format("text")}) AS leaf, sha256(head || {FIELD.format("(CASE WHEN bad THEN replace(text, chr(10), '') ELSE text END)")}) AS claimed,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, sha256(head || {FIELD.format("text")})) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM rows
), tree AS (
  SELECT g, 0 AS level, i, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT g, level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY g, level, i // 3, n
), subroots AS (
  SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1
), trunk AS (
  SELECT 0 AS level, i, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3 FROM trunk WHERE n > 1 GROUP BY level, i // 3, n
), beside AS (
  SELECT t.g, t.level, t.i, coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i < t.i), '') AS l, coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i > t.i), '') AS r
  FROM tree t JOIN tree o ON o.g = t.g AND o.level = t.level AND o.i // 3 = t.i // 3 WHERE t.n > 1 GROUP BY ALL
), above AS (
  SELECT t.level, t.i, coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i < t.i), '') AS l, coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i > t.i), '') AS r
  FROM trunk t JOIN trunk o ON o.level = t.level AND o.i // 3 = t.i // 3 WHERE t.n > 1 GROUP BY ALL
), climb AS (
  SELECT g, i AS leaf_i, 0 AS level, i, claimed AS digest, '' AS proof, false AS trunk FROM leaves
  UNION ALL
  SELECT c.g, c.leaf_i, CASE WHEN b.g IS NULL AND NOT c.trunk THEN 0 ELSE c.level + 1 END, CASE WHEN c.trunk OR b.g IS NOT NULL THEN c.i // 3 ELSE s.i END,
         CASE WHEN c.trunk THEN sha256(a.l || c.digest || a.r) WHEN b.g IS NOT NULL THEN sha256(b.l || c.digest || b.r) ELSE c.digest END,
         c.proof || CASE WHEN c.trunk THEN a.l || a.r WHEN b.g IS NOT NULL THEN b.l || b.r ELSE '' END, c.trunk OR b.g IS NULL
  FROM climb c JOIN subroots s ON s.g = c.g LEFT JOIN beside b ON NOT c.trunk AND b.g = c.g AND b.level = c.level AND b.i = c.i LEFT JOIN above a ON c.trunk AND a.level = c.level AND a.i = c.i
  WHERE NOT c.trunk OR a.i IS NOT NULL
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM leaves JOIN subroots USING (g) JOIN climb ON climb.g = leaves.g AND climb.leaf_i = leaves.i AND climb.trunk, (SELECT digest AS root FROM trunk WHERE n = 1)
WHERE climb.level = (SELECT max(level) FROM trunk)
"""
