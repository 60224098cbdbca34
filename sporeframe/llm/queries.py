"""Registered queries of the llm operators: contract digests over each operator's own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeframe.llm import quality, toxicity
from sporeframe.llm.capfilter import near_vectors
from sporeframe.llm.chat import prefix_trees, read_back
from sporeframe.llm.common import materialise, table
from sporeframe.llm.decontaminate import contamination
from sporeframe.llm.digest import compare_neighbours
from sporeframe.llm.lines import dedup_lines
from sporeframe.llm.packing import pack_documents
from sporeframe.llm.runs import periodic_runs
from sporeframe.llm.sharding import shard_documents
from sporeframe.llm.simhash import near_duplicates
from sporeframe.llm.substring import dedup_substrings
from sporeframe.llm.trie import depth_rows, number_turns, trie


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS s FROM b WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, s, array_to_string(w[i : i + s - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS i FROM sized)),
dw AS (
  SELECT doc_id, s, i, array_to_string(w[i : i + s - 1], ' ') AS k
  FROM (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS i
        FROM d, (SELECT DISTINCT s FROM sized) WHERE len(w) >= s)),
hits AS (SELECT doc_id, i, dw.s, item_id FROM dw JOIN win ON dw.s = win.s AND dw.k = win.k),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + s)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(cover.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every conversation as read back from the prefix trees."""
    import public_tokenizers

    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tricky = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = read_back(prefix_trees(rows, vocabulary, pattern), vocabulary, pattern)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, length(regexp_replace(role, '([\\#<:])', '#\1', 'g')) + length(regexp_replace(text, '([\\#<])', '#\1', 'g')) + 15 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shards hold equally many rows but for one."""
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("k1").alias("text_group"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeated windows cover removed: digest of each document's other words."""
    kept = dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 19], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
kept AS (
  SELECT o.doc_id, count(*) AS n, string_agg(o.word, ' ' ORDER BY o.p) AS words
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) o ANTI JOIN gone ON o.doc_id = gone.doc_id AND o.p = gone.p
  GROUP BY o.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector within its label."""
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


OP5_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN degree ON vec_id = degree.a
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document by a model that never saw the held-out labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out()))
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "severity", F.col("toxicity").alias("score"), "grade",
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), (F.col("toxicity") >= 0.5).alias("toxic"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a model that never saw the held-out labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent lines removed: digest of each document's remaining text."""
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (last IS NOT NULL AND last <> doc_id) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR last = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (k) GROUP BY doc_id
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence, with the checksum of its ids."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartile bucket digest of every document and of its edited text, and how alike they are."""
    found = compare_neighbours(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, row_number() OVER (ORDER BY doc_id) AS i,
         count(*) OVER () AS rows
  FROM documents),
e AS (
  SELECT d.doc_id, d.i, x.i AS next_i, d.n,
         CASE WHEN d.n // 4 > 0 THEN left(d.t, d.n - d.n // 4) || left(x.t, d.n // 4) ELSE d.t END AS changed, d.t
  FROM d JOIN d x ON x.i = d.i % d.rows + 1),
texts AS (SELECT i, false AS changed, t FROM e UNION ALL SELECT i, true, changed FROM e),
bytes AS (
  SELECT i, changed, octet_length(encode(t)) AS n,
         list_transform(regexp_extract_all(hex(encode(t)), '..'),
                        lambda h: (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1) AS b
  FROM texts),
triplets AS (
  SELECT i, changed, CAST(b[k] AS BIGINT) * 65536 + b[k + 1] * 256 + b[k + 2] AS v
  FROM (SELECT *, unnest(range(1, n - 1)) AS k FROM bytes WHERE n > 2)),
counts AS (SELECT i, changed, ((v * 2654435761) % 4294967296) >> 24 AS bucket, count(*) AS c FROM triplets GROUP BY ALL),
dense AS (
  SELECT i, changed, bucket, coalesce(c, 0) AS c
  FROM (SELECT i, changed, unnest(range(256)) AS bucket FROM bytes) LEFT JOIN counts USING (i, changed, bucket)),
quarters AS (
  SELECT i, changed, s[64] AS q1, s[128] AS q2, s[192] AS q3
  FROM (SELECT i, changed, list_sort(list(c)) AS s FROM dense GROUP BY i, changed)),
codes AS (SELECT i, changed, bucket, CAST(c > q1 AS INT) + CAST(c > q2 AS INT) + CAST(c > q3 AS INT) AS code FROM dense JOIN quarters USING (i, changed)),
heads AS (
  SELECT i, changed, CASE WHEN n < 4 THEN n ELSE 4 * (length(bin(n)) - 1) + (n >> (length(bin(n)) - 3)) % 4 END AS size,
         least(16 * q1 // greatest(q3, 1), 15) AS r1, least(16 * q2 // greatest(q3, 1), 15) AS r2
  FROM bytes JOIN quarters USING (i, changed)),
packed AS (
  SELECT i, changed, bucket // 4 AS k, CAST(sum(code << (6 - 2 * (bucket % 4))) AS INT) AS v FROM codes GROUP BY ALL),
prints AS (
  SELECT i, changed, printf('%02x%02x', CAST(any_value(size) AS INT), CAST(any_value(r1 * 16 + r2) AS INT)) || string_agg(printf('%02x', v), '' ORDER BY k) AS print
  FROM packed JOIN heads USING (i, changed) GROUP BY i, changed),
pairs AS (
  SELECT i, true AS edit, i AS j, true AS other FROM e UNION ALL SELECT i, false, next_i, false FROM e),
body AS (
  SELECT p.i, p.edit, sum(CASE abs(a.code - b.code) WHEN 3 THEN 6 ELSE abs(a.code - b.code) END) AS gap
  FROM pairs p JOIN codes a ON a.i = p.i AND NOT a.changed JOIN codes b ON b.i = p.j AND b.changed = p.other AND b.bucket = a.bucket
  GROUP BY p.i, p.edit),
likeness AS (
  SELECT p.i, p.edit, 1 - least(gap + least(2 * abs(a.size - b.size), 24) + least(2 * abs(a.r1 - b.r1), 24) + least(2 * abs(a.r2 - b.r2), 24), 320) / 320.0::DOUBLE AS near
  FROM pairs p JOIN body USING (i, edit) JOIN heads a ON a.i = p.i AND NOT a.changed JOIN heads b ON b.i = p.j AND b.changed = p.other)
SELECT doc_id, n AS n_chars, sha256(e.changed) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint, x.near AS near_edited, y.near AS near_next
FROM e JOIN prints a ON a.i = e.i AND NOT a.changed JOIN prints b ON b.i = e.i AND b.changed
JOIN likeness x ON x.i = e.i AND x.edit JOIN likeness y ON y.i = e.i AND NOT y.edit
"""


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """Turns by depth of every conversation c, its first h turns taken from conversation c - c % 100 (h = crc32(c) % 6).

    At most five turns of a template conversation go to at most 100 others; a
    conversation's own turns only get a new depth.
    """
    c = F.col("conv_id")
    convs = turns.where("i = 0").select(c, "n", (F.crc32(c.cast("string")) % 6).alias("h"), (c - c % 100).alias("base"))
    bases = turns.where((F.col("i") == 0) & (c % 100 == 0)).select(c.alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).select(
        "conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("last"))
    convs = materialise(convs, "trie-rebuilt")
    cols = ["conv_id", "depth", "last", "k1", "k2", "chars"]
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), "last", *[zero.alias(k) for k in ("k1", "k2", "chars")])
    heads = turns.where((F.col("i") < 5) & (c % 100 == 0)).select(F.col("conv_id").alias("base"), "i", "k1", "k2", "chars")
    taken = convs.where("taken > 0").join(heads, "base").where(F.col("i") < F.col("taken")).withColumn("depth", F.col("i") + 1)
    own = turns.select("conv_id", "i", "k1", "k2", "chars").join(convs, "conv_id").where(F.col("i") >= F.col("h")).withColumn("depth", F.col("taken") + F.col("i") - F.col("h") + 1)
    return roots.unionAll(taken.select(*cols)).unionAll(own.select(*cols))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return trie(rebuilt_turns(materialise(number_turns(table(spark, sf_dir, "conversations")), "trie-numbered")))


#: CRC-32 of a string of ASCII characters, bit by bit
_CRC32 = """xor(list_reduce(
  list_concat([4294967295], flatten(list_transform(string_split(s, ''), lambda ch: [-1 - ascii(ch)] || [0, 0, 0, 0, 0, 0, 0, 0]))),
  lambda crc, x: CASE WHEN x < 0 THEN xor(crc, -1 - x) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295)"""


def crc32_sql(number: str) -> str:
    return "(" + _CRC32.replace("string_split(s, '')", f"string_split(CAST({number} AS VARCHAR), '')") + ")"


OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT conv_id, n, {crc32_sql('conv_id')} % 6 AS h FROM turns),
shaped AS (SELECT c.conv_id, c.n, c.h, c.conv_id - c.conv_id % 100 AS base, least(c.h, coalesce(b.n, 0)) AS taken
           FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100),
own AS (
  SELECT t.conv_id, taken + i - h + 1 AS d, role, text FROM turns t JOIN shaped USING (conv_id) WHERE i >= h
  UNION ALL SELECT s.conv_id, i + 1, role, text FROM shaped s JOIN turns t ON t.conv_id = s.base AND t.i < s.taken),
chained AS (
  SELECT conv_id, d, length(text) AS chars,
         sha256(string_agg(sha256(role || chr(0) || text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS k
  FROM own UNION ALL SELECT conv_id, 0, 0, '' FROM shaped),
lasts AS (SELECT conv_id, max(d) AS last FROM chained GROUP BY conv_id),
named AS (SELECT *, min(conv_id) OVER (PARTITION BY d, k) AS node, count(*) OVER (PARTITION BY d, k) AS n_convs FROM chained),
nodes AS (
  SELECT a.d, a.node, any_value(a.n_convs) AS n_convs, any_value(a.chars) AS chars, any_value(p.node) AS parent,
         string_agg(CAST(a.conv_id AS VARCHAR), ',' ORDER BY a.conv_id) FILTER (a.d = l.last) AS ends
  FROM named a JOIN lasts l USING (conv_id) LEFT JOIN named p ON p.conv_id = a.conv_id AND p.d = a.d - 1 GROUP BY a.d, a.node),
children AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
tree AS (SELECT *, coalesce(n_children, 0) AS kids FROM nodes LEFT JOIN children USING (d, node)),
sums AS (
  SELECT a.d, a.node, count(*) FILTER (u.kids = 0) AS n_leaves, sum((u.n_convs - 1) * u.chars) AS saved
  FROM tree u JOIN named a ON a.conv_id = u.node AND a.d <= u.d GROUP BY a.d, a.node)
SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, kids AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(ends, '')) AS ends_sha256
FROM tree JOIN sums USING (d, node)
"""


def repeated_ends(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; texts of ids with crc32 % 10 = 0 repeat a stretch of words from word a to their end.

    With n words and g = crc32 / 10: a = g % n, the stretch has 1 + (n - a) / (3 + g % 8) words, so it is repeated at most
    eleven times.
    """
    text = F.coalesce("text", F.lit(""))
    h = F.crc32(F.col("doc_id").cast("string"))
    split = docs.select("doc_id", text.alias("text"), F.floor(h / 10).alias("g"),
                        F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).alias("words"))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", a + 1, p), 11))
    rebuilt = F.array_join(F.concat(F.slice("words", 1, a), F.slice(again, 1, n - a)), " ")
    return split.select("doc_id", F.when(n > 0, rebuilt).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the longest of them, and the words left when each keeps its first period."""
    found = periodic_runs(repeated_ends(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n")))), "")
    found = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    length, period = F.col("best")["length"], -F.col("best")["col3"]
    return found.select(
        "doc_id", "n_runs", (-F.col("best")["col2"]).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_format": op2_chat_format,
    "op3_sharding": op3_sharding,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_fingerprints": op11_fingerprints,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE = {
    "op1_decontamination": OP1_SQL,
    "op2_chat_format": OP2_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_embedding_dedup": OP5_SQL,
    "op8_line_dedup": OP8_SQL,
    "op11_fingerprints": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
