"""The registered corpus queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.llm import (
    chat,
    decontaminate,
    exact_dedup,
    filter_audit,
    language,
    near_dedup,
    packing,
    sharding,
    simhash_dedup,
    spelling,
    suffix_dedup,
    token_counts,
    toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(modulus: int) -> Column:
    """crc32 of the document's id as text, by which folds are made."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_merged_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        F.coalesce(removed, F.lit(0)).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_string_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(fold(3) != 1))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op3_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_counts.section_tokens(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule="first"
    )
    return found.select("doc_id", "section", "char_start", "char_end", F.col("n_tokens").cast("long").alias("n_tokens"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.minimax_shards(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    messages = chat.linear_replies(rows)
    read = chat.format_conversations(messages).select(
        F.col("tree").alias("conv_id"),
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g'))) AS BIGINT)
    AS formatted_chars
FROM rows GROUP BY conv_id
"""


def op6_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id AS id, regexp_extract_all(lower(text), '[^ 	-
]+') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id AS item, regexp_extract_all(lower(text), '[^ 	-
]+') AS w FROM benchmark WHERE text IS NOT NULL
), ds AS (
  SELECT id, len(w) AS n, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM (SELECT *, unnest(range(0, len(w) - 4)) AS p FROM w)
), items AS (
  SELECT item, len(w) AS size, array_to_string(w[p + 1:p + 5], ' ') AS s FROM (SELECT *, unnest(range(0, len(w) - 4)) AS p FROM i)
), counts AS (SELECT item, size, s, count(*) AS c FROM items GROUP BY ALL
), pairs AS (SELECT DISTINCT id, n, item, size FROM ds JOIN counts USING (s)
), starts AS (SELECT id, item, size, n, unnest(range(0, greatest(n - size, 0) + 1)) AS start FROM pairs
), windows AS (
  SELECT t.id, t.item, t.size, t.n, start, s, count(*) AS c
  FROM starts t JOIN ds ON ds.id = t.id AND p BETWEEN start AND start + t.size - 5 GROUP BY ALL
), shared AS (
  SELECT id, v.item, v.size, n, start, sum(least(v.c, counts.c)) AS b
  FROM windows v JOIN counts ON counts.item = v.item AND counts.s = v.s GROUP BY ALL
)
SELECT id AS doc_id, item AS item_id, round(max(CAST(b AS DOUBLE) / (least(size, n) - 4 + size - 4 - b)), 6) AS similarity
FROM shared GROUP BY id, item HAVING max(CAST(b AS DOUBLE) / (least(size, n) - 4 + size - 4 - b)) >= 0.75
"""


def op7_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    return toxicity.score(docs, machine).select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
), least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""


def op9_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), size=2048, end=0)


def op10_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), batches=2)


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


#: The checksum is a fold over bytes; its table of 256 remainders comes from the polynomial.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents WHERE text IS NOT NULL
), counted AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY id, run
), summed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) AS h
  FROM counted, crc
), spelled AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM summed
), words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON b.word = a.rest
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON b.word = a.rest
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n,
    CASE WHEN b.m >= 10 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.m = b.m) END AS form
  FROM words w LEFT JOIN best b USING (word)
), steps AS (
  SELECT word, word AS root FROM formed
  UNION SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL
), roots AS (SELECT s.word, s.root FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT '' AS o UNION ALL SELECT o || f FROM orders, letters WHERE length(o) < 5 AND NOT contains(o, f)
), steps AS (SELECT o, step, o[step:step] AS f, left(o, step - 1) AS before FROM (SELECT o, unnest(range(1, 6)) AS step FROM orders WHERE length(o) = 5)
), marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts
), fails AS (
  SELECT doc_id, part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS bits
  FROM words
), kinds AS (
  SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM fails LEFT JOIN marks USING (doc_id) GROUP BY part, bits
), counted AS (
  SELECT part, o, step, f,
    coalesce(sum(n) FILTER (translate(bits, before || f, '') = bits), 0) AS kept,
    coalesce(sum(n) FILTER (contains(bits, f) AND translate(bits, before, '') = bits), 0) AS removed,
    coalesce(sum(n) FILTER (contains(bits, f) AND translate(bits, before, '') <> bits), 0) AS redundant,
    coalesce(sum(n) FILTER (bits = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (contains(bits, f) AND translate(bits, before, '') = bits), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (contains(bits, f) AND translate(bits, before, '') = bits), 0) AS toxic_lost
  FROM kinds, steps GROUP BY part, o, step, f
)
SELECT part, o AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_merged_transforms,
        op2_string_kernels,
        op3_offset_attribution,
        op4_minimax_shards,
        op5_reply_trees,
        op6_simhash_windows,
        op7_factorization_machine,
        op8_circulant_minhash,
        op9_residual_packing,
        op10_digest_index,
        op11_simhash_trie,
        op12_spelling_variants,
        op13_filter_audit,
    )
}
SQL: dict[str, str] = {
    "op5_reply_trees": OP5_SQL,
    "op6_simhash_windows": OP6_SQL,
    "op8_circulant_minhash": OP8_SQL,
    "op10_digest_index": OP10_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
