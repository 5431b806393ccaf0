"""The registered queries of the document operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import bitpack, embed_dedup, licenses, packing, pii, quality_cnn, quality_rules, resample, simhash, sp_codec, spelling, token_rollup, winnowing
from clickloom.llm.shared import cut, table
from clickloom.sources.shared import fresh_folder


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
    return judged.withColumnRenamed("id", "doc_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sp_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_cnn.score(docs, quality_cnn.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), quality_cnn.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= quality_cnn.THRESHOLD).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), around=True)
    of = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    base = pii.digest(F.filter("spans", lambda s: s["base"]))
    return found.select(F.col("id").alias("doc_id"), *[of(k.name) for k in pii.KINDS if k.own], F.sha2(base, 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: inserts of words counted with one tokenizer, the other's inserts, the deletion of
    documents without text, and a revision of the second tokenizer's version name. A repeated commit adds nothing."""
    docs = table(spark, sf_dir, "documents")
    rollup = token_rollup.Rollup(spark, fresh_folder(spark, "rollup"))
    counts = {kind: cut(token_rollup.count_tokens(docs, public_tokenizers.path(file), file.removesuffix(".json"))) for kind, file in (("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json"))}
    draft = counts["word"].withColumn("tokenizer_version", F.concat("tokenizer_version", F.lit("-draft")))
    rollup.commit("insert-byte", token_rollup.signed(counts["byte"], 1))
    rollup.commit("insert-word", token_rollup.signed(draft, 1))
    rollup.commit("insert-byte", token_rollup.signed(counts["byte"], 1))
    rollup.commit("delete-empty", token_rollup.signed(counts["byte"].where("n_chars = 0").unionByName(draft.where("n_chars = 0")), -1))
    rollup.commit("revise-word", token_rollup.revised(draft.where("n_chars > 0"), counts["word"].where("n_chars > 0")))
    return rollup.totals()


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "tokens")
    bitpack.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 49_408, 2)
    return bitpack.read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents")))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints as digests of their hashes and places."""
    found = winnowing.compare_packed(table(spark, sf_dir, "documents"))
    digests = [winnowing.digest(F.col(x)).alias(y) for x, y in (("packed", "fingerprint"), ("edited_packed", "edited_fingerprint"))]
    return found.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *digests, "near_edited", "near_next")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_sentencepiece, op3_quality_cnn, op4_pii, op5_token_rollup, op6_token_files, op7_best_fit_packing, op8_license_scan, op9_embedding_dedup, op10_simhash_dedup, op11_importance_resampling, op12_spelling_variants, op13_winnowing)}


#: CTE of one row: CRC-32's table of 256 entries, made from its polynomial.
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(CAST(range(8) AS UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, i::UBIGINT) AS v FROM range(256) r(i)))"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_sql(text: str) -> str:
    """The CRC-32 of the UTF-8 bytes of a text, where crc_table is in scope."""
    at = f"hex(encode({text}))"
    digit = lambda k: f"instr('0123456789ABCDEF', substr({at}, CAST(2 * i + {k} AS BIGINT), 1)) - 1"
    octets = f"list_transform(range(strlen({text})), lambda i: CAST(16 * ({digit(1)}) + {digit(2)} AS UBIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)]), 4294967295::UBIGINT), 4294967295::UBIGINT)"


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that DuckDB can express and run on whole tables: op9 by all pairs, op11 with CRC-32 written
    out, op12 by words with one code point left out.

    The others need a tokenizer, XXH64, a trained model or lookbehind patterns; tests hold them against brute force.
    """
    return {
        "op9_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
roots AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x), degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept FROM embeddings e JOIN roots r ON r.x = e.vec_id LEFT JOIN degrees d ON d.x = e.vec_id""",
        "op11_importance_resampling": f"""WITH {_CRC_TABLE},
both_texts AS (SELECT doc_id AS id, true AS own, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
found AS (SELECT id, own, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM both_texts WHERE text IS NOT NULL),
counted AS (SELECT id, own, w, count(*) AS n FROM found GROUP BY ALL),
hashed AS (SELECT w, {_crc_sql("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM counted), crc_table),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM counted JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM totals),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM totals, sums),
weights AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight FROM counted JOIN hashed USING (w) JOIN gains USING (bucket) WHERE own GROUP BY id),
noises AS (SELECT doc_id, list_reduce(list_transform(range(8), lambda i: CAST(instr('0123456789abcdef', substr(sha256(concat('2024:', doc_id)), CAST(i + 1 AS BIGINT), 1)) - 1 AS BIGINT)), lambda h, d: 16 * h + d) AS h FROM documents),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM noises LEFT JOIN weights ON id = doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.*, CASE WHEN place <= 10 * n // 100 THEN place END AS "rank" FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id""",
        "op12_spelling_variants": f"""WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT name, run, count(*) AS c FROM (SELECT concat(doc_id, ':') AS name, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL) WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, c, CAST({_crc_sql("concat(name, run)")} AS BIGINT) AS h FROM runs, crc_table),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, c FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
gaps AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
links AS (SELECT a.word AS x, b.word AS y, b.n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT g.word, v.word, v.n FROM gaps g JOIN v ON v.word = g.rest UNION SELECT v.word, g.word, g.n FROM gaps g JOIN v ON v.word = g.rest),
best AS (SELECT x, count(*) AS n_near, arg_min(y, (-n, y)) AS form, max(n) AS form_n FROM links GROUP BY x),
formed AS (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best ON x = word),
chain(word, tip, step) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON f.word = c.tip AND f.form IS NOT NULL)
SELECT f.word, f.form, r.tip AS root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(tip, step) AS tip FROM chain GROUP BY word) r ON r.word = f.word""",
    }
