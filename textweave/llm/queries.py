"""One query per training-data operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.llm import bpe, convrepair, decontam, langid, linededup, lm, packing, pii, quality, rans, simhash, spelling, substring
from textweave.llm.common import documents, query, written
from textweave.session import new_folder

# -- 5: quality rules ----------------------------------------------------------------------------------------------

_WS = r"[ \x09-\x0D]"
_CLASS_SQL = ", ".join(
    f"length(regexp_replace({src}, '{pattern}', '', 'g')) AS {name}"
    for name, src, pattern in [
        ("upper", "body", r"[^\p{Lu}]+"), ("number", "rests", r"[^\p{N}]+"), ("white", "rests", r"[^ \x09-\x0D]+"),
        ("mark", "rests", r"[^.,;:!?''\"()-]+"), ("rest", "rests", r"[\p{N} \x09-\x0D.,;:!?''\"()-]+"), ("n_symbols", "rests", "[^#*$%&|<>]+"),
    ]
)
OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\p{{L}}\p{{M}}]+', '', 'g') AS rests,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS ls
  FROM documents),
f AS (
  SELECT *, len(w) AS n_words, length(body) AS n_all, length(body) - length(rests) - upper AS letter
  FROM (SELECT doc_id, lang, body, rests, w, ls, {_CLASS_SQL} FROM d)),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
again AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
repeats AS (SELECT doc_id, sum(least(5, coalesce(j - i, 5))) AS n FROM again GROUP BY doc_id),
words AS (SELECT lang, unnest(w) AS word FROM d),
ranked AS (
  SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r
  FROM words WHERE length(word) <= 4 GROUP BY lang, word),
common AS (SELECT lang, word, n, r FROM ranked WHERE r <= 20),
refs AS (
  SELECT lang, sum(n_words) AS total, sum(n_all) AS chars, sum(upper) AS upper, sum(letter) AS letter, sum(number) AS number,
         sum(white) AS white, sum(mark) AS mark, sum(rest) AS rest
  FROM f GROUP BY lang HAVING count(*) >= 20 AND sum(n_words) > 0),
pairs AS (
  SELECT f.doc_id, 0 AS part, unnest([f.upper, f.letter, f.number, f.white, f.mark, f.rest]) / n_all AS p,
         unnest([r.upper, r.letter, r.number, r.white, r.mark, r.rest]) / r.chars AS q
  FROM f JOIN refs r ON f.lang IS NOT DISTINCT FROM r.lang WHERE n_all >= 200
  UNION ALL
  SELECT f.doc_id, 1, len(list_filter(f.w, lambda x: x = c.word)) / f.n_words, c.n / r.total
  FROM f JOIN refs r ON f.lang IS NOT DISTINCT FROM r.lang JOIN common c ON c.lang IS NOT DISTINCT FROM r.lang WHERE f.n_words >= 40
  UNION ALL
  SELECT f.doc_id, 1, len(list_filter(f.w, lambda x: NOT list_contains(c.ws, x))) / f.n_words, 1 - c.n / r.total
  FROM f JOIN refs r ON f.lang IS NOT DISTINCT FROM r.lang
       JOIN (SELECT lang, list(word) AS ws, sum(n) AS n FROM common GROUP BY lang) c ON c.lang IS NOT DISTINCT FROM r.lang
  WHERE f.n_words >= 40),
far AS (
  SELECT doc_id, part,
         sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2)) AS distance
  FROM pairs GROUP BY doc_id, part),
verdict AS (SELECT doc_id, bool_or(distance > CASE part WHEN 0 THEN 0.3 ELSE 0.45 END) AS bad FROM far GROUP BY doc_id),
base AS (
  SELECT f.doc_id, n_words, n_all - white AS word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM f LEFT JOIN repeats USING (doc_id))
SELECT base.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce(bad, false) AS kept
FROM base LEFT JOIN verdict USING (doc_id)"""


@query("op5_distribution_divergence", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.quality_rules(documents(spark, folder))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[F.col("quality")[f].alias(f) for f in fields])


# -- 9: line dedup -------------------------------------------------------------------------------------------------

OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, ls[pos] AS line,
         translate(trim(ls[pos], ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.keeper AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


@query("op9_range_line_dedup", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    out = linededup.dedup_lines(documents(spark, folder).select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("lines")["n_lines"].alias("n_lines"), F.col("lines")["n_dropped"].alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256")
    )


# -- 2: SimHash near-dedup -----------------------------------------------------------------------------------------


@query("op2_pigeonring_simhash")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder), words=4, most=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- 7: benchmark decontamination ----------------------------------------------------------------------------------


@query("op7_greedy_string_tiling")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """One row per leak: a document and the benchmark item that its tiles cover."""
    found = decontam.contaminations(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").cast("bigint").alias("n_tiles"), F.lit(True).alias("contaminated"))


# -- 10: best-fit packing ------------------------------------------------------------------------------------------


@query("op10_variable_best_fit")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder)).drop("text_hash")


# -- 8: token-id output --------------------------------------------------------------------------------------------


@query("op8_rans_token_files")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    out = new_folder(spark, "token-files")
    rans.write_token_file(documents(spark, folder), out)
    return rans.read_token_file(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# -- 6: substring dedup --------------------------------------------------------------------------------------------


@query("op6_unit_hashing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """The spans to remove, one row each."""
    return substring.repeated_spans(documents(spark, folder)).drop("text_hash")


# -- 4: language identification ------------------------------------------------------------------------------------


@query("op4_hashed_naive_bayes")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    held_out = langid.remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


# -- 1: language-model scoring -------------------------------------------------------------------------------------


@query("op1_causal_attention")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    held_out = langid.remainder(F.col("doc_id"), 5) == 1
    return lm.score(docs, docs.filter(~held_out)).withColumn("held_out", held_out)


# -- 3: PII --------------------------------------------------------------------------------------------------------


@query("op3_feistel_pseudonyms")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    key = spark.conf.get("spark.textweave.pseudonymKey", "public key of the check, not for use")
    return pii.pseudonymise(documents(spark, folder).select("doc_id", "text"), key)


# -- 11: conversation structure repair -----------------------------------------------------------------------------


def damaged(talks: DataFrame) -> DataFrame:
    """Conversations with the faults that crc32 of ``conv_id:turn`` deals out; nulls read as one space."""
    blank = F.lit(" ")
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = talks.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


@query("op11_four_russians_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    talks = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = damaged(talks)
    found = written(convrepair.audits(rows), "audits")
    texts = convrepair.digests(convrepair.repaired(rows, found)).withColumnRenamed("conv_id", "t_conv")
    every = talks.select("conv_id").distinct()
    f = found.withColumnRenamed("conv_id", "f_conv")
    out = every.join(f, F.col("conv_id").eqNullSafe(F.col("f_conv")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("t_conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


# -- 12: spelling variants -----------------------------------------------------------------------------------------


@query("op12_variable_grams")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(documents(spark, folder), typo_every=97))


# -- 13: BPE encoding and decoding ---------------------------------------------------------------------------------


@query("op13_linked_list_bpe")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(documents(spark, folder).select("doc_id", F.col("text").alias("ids")), "ids")
    digests = ["doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256")]
    texts = bpe.decode(coded.select(*digests, F.col("ids").alias("decoded")), "decoded")
    return texts.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
