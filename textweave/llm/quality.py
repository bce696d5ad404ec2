"""Quality rules by distribution divergence, as DataFrame expressions only.

A document is compared with two references of its language, both counted over all documents of that language: the mix of
character classes and the mix of the language's common words. Both differences are Jensen-Shannon distances (base 2,
0 to 1). If copies of one junk document hold a third of a language, its clean documents move by less than the limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textweave.llm.common import WHITE_CHARS, WHITE_PATTERN, fresh, sized_broadcast, words, written

COMMON_WORDS = 20
COMMON_WORD_LENGTH = 4  # function words are short; longer ones are not candidates for the common words
MIN_CHARS = 200
MIN_WORDS = 40
MIN_DOCUMENTS = 20
MAX_CHAR_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.45
REFERENCES_BROADCAST = 10_000
WINDOW = 5

CLASSES = ["upper", "letter", "number", "white", "mark", "rest"]
NOT_WHITE = r"[^ \x09-\x0D]+"


LONG_WORD = r"[^ \x09-\x0D]{%d,}+" % (COMMON_WORD_LENGTH + 1)


def _left(text: Column, removed: str) -> Column:
    return F.length(F.regexp_replace(text, removed, ""))


def char_classes(docs: DataFrame, text: str) -> DataFrame:
    """Adds _<class> for each of CLASSES: code points of that class (a partition of the text), and _n_symbols."""
    body = F.coalesce(F.col(text), F.lit(""))
    # most of a text is plain lower case and blanks: one pass removes that, the other classes are counted in what is left
    blanks = F.octet_length(body) - F.octet_length(F.replace(body, F.lit(" "), F.lit("")))
    out = docs.withColumns({"_all": F.length(body), "_blanks": blanks, "_mid": F.regexp_replace(body, "[a-z ]++", "")})
    out = out.withColumn("_rests", F.regexp_replace("_mid", r"[\p{L}\p{M}]+", ""))
    return out.withColumns({
        "_upper": _left(F.col("_mid"), r"[^\p{Lu}]+"),
        "_number": _left(F.col("_rests"), r"[^\p{N}]+"),
        "_white": F.col("_blanks") + _left(F.col("_rests"), NOT_WHITE),
        "_mark": _left(F.col("_rests"), r"[^.,;:!?'\"()-]+"),
        "_rest": _left(F.col("_rests"), r"[\p{N} \x09-\x0D.,;:!?'\"()-]+"),
        "_n_symbols": _left(F.col("_rests"), "[^#*$%&|<>]+").cast("bigint"),
    }).withColumn("_letter", F.col("_all") - F.col("_blanks") - F.length("_rests") - F.col("_upper")).drop("_mid", "_blanks", "_rests")


def base_measures(docs: DataFrame, text: str) -> DataFrame:
    """Adds _n_words, _n_dup_lines and _n_repeat_words, the words inside a WINDOW-word run that occurs twice or more."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({"_w": words(F.col(text)), "_lines": F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^ \x09-\x0D]"))})
    n = F.size("_w")
    out = out.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))  # a word is hashed once, not in every window
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)]))
    out = out.withColumns({
        "_n_words": n.cast("bigint"),
        "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_hashes": F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")),
    })
    # windows with their place, only where some window repeats; equal neighbours after sorting are the repeats
    placed = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("_placed", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), placed).otherwise(none))
    same = lambda x, k: F.coalesce(F.get(F.col("_placed"), k)["h"] == x["h"], F.lit(False))
    repeated = F.filter("_placed", lambda x, k: same(x, k - 1) | same(x, k + 1))
    out = out.withColumn("_starts", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.transform("_starts", lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_starts"), k + 1) - v, F.lit(WINDOW))))
    out = out.withColumn("_n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("bigint"))
    return out.drop("_w", "_h", "_lines", "_hashes", "_placed", "_starts")


def word_counts(docs: DataFrame, text: str, common: str, most: int) -> DataFrame:
    """Adds _counts: how often each of the at most ``most`` words of the list ``common`` occurs in the text.

    None of them is longer than COMMON_WORD_LENGTH: longer words are taken out once, not passed by for each of the list.
    """
    few = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), LONG_WORD, "")
    # every word between blanks of its own, so that removing " word " counts it exactly
    out = docs.withColumn("_spaced", F.concat(F.lit(" "), F.regexp_replace(few, WHITE_PATTERN, "  "), F.lit(" ")))
    counts = []
    for k in range(most):
        word = F.concat(F.lit(" "), F.coalesce(F.get(common, F.lit(k)), F.lit("")), F.lit(" "))
        less = F.octet_length("_spaced") - F.octet_length(F.replace(F.col("_spaced"), word, F.lit("")))
        counts.append(F.when(F.size(common) > k, (less / F.octet_length(word)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out.withColumn("_counts", F.array(*counts)).drop("_spaced")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of the same length that each sum to 1."""
    part = lambda a, b: F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(0.0)
    both = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / 2))


def shares(counts: Column, total: Column) -> Column:
    """Counts and what is left of ``total``, as shares of it."""
    left = total - F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.transform(F.concat(counts, F.array(left)), lambda x: x / F.greatest(total, F.lit(1)))


def language_references(docs: DataFrame, common_words: int = COMMON_WORDS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(g, common, ref_chars, ref_words) for each language g = struct(lang), null included, with ``min_documents`` documents.

    ``common`` are the language's most frequent words of at most COMMON_WORD_LENGTH characters, counted over all texts;
    the others are shares of the character classes, and of each common word and all other words.
    """
    base = docs.select(F.struct("lang").alias("g"), "text")
    short = r"(?<![^ \x09-\x0D])[^ \x09-\x0D]{1,%d}(?![^ \x09-\x0D])" % COMMON_WORD_LENGTH
    found = base.select("g", F.explode(F.regexp_extract_all("text", F.lit(short), F.lit(0))).alias("word"))
    counted = found.groupBy("g", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.col("n").desc(), "word"))
    common = (
        counted.withColumn("r", rank).filter(F.col("r") <= common_words)
        .groupBy("g").agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("c"))
        .select("g", F.transform("c", lambda x: x["word"]).alias("common"), F.transform("c", lambda x: x["n"]).alias("counts"))
    )
    classed = char_classes(base.withColumn("_n", F.size(words(F.col("text")))), "text")
    sums = classed.groupBy("g").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("_n").alias("total"), F.sum("_all").alias("chars"), *[F.sum(f"_{c}").alias(f"_{c}") for c in CLASSES]
    ).filter((F.col("docs") >= min_documents) & (F.col("total") > 0))
    return sums.join(common, "g", "left").select(
        "g", F.coalesce("common", F.array().cast("array<string>")).alias("common"),
        F.transform(F.array(*[f"_{c}" for c in CLASSES]), lambda x: x / F.col("chars")).alias("ref_chars"),
        shares(F.concat(F.coalesce("counts", F.array().cast("array<bigint>")), F.array_repeat(F.lit(0).cast("bigint"), common_words - F.coalesce(F.size("common"), F.lit(0)))), F.col("total")).alias("ref_words"),
    )


def quality_rules(
    docs: DataFrame,
    common_words: int = COMMON_WORDS,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
    min_documents: int = MIN_DOCUMENTS,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """Every row of ``docs`` (text, lang and whatever else) with a struct ``quality``.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.
    A null text counts as empty. A distance is null (and never rejects) where the text has fewer than ``min_chars``
    characters or ``min_words`` words or the language has no reference. Repeated rows get equal verdicts; extra columns
    pass through; an existing column ``quality`` is replaced. An empty table gives an empty result.
    """
    own = docs.columns
    row = [F.col(f"`{c}`") for c in own]
    packed = docs.select(F.struct(*row).alias("_row"), F.struct("lang").alias("g"), F.col("text"))
    refs = written(language_references(docs, common_words, min_documents), "language-references")
    rows = packed.join(sized_broadcast(refs, REFERENCES_BROADCAST), "g", "left")
    rows = word_counts(char_classes(base_measures(rows, "text"), "text"), "text", "common", common_words)
    chars = F.transform(F.array(*[f"_{c}" for c in CLASSES]), lambda x: x / F.col("_all"))
    rows = rows.withColumns({
        "_failed": (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words")),
        "_char_distance": F.when(F.col("_all") >= min_chars, js_distance(chars, F.col("ref_chars"))),
        "_word_distance": F.when(F.col("_n_words") >= min_words, js_distance(shares(F.col("_counts"), F.col("_n_words")), F.col("ref_words"))),
    })
    good = (F.coalesce("_char_distance", F.lit(0.0)) <= max_char_distance) & (F.coalesce("_word_distance", F.lit(0.0)) <= max_word_distance)
    verdict = F.struct(
        F.col("_n_words").alias("n_words"), (F.col("_all") - F.col("_white")).cast("bigint").alias("word_chars"),
        *[F.col(f"_{f}").alias(f) for f in ("n_symbols", "n_dup_lines", "n_repeat_words")], F.col("_failed").alias("base_failed"),
        F.col("_char_distance").alias("char_distance"), F.col("_word_distance").alias("word_distance"),
        (~F.col("_failed") & good).alias("kept"),
    )
    return rows.select(*[F.col("_row")[c].alias(c) for c in own if c.lower() != "quality"], verdict.alias("quality"))


def keep_good(docs: DataFrame, **settings) -> DataFrame:
    """The documents that pass, with their own columns only, one called ``quality`` included."""
    aside = {c: fresh(docs, "own_quality") for c in docs.columns if c.lower() == "quality"}
    judged = quality_rules(docs.withColumnsRenamed(aside), **settings)
    # a filter on the verdict alone would be pushed below the steps that lead to it and repeat them for every element of
    # their arrays; a non-deterministic column that it reads too keeps it where it is
    held = fresh(judged, "_held")
    kept = judged.withColumn(held, F.spark_partition_id()).filter(F.col("quality")["kept"] & (F.col(held) >= 0)).drop("quality", held)
    return kept.withColumnsRenamed({b: a for a, b in aside.items()}).select(*[f"`{c}`" for c in docs.columns])
