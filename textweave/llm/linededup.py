"""Line dedup over range-partitioned hashes, as DataFrame operations only.

Lines become (hash, document, position) rows, range-partitioned by hash and sorted by document (largest first) and
position. One pass over each sorted partition numbers the documents of a hash; the first one in that order keeps its
lines. Only positions of dropped lines leave the pass; they return as sparse keep bitmaps, one per document, so text is
neither sorted nor carried along. A hash with more than ``rows_per_salt`` rows is cut into salts by document; its runs
are then combined from one summary row per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textweave.llm.common import WHITE_CHARS, fresh, lower_ascii, shuffle_width, sized_broadcast, written

MIN_LENGTH = 20
MIN_DOCUMENTS = 3
ROWS_PER_SALT = 2_000
HOT_BROADCAST = 1_000_000
WORD = 64


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, min_length: int) -> DataFrame:
    """(h1, h2, doc_id, text_hash, pos) for every line whose key has ``min_length`` code points or more."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.withColumn("key", lower_ascii(F.btrim("line", F.lit(WHITE_CHARS)))).filter(F.length("key") >= min_length)
    # two hashes with different seeds make a 128-bit key
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos")


def keep_bitmaps(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep) for every document that loses a line.

    A key found in ``min_documents`` different doc_ids or more loses all its lines except those of the largest doc_id.
    ``keep`` is sparse: array of (word, bits), where bit b of word w is set if line 64 * w + b stays; words that are not
    listed keep all their lines. Rows of one doc_id count as one document, null ids as one document below all others;
    ``text_hash`` tells rows of one doc_id with different texts apart.
    """
    rows = written(line_rows(docs, min_length), "line-hashes")
    key = ["h1", "h2"]
    hot = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows_per_salt)
    hot = written(hot.select(*key, F.ceil(F.col("n") / rows_per_salt).alias("salts")), "hot-lines")
    salted = rows.join(sized_broadcast(hot, HOT_BROADCAST), key, "left").withColumn(
        "salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("salts"))).cast("int")
    )
    run = [*key, "salt"]
    order = [F.col("doc_id").desc_nulls_last(), F.col("pos")]
    # the window below finds its partitioning and order already in place
    dealt = salted.repartitionByRange(shuffle_width(docs.sparkSession), *run).sortWithinPartitions(*run, *order)
    streamed = dealt.withColumns({
        "nth": F.dense_rank().over(Window.partitionBy(*run).orderBy(F.col("doc_id").desc_nulls_last())),
        "last_doc": F.first("doc_id").over(Window.partitionBy(*run).orderBy(F.col("doc_id").desc_nulls_last())),
    })
    whole = Window.partitionBy(*run).orderBy(F.col("doc_id").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = streamed.withColumn("docs", F.max("nth").over(whole))
    once = counted.filter(F.col("salts").isNull() & (F.col("docs") >= min_documents) & (F.col("nth") > 1))
    place = ["doc_id", "text_hash", "pos"]
    dropped = once.select(*place)
    if not hot.isEmpty():
        runs = written(counted.filter(F.col("salts").isNotNull()).select(*key, *place, "nth", "docs"), "hot-runs")
        heads = runs.filter("nth = 1").select(*key, "doc_id", "docs").distinct()
        total = heads.groupBy(*key).agg(F.sum("docs").alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_documents)
        lost = runs.join(sized_broadcast(written(total, "hot-totals"), HOT_BROADCAST), key).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        dropped = dropped.unionByName(lost.select(*place))
    cells = dropped.groupBy("doc_id", "text_hash", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias("bits")
    )
    return cells.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep")
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The text without the lines that the bitmap drops; null where no line stays, the text itself without a bitmap."""
    # from sparse to one flag a line: all-ones words fill the gaps, and whatever follows the last word stays
    before = lambda k: F.when(k > 0, F.get(keep, k - 1)["word"]).otherwise(-1)
    filled = F.flatten(F.transform(keep, lambda c, k: F.concat(F.array_repeat(F.lit(-1).cast("bigint"), c["word"] - before(k) - 1), F.array(c["bits"]))))
    flags = F.flatten(F.transform(filled, lambda w: F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(w, b))))
    # array_join leaves nulls out
    left = F.array_join(F.zip_with(split_lines(text), flags, lambda line, f: F.when(F.coalesce(f, F.lit(1)) == 1, line)), "\n")
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(left)


def dedup_lines(docs: DataFrame, **settings) -> DataFrame:
    """Every row of ``docs`` with its lines dropped, plus a struct ``lines``: n_lines, n_dropped, keep.

    A null or empty text is one empty line and stays "". A document whose lines all go keeps an empty text. Extra
    columns pass through; an existing column ``lines`` is replaced. An empty table gives an empty result.
    """
    own = [c for c in docs.columns if c.lower() != "lines"]
    maps = keep_bitmaps(docs.select("doc_id", "text"), **settings).select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "n_dropped", "keep"
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")).withColumn("_text_hash", F.xxhash64(F.col("_row")["text"]))
    # bitmaps are the small side: hash them, so that texts are dealt by document but never sorted
    joined = rows.join(maps.hint("shuffle_hash"), F.col("_row")["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash")), "left")
    fields = [
        (kept_text(F.col("_row")["text"], F.col("keep")) if c == "text" else F.col("_row")[c]).alias(c) for c in own
    ]
    facts = F.struct(
        F.size(split_lines(F.col("_row")["text"])).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), F.col("keep"),
    )
    return joined.select(*fields, facts.alias("lines"))


def drop_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the same columns and shortened texts; a column called ``lines`` is carried as it is."""
    aside = {c: fresh(docs, "own_lines") for c in docs.columns if c.lower() == "lines"}
    out = dedup_lines(docs.withColumnsRenamed(aside), **settings).drop("lines")
    return out.withColumnsRenamed({b: a for a, b in aside.items()}).select(*[f"`{c}`" for c in docs.columns])
