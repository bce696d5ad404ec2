"""Linking documents and rows: by id, time, period, keyword and vector, and what links are used for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.functions.text import words
from textweave.functions.time import period_label, period_start
from textweave.functions.vectors import distance_similarity
from textweave.plans.knn import nearest_neighbours, unit_vectors
from textweave.plans.lineage import cut_lineage
from textweave.plans.skew import salted_join
from textweave.plans.timejoin import micros, nearest_times, window_join


@dataclass(frozen=True)
class HubLinks:
    """Links through a shared hub (a period, a keyword): every document of a hub is linked to every row of it.

    The two sides hold all the links without listing them: a week with d documents and r rows costs d + r records
    instead of d * r. Filters, counts and outcomes work on the sides.
    """

    doc_side: DataFrame  # doc_id, hub
    row_side: DataFrame  # row_id, hub
    link_type: str

    def counts(self) -> DataFrame:
        """Links per document and hub."""
        rows = self.row_side.groupBy("hub").agg(F.count(F.lit(1)).alias("n_links"))
        return self.doc_side.join(rows, "hub").select("doc_id", "hub", "n_links")

    def hub_sizes(self) -> DataFrame:
        """Documents, rows and links of every hub that has both."""
        d = self.doc_side.groupBy("hub").agg(F.count(F.lit(1)).alias("n_documents"))
        r = self.row_side.groupBy("hub").agg(F.count(F.lit(1)).alias("n_rows"))
        return d.join(r, "hub").withColumn("n_links", F.col("n_documents") * F.col("n_rows"))

    def pairs(self) -> DataFrame:
        """The links one by one, for small hubs: the output is as large as the links are many."""
        joined = salted_join(self.row_side, self.doc_side, ["hub"], ["row_id"])
        return _links(joined, self.link_type, period=F.col("hub"))


def _links(df: DataFrame, link_type: str, gap: Column | None = None, score: Column | None = None, period: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        "doc_id", "row_id", F.lit(link_type).alias("link_type"),
        (none if gap is None else gap).cast("double").alias("gap"),
        (none if score is None else score).cast("double").alias("score"),
        (none if period is None else period).cast("string").alias("period"),
    )


def _dated(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("ts").isNotNull()).select(F.col("id").alias("doc_id"), micros("ts").alias("_t"))


def _timed(rows: DataFrame, time_column: str) -> DataFrame:
    return rows.filter(F.col(time_column).isNotNull()).select("row_id", micros(time_column).alias("_t"))


def link_by_id(documents: DataFrame, rows: DataFrame, id_column: str = "id") -> DataFrame:
    """Documents and rows with the same id, compared as text."""
    left = rows.select("row_id", F.col(id_column).cast("string").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    return _links(left.join(documents.select(F.col("id").alias("doc_id")), "doc_id"), "id")


def link_by_nearest_time(documents: DataFrame, rows: DataFrame, time_column: str = "ts", max_gap: float | None = None) -> DataFrame:
    """Each dated document to the row nearest in time, at most ``max_gap`` seconds away; gap is absolute."""
    dated = _dated(documents)
    near = nearest_times(dated, _timed(rows, time_column))
    if max_gap is not None:
        near = near.filter(F.col("_gap") <= int(round(max_gap * 1e6)))
    joined = salted_join(dated, near, ["_t"], ["doc_id"])
    return _links(joined, "nearest_time", gap=F.col("_gap") / 1e6)


def link_by_time_window(
    documents: DataFrame, rows: DataFrame, time_column: str = "ts", before: float = 300.0, after: float = 300.0
) -> DataFrame:
    """Every row from ``before`` seconds before to ``after`` seconds after each document; gap is row - document."""
    pairs = window_join(
        _dated(documents), _timed(rows, time_column), int(round(before * 1e6)), int(round(after * 1e6)), "row_id"
    )
    return _links(pairs, "time_window", gap=F.col("_gap") / 1e6)


def link_by_period(documents: DataFrame, rows: DataFrame, time_column: str = "ts", period: str = "W") -> HubLinks:
    """Documents and rows of the same day, week, month or year."""
    hub = lambda c: period_label(period_start(c, period), period).alias("hub")
    return HubLinks(
        documents.filter(F.col("ts").isNotNull()).select(F.col("id").alias("doc_id"), hub("ts")),
        rows.filter(F.col(time_column).isNotNull()).select("row_id", hub(time_column)),
        "sequence",
    )


def link_by_keyword(document_keywords: DataFrame, rows: DataFrame, text: Column | str) -> HubLinks:
    """Documents (``doc_id, keyword``) and the rows whose text holds the keyword."""
    doc_side = cut_lineage(document_keywords.select("doc_id", F.lower("keyword").alias("hub")).distinct())  # read several times
    tokens = rows.select("row_id", F.explode(F.array_distinct(words(text))).alias("hub"))
    used = doc_side.select("hub").distinct()
    return HubLinks(doc_side, tokens.join(used, "hub", "left_semi").select("row_id", "hub"), "keyword")


def numeric_vectors(rows: DataFrame, columns: list[str], normalise: bool = True) -> DataFrame:
    """(row_id, vec): mean-imputed, z-scored with the population deviation, what is left missing is 0."""
    from textweave.operators.features import standardise

    ready = standardise(rows, columns) if normalise else rows.fillna(0.0, columns)
    return ready.select("row_id", F.array(*[F.col(c).cast("double") for c in columns]).alias("vec"))


def project(df: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """Centred principal-component scores of an array column; the largest loading of a component is positive."""
    from textweave.operators.ml import principal_axes

    mean, axes = principal_axes(df, vector, dimensions)
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)
    scores = [
        F.aggregate(
            F.zip_with("_c", F.array(*[F.lit(float(w)) for w in axes[:, i]]), lambda x, w: x * w),
            F.lit(0.0), lambda acc, x: acc + x,
        )
        for i in range(dimensions)
    ]
    return df.withColumn("_c", centred).withColumn(vector, F.array(*scores)).drop("_c")


def common_space(text_vectors: DataFrame, row_vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both vector tables projected to the smaller of their dimensions (and sample counts)."""
    shape = lambda df: df.agg(F.max(F.size("vec")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    t, r = shape(text_vectors), shape(row_vectors)
    d = min(t["d"] or 0, r["d"] or 0, t["n"], r["n"])
    if d < 1:
        raise ValueError("not enough vectors to compare")
    fit = lambda df, s: df if s["d"] == d else project(df, "vec", d)
    return fit(text_vectors, t), fit(row_vectors, r)


def link_by_embedding(
    text_vectors: DataFrame, row_vectors: DataFrame, top_k: int = 1, threshold: float | None = None, metric: str = "cosine"
) -> DataFrame:
    """Each document (``doc_id, vec``) to its ``top_k`` most similar rows (``row_id, vec``)."""
    docs, rows = common_space(text_vectors, row_vectors)
    links = top_similar(docs, rows, top_k, "doc_id", "row_id", metric)
    if threshold is not None:
        links = links.filter(F.col("score") >= threshold)
    return _links(links, "embedding", score=F.col("score"))


def top_similar(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, metric: str = "cosine") -> DataFrame:
    """(query_id, point_id, score, rank): the exact k best by cosine or by 1/(1+distance)."""
    if metric == "cosine":
        queries, points = unit_vectors(queries, "vec", False), unit_vectors(points, "vec", True)
    elif metric != "euclidean":
        raise ValueError(f"unknown metric {metric!r}")
    found = nearest_neighbours(queries, points, k, query_id, point_id)
    d = F.col("distance")
    score = 1 - d * d / 2 if metric == "cosine" else distance_similarity(d)
    return found.select(query_id, point_id, score.alias("score"), "rank")


def link_statistics(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Documents, linked documents, links and average, least and greatest score (0, 1, 0 without links)."""
    totals = documents.agg(F.count(F.lit(1)).alias("total_documents")).withColumn("_k", F.lit(1))
    found = links.agg(
        F.countDistinct("doc_id").alias("linked_documents"),
        F.count(F.lit(1)).alias("total_links"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_similarity"),
        F.coalesce(F.min("score"), F.lit(1.0)).alias("min_similarity"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max_similarity"),
    ).withColumn("_k", F.lit(1))
    return totals.join(found, "_k").drop("_k")


def metadata_export(documents: DataFrame, rows: DataFrame | None, keys: list[str] | None = None, id_column: str = "id") -> DataFrame:
    """Metadata values as columns, outer-joined to the rows on id; clashing names get ``_metadata``.

    Without ``keys`` every key that some document has becomes a column, in alphabetical order: one pass over the key names.
    The outer join is a left join plus the documents without a row, because Spark can split a hot id in those.
    """
    if keys is None:
        keys = sorted(r["k"] for r in documents.select(F.explode(F.map_keys("metadata")).alias("k")).distinct().collect())  # names of columns
    taken = set(rows.columns) if rows is not None else set()
    name = lambda k: f"{k}_metadata" if k in taken else k
    meta = documents.select(
        F.col("id").alias(id_column), *[F.try_element_at("metadata", F.lit(k)).alias(name(k)) for k in keys if k != id_column]
    )
    if rows is None or id_column not in rows.columns:
        return meta
    left = rows.withColumn(id_column, F.col(id_column).cast("string"))
    known = left.select(id_column).distinct()
    return left.join(meta, id_column, "left").unionByName(meta.join(known, id_column, "left_anti"), allowMissingColumns=True)


# -- outcomes ------------------------------------------------------------------------------------------------------


def _number(values: DataFrame, value: str) -> Column:
    return F.col(value).try_cast("double") if dict(values.dtypes)[value] == "string" else F.col(value).cast("double")


def reduce_values(values: DataFrame, keys: list[str], how: str = "majority", value: str = "value", order: str = "order", weight: str | None = None) -> DataFrame:
    """One value per key: majority or mode (first seen wins a tie), mean (majority if not numeric), first.

    Equal values are counted together before anything is ranked, so a hot key costs one record per distinct value.
    """
    if how not in ("majority", "mode", "mean", "first"):
        raise ValueError(f"unknown aggregation {how!r}")
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = values.groupBy(*keys, value).agg(n.alias("_n"), F.min(order).alias("_first"))
    majority = F.min_by(F.col(value), F.struct(-F.col("_n"), F.col("_first")))
    if how == "first":
        return counted.groupBy(*keys).agg(F.min_by(value, "_first").alias(value))
    if how != "mean":
        return counted.groupBy(*keys).agg(majority.alias(value))
    number = _number(values, value)
    mean = F.sum(number * F.col("_n")) / F.sum("_n")
    return counted.groupBy(*keys).agg(
        F.when(F.bool_and(number.isNotNull()), mean.cast("string")).otherwise(majority.cast("string")).alias(value)
    )


def import_order(order: str) -> Column:
    """Order of a column in which documents came in: whole numbers by value, then anything else as text."""
    number = F.col(order).cast("string").try_cast("bigint")
    return F.struct(number.isNull().alias("text"), number.alias("number"), F.col(order).cast("string").alias("name"))


def _valued(documents: DataFrame, field: str, order: str) -> DataFrame:
    """(doc_id, value, order) of the documents that have the metadata field."""
    value = F.try_element_at("metadata", F.lit(field)).alias("value")
    return documents.select(F.col("id").alias("doc_id"), value, import_order(order).alias("order")).filter(F.col("value").isNotNull())


def text_outcome(documents: DataFrame, links: DataFrame | HubLinks, field: str, how: str = "majority", order: str = "id") -> DataFrame:
    """(row_id, value): a metadata field of the linked documents brought to each row.

    The first document is the first by ``order``, in which document 2 comes before document 10.
    """
    valued = _valued(documents, field, order)
    if not isinstance(links, HubLinks):
        return reduce_values(links.select("doc_id", "row_id").join(valued, "doc_id"), ["row_id"], how)
    met = links.doc_side.join(valued, "doc_id")
    per_hub = met.groupBy("hub", "value").agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("order"))
    if links.link_type == "sequence":  # a row has one period, so the period's value is the row's value
        return links.row_side.join(reduce_values(per_hub, ["hub"], how, weight="n"), "hub").select("row_id", "value")
    return _through_hubs(links.row_side, per_hub, how)


def _through_hubs(row_side: DataFrame, valued: DataFrame, how: str) -> DataFrame:
    """(row_id, value) from ``row_side(row_id, hub)`` and ``valued(hub, value, n, order)``, which may list a value repeatedly.

    For the first value and the mean a row meets one record per hub, otherwise one per hub and value.
    """
    if how == "first":
        firsts = valued.groupBy("hub").agg(F.min_by("value", "order").alias("value"), F.min("order").alias("order"))
        return row_side.join(firsts, "hub").groupBy("row_id").agg(F.min_by("value", "order").alias("value"))
    if how == "mean":
        return _mean_through_hubs(row_side, valued)
    per_value = valued.groupBy("hub", "value").agg(F.sum("n").alias("n"), F.min("order").alias("order"))
    return reduce_values(row_side.join(per_value, "hub"), ["row_id"], how, weight="n")


def _mean_through_hubs(row_side: DataFrame, valued: DataFrame) -> DataFrame:
    """The mean of the linked values, from one sum per hub, so that a row meets one record per hub and not one per value.

    Only rows that are linked to a value that is not a number meet the values themselves, for the commonest.
    """
    number = _number(valued, "value")
    sums = valued.groupBy("hub").agg(F.sum(number * F.col("n")).alias("_s"), F.sum("n").alias("_n"), F.bool_and(number.isNotNull()).alias("_numeric"))
    totals = row_side.join(cut_lineage(sums), "hub").groupBy("row_id").agg(
        (F.sum("_s") / F.sum("_n")).cast("string").alias("value"), F.bool_and("_numeric").alias("_numeric")
    )
    totals = cut_lineage(totals)
    means = totals.filter("_numeric").select("row_id", "value")
    if totals.filter(~F.col("_numeric")).isEmpty():
        return means
    mixed = row_side.join(totals.filter(~F.col("_numeric")).select("row_id"), "row_id", "left_semi")
    return means.unionByName(_through_hubs(mixed, valued, "majority").withColumn("value", F.col("value").cast("string")))


def outcome_by_time_window(
    documents: DataFrame, rows: DataFrame, field: str, how: str = "majority", order: str = "id", time_column: str = "ts",
    before: float = 300.0, after: float = 300.0,
) -> DataFrame:
    """``text_outcome`` of ``link_by_time_window`` without a record for every link.

    Documents of an instant with the same value, and rows of an instant, meet as one; what meets is summed where it meets.
    """
    valued = _valued(documents, field, order)
    dated = _dated(documents).join(valued, "doc_id").groupBy("_t", "value").agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("order"))
    row_side = _timed(rows, time_column).select("row_id", F.col("_t").alias("hub"))
    instants = row_side.select("hub", F.col("hub").alias("_t")).distinct()
    met = window_join(dated, instants, int(round(before * 1e6)), int(round(after * 1e6)), "hub")
    met = met.select("hub", "value", "n", "order")
    if how in ("first", "mean"):
        return _through_hubs(row_side, met, how)
    # a row has one instant, so the instant's value is the row's value, unless its id comes back at another
    one = row_side.groupBy("row_id").agg(F.min("hub").alias("hub"), F.max("hub").alias("_last"))
    again = cut_lineage(one.filter(F.col("hub") != F.col("_last")).select("row_id"))
    told = one.filter(F.col("hub") == F.col("_last")).join(reduce_values(met, ["hub"], how, weight="n"), "hub").select("row_id", "value")
    return told if again.isEmpty() else told.unionByName(_through_hubs(row_side.join(again, "row_id", "left_semi"), met, how))


def rows_with_outcome(rows: DataFrame, outcome: DataFrame, name: str) -> DataFrame:
    """Linked rows only, with the outcome as a column."""
    return rows.join(outcome.withColumnRenamed("value", name), "row_id")


def align_text_outcome(documents: DataFrame, rows: DataFrame, outcome: str, id_column: str = "id") -> DataFrame:
    """(doc_id, text, outcome): documents and the outcome of the first row with the same id."""
    first = rows.groupBy(F.col(id_column).cast("string").alias("id")).agg(F.min_by(outcome, "row_id").alias("outcome"))
    return documents.select("id", "text").join(first, "id").select(F.col("id").alias("doc_id"), "text", "outcome")
