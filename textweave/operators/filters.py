"""Row and document filters, column choices, lookups, relationships."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.operators.linkage import HubLinks

# Accepted spellings of a link filter -> (link family, side it starts from).
LINK_FILTERS = {
    "embedding:text": ("embedding", "text"),
    "embedding=text": ("embedding", "text"),
    "embedding:df": ("embedding", "df"),
    "embedding=df": ("embedding", "df"),
    "temporal:text": ("temporal", "text"),
    "temporal=text": ("temporal", "text"),
    "temporal:df": ("temporal", "df"),
    "temporal=df": ("temporal", "df"),
    "=embedding": ("embedding", "text"),
    ":embedding": ("embedding", "text"),
    "=temporal": ("temporal", "text"),
    ":temporal": ("temporal", "text"),
}
# Link types that belong to a family.
LINK_FAMILIES = {"embedding": ("embedding",), "temporal": ("nearest_time", "time_window", "sequence"), "keyword": ("keyword",)}


# -- columns -------------------------------------------------------------------------------------------------------


def include_columns(df: DataFrame, columns: Sequence[str], outcome: str | None = None) -> DataFrame:
    wanted = [*columns, outcome] if outcome and outcome not in columns else list(columns)
    return df.select(*[c for c in wanted if c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def keep_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def split_xy(df: DataFrame, outcome: str) -> tuple[DataFrame, DataFrame | None]:
    """Features and outcome; without an outcome everything is a feature."""
    return (df.drop(outcome), df.select(outcome)) if outcome in df.columns else (df, None)


# -- rows ----------------------------------------------------------------------------------------------------------


def mark_missing(df: DataFrame) -> DataFrame:
    """Empty text and NaN become null."""
    changes: dict[str, Column] = {}
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            changes[f.name] = F.nullif(F.col(f.name), F.lit(""))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            changes[f.name] = F.when(~F.isnan(f.name), F.col(f.name))
    return df.withColumns(changes) if changes else df


def drop_missing(df: DataFrame, empty_is_missing: bool = True) -> DataFrame:
    return (mark_missing(df) if empty_is_missing else df).dropna("any")


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def rows_equal(df: DataFrame, column: str, value: str | int | float | bool) -> DataFrame:
    """Rows whose column equals the value read as that column's type."""
    kind = df.schema[column].dataType.simpleString()
    return df.filter(F.col(column) == F.lit(str(value)).try_cast(kind))


def filter_rows(df: DataFrame, predicate: str) -> DataFrame:
    return df.filter(F.expr(predicate))


def group_aggregate(df: DataFrame, keys: Sequence[str], aggregates: dict[str, str]) -> DataFrame:
    """``aggregates`` maps an output name to an aggregate expression, e.g. ``{"mean_value": "avg(value)"}``."""
    return df.groupBy(*keys).agg(*[F.expr(e).alias(name) for name, e in aggregates.items()])


def top_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows of an ordering such as ``["value desc", "event_id"]``."""
    columns = [F.col(o.split()[0]).desc() if o.lower().endswith(" desc") else F.col(o.split()[0]) for o in order]
    return df.orderBy(*columns).limit(n)


# -- documents -----------------------------------------------------------------------------------------------------


def document_predicate(key: str, value: str) -> Column:
    """Metadata value, id or name contains the value."""
    v = F.lit(value)
    found = F.coalesce(F.contains(F.try_element_at("metadata", F.lit(key)), v), F.lit(False))
    return found | F.contains("id", v) | F.coalesce(F.contains("name", v), F.lit(False))


def filter_documents(documents: DataFrame, key: str, value: str) -> DataFrame:
    return documents.filter(document_predicate(key, value))


def rows_of_documents(rows: DataFrame, documents: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows whose id, as text, is the id of a remaining document."""
    ids = documents.select(F.col("id").alias("_doc")).distinct()
    return rows.join(ids, rows[id_column].cast("string") == ids["_doc"], "left_semi")


def parse_filter(text: str) -> tuple[str, str]:
    for sign in ("=", ":"):
        if sign in text:
            key, value = text.split(sign, 1)
            return key.strip(), value.strip()
    raise ValueError(f"filter {text!r} is neither key=value nor key:value")


def apply_filters(
    documents: DataFrame, rows: DataFrame, filters: Sequence[str], links: DataFrame | HubLinks | None = None, id_column: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """Apply ``key=value`` filters to both sides, then id synchronisation, then link filters."""
    sync = False
    for text in [f for f in filters if f not in LINK_FILTERS]:
        key, value = parse_filter(text)
        if key.lower() == "id":
            if not value:
                sync = True
                continue
            documents = filter_documents(documents, "id", value)
            if id_column in rows.columns:
                rows = rows.filter(F.col(id_column).cast("string") == value)
            continue
        documents = filter_documents(documents, key, value)
        if key in rows.columns:
            rows = rows_equal(rows, key, value)
    if sync and id_column in rows.columns:
        rows = rows_of_documents(rows, documents, id_column)
    for text in [f for f in filters if f in LINK_FILTERS]:
        if links is None:
            raise ValueError(f"link filter {text!r} needs links")
        family, side = LINK_FILTERS[text]
        if side == "text":
            rows = rows_linked_from(rows, documents, links, LINK_FAMILIES[family])
        else:
            documents = documents_linked_to(documents, rows, links, LINK_FAMILIES[family])
    return documents, rows


def _family(links: DataFrame, types: Sequence[str] | None) -> DataFrame:
    return links if types is None else links.filter(F.col("link_type").isin(list(types)))


def rows_linked_from(rows: DataFrame, documents: DataFrame, links: DataFrame | HubLinks, types: Sequence[str] | None = None) -> DataFrame:
    """Rows that some remaining document links to."""
    ids = documents.select(F.col("id").alias("doc_id"))
    if isinstance(links, HubLinks):
        hubs = links.doc_side.join(ids, "doc_id", "left_semi").select("hub").distinct()
        targets = links.row_side.join(hubs, "hub", "left_semi").select("row_id").distinct()
    else:
        targets = _family(links, types).join(ids, "doc_id", "left_semi").select("row_id").distinct()
    return rows.join(targets, "row_id", "left_semi")


def documents_linked_to(documents: DataFrame, rows: DataFrame, links: DataFrame | HubLinks, types: Sequence[str] | None = None) -> DataFrame:
    """Documents that link to some remaining row."""
    ids = rows.select("row_id")
    if isinstance(links, HubLinks):
        hubs = links.row_side.join(ids, "row_id", "left_semi").select("hub").distinct()
        targets = links.doc_side.join(hubs, "hub", "left_semi").select(F.col("doc_id").alias("id")).distinct()
    else:
        targets = _family(links, types).join(ids, "row_id", "left_semi").select(F.col("doc_id").alias("id")).distinct()
    return documents.join(targets, "id", "left_semi")


def in_time_range(df: DataFrame, time_column: str = "ts", start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive range, either end open; records without a time are kept."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(time_column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        inside = inside & (F.col(time_column) <= F.lit(end).cast("timestamp_ntz"))
    return df.filter(F.col(time_column).isNull() | inside)


def document_by_id(documents: DataFrame, doc_id: str) -> DataFrame:
    return documents.filter(F.col("id") == doc_id)


def document_ids(documents: DataFrame) -> DataFrame:
    return documents.select("id")


def add_documents(documents: DataFrame, more: DataFrame) -> DataFrame:
    return documents.unionByName(more, allowMissingColumns=True)


def remove_documents(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not in ``ids(id)``."""
    return documents.join(ids.select("id").distinct(), "id", "left_anti")


def document_table(documents: DataFrame) -> DataFrame:
    return documents.select("id", "name", "description", "score", "text", "ts", "metadata")


def chunks_of_document(chunks: DataFrame, doc_id: str) -> DataFrame:
    return chunks.filter(F.col("doc_id") == doc_id)


# -- relationships -------------------------------------------------------------------------------------------------


def add_relationship(relationships: DataFrame, first: str, second: str, relation: str) -> DataFrame:
    row = relationships.sparkSession.range(1).select(
        F.lit(first).alias("first"), F.lit(second).alias("second"), F.lit(relation).alias("relation")
    )
    return relationships.unionByName(row)


def clear_relationships(relationships: DataFrame) -> DataFrame:
    return relationships.limit(0)


def relationships_for(relationships: DataFrame, keyword: str) -> DataFrame:
    return relationships.filter(F.contains("first", F.lit(keyword)) | F.contains("second", F.lit(keyword)))


def add_temporal_relationship(
    relationships: DataFrame, documents: DataFrame, rows: DataFrame, doc_id: str, column: str, relation: str = "temporal_correlation"
) -> DataFrame:
    """Relate a dated document to a column; nothing is added when the document has no time."""
    if column not in rows.columns:
        raise ValueError(f"no column {column!r}")
    dated = document_by_id(documents, doc_id).filter(F.col("ts").isNotNull())
    return relationships.unionByName(
        dated.select(
            F.concat(F.lit("text:"), "id").alias("first"), F.lit(f"numb:{column}").alias("second"), F.lit(relation).alias("relation")
        )
    )
