"""The unit of work: documents, numeric rows and everything derived from them, all lazy."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("text", T.StringType(), False),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
LINKS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("link_type", T.StringType()),
        T.StructField("gap", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("period", T.StringType()),
    ]
)
RELATIONSHIPS = T.StructType([T.StructField(n, T.StringType()) for n in ("first", "second", "relation")])


@dataclass(frozen=True)
class Corpus:
    """Documents and rows plus links, relationships and named results; operators return a new one."""

    id: str
    documents: DataFrame
    rows: DataFrame
    links: DataFrame | None = None
    relationships: DataFrame | None = None
    name: str | None = None
    description: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    results: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    def with_(self, **changes) -> Corpus:
        return replace(self, **changes)

    def with_result(self, name: str, result: DataFrame) -> Corpus:
        return replace(self, results={**self.results, name: result})

    def with_links(self, links: DataFrame) -> Corpus:
        """Replace the links of the given types, keep the others, so linking twice changes nothing."""
        if self.links is None:
            return replace(self, links=links)
        kinds = links.select("link_type").distinct()
        others = self.links.join(kinds, "link_type", "left_anti").select(*links.columns)
        return replace(self, links=others.unionByName(links))


def empty_links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LINKS)
