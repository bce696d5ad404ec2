"""Functions on document metadata, tags, keywords and sentiment labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentiment label -> score; any other label scores 0.
SENTIMENT_SCORES = {"pos": 1.0, "positive": 1.0, "neg": -1.0, "negative": -1.0, "neu": 0.0, "neutral": 0.0}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_tag(file_name: Column | str) -> Column:
    """Part of the stem before the first '-', else before the first '_'; null when there is none."""
    stem = F.regexp_replace(F.regexp_replace(_col(file_name), r"^.*/", ""), r"(.)\.[^.]*$", "$1")
    tag = F.when(F.contains(stem, F.lit("-")), F.split_part(stem, F.lit("-"), F.lit(1))).when(
        F.contains(stem, F.lit("_")), F.split_part(stem, F.lit("_"), F.lit(1))
    )
    return F.nullif(tag, F.lit(""))


def keyword_list(keywords: Column | str) -> Column:
    """Comma text -> trimmed array; an array column is used as it is."""
    return F.transform(F.split(_col(keywords), ","), lambda k: F.trim(k))


def prefixed_scalars(metadata: Column | str, prefix: str = "doc_") -> Column:
    """Metadata map without nulls and with every key prefixed."""
    kept = F.map_filter(_col(metadata), lambda k, v: v.isNotNull())
    return F.transform_keys(kept, lambda k, v: F.concat(F.lit(prefix), k))


def json_scalars(text: Column | str) -> Column:
    """JSON object text -> map of its scalar members as text (nested members and nulls dropped)."""
    parsed = F.from_json(_col(text), "map<string,string>")
    # the type decides, not the first character: a string may begin with a bracket
    typed = F.try_variant_get(F.try_parse_json(_col(text)), "$", "map<string,variant>")
    nested = lambda k: F.coalesce(F.schema_of_variant(F.try_element_at(typed, k)).rlike("^(OBJECT|ARRAY)<"), F.lit(False))
    return F.map_filter(parsed, lambda k, v: v.isNotNull() & ~nested(k))


def collection_metadata(metadata: Column | str, doc_id: Column | str) -> Column:
    """Metadata as a search collection stores it: no nulls, ``_doc_id`` when nothing is left."""
    kept = F.map_filter(_col(metadata), lambda k, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(F.create_map(F.lit("_doc_id"), _col(doc_id).cast("string")))


def sentiment_label(neg: Column | str, neu: Column | str, pos: Column | str) -> Column:
    """Label of the largest score; the earlier of neg, neu, pos wins a tie."""
    a, b, c = _col(neg), _col(neu), _col(pos)
    return F.when((a >= b) & (a >= c), "neg").when(b >= c, "neu").otherwise("pos")


def sentiment_score(label: Column | str) -> Column:
    """Label to +1 / 0 / -1, ignoring case."""
    lower = F.lower(_col(label))
    out = F.lit(0.0)
    for name, score in SENTIMENT_SCORES.items():
        if score:
            out = F.when(lower == name, F.lit(score)).otherwise(out)
    return F.when(lower.isNotNull(), out)
