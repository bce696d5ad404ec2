"""Rule-based sentiment with the valence lexicon as a parameter (after Hutto and Gilbert, 2014)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.functions.metadata import sentiment_label
from textweave.functions.text import WHITE_SPACE, let, non_blank
from textweave.plans.lookup import with_lookup

# Fixed values of the published method.
BOOST = 0.293
CAPITALS = 0.733
NEGATION = -0.74
FADING = (1.0, 0.95, 0.9)  # effect of a booster one, two and three tokens away
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
ALPHA = 15.0
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
EDGE_PUNCTUATION = r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$"

NEGATORS = tuple("not no never none nor neither nobody nothing nowhere cannot without hardly".split())
BOOSTERS = {
    **{w: BOOST for w in "very really extremely so totally completely absolutely especially highly most".split()},
    **{w: -BOOST for w in "barely slightly somewhat partly almost little less marginally scarcely occasionally".split()},
}


def _is_capital(t: Column) -> Column:
    return (F.upper(t) == t) & (F.lower(t) != t)


def sentiment_scores(
    documents: DataFrame, lexicon: DataFrame, negators: Sequence[str] = NEGATORS, boosters: Mapping[str, float] | None = None,
    contrast: str = "but", whole_corpus: bool = False,
) -> DataFrame:
    """(doc_id, neg, neu, pos, compound, sentiment) from ``lexicon(form, valence)``.

    Valences are looked up and everything is worked out inside the record: boosters, negation, capitals, the contrast
    word, the sums. ``whole_corpus`` gives one record for all documents.
    """
    boosters = dict(BOOSTERS if boosters is None else boosters)
    modifiers = sorted({*negators, *boosters})
    # a modifier with a valence of its own acts through that valence: at most len(modifiers) records
    valued = {r["form"] for r in lexicon.filter(F.col("form").isin(modifiers)).select("form").distinct().collect()}
    negating = F.array(*[F.lit(w) for w in negators if w not in valued]).cast("array<string>")
    active = {w: b for w, b in boosters.items() if w not in valued}
    boost_of = F.create_map(*[F.lit(x) for w, b in (active or {"": 0.0}).items() for x in (w, float(b))])

    raw = F.transform(F.split("text", WHITE_SPACE), lambda t: F.regexp_replace(t, EDGE_PUNCTUATION, ""))
    base = documents.select(F.col("id").alias("doc_id"), "text", non_blank(raw).alias("raw"))
    n_capital = F.size(F.filter("raw", _is_capital))
    marks = lambda sign: F.length("text") - F.length(F.replace(F.col("text"), F.lit(sign), F.lit("")))
    base = base.select(
        "doc_id", "raw", F.transform("raw", F.lower).alias("low"), F.size("raw").alias("n_tokens"),
        ((n_capital > 0) & (n_capital < F.size("raw"))).alias("mixed"), marks("!").alias("n_excl"), marks("?").alias("n_quest"),
    ).withColumn("but_at", F.array_position("low", F.lit(contrast)) - 1)
    # looked up before what is worked out per word, so that a row that has to move is no wider than its words
    entries = lexicon.filter(F.col("valence") != 0).select("form", F.col("valence").cast("double").alias("valence"))
    base = with_lookup(base, "low", entries, "form", ["valence"])
    lift = lambda t, i: F.coalesce(F.try_element_at(boost_of, t), F.lit(0.0))
    base = base.withColumns(
        {"caps": F.transform("raw", lambda t: _is_capital(t) & F.col("mixed")),
         "negs": F.transform("low", lambda t: F.array_contains(negating, t)),
         "lifts": F.transform("low", lift)}
    )

    def moved(lift: Column, turn: Column):
        return lambda x: (x + lift * F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0))) * turn

    def effect(i: Column) -> Column:
        """Valence of the word at ``i`` after what stands around it."""
        own = F.get("valence", i)
        v = own + F.when(F.get("caps", i), F.signum(own) * CAPITALS).otherwise(F.lit(0.0))
        for k in range(3):
            j = i - (k + 1)
            step = F.when(j >= 0, F.get("lifts", j)).otherwise(F.lit(0.0))
            capital = F.when((j >= 0) & F.get("caps", j) & (step != 0), F.signum(step) * CAPITALS).otherwise(F.lit(0.0))
            turn = F.when((j >= 0) & F.get("negs", j), F.lit(NEGATION)).otherwise(F.lit(1.0))
            v = let(v, moved((step + capital) * FADING[k], turn))
        weight = F.when(F.col("but_at") < 0, 1.0).when(i < F.col("but_at"), BEFORE_BUT).when(i > F.col("but_at"), AFTER_BUT)
        return v * weight.otherwise(F.lit(1.0))

    places = F.when(F.col("n_tokens") > 0, F.sequence(F.lit(0), F.col("n_tokens") - 1)).otherwise(F.array().cast("array<int>"))
    valued = F.filter(places, lambda i: F.get("valence", i).isNotNull())
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    facts = base.select("doc_id", "n_tokens", "n_excl", "n_quest", F.transform(valued, effect).alias("v")).select(
        "doc_id", "n_tokens", "n_excl", "n_quest", total("v").alias("total"),
        total(F.transform("v", lambda v: F.when(v > 0, v + 1).otherwise(0.0))).alias("pos_sum"),
        total(F.transform("v", lambda v: F.when(v < 0, v - 1).otherwise(0.0))).alias("neg_sum"),
        F.size(F.filter("v", lambda v: v != 0)).cast("bigint").alias("n_valued"),
    )
    if whole_corpus:
        names = [c for c in facts.columns if c != "doc_id"]
        facts = facts.agg(*[F.sum(c).alias(c) for c in names]).withColumn("doc_id", F.lit("corpus"))
    return _finish(facts)


def _finish(facts: DataFrame) -> DataFrame:
    quest = F.when(F.col("n_quest") <= 1, 0.0).when(F.col("n_quest") <= 3, F.col("n_quest") * QUESTION).otherwise(MANY_QUESTIONS)
    emphasis = F.least("n_excl", F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION + quest
    s = F.col("total") + F.signum("total") * emphasis
    facts = facts.withColumns({"s": s, "emphasis": emphasis})
    stronger = F.col("pos_sum") - F.abs("neg_sum")
    facts = facts.withColumns(
        {"p": F.col("pos_sum") + F.when(stronger > 0, F.col("emphasis")).otherwise(0.0),
         "n": F.abs("neg_sum") + F.when(stronger < 0, F.col("emphasis")).otherwise(0.0),
         "u": (F.col("n_tokens") - F.col("n_valued")).cast("double")}
    )
    whole = F.col("p") + F.col("n") + F.col("u")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), whole), F.lit(0.0))
    out = facts.select(
        "doc_id", share("n").alias("neg"), share("u").alias("neu"), share("p").alias("pos"),
        (F.col("s") / F.sqrt(F.col("s") * F.col("s") + ALPHA)).alias("compound"),
    )
    return out.withColumn("sentiment", sentiment_label("neg", "neu", "pos"))


def with_sentiment(documents: DataFrame, scores: DataFrame) -> DataFrame:
    """Documents with their label in the metadata."""
    labels = scores.select(F.col("doc_id").alias("id"), "sentiment")
    joined = documents.join(labels, "id", "left")
    added = F.map_concat(
        F.map_filter("metadata", lambda k, v: k != "sentiment"), F.create_map(F.lit("sentiment"), F.col("sentiment"))
    )
    return joined.withColumn("metadata", F.when(F.col("sentiment").isNotNull(), added).otherwise(F.col("metadata"))).drop("sentiment")
