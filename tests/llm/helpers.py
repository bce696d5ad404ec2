"""Small corpora with awkward rows, and plain Python versions of the rules they are held against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

PASSAGE = (
    "It was the clear and quiet morning of the second day when nobody at the old harbour expected the long grey ships to come "
    "back from the north with their holds full of salt and their sails torn by the wind of a week that had seemed to last a year."
)


def corpus(spark, more=()):
    """Nulls in every column, empty and blank texts, repeated rows, a very long text, and rows of ``more``."""
    long = " ".join(f"word{i % 7919} of" for i in range(60_000))
    rows = [
        (0, None, "en", "a", None), (1, "", "en", "a", 0), (2, " \t\n ", None, None, 3), (3, PASSAGE, "en", "a", 1), (4, PASSAGE.upper(), "en", "b", 1),
        (5, PASSAGE + "\nAn own line at the end of it.", "en", "b", 1), (5, PASSAGE + "\nAn own line at the end of it.", "en", "b", 1),
        (None, "Nobody knows the number of this one.\nIt has two lines.", "en", "c", 1), (6, long, "en", "c", 1),
        (7, "Straße größer Öl 日本語 😀.\n\nDas ist der Text mit der Zahl 12.", "de", "c", 1), *more,
    ]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def documents(spark, folder, n=None):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in (rows if n is None else rows[:n])]
