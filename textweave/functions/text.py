"""String functions on text columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates words (letters, their marks and numbers of any script), and white space as the
# language's own split() sees it.
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"
SENTENCE_END = r"(?<=[.!?])\s+"

# Placeholder for each kind of span, in the order the replacements are applied.
PLACEHOLDERS = (
    (r"(?:https?://|www\.)[^\s<>\"]+", "_URL_"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "_EMAIL_"),
    (r"\+?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}", "_PHONE_"),
    (r"[$¢£¤¥฿₠-₿]", "_CUR_"),
    (r"#[A-Za-z_][0-9A-Za-z_]*", "_TAG_"),
    (r"\d+(?:[.,]\d+)*", "_NUMBER_"),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def non_blank(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def words(text: Column | str) -> Column:
    """Lower-cased words: runs of letters and digits of any script."""
    return non_blank(F.split(F.lower(_col(text)), NOT_WORD))


def whitespace_tokens(text: Column | str) -> Column:
    """Lower-cased tokens between white space, punctuation kept."""
    return non_blank(F.split(F.lower(_col(text)), WHITE_SPACE))


def sentences(text: Column | str) -> Column:
    """Sentences cut at the white space after closing punctuation, which stays with its sentence."""
    return F.filter(F.transform(F.split(_col(text), SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def normalise_text(text: Column | str) -> Column:
    """Replace links, e-mails, phone numbers, currency signs, hashtags and numbers, then lower-case."""
    out = _col(text)
    for pattern, placeholder in PLACEHOLDERS:
        out = F.regexp_replace(out, pattern, placeholder)
    return F.lower(out)


def remove_words(text: Column | str, ignored: Sequence[str]) -> Column:
    """Delete whole words, ignoring case; the spaces around them stay."""
    wanted = [w.strip() for w in ignored if w.strip()]
    if not wanted:
        return _col(text)
    return F.regexp_replace(_col(text), r"(?iU)\b(?:" + "|".join(wanted) + r")\b", "")


def chunk_starts(text: Column | str, size: int = 500, overlap: int = 50) -> Column:
    """Zero-based start of every chunk of ``size`` characters that overlaps its neighbour by ``overlap``."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    length = F.length(_col(text))
    last = F.greatest(F.ceil((length - size) / (size - overlap)), F.lit(0)).cast("int")
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * (size - overlap)))


def chunks(text: Column | str, size: int = 500, overlap: int = 50) -> Column:
    """Overlapping chunks; blank ones are dropped."""
    cut = F.transform(chunk_starts(text, size, overlap), lambda s: F.substring(_col(text), s + 1, F.lit(size)))
    return F.filter(cut, lambda c: F.regexp_replace(c, WHITE_SPACE, "") != "")


def kept_tokens(text: Column | str, stop_words: Sequence[str] = ()) -> Column:
    """Tokens worth analysing, original case: no stop word, number, link, e-mail, punctuation or
    all-capital token, and at least three characters long."""
    raw = non_blank(F.split(_col(text), WHITE_SPACE))
    bare = F.transform(raw, lambda t: F.regexp_replace(t, r"(?U)^[^\w@#]+|[^\w]+$", ""))
    stops = F.array(*[F.lit(s.lower()) for s in stop_words]) if stop_words else None

    def keep(t: Column) -> Column:
        ok = (
            (F.length(t) >= 3)
            & ~t.rlike(r"^[+-]?\d[\d.,:/%-]*$")
            & ~t.rlike(r"^(https?://|www\.)")
            & ~t.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
            & ~((F.upper(t) == t) & (F.lower(t) != t))
        )
        return ok if stops is None else ok & ~F.array_contains(stops, F.lower(t))

    return F.filter(bare, keep)


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - Levenshtein distance / longer length; two empty strings are equal."""
    x, y = _col(a), _col(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def token_counts(tokens: Column) -> Column:
    """Array of (token, n) with each distinct token once: run lengths of the sorted tokens, inside the record."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        lengths = let(
            begins,
            lambda b: F.transform(
                b, lambda i, k: F.struct(F.get(s, i).alias("token"), (F.coalesce(F.get(b, k + 1), n) - i).alias("n"))
            ),
        )
        return F.when(n > 0, lengths).otherwise(F.array().cast("array<struct<token:string,n:int>>"))

    return let(F.sort_array(tokens), runs)


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array."""
    count = F.size(tokens) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(count > 0, grams).otherwise(F.array().cast("array<string>"))
