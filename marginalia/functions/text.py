"""Column functions on text: tokens, stopwords, snippets, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a question.
STOPWORDS = "how did i the a to do my for without should what is are it in on of an and or from with be was".split()

#: White space as Unicode has it, as a class of patterns.
WHITE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: Letters with marks and the letters they are folded to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """Lower-cased words with _, - and . kept inside and marks removed; null gives none."""
    return F.array_remove(F.split(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_.-]+"), "")


def query_tokens(text: Column) -> Column:
    """The searchable tokens of a question in order: without stopwords, and without . and - at the end."""
    bare = F.transform(tokens(text), lambda t: F.regexp_replace(t, r"[.-]+$", ""))
    return F.filter(bare, lambda t: (t != "") & ~t.isin(STOPWORDS))


def normalized(question: Column) -> Column:
    """The key under which a question is remembered: its words, lower-cased, without marks at their ends and stopwords; all raw words if nothing is left."""
    raw = F.array_remove(F.split(F.lower(question), r"\s+"), "")
    words = F.transform(raw, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(STOPWORDS))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(F.array_join(raw, " "))


def heading_terms(question: Column) -> Column:
    """Words of a question that a heading is searched for: no stopwords, more than two bytes."""
    words = F.transform(F.split(F.lower(question), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) > 2) & ~w.isin(STOPWORDS)))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def trimmed_end(text: Column) -> Column:
    return F.regexp_replace(text, f"{WHITE}+$", "")


def snippet(body: Column, width: int = 240) -> Column:
    """The trimmed text, cut at `width` characters with an ellipsis."""
    text = trimmed(body)
    return F.when(F.length(text) > width, F.concat(trimmed_end(F.substring(text, 1, width)), F.lit("…"))).otherwise(text)


def token_estimate(body: Column) -> Column:
    """Tokens as bytes / 3.6."""
    return F.octet_length(body) / F.lit(3.6)


def without_thinking(answer: Column) -> Column:
    """An answer without its <think> parts; one that never ends takes the rest."""
    return F.regexp_replace(answer, r"(?s)<think>.*?(</think>|$)", "")
