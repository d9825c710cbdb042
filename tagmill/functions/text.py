"""Text expressions: model input, probe text, terms, keyword normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rand import uniform

# Section names, the separator and the spellings of "missing".
SECTIONS = [("Service", "service"), ("Complaint", "summary"), ("Context", "context")]
SEPARATOR = " [SEP] "
MISSING = ["", "nan", "none"]
# Fixed value: a token is two or more word characters (letters of any script).
TOKEN = r"[\p{L}\p{N}_]{2,}"


def build_input_text(columns: list[str], keywords: str = "keywords",
                     dropout: float | None = None, key: str = "case_id") -> Column:
    """Labelled sections joined by a separator, missing ones left out.

    With ``dropout`` (training) the categories section stays with probability 1 - dropout.
    """
    parts = []
    for name, column in SECTIONS:
        if column in columns:
            value = F.trim(F.col(column))
            parts.append(F.when(~F.lower(value).isin(*MISSING), F.concat(F.lit(f"{name}: "), value)))
    if keywords in columns:
        present = F.size(keywords) > 0
        if dropout is not None:
            present = present & (uniform("kw-dropout", key) > dropout)
        parts.append(F.when(present, F.concat(F.lit("Categories: "), F.array_join(keywords, ", "))))
    return F.concat_ws(SEPARATOR, *parts)


def build_probe_text(*parts: Column) -> Column:
    """Trimmed parts joined by ' | ', NULL as empty."""
    return F.concat_ws(" | ", *[F.coalesce(F.trim(p), F.lit("")) for p in parts])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def terms(words: Column) -> Column:
    """The tokens and, in reading order, the pairs of neighbouring tokens.

    ``words`` should be a column rather than an expression: it is read several times.
    """
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, n),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def normalize_keyword(raw: Column) -> Column:
    """Lower case, no punctuation, single blanks."""
    bare = F.regexp_replace(F.trim(F.lower(raw)), r"[^\p{L}\p{N}_\s]", "")
    return F.regexp_replace(bare, r"\s+", " ")
