"""Text out of markup, and differences of two titles, as Arrow UDFs: no built-in decodes character references."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

RUN = StructType().add("op", "string").add("old", "string").add("new", "string")


def cleaned(value: str | None) -> str:
    """Plain text of a fragment: tags are spaces, references decoded twice, control characters gone, white space single."""
    import html
    import re

    text = html.unescape(html.unescape(re.sub(r"<[^>]*>", " ", value or "")))
    return " ".join(re.sub(r"[\u200b\x00-\x08\x0e-\x1f\x7f]", "", text.replace("\xa0", " ")).split())


@F.pandas_udf(StringType())
def clean_text(values: pd.Series) -> pd.Series:
    return values.map(cleaned)


@F.pandas_udf(ArrayType(RUN))
def word_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Runs of words that are equal, replaced, deleted or inserted between two titles."""
    from difflib import SequenceMatcher

    def runs(a: str | None, b: str | None) -> list:
        x, y = (a or "").split(), (b or "").split()
        codes = SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
        return [{"op": op, "old": " ".join(x[i:j]), "new": " ".join(y[k:m])} for op, i, j, k, m in codes]

    return pd.Series([runs(a, b) for a, b in zip(old, new, strict=True)])
