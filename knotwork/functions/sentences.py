"""Sentence splitting for marked-up Turkish and other Latin text.

Mentions are opaque; a dot after digits or after a word of up to four letters, with a letter following, isn't an end; a sentence ends
at . ! or ? before white space and an upper-case letter. So a sentence that begins with a mention doesn't split off, nor
does one after a short word: that is part of what sentence numbers mean, and so are the patterns.

Texts without mentions are split by Spark's own functions; only the others go through Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from knotwork.functions.text import ENTITY, markup, strip

_LETTERS = "a-zA-ZçğıöşüÇĞİÖŞÜ"
_BLOCK = re.compile(markup(".*?", r"\(.*?\)"))
# The letter that follows is taken along, so of two neighbours in "A. B. C" only the first is held back.
_NUMBER_DOT = re.compile(rf"(\d+)\.(\s*[{_LETTERS}])")
_SHORT_DOT = re.compile(rf"\b([{_LETTERS}]{{1,4}})\.(\s*[{_LETTERS}])")
_UPPER = "A-ZÇĞİÖŞÜ"
_END = re.compile(rf"(?<=[.!?])\s+(?=[{_UPPER}])")
#: Private-use characters stand for mentions and for dots that end nothing; neither is a letter, digit, space or end.
_MENTION, _DOT = "\ue000", "\ue001"


def split_sentences(text: str | None) -> list[str]:
    if not text:
        return []
    blocks = _BLOCK.findall(text)
    held = _BLOCK.sub(_MENTION, text)
    held = _NUMBER_DOT.sub(rf"\1{_DOT}\2", held)
    held = _SHORT_DOT.sub(rf"\1{_DOT}\2", held)
    out, at = [], 0
    for part in _END.split(held.strip()):
        pieces = part.replace(_DOT, ".").split(_MENTION)
        whole = pieces[0]
        for p in pieces[1:]:
            whole += (blocks[at] if at < len(blocks) else _MENTION) + p
            at += 1
        if whole.strip():
            out.append(whole.strip())
    return out


@pandas_udf(ArrayType(StringType()))
def _with_mentions(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(split_sentences)


def plain_sentences(text: Column) -> Column:
    """split_sentences() for texts without mentions, as a column."""
    held = F.regexp_replace(text, rf"(?U)(\d+)\.(\s*[{_LETTERS}])", f"$1{_DOT}$2")
    held = F.regexp_replace(held, rf"(?U)\b([{_LETTERS}]{{1,4}})\.(\s*[{_LETTERS}])", f"$1{_DOT}$2")
    parts = F.split(strip(held), rf"(?U)(?<=[.!?])\s+(?=[{_UPPER}])")
    return F.filter(F.transform(parts, lambda p: strip(F.replace(p, F.lit(_DOT), F.lit(".")))), lambda p: p != "")


def sentences(text: Column | str) -> Column:
    """The sentences of each text; none for null. Python sees nulls but for the texts with mentions."""
    c = F.col(text) if isinstance(text, str) else text
    marked = F.coalesce(c.contains(f"<{ENTITY}>"), F.lit(False))
    return F.when(marked, _with_mentions(F.when(marked, c))).otherwise(F.coalesce(plain_sentences(c), F.array().cast("array<string>")))


def numbered(df, title: str, sentences_col: str):
    """A row for each sentence with its id title#n, n from 1 in each page."""
    at = F.posexplode(sentences_col).alias("pos", "sentence")
    return df.select("*", at).withColumn("sent_id", F.concat(F.col(title), F.lit("#"), F.col("pos") + 1)).drop(sentences_col)
