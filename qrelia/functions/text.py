"""Text expressions: whitespace rules, document text, tokens, id casts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

# Fixed value: the code points str.split() treats as whitespace.
WHITESPACE = r"[\x09-\x0d\x1c-\x1f\x85\p{Z}]+"


def normalize_text(c: Column) -> Column:
    """Collapse whitespace runs to one space and trim; NULL stays NULL."""
    return F.trim(F.regexp_replace(c.cast("string"), WHITESPACE, " "))


def words(c: Column) -> Column:
    """Non-empty whitespace-separated words, as an array."""
    return F.array_remove(F.split(c, WHITESPACE), "")


def word_lists(texts: pa.Array) -> pa.ListArray:
    """``words`` of texts inside a task: Arrow splits at the same code points; a null text has no words."""
    lists = pc.utf8_split_whitespace(texts.cast(pa.string()).fill_null(""))
    found = lists.flatten()
    filled = pc.greater(pc.binary_length(found), 0)
    if pc.all(filled).as_py():
        return lists
    text = pc.list_parent_indices(lists).filter(filled).to_numpy()
    starts = np.searchsorted(text, np.arange(len(lists) + 1))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), found.filter(filled))


def bm25_tokenize(c: Column) -> Column:
    """Lower-cased words."""
    return words(F.lower(c))


def max_tokens(c: Column, n: int) -> Column:
    """The first ``n`` whitespace words of a text."""
    return F.array_join(F.slice(words(c), 1, n), " ")


def falsy_to_empty(df: DataFrame, name: str | None) -> Column:
    """Column ``name`` as a string; NULL, an absent column, the number 0 and false are read as ''."""
    if name is None or name not in df.columns:
        return F.lit("")
    text = F.coalesce(df[name].cast("string"), F.lit(""))
    if isinstance(df.schema[name].dataType, (NumericType, BooleanType)):
        return F.when(df[name].cast("double") == 0, "").otherwise(text)
    return text


def corpus_text(title: Column, text: Column) -> Column:
    """Title and text on two lines, or whichever of them is not empty."""
    return F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(text, F.lit("")))


def cast_id(c: Column) -> Column:
    return c.cast("string")


def cast_score(c: Column) -> Column:
    """Relevance as an integer; fractions are cut off, not rounded."""
    return c.cast("int")
