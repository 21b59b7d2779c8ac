"""Tokens, white space and stems."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webrank.config import STOP_WORDS

#: White space as Unicode sees it; the engines' own \s is narrower.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def tokenize(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; none for a null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def tokenize_with_stop_words(text: Column) -> Column:
    """Tokens that aren't all digits."""
    return F.filter(tokenize(text), lambda t: ~t.rlike("^[0-9]+$"))


def tokenize_content(text: Column) -> Column:
    """Tokens that are neither all digits nor stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(tokenize_with_stop_words(text), lambda t: ~F.array_contains(stop, t))


@F.pandas_udf(T.StringType())
def stem_word(words: pd.Series) -> pd.Series:
    from webrank.functions.porter2 import stem

    return words.map(stem)


#: Words whose stems a worker remembers.
REMEMBERED = 1 << 17


@lru_cache(REMEMBERED)
def remembered_stem(word: str) -> str:
    from webrank.functions.porter2 import stem

    return stem(word)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_words(words: pa.Array) -> pa.Array:
    """Arrays of words as arrays of stems; a batch's distinct words are stemmed, unless the worker still knows them."""
    coded = words.flatten().dictionary_encode()
    stems = pa.array(map(remembered_stem, coded.dictionary.to_pylist()), pa.string())
    return pa.ListArray.from_arrays(pc.subtract(words.offsets, words.offsets[0]), stems.take(coded.indices))


def stemmed(tokens: DataFrame, column: str = "term") -> DataFrame:
    """tokens with `column` stemmed.  The stemmer sees each distinct word once; words meet stems in a join."""
    words = tokens.select(column).distinct().withColumn("_stem", stem_word(F.col(column)))
    return tokens.join(words, column).withColumn(column, F.col("_stem")).drop("_stem")


@F.pandas_udf(T.StringType())
def to_text(content: pd.Series) -> pd.Series:
    """UTF-8 without the bytes that are invalid; a null is empty."""
    return content.map(lambda b: "" if b is None else bytes(b).decode("utf-8", "ignore"))
