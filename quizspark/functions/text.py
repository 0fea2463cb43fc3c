"""String helpers: word counts and report formatting."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _count_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([len(str(t.as_buffer(), "utf-8", "replace").split()) if t.is_valid else 0 for t in texts], pa.int64())


def word_count(text="prompt") -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``, over
    Arrow batches: a tenth of the time of a pattern, which makes a list of the
    words); 0 for NULL."""
    return F.arrow_udf(_count_words, T.LongType())(_col(text))


def as_percent(x, digits: int = 1) -> Column:
    """100 * x rounded to one decimal (report cells)."""
    return F.round(F.lit(100.0) * _col(x), digits)


def format_stat(statistic, pvalue, alpha: float = 0.05, pad: str = " ") -> Column:
    """'0.12*' when p < alpha, else '0.12' + pad (one space in most report
    tables, none in the pairwise table)."""
    mark = F.when(_col(pvalue) < alpha, F.lit("*")).otherwise(F.lit(pad))
    return F.format_string("%.2f%s", F.round(_col(statistic), 2), mark)


def response_file_name(model="model", dataset="dataset") -> Column:
    """'<last part of the model path>_<dataset>.json' (e.g. org/name -> name_medqa.json)."""
    return F.concat(F.element_at(F.split(_col(model), "/"), -1), F.lit("_"), _col(dataset), F.lit(".json"))


#: Common English words without content, for the registered query
#: and its SQL.
STOP_WORDS = tuple(
    "a about after all also an and any are as at be been but by can could did do does for from had has have he her his how i if "
    "in into is it its may more most no not of on or our out over she should so some such than that the their them then there "
    "these they this those to under up was we were what when which who will with would you your".split())
