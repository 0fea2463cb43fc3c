"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizspark.session import checkpoint_dir

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(r"[\x20\x09-\x0D]")
PIECE_CHARS = 1 << 20
BATCH_ROWS = 1_000


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is 0 modulo 5. A null id counts as
    the empty text (crc 0), so such a row is never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name = "_" + name
    return name


def shared_table(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts the lineage, and every executor can read it again. ``options``
    are those of the writer."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Slices of a long text, cut at ASCII white space only, so that words stay
    whole and memory per step stays bounded. Joined, they are the text."""
    start, n = 0, len(text)
    while n - start > size:
        m = _SPACE.search(text, start + size)
        if m is None:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` whole texts where the session still has
    Spark's default of 10,000; a size that the caller chose stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def text_udf(start: Callable[[], Callable[[str | None], object]], returns: str, arrow_type: pa.DataType) -> Callable[[Column], Column]:
    """A column function of texts. ``start`` is called once per task and gives the
    function of one text. A batch stays in its Arrow buffer and one text at a
    time is decoded, so that a worker holds no second copy of a batch."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = start()
        for texts in batches:
            out = pa.array([of(t.as_py()) for t in texts], arrow_type)
            del texts  # before the next batch is read
            yield out
    udf = F.arrow_udf(run, returns)

    def column(text: Column) -> Column:
        bounded_batches(SparkSession.active())
        return udf(text)
    return column


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; reads no more than one
    row beyond the bound from each partition."""
    return df.limit(max_rows + 1).count() <= max_rows
