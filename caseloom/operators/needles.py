"""Many literal needles in one pass over each text, where the needles fit in a task.

The needles are counted first; up to ``MOST`` of them and ``CHARACTERS`` in all they are sent to the tasks as
one automaton. Only ids leave the task: no text is shuffled, and no key of a text is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 200_000
CHARACTERS = 16_000_000


def bounded(needles: DataFrame, needle_id: str, needle: str) -> DataFrame | None:
    """The needles as a local table (needle_id, _needle), or None if they are too many."""
    rows = needles.filter(F.length(needle) > 0).select(needle_id, F.col(needle).alias("_needle"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("_needle")), F.lit(0)).alias("c")).first()
    if size.n > MOST or size.c > CHARACTERS:
        return None
    return needles.sparkSession.createDataFrame(rows.collect(), rows.schema)  # at most MOST rows


def occurring(texts: DataFrame, text_id: str, text: str, needles: DataFrame, needle_id: str) -> DataFrame:
    """(text_id, needle_id) where the text holds the needle; ``needles`` comes from ``bounded``."""
    strings = sorted({r._needle for r in needles.select("_needle").collect()})
    sent = texts.sparkSession.sparkContext.broadcast(strings)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for string in sent.value:
            automaton.add_word(string, string)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                hits = sorted({s for _, s in automaton.iter(value)}) if value and sent.value else []
                rows += [i] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())],
                                             names=[text_id, "_needle"])

    schema = T.StructType([texts.schema[text_id], T.StructField("_needle", T.StringType())])
    hits = texts.select(text_id, text).mapInArrow(work, schema)
    return hits.join(F.broadcast(needles), "_needle").select(text_id, needle_id)
