"""Row-local operators on Structured Streaming.

The workflow has no stream, but its row-local operators (answer parsing,
fingerprints, numeric transforms) are plain Column expressions and work on a
streaming DataFrame unchanged. :func:`parse_answer_stream` parses candidate
answers as they land: file source -> :func:`parse_answers` -> parquet sink,
with the progress checkpoint in the shared checkpoint folder so a restarted
job resumes where it stopped (exactly-once file sink).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaylake.operators.answers import parse_answers


def parse_answer_stream(spark: SparkSession, source: str, schema: str, sink: str,
                        checkpoint: str, to_candidates: Callable[[DataFrame], DataFrame],
                        fmt: str = "parquet", available_now: bool = True,
                        file_glob: str | None = None):
    """Start (and with ``available_now`` finish) the parsing stream.

    ``to_candidates`` maps the source rows to ``(query_id, candidate_no,
    text)``. ``source`` is a folder; ``file_glob`` picks files inside it.
    Returns the StreamingQuery.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    src = reader.load(source)
    pairs = parse_answers(to_candidates(src))
    writer = (pairs.writeStream.format("parquet").option("path", sink)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="10 seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q
