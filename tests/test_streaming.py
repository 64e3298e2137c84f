"""The answer stream resumes from its checkpoint (exactly-once file sink)."""

from assaylake.plans import catalog as C
from assaylake.streaming import parse_answer_stream

SF = "/root/testdata/sf0.001"


def test_stream_restart_does_not_duplicate(spark, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    parse_answer_stream(spark, SF, C.EVENTS_SCHEMA, out, ckpt, C.event_candidates,
                        file_glob="events.parquet")
    first = spark.read.parquet(out).count()
    parse_answer_stream(spark, SF, C.EVENTS_SCHEMA, out, ckpt, C.event_candidates,
                        file_glob="events.parquet")
    assert spark.read.parquet(out).count() == first
    batch = C.QUERIES["parse_answers"](spark, SF).count()
    assert first == batch
