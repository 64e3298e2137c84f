from assaylake.streaming.answers import parse_answer_stream  # noqa: F401
