from .stream import Memory, StreamError, run_stream, stateful_unique, transform_stream  # noqa: F401
