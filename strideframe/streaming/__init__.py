"""The fixed-length epoch operator on unbounded input."""

from strideframe.streaming.epochs import epoch_statistics  # noqa: F401
from strideframe.streaming.sessions import batch_segments, distinct_events, sessions, stream_segments  # noqa: F401
