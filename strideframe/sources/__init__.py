"""Readers and writers for recordings, labels, features and results."""

from strideframe.sources.edf import EdfSource, read_edf  # noqa: F401
from strideframe.sources.eeg import eeg_channel_type, file_keys, read_sensor_layout  # noqa: F401
from strideframe.sources.recording_source import RecordingSource, on_common_span, scan_recordings  # noqa: F401
from strideframe.sources.recordings import (  # noqa: F401
    RecordingFiles,
    channel_table,
    discover_recordings,
    read_recordings,
    sniff_format,
    trim_to_common_span,
)
from strideframe.sources.tables import (  # noqa: F401
    entities,
    read_demographics,
    read_features,
    read_or_empty,
    read_profiles,
    read_segments,
    read_selection,
    read_stage,
    with_segments,
)
