from lapsewise.streaming.ingest import ingest_stream, staged_from_stream, stream_sources

__all__ = ["ingest_stream", "staged_from_stream", "stream_sources"]
