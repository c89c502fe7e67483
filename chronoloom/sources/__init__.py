"""Reading raw tables and writing result tables."""

from chronoloom.sources.readers import SourceSpec, read_source, read_split_text
from chronoloom.sources.sinks import result_name, write_results

__all__ = ["SourceSpec", "read_source", "read_split_text", "result_name", "write_results"]
