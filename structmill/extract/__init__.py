"""Source text to nested rows: symbols, imports, exports, calls, tagged comments. One function per language family."""

from structmill.extract.files import extract, extract_files, extractor_version, supported_suffixes

__all__ = ["extract", "extract_files", "extractor_version", "supported_suffixes"]
