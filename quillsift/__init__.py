"""Spark-first inspection and conservative cleaning of text and file metadata."""

from quillsift.functions.kernels import Finding, Run, clean, findings, fold_confusables, inspect, is_load_bearing, load_bearing, protected_regions, strip_invisible, suspicious_runs
from quillsift.functions.taxonomy import CATEGORIES, RANKS, classify, compatibility_ascii, script_of, scripts_in
from quillsift.sources.containers import clean_bytes, detect_format, parse_bytes

__version__ = "0.1.0"
__all__ = [
    "CATEGORIES", "RANKS", "Finding", "Run", "classify", "clean", "clean_bytes", "compatibility_ascii", "detect_format", "findings", "fold_confusables", "inspect",
    "is_load_bearing", "load_bearing", "parse_bytes", "protected_regions", "script_of", "scripts_in", "strip_invisible", "suspicious_runs",
]
