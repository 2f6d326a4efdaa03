"""Evaluation telemetry and text corpora on Spark: what users import most."""

from runlens.functions.hooks import HookSpec, hook_metrics, run_hook
from runlens.schema import SCHEMA_VERSION, TABLES, describe_schema
from runlens.sources.runs import discover_runs, fingerprints, load_signals, read_manifest, read_results, read_sample_metrics, read_table

__all__ = [
    "SCHEMA_VERSION", "TABLES", "HookSpec", "describe_schema", "discover_runs", "fingerprints", "hook_metrics", "load_signals", "read_manifest",
    "read_results", "read_sample_metrics", "read_table", "run_hook",
]
