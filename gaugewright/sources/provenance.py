"""What a run was: fingerprints, atomic JSON, logs, metadata, manifests, configuration."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import tempfile
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of experiment metadata that have to be there, with their types.
REQUIRED = {"experiment_id": str, "run_id": str, "dataset": str, "random_state": int, "n_splits": int, "n_repetitions": int, "models": list, "created": str, "environment": dict}


def file_fingerprint(path: str) -> str:
    """SHA-256 of a text file's lines without white space at their ends, joined by line feeds."""
    with open(path, encoding="utf-8", errors="replace") as f:
        return hashlib.sha256("\n".join(line.rstrip() for line in f).encode()).hexdigest()


def table_fingerprint(df: DataFrame) -> str:
    """A hash of a table's rows whatever their order and partitions; not that of a file."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substring(row, i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 16, 31)]
    found = df.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(h), F.lit(0)) for h in halves]).first()
    return hashlib.sha256(":".join(str(x) for x in found).encode()).hexdigest()


def write_json(value: Any, path: str) -> None:
    """Write a JSON file whole: to a temporary name, to disk, then under its own."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    handle, draft = tempfile.mkstemp(dir=at.parent, suffix=".tmp")
    with os.fdopen(handle, "w") as f:
        json.dump(value, f, indent=2, default=str, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(draft, at)


class JsonLog:
    """A log of JSON lines."""

    def __init__(self, path: str):
        self.path = path

    def write(self, level: str, message: str, **meta: Any) -> None:
        with open(self.path, "a") as f:
            f.write(json.dumps({"timestamp": datetime.now(UTC).isoformat(), "level": level, "message": message, "meta": meta}, default=str) + "\n")


def environment() -> dict[str, str]:
    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "platform": platform.platform(), "cpu_count": str(os.cpu_count())}


def metadata(**values: Any) -> dict[str, Any]:
    """Experiment metadata with time and environment, checked."""
    found = {"created": datetime.now(UTC).isoformat(), "environment": environment()} | values
    for key, kind in REQUIRED.items():
        if not isinstance(found.get(key), kind):
            raise ValueError(f"metadata {key!r} has to be {kind.__name__}")
    return found


def load_config(path: str) -> dict[str, Any]:
    """A configuration from YAML, where PyYAML is there, or JSON, with the text's SHA-256."""
    text = Path(path).read_text()
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    validate_config(found)
    return found | {"_sha256": hashlib.sha256(text.encode()).hexdigest()}


def validate_config(config: dict[str, Any]) -> None:
    """An error for a configuration that can't run."""
    if not isinstance(config, dict):
        raise ValueError("a configuration is a mapping")
    if not isinstance(config.get("dataset"), dict):
        raise ValueError("configuration needs a mapping 'dataset'")
    if not config.get("models"):
        raise ValueError("configuration needs 'models'")
    if not 0 < config["dataset"].get("test_size", 0.3) < 1:
        raise ValueError("dataset.test_size lies between 0 and 1")
