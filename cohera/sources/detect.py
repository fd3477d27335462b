"""Which format a file or folder has."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import SparkSession

# Formats by the files that mark them, most special first.
MARKERS = {
    "zoo_classes_json": ("classes.json", "theorems.json"), "frictionless": ("datapackage.json",), "ro_crate": ("ro-crate-metadata.json",),
    "codemeta": ("codemeta.json",), "citation_cff": ("CITATION.cff",),
}


def _listing(spark: SparkSession, path: str) -> tuple[bool, list[str]]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if fs.getFileStatus(at).isFile():
        return False, [at.getName()]
    return True, sorted(s.getPath().getName() for s in fs.listStatus(at))


def detect(spark: SparkSession, path: str) -> str:
    """The format's name, or unknown; files are found through Hadoop's file system."""
    folder, names = _listing(spark, path)
    if not folder:
        return _file_format(spark, path, names[0])
    for fmt, marks in MARKERS.items():
        if set(marks) <= set(names):
            return fmt
    found = (_file_format(spark, posixpath.join(path, n), n) for n in names if n.endswith(".json"))
    return next((f for f in found if f != "unknown"), "unknown")


def _file_format(spark: SparkSession, path: str, name: str) -> str:
    if name.lower().endswith(".pdf"):
        return "paper_pdf"
    if name == "CITATION.cff":
        return "citation_cff"
    if not name.endswith((".json", ".JSON")):
        return "unknown"
    raw = spark.read.format("binaryFile").load(path).select("content").first()
    try:
        data = json.loads(bytes(raw["content"]))
    except (ValueError, TypeError):
        return "unknown"
    records = lambda v: isinstance(v, list) and len(v) > 0 and isinstance(v[0], dict)
    if isinstance(data, dict):
        for fmt, keys in (("cobra_json", {"reactions", "metabolites", "genes"}), ("ro_crate", {"@context", "@graph"}), ("frictionless", {"name", "resources"})):
            if keys <= set(data):
                return fmt
        return "flat_json" if any(records(v) for v in data.values()) else "unknown"
    return "flat_json" if records(data) else "unknown"


def detect_with_report(spark: SparkSession, path: str) -> dict:
    """The format, the files found and the marker files that speak for it."""
    fmt = detect(spark, path)
    folder, names = _listing(spark, path)
    out = {"path": path, "format": fmt, "evidence": []}
    if folder:
        out["files_found"] = names
        out["evidence"] = [f"marker file present: {m}" for m in MARKERS.get(fmt, ()) if m in names]
    return out
