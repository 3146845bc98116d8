"""The source registry: parsed on the driver, where a registry is a few hundred entries, to a typed table."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from pressloom.schemas import fields

SOURCES = fields("id string, name string, url string, site string, categories string[], lean string, confidence string, source_type string, country string, ownership string, notes string, enabled boolean")
DEFAULTS = {"lean": "unknown", "confidence": "low", "source_type": "digital-native", "country": "US", "enabled": True}
LEANS = {"left", "center-left", "center", "center-right", "right", "state-affiliated", "not-applicable", "unknown"}


class RegistryError(ValueError):
    """A registry that gives no usable source."""


def as_list(value: object) -> list[str]:
    parts = [] if value is None else value.split(",") if isinstance(value, str) else value if isinstance(value, list) else [value]
    return [t for p in parts if (t := str(p).strip())]


def parse_registry(data: object) -> list[dict]:
    """Usable entries: mappings with id and http(s) url, the first of an id; defaults fill what is missing."""
    data = data if isinstance(data, dict) else {}
    base = DEFAULTS | (data.get("defaults") or {})
    out: dict[str, dict] = {}
    for entry in data.get("sources") or []:
        if not isinstance(entry, dict):
            continue
        e = base | entry
        ident, url = str(e.get("id") or "").strip(), str(e.get("url") or "").strip()
        if not ident or ident in out or not url.startswith(("http://", "https://")):
            continue
        row = {f.name: None if (v := e.get(f.name)) is None else v if f.name in ("enabled", "categories") else str(v) for f in SOURCES.fields}
        row |= {"id": ident, "url": url, "name": str(e.get("name") or ident), "categories": as_list(e.get("categories")), "enabled": bool(e["enabled"])}
        row["lean"] = row["lean"] if row["lean"] in LEANS else "unknown"
        row["confidence"] = row["confidence"] if row["confidence"] in ("low", "medium", "high") else "low"
        out[ident] = row
    if not out:
        raise RegistryError("no usable source")
    return list(out.values())


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources from a JSON or, where a YAML reader is installed, YAML file."""
    try:
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            import yaml

            data = yaml.safe_load(text)
        else:
            data = json.loads(text)
    except (OSError, ValueError, ImportError) as why:
        raise RegistryError(str(why)) from why
    rows = parse_registry(data)
    return spark.createDataFrame([tuple(r[f.name] for f in SOURCES.fields) for r in rows], SOURCES)
