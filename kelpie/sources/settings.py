"""Settings and library roots: small text files that the driver reads."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def parse_settings(text: str) -> dict[str, str]:
    """NAME=value lines; blank lines, lines that begin with # and quotes around a value are left out."""
    out = {}
    for line in text.splitlines():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and not name.startswith("#") and name.strip().isidentifier():
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
            out[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].rstrip()
    return out


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """The settings of a file, by the session's file system."""
    return parse_settings("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def roots_with(registry: str, name: str, root: str) -> str:
    """A registry of library roots (JSON) with one more, or one changed; names in order."""
    known = json.loads(registry) if registry.strip() else {}
    return json.dumps(known | {name: root.rstrip("/")}, sort_keys=True)
