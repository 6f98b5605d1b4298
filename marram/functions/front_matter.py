"""Front matter with nested values.

Scalars are kept as they are written; lists and mappings become JSON text. Where no
YAML reader is installed, or a block is no mapping, flat ``key: value`` lines are read.
"""

from __future__ import annotations

import json
import re

try:
    import yaml
except ImportError:
    yaml = None

_FLAT = re.compile(r"^([A-Za-z_][\w-]*):[ \t]*(.*?)[ \t]*$", re.M)


def parse(block: str | None) -> dict[str, str]:
    """Keys and values of a block between marks; empty for null. The last of equal keys wins."""
    if not block:
        return {}
    if yaml is not None:
        try:
            # every scalar is a string to this loader, and it makes no other objects
            got = yaml.load(block, Loader=yaml.BaseLoader)
        except yaml.YAMLError:
            got = None
        if isinstance(got, dict):
            return {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in got.items()}
    return {k: re.sub(r"^[\"'](.*)[\"']$", r"\1", v) for k, v in _FLAT.findall(block)}
