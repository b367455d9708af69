"""Post-processors: templates around the ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.spec import UnsupportedComponent

IDS = None  # the place of the ids in a compiled template


def _template(c: dict) -> list:
    named: dict[str, list[int]] = {}
    for s in (c.get("special_tokens") or {}).values():
        named[s.get("id")] = list(s.get("ids") or [])
    out: list = []
    for item in c.get("single") or []:
        if "SpecialToken" in item:
            out += named.get(item["SpecialToken"].get("id"), [])
        elif (item.get("Sequence") or {}).get("id") == "A":
            out.append(IDS)
    return out


def build(config: dict | None) -> list[list]:
    """Templates to apply in order; each is a list of ids and ``IDS``."""
    if not config:
        return []
    kind = config.get("type")
    if kind == "TemplateProcessing":
        return [_template(config)]
    if kind == "ByteLevel":
        return []
    if kind == "Sequence":
        return [t for c in config.get("processors") or [] for t in build(c)]
    raise UnsupportedComponent("post-processor", kind)


def apply(templates: list[list], ids: list[int]) -> list[int]:
    for t in templates:
        ids = [x for item in t for x in (ids if item is IDS else (item,))]
    return ids


def apply_column(templates: list[list], ids: Column) -> Column:
    for t in templates:
        parts, fixed = [], []
        for item in [*t, IDS]:
            if item is not IDS:
                fixed.append(F.lit(item))
                continue
            if fixed:
                parts.append(F.array(*fixed).cast("array<int>"))
                fixed = []
            parts.append(ids)
        parts.pop()
        # null ids stay null whatever the template holds
        ids = F.when(ids.isNotNull(), F.concat(*parts) if parts else F.array().cast("array<int>"))
    return ids


def added(templates: list[list]) -> int:
    """Ids that the templates put around a single sequence."""
    return len(apply(templates, []))
