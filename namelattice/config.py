"""Settings of a run, all explicit; thresholds apply to ratios of child tokens."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path
from types import SimpleNamespace

UNKNOWN, CONTAINER, COMPOSITE, UNINTELLIGIBLE, COLLECTION = "UNKNOWN", "CONTAINER", "COMPOSITE", "UNINTELLIGIBLE", "COLLECTION"
#: A class name that is never reported.
SKIPPED_CLASS = "nnnn"


#: Where a settings file is looked for, in order.
PLACES = ("config", "../config", "inference/config")


def read_settings(name: str = "config.json", places: tuple[str, ...] = PLACES, output_key: str = "OUTPUTFOLDER") -> SimpleNamespace:
    """All keys of a JSON settings file, on the driver, as attributes; the first of ``places`` that has it, or ``name`` as a path.

    The folder that ``output_key`` names is made.  A file that is missing or no
    JSON object is an error that names it.
    """
    tried = [Path(name), *(Path(place) / name for place in places)]
    path = next((p for p in tried if p.is_file()), None)
    if path is None:
        raise FileNotFoundError(f"no settings file {name} in {', '.join(map(str, places))}")
    try:
        found = json.loads(path.read_text(encoding="utf-8"))
    except ValueError as error:
        raise ValueError(f"{path} is not valid JSON: {error}") from error
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no JSON object")
    if found.get(output_key):
        Path(found[output_key]).mkdir(parents=True, exist_ok=True)
    return SimpleNamespace(**found)


@dataclass(frozen=True)
class Config:
    similarity: float = 0.9
    refinement: float = 0.9
    cleanup: float = 0.8
    least_members: int = 2
    most_members: int = 150
    #: Features below this leave a class UNKNOWN.
    class_floor: float = 1.0
    #: "concat" joins tokens without a mark, so that A+BC and AB+C are one node; "path" keeps them apart.
    id_mode: str = "concat"
    #: "truncate" reads three-letter names as their first letter, "fixed" as they are.
    uncamel: str = "truncate"
    #: "nested" leaves point alternatives appended as one list, as they are scored by; "flat" adds each.
    catalog_merge: str = "nested"
    #: "stop" ends labelling when points run out; "overwrite" goes on with score -1.
    overflow: str = "stop"

    @classmethod
    def of(cls, settings: SimpleNamespace) -> "Config":
        """The settings that a run knows, by name in any case; others are left to their readers."""
        given = {k.lower(): v for k, v in vars(settings).items()}
        return cls(**{f.name: type(f.default)(given[f.name]) for f in fields(cls) if f.name in given})
