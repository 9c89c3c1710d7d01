"""Configuration of runs, on the driver: nested settings, caps by pair, names of profiles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping

from parlance.operators.graph import SessionGraph


def merged(base: Mapping, over: Mapping) -> dict:
    """base with what over says; a mapping in both is merged in turn, anything else is replaced."""
    out = dict(base)
    for key, value in over.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = merged(out[key], value) if both else value
    return out


def pair_caps(items: Iterable[Mapping]) -> dict[str, int]:
    """Cap by pair key of items {pair: [a, b], value}, in any order of names; items without two names go."""
    out = {}
    for item in items:
        names = sorted(str(x).strip() for x in item.get("pair") or [])
        if len(names) == 2 and all(names):
            out["::".join(names)] = int(item["value"])
    return out


def cap_items(caps: Mapping[str, int]) -> list[dict]:
    """The items of pair_caps(), in order of pairs."""
    return [{"pair": key.split("::"), "value": value} for key, value in sorted(caps.items())]


def profile_name(prefix: str, phase: str, experiment: str, folder: str) -> str:
    """A name that is readable and, by a digest of all it depends on, one experiment's own."""
    plain = lambda text: "_".join(filter(None, "".join(c if c.isalnum() else " " for c in text).lower().split())) or "experiment"
    own = hashlib.sha1(f"{folder}::{phase}::{experiment}".encode()).hexdigest()[:10]
    return f"{prefix}_{plain(phase)}_{plain(experiment)}_{own}"


def graph_of(base: Mapping, experiment: Mapping | None = None) -> SessionGraph:
    """The session graph of settings {session_graph: {..., pair_overrides: {pair: {field: value}}}}; an experiment's pairs replace the base's pair by pair, its other fields one by one. Unknown fields are an error."""
    first, second = (dict((x or {}).get("session_graph") or {}) for x in (base, experiment))
    pairs = {**dict(first.pop("pair_overrides", None) or {}), **dict(second.pop("pair_overrides", None) or {})}
    fields = {k: v for k, v in {**first, **second}.items() if k != "enabled"}
    known = SessionGraph.__dataclass_fields__
    if odd := sorted(set(fields) - set(known)):
        raise ValueError(f"unknown settings of the session graph: {', '.join(odd)}")
    keyed = {"::".join(sorted(x.strip() for x in k.split("::"))): {f: float(x) for f, x in v.items()} for k, v in pairs.items()}
    return SessionGraph(**{k: type(known[k].default)(v) for k, v in fields.items()}, pairs=keyed)
