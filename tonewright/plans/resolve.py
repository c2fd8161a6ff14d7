"""A knowledge base as a profile sees it: the house's, or a speaker's overlay on it."""

from __future__ import annotations

import os
import re

from tonewright.functions import vocab as V
from tonewright.plans import markdown

SLUG = re.compile(r"[a-z][a-z0-9-]{0,39}")


def overlay_root(root: str, slug: str) -> str:
    return os.path.join(root, "profiles", slug)


def speakers(config: dict) -> list[str]:
    return sorted(p for p in config["profiles"] if p != "default")


def merged_rules(house: list[dict], overlay: list[dict], locks: list[str]) -> tuple[list[dict], list[str], list[str]]:
    """(rules, ids that the overlay replaces, locked ids that it tried to).  Voice rules replace
    the house's as a set, locked ones stay; the others replace by id unless locked."""
    voiced = any(r["id"].startswith("V") for r in overlay)
    own, home, held = {r["id"] for r in overlay}, {r["id"] for r in house}, set(locks)
    is_voice = lambda r: r["id"].startswith("V")
    kept = [r for r in house if (not voiced if is_voice(r) else r["id"] in held or r["id"] not in own)]
    new = [r for r in overlay if is_voice(r) or r["id"] not in held]
    last = [r for r in house if is_voice(r) and voiced and r["id"] in held]
    mark = lambda rows, origin: [r | {"origin": origin, "locked": origin == "house" and r["id"] in held} for r in rows]
    overrides = [r["id"] for r in new if not is_voice(r) and r["id"] in home]
    return mark(kept, "house") + mark(new, "speaker") + mark(last, "house"), overrides, [r["id"] for r in overlay if not is_voice(r) and r["id"] in held & home]


def resolve(root: str, slug: str = "default") -> dict:
    """`read_kb` with rules merged, and what the profile changes.  Default dials and cells are
    the speaker's alone, vectors merge row by row, channels and locales by name; the ledger is
    shared, and so the ids of every overlay travel along."""
    house = markdown.read_kb(root)
    config, locks = house["config"], list(house["config"].get("locks") or [])
    overlays = {s: markdown.read_kb(overlay_root(root, s)) for s in speakers(config) if os.path.isdir(overlay_root(root, s))}
    universe = sorted({r["id"] for r in house["rules"]} | {r["id"] for o in overlays.values() for r in o["rules"]})
    base = {"profile": slug, "role": "house", "locks": locks, "overrides": [], "lock_violations": [], "offset": None, "known_ids": universe, "drafts_root": os.path.join(root, ".drafts")}
    if slug not in overlays:
        return house | base | {"rules": merged_rules(house["rules"], [], locks)[0]}
    own = overlays[slug]
    rules, overrides, violations = merged_rules(house["rules"], own["rules"], locks)
    offset = None
    if own["default_dials"] is not None:
        neutral = {d: 0 if d == "humor" else 2 for d in V.DIALS}
        offset = {d: own["default_dials"].get(d, neutral[d]) - (house["default_dials"] or {}).get(d, neutral[d]) for d in V.DIALS}
    return house | base | {
        "role": "speaker",
        "rules": rules,
        "overrides": overrides,
        "lock_violations": violations,
        "cells": own["cells"],
        "default_dials": own["default_dials"],
        "vectors": {k: house["vectors"][k] | own["vectors"][k] for k in house["vectors"]},
        "channels": sorted({*house["channels"], *own["channels"]}),
        "locales": sorted({*house["locales"], *own["locales"]}),
        "unparsed": house["unparsed"] + [h | {"file": f"profiles/{slug}/{h['file']}"} for h in own["unparsed"]],
        "offset": offset,
    }
