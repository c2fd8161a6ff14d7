"""Reports: pure string functions over collected, small frames: the card, the ASCII status and
the HTML page.  Nothing here reads files or touches Spark."""

from __future__ import annotations

import html
import unicodedata

from tonewright.functions import vocab as V

WIDTH, LEAST, MOST = 72, 60, 120
#: Typographic characters that ASCII folds to.
FOLD = {"“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "‚": "'", "–": "-", "—": "-", "…": "...", "·": "-", "•": "*", "→": "->", "×": "x", "ß": "ss", "ø": "o", "ł": "l", "æ": "ae", " ": " "}


def to_ascii(s: str) -> str:
    flat = unicodedata.normalize("NFD", "".join(FOLD.get(c, c) for c in s))
    return "".join(c if c < "\x7f" else "?" for c in flat if not unicodedata.combining(c))


def width_of(n: int | None) -> int:
    return max(LEAST, min(MOST, n or WIDTH))


def truncate(s: str, n: int) -> str:
    return s if len(s) <= n else s[: max(0, n - 3)] + "..."


def bar(share: float | None, n: int = 20) -> str:
    if share is None:
        return "n/a".ljust(n)
    full = round(max(0.0, min(1.0, share)) * n)
    return "#" * full + "." * (n - full)


def delta_bar(delta: float | None, limit: float, n: int = 10) -> str:
    """Left of the middle for a fall, right for a rise; n/a where nothing can be said."""
    if delta is None:
        return "n/a".center(2 * n + 1)
    k = min(n, round(abs(delta) / (2 * limit) * n))
    return ("." * (n - k) + "#" * k + "|" + "." * n) if delta < 0 else ("." * n + "|" + "#" * k + "." * (n - k))


def panel(title: str, lines: list[str], width: int = WIDTH) -> str:
    head = f"+- {title} ".ljust(width - 1, "-") + "+"
    return "\n".join([head, *(f"| {truncate(to_ascii(x), width - 4).ljust(width - 4)} |" for x in lines), "+" + "-" * (width - 2) + "+"])


def status(state: dict, width: int | None = None, panels: tuple[str, ...] = ()) -> str:
    """`state` holds lists of dicts: stages, findings, matrix, rules, drift, sources, evidence,
    settings, speakers, gaps."""
    w = width_of(width)
    body = {
        "pipeline": [" > ".join(("[" + s + "]") if state.get("stages", {}).get(s) else s for s in V.STAGES)],
        "integrity": [f"{f['severity']:<8}{f['code']} {f['ref']}" for f in state.get("findings", [])] or ["no findings"],
        "coverage": [f"{c['context']:<16}{c['authored']}/{c['of']} {bar(c['authored'] / c['of'])} {c['traffic']} words" for c in state.get("matrix", [])],
        "rules": [f"{r['confidence']:<10}{r['n']}" for r in state.get("rules", [])],
        "drift": [f"{d['locale']:<6}{d['metric']:<26}{delta_bar(d['delta_pct'], V.THRESHOLDS['drift_pct'])}{' !' if d['flagged'] else ''}" for d in state.get("drift", [])],
        "sources": [f"{s['status']:<10}{s['n']}" for s in state.get("sources", [])],
        "evidence": [f"{e['type']:<12}{e['n']}" for e in state.get("evidence", [])],
        "settings": [f"{k}: {v}" for k, v in state.get("settings", {}).items()],
        "speakers": [f"{s['slug']:<16}{s['rules']} rules" for s in state.get("speakers", [])] or ["none"],
        "missing": [f"{g['severity']:<8}{g['id']} {g['what']}: {g['fix']}" for g in state.get("gaps", [])[:10]] + ([f"+{len(state['gaps']) - 10} more"] if len(state.get("gaps", [])) > 10 else []),
    }
    return "\n".join(panel(k, v, w) for k, v in body.items() if not panels or k in panels) + "\n"


def page(state: dict, title: str = "Status") -> str:
    """The same state as an HTML page; everything is escaped."""
    e = lambda x: html.escape(str(x), quote=True)

    def rows(name: str) -> str:
        items = state.get(name) or []
        items = [items] if isinstance(items, dict) else items
        if not items:
            return "<p>none</p>"
        heads = list(items[0])
        return "<table><tr>" + "".join(f"<th>{e(h)}</th>" for h in heads) + "</tr>" + "".join("<tr>" + "".join(f"<td>{e('n/a' if r[h] is None else r[h])}</td>" for h in heads) + "</tr>" for r in items) + "</table>"

    names = ("stages", "gaps", "matrix", "rules", "speakers", "drift", "findings", "sources", "evidence", "settings")
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1>" + "".join(f"<section><h2>{e(n)}</h2>{rows(n)}</section>" for n in names) + "</body></html>\n"


def first_clause(s: str, n: int = 60) -> str:
    cut = min((k for k in (s.find(c) for c in ".;") if k > 0), default=len(s))
    return truncate(s[:cut], n)


#: Fixed texts of the card.
CARD_HEAD = ("<!-- GENERATED FILE - do not edit by hand. Rebuild with sync -->", "", "# Voice & Tone - compiled card", "")
CARD_HUMOR = "Humor requires an **authored** tone cell. An interpolated cell never carries humor."
CARD_NONE = "_None yet._"


def _section(title: str, rows: list[str], none: str | None = CARD_NONE) -> list[str]:
    return [f"## {title}", "", *(rows or [none]), ""]


def card(kb: dict, lexicon: list[dict], mechanics: list[dict], profile: str = "default", generated: str = "", overlay: dict | None = None) -> str:
    """The compiled card: voice, dials, the most violated rules, gates, and where to look next.
    `lexicon` and `mechanics` are ranked, 8 and 6 of them are shown, and 6 voice rules; none is
    disputed.  A speaker's card lists the locked rules of the house apart and the rules it
    replaces; `overlay` tells which files the speaker has of its own (channels, locales,
    audience)."""
    config, speaking = kb["config"], kb.get("role") == "speaker"
    people, own = config["profiles"], overlay or {}
    me = people.get(profile, people["default"])
    agreed = [r for r in kb["rules"] if r["confidence"] != "disputed"]
    voice = [r for r in agreed if r["id"].startswith("V") and not (speaking and r.get("locked"))]
    who = f"**Brand:** {people['default'].get('name')} · " + (f"**Speaker:** {me.get('name')} ({profile})" if speaking else f"**Profile:** {profile}")
    spoken = ", ".join(me.get("locales") or []) or me.get("primary_locale") or "en"
    lines = [*CARD_HEAD, f"{who} · **Locales:** {spoken} · **KB version:** {config['kb_version']} · **Generated:** {generated}", ""]
    lines += _section("Voice - constant", [x for r in voice[:6] for x in (f"- **{r['name'] or r['id']}** (`{r['confidence']}`) - {r['cells'].get('Means', '')}", f"  - Rules out: {r['cells'].get('Rules out', '(unspecified)')}")])
    if speaking:
        rows = []
        for r in (r for r in agreed if r.get("locked")):
            c = r["cells"]
            if r["kind"] == "prose":
                rows.append(f"- **{r['id']}** {r['name'] or ''} - rules out {first_clause(c.get('Rules out') or c.get('Means') or '(unspecified)')}")
            else:
                rows.append(f"- **{r['id']}** - {first_clause(c.get('Avoid') or c.get('Rule') or next(iter(c.values()), ''))}")
        lines += _section("House guardrails (locked)", [*(rows or ["_None declared - see `locks:` in config.yml._"]), "Full wording: `lexicon.md`, `mechanics.md`, `voice.md` in the house."])
    dials = kb.get("default_dials") or {}
    lines += _section("Default dials", [" · ".join(f"{d} {dials.get(d, 0 if d == 'humor' else 2)}" for d in V.DIALS)])
    replaced = {f: [r["id"] for r in kb["rules"] if r["id"] in kb.get("overrides", ()) and r["file"] == f] for f in ("lexicon", "mechanics")}
    rows = [f"| {r['avoid'] or ''} | {r['prefer'] or ''} | {r['confidence'] or ''} |" for r in lexicon[:8]]
    tables = {"lexicon": ("Lexicon", ["| Avoid | Prefer | Conf |", "|---|---|---|", *rows] if rows else []), "mechanics": ("Mechanics", [f"- {r.get('rule') or r['id']} (`{r['confidence']}`)" for r in mechanics[:6]])}
    for f, (title, rows) in tables.items():
        lines += _section(f"{title} - most-violated first", rows)
        if speaking and replaced[f]:
            lines += [f"Overrides: {', '.join(replaced[f])} (house rule replaced)", ""]
    lines += _section("Humor gate", [CARD_HUMOR, f"These states force `humor 0` whatever the dials say: {' · '.join(V.HUMOR_FREE_STATES)}."])
    at = lambda kind, name=None: f"profiles/{profile}/" if speaking and (own.get(kind) if name is None else name in own.get(kind, ())) else ""
    named = lambda kind: ", ".join(f"`{at(kind, n)}{kind}/{n}.md`" for n in kb.get(kind, ())) or "_none yet_"
    tone = f"`{f'profiles/{profile}/' if speaking else ''}tone.md` - {len(kb['cells'])} authored of {len(V.CONTEXTS) * len(V.STATES)}"
    next_ = [("A tone cell", tone), ("A channel playbook", named("channels")), ("A locale pack", named("locales")), ("Who we write for", f"`{at('audience')}audience.md`"), ("Why a rule exists", "`evidence/ledger.md`")]
    if speaking:
        next_ += [("The house card", "`CONTEXT.md`"), ("The house voice, persona and self-reference rules", "`voice.md`")]
    lines += _section("Where to look next", ["| Need | Load |", "|---|---|", *(f"| {need} | {load} |" for need, load in next_)])
    return "\n".join(lines) + "\n"
