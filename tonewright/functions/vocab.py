"""Vocabularies, word lists, thresholds and patterns of the domain."""

from __future__ import annotations

STATES = ("delighted", "curious", "focused", "uncertain", "confused", "frustrated", "anxious-at-risk", "disappointed-leaving")
CONTEXTS = ("marketing-page", "product-ui", "system-error", "help-doc", "email", "social", "legal-policy", "notification", "support-reply", "release-notes")
DIALS = ("warmth", "humor", "directness", "detail", "urgency", "formality")
HUMOR_FREE_STATES = ("frustrated", "anxious-at-risk", "disappointed-leaving")
CONFIDENCES = ("confirmed", "derived", "assumed", "disputed")
EVIDENCE_TYPES = ("source", "corpus", "interview", "correction", "decision")
ID_PREFIXES = ("V", "T", "L", "M", "C", "A", "X")
STAGES = ("scan", "ingest", "measure", "draft", "interview", "canonize")
CONTRIBUTING = ("used", "missing", "stale")
THRESHOLDS = {"corroboration": 2, "derived_min_samples": 5, "stale_months": 9, "drift_pct": 25}

FIRST_PERSON = {
    "en": ("i", "me", "my", "mine", "we", "us", "our", "ours"),
    "cs": ("ja", "me", "mne", "muj", "moje", "my", "nas", "nam", "nase"),
    "de": ("ich", "mich", "mir", "mein", "wir", "uns", "unser"),
}
SECOND_PERSON = {
    "en": ("you", "your", "yours", "you're", "you'll", "you've"),
    "cs": ("ty", "tebe", "tvuj", "tvoje", "vy", "vas", "vam", "vase"),
    "de": ("du", "dich", "dir", "dein", "ihr", "euch", "euer", "sie", "ihnen"),
}
HEDGES = ("maybe", "perhaps", "might", "could", "somewhat", "fairly", "rather", "seems", "appears", "generally", "usually", "often", "probably", "possibly", "just", "simply", "basically", "essentially", "quite", "slightly")
INTENSIFIERS = ("very", "really", "extremely", "incredibly", "super", "totally", "absolutely", "highly", "completely", "definitely", "literally")
OPENERS = (
    "add", "browse", "check", "choose", "click", "connect", "copy", "create", "delete", "download", "edit", "enable", "enter", "explore", "find", "get",
    "go", "install", "join", "learn", "log", "make", "open", "pick", "read", "remove", "rename", "reset", "review", "save", "schedule", "select", "send",
    "set", "share", "sign", "start", "stop", "switch", "try", "turn", "update", "upgrade", "upload", "use", "view", "visit", "write",
)
MINOR_WORDS = ("a", "an", "the", "and", "or", "but", "of", "in", "on", "to", "for", "with")
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "st", "vs", "etc", "fig", "no", "inc", "ltd", "co", "jr", "sr", "approx", "dept", "est", "vol", "al", "e.g", "i.e")

#: White space of the reference language's regexes, as a class body for both engines.
SPACE = r"\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WORD = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
#: Pictographic ranges (the public emoji data's letterless part).
EMOJI = r"[\x{00a9}\x{00ae}\x{203c}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21a9}-\x{21aa}\x{231a}-\x{231b}\x{2328}\x{23cf}\x{23e9}-\x{23f3}\x{23f8}-\x{23fa}\x{24c2}\x{25aa}-\x{25ab}\x{25b6}\x{25c0}\x{25fb}-\x{25fe}\x{2600}-\x{27bf}\x{2934}-\x{2935}\x{2b05}-\x{2b07}\x{2b1b}-\x{2b1c}\x{2b50}\x{2b55}\x{3030}\x{303d}\x{3297}\x{3299}\x{1f000}-\x{1faff}]"
BE_VERBS, PARTICIPLES = "am|is|are|was|were|be|been|being", "born|done|made|given|taken|seen|known|written|shown|held|sent|built|kept|found|put|set|read"
SERIAL_LIST = r"(?i)[A-Za-z0-9_'’\-]+\s*,\s*[A-Za-z0-9_'’\-]+(?:\s*,)?\s+(?:and|or)\s+[A-Za-z0-9_'’\-]+"
OXFORD = r"(?i),\s+(?:and|or)\s+"
CONTRACTION_TAIL = "t|s|re|ve|ll|d|m"

HISTOGRAM = (("h_1_5", 0, 5, 3.0), ("h_6_10", 6, 10, 8.0), ("h_11_20", 11, 20, 15.5), ("h_21_40", 21, 40, 30.5), ("h_41p", 41, None, 41.0))

#: Quality gate.
QUALITY = {"long": 0.015, "single": 0.10, "repl": 0.005, "glyph": 0.5}
SINGLE_LETTERS = {"en": "aio", "cs": "aikosuvz", "sk": "aikosuvz", "de": "", "fr": "ay", "es": "aeouy", "it": "aeio"}
COMPOUNDING = ("de", "nl", "fi", "hu", "sv", "da", "no", "is")
LONG_TOKEN, LONG_TOKEN_COMPOUNDING, MIN_SHAPE_TOKENS = 20, 30, 10
AUTHORED_FORMATS = ("text", "markdown", "json", "yaml", "po", "csv", "tsv", "subtitles")
VOWELS = "aeiouyáéíóúůýěäöüåøæàèìòùâêîôû"

TEXT_FORMATS = {
    "md": "markdown", "mdx": "markdown", "markdown": "markdown", "json": "json", "yml": "yaml", "yaml": "yaml", "po": "po", "pot": "po",
    "html": "html", "htm": "html", "txt": "text", "rtf": "rtf", "vtt": "subtitles", "srt": "subtitles", "csv": "csv", "tsv": "tsv",
}
CONTAINER_FORMATS = {x: x for x in ("pdf", "docx", "pptx", "xlsx", "odt", "odp", "ods")}

#: Default dial vectors: warmth, humor, directness, detail, urgency, formality.
STATE_VECTORS = {
    "delighted": (4, 3, 2, 1, 1, 1), "curious": (3, 2, 3, 3, 1, 2), "focused": (2, 1, 4, 2, 2, 2), "uncertain": (3, 1, 4, 3, 1, 2),
    "confused": (3, 1, 4, 4, 2, 2), "frustrated": (2, 0, 4, 3, 2, 2), "anxious-at-risk": (3, 0, 4, 3, 3, 3), "disappointed-leaving": (3, 0, 4, 2, 1, 3),
}
CONTEXT_OFFSETS = {
    "marketing-page": (1, 1, 0, -1, 1, -1), "product-ui": (0, 0, 1, -1, 0, 0), "system-error": (-1, -2, 1, 0, 0, 0), "help-doc": (0, -1, 1, 2, -1, 0), "email": (1, 0, 0, 0, 0, 0),
    "social": (1, 2, 0, -2, 0, -2), "legal-policy": (-1, -2, 1, 2, -1, 2), "notification": (0, 0, 1, -2, 1, 0), "support-reply": (1, -1, 1, 1, 0, 0), "release-notes": (0, 0, 1, 1, -1, 0),
}
#: Metrics watched for drift.
DRIFT_METRICS = ("mean_sentence_length", "median_sentence_length", "mean_word_length", "exclamation_rate", "question_rate", "emoji_per_1000", "contraction_per_1000", "reading_grade", "passive_rate")

#: Typography by locale: quotes, date, thousands, decimal, currency.
LOCALE_SEED = {
    "en-US": ('" "', "MM/DD/YYYY", ",", ".", "before: $9.99"),
    "en-GB": ('" "', "DD/MM/YYYY", ",", ".", "before: GBP 9.99"),
    "cs": ("low-high double quotes", "D. M. YYYY", "space", ",", "after: 9,99 CZK"),
    "de": ("low-high double quotes", "DD.MM.YYYY", ".", ",", "after: 9,99 EUR"),
    "fr": ("guillemets, spaced", "DD/MM/YYYY", "space", ",", "after: 9,99 EUR"),
    "es": ('guillemets or " "', "DD/MM/YYYY", ".", ",", "after: 9,99 EUR"),
    "pl": ("low-high double quotes", "DD.MM.YYYY", "space", ",", "after: 9,99 PLN"),
}
