"""Parameters of the registered queries: clocks, patterns and a lexicon that the test corpus hits."""

from __future__ import annotations

AS_OF = "2025-10-01 00:00:00"
EVENTS_END = "2024-01-31 00:00:00"

#: The reference phrases are rare in the corpus, so the registered queries use words it has.
CORPUS_SIGNALS = {
    "academic": ["forgotten teacher", "careful (mentor|expert)", "another (early|sudden) lesson"],
    "contrarian": ["the habit of ignoring", "what happens if"],
    "meaning": ["the cost of keeping", "a fear of losing"],
    "implicit_insight": ["because (of|her|his|their)", "in the end"],
}

ELITE_AXES = [("punch", 1, 30), ("identity", 1, 20), ("tension", 1, 20), ("quotability", 1, 60)]

URL_PATTERNS = [("forum.example", "forum"), ("video.example", "video"), ("papers.example", "papers"), ("ledger", "ledger"), (".example", "other")]

PILLAR_TONE = {"PRODUCTIVITY": "URGENT", "RELATIONSHIPS": "WARM", "PHILOSOPHY": "CALM"}

#: A week's slots (number, pillar, format) and the angles a piece may take (name, active, pillars, formats, levels, multiplier).
SLOTS = [(i + 1, p, f) for i, (p, f) in enumerate(zip(["PRODUCTIVITY", "RELATIONSHIPS", "PHILOSOPHY", "SELF_CARE", "PRODUCTIVITY", "NEUROSCIENCE", "SELF_WORTH"] * 2, ["REEL", "CAROUSEL", "QUOTE", "REEL", "CAROUSEL"] * 3))]
ANGLES = [
    ("myth", True, ["PRODUCTIVITY", "NEUROSCIENCE"], ["REEL", "CAROUSEL"], [1, 3], 1.2),
    ("story", True, ["RELATIONSHIPS", "SELF_WORTH", "SELF_CARE"], ["REEL", "QUOTE"], [2, 5], 1.1),
    ("list", True, ["PRODUCTIVITY", "RELATIONSHIPS", "SELF_CARE"], ["CAROUSEL"], [1, 4], 1.0),
    ("question", True, ["PHILOSOPHY", "SELF_WORTH"], ["QUOTE", "REEL", "CAROUSEL"], [], 0.9),
    ("mirror", True, ["PRODUCTIVITY", "PHILOSOPHY"], ["REEL"], [4, 5], 1.3),
    ("retired", False, ["PHILOSOPHY"], ["QUOTE"], [1, 5], 2.0),
]
RATES = {"click": 0.5, "purchase": 1.0, "view": 0.1}
#: Score, least value that passes.
CRITERIA = [("hook", 6), ("voice", 7), ("share", 6), ("precision", 6), ("flow", 6), ("pace", 6), ("form", 6)]
