"""Rule packs as data.

The decision-corpus pack reproduces the published matcher rules; the
licence pack is the one our fixtures exercise (licence sentences and
frequent short words in ``documents``).
"""

from __future__ import annotations

from .rules import ANY, RulePack, exact, fuzzy, gap, lemma

# ---------------------------------------------------------------------------
# Decision-corpus matcher rules (case type, appellant type,
# outcome), their label priorities and the lemma forms of "refuse".
# ---------------------------------------------------------------------------
REFUSE_FORMS = ("refuse", "refuses", "refused", "refusing", "refusal")
LP, RP = exact("("), exact(")")

CASE_TYPE = RulePack({
    "Admissibility": [
        (exact("restricted"), gap(), fuzzy("admissibility")),
    ],
    "Opposition Division": [
        (exact("opposition"), exact("division")),
    ],
    "Patent Refusal": [
        (lemma("refuse", REFUSE_FORMS), gap(), exact("european", "*"), exact("patent", "*"), exact("application")),
    ],
})
CASE_TYPE_ORDER = ["Admissibility", "Opposition Division", "Patent Refusal"]

APPELLANT_TYPE = RulePack({
    "3": [
        (fuzzy("patent"), exact("proprietor"), exact("and"), gap(5), fuzzy("opponent")),
        (fuzzy("proprietor"), gap(3), LP, gap(5), fuzzy("appellant"), gap(5), RP, gap(10),
         fuzzy("opponent"), gap(3), LP, gap(5), fuzzy("appellant"), gap(5), RP),
        (fuzzy("opponent"), gap(3), fuzzy("proprietor"), fuzzy("appeal")),
    ],
    "2": [
        (fuzzy("appellant"), gap(3), LP, gap(5), fuzzy("opponent"), gap(5), RP),
        (fuzzy("opponent"), gap(3), LP, gap(5), fuzzy("appellant"), gap(3), RP),
        (fuzzy("opponent"), gap(3), fuzzy("appeal")),
        (fuzzy("appeal"), exact("of"), fuzzy("opponent")),
    ],
    "1": [
        (fuzzy("appellant"), gap(3), LP, gap(5), fuzzy("patent"), gap(3), RP),
        (fuzzy("proprietor"), gap(3), LP, gap(5), fuzzy("appellant"), gap(3), RP),
        (fuzzy("appellant"), gap(3), LP, gap(5), fuzzy("proprietor"), gap(3), RP),
        (fuzzy("patent"), gap(3), LP, gap(5), fuzzy("appellant"), gap(3), RP),
        (fuzzy("proprietor"), gap(3), fuzzy("appeal")),
        (fuzzy("appeal"), exact("by"), exact("the"), fuzzy("proprietor")),
    ],
})
APPELLANT_ORDER = ["3", "2", "1"]

OUTCOME = RulePack({
    "Affirmed": [
        (fuzzy("appeal"), gap(), exact("dismissed")),
        (fuzzy("appeal"), gap(), exact("rejected")),
    ],
    "Reversed": [
        (fuzzy("appeal"), gap(), exact("set"), exact("aside")),
    ],
}, default="Unknown")
OUTCOME_ORDER = ["Affirmed", "Reversed"]

# ---------------------------------------------------------------------------
# Fixture pack: licence statements and short-word gap rules.
# ---------------------------------------------------------------------------
LICENCE = RulePack({
    "copyleft": [
        (exact("gnu"), gap(2), exact("public"), fuzzy("license")),
    ],
    "permissive": [
        (fuzzy("licensed"), exact("under"), gap(1), exact("apache")),
        (lemma("release", ("release", "released", "releases")), exact("under"), exact("the"), exact("mit")),
    ],
    "creative": [
        (fuzzy("licensed"), exact("under"), exact("cc")),
    ],
    "licensed": [
        (fuzzy("license"),),
    ],
    "with_the": [
        (exact("with"), gap(2), exact("the"), ANY, exact("of")),
    ],
    "and_of": [
        (exact("and"), gap(3), exact("of"), gap(), exact("that")),
    ],
})
LICENCE_ORDER = ["copyleft", "permissive", "creative", "licensed", "with_the", "and_of"]
