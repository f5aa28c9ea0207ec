"""Parameters of the registered queries: word lists and weights fitting the given tables."""

from __future__ import annotations

from wardline.operators.scoring import LexiconScorer
from wardline.plans.gates import GuardrailLists, ServiceLists

SEVERE = ["scum", "moron", "worthless", "disgusting"]
MODERATE = ["trash", "idiot", "clown", "stupid"]
BLACKLIST = {
    "contempt": ["worthless", "pathetic", "loser"],
    "insult": ["idiot", "clown", "moron"],
}
BLACKLIST_WORDS = [w for subs in BLACKLIST.values() for w in subs]

DOC_HIGH = ["moron", "worthless"]
DOC_LEXICON = {
    "scum": 4000, "disgusting": 4000, "moron": 4000, "worthless": 4000,
    "trash": 100, "idiot": 100, "clown": 100, "stupid": 100, "pathetic": 100, "loser": 100,
    "und": 3, "avec": 3, "para": 3, "with": 3,
}
DOC_GUARDRAIL = GuardrailLists(severe=DOC_HIGH, moderate=MODERATE)
DOC_SERVICE = ServiceLists(high=DOC_HIGH, secondary=BLACKLIST_WORDS)
DOC_SCORER = LexiconScorer(DOC_LEXICON)

CHAT_HIGH = ["es", "ha"]
CHAT_SECONDARY = ["de", "be", "ed"]
CHAT_LEXICON = {
    "at": 4000, "onen": 4000, "erti": 4000,
    "la": 100, "oned": 100, "with": 100,
    "der": 3, "que": 3, "this": 3, "from": 3,
}
CHAT_GUARDRAIL = GuardrailLists(severe=CHAT_HIGH, moderate=CHAT_SECONDARY)
CHAT_SERVICE = ServiceLists(high=CHAT_HIGH, secondary=CHAT_SECONDARY)
CHAT_SCORER = LexiconScorer(CHAT_LEXICON)
