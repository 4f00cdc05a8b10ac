"""Vocabularies of the house rules, and how their forms are made."""

from __future__ import annotations

import re

# Results depend on these lists and their order.
BANNED_WORDS = [
    "delve", "underscore", "testament", "foster", "maximize", "navigate", "tapestry", "catalyst", "elevate", "paradigm",
    "revolutionize", "paramount", "leverage", "harness", "unlock", "seamless", "robust", "realm", "landscape", "beacon",
    "game-changer", "cutting-edge", "utilize", "myriad", "vibrant", "bustling", "whimsical", "profound",
]
BANNED_PHRASES = [
    "in today's fast-paced world", "at its core", "it's important to note", "furthermore", "moreover", "in conclusion",
    "in summary", "let's face it", "but here's the kicker", "when it comes to", "in the realm of", "look no further",
    "rest assured", "needless to say", "not only", "but also", "whether you're", "that said", "in essence", "ultimately",
    "paradigm shift", "the dawn of", "in today's world",
]
REPLACEMENTS = {
    "delve": "examine", "underscore": "highlight", "testament": "sign", "foster": "encourage", "maximize": "increase",
    "navigate": "handle", "tapestry": "mix", "catalyst": "trigger", "elevate": "raise", "paradigm": "model",
    "revolutionize": "transform", "paramount": "essential", "leverage": "use", "harness": "use", "unlock": "enable",
    "seamless": "smooth", "robust": "strong", "realm": "area", "landscape": "field", "beacon": "example",
    "game-changer": "breakthrough", "cutting-edge": "advanced", "utilize": "use", "myriad": "many", "vibrant": "vivid",
    "bustling": "busy", "whimsical": "playful", "profound": "deep",
    "in today's fast-paced world": "today", "at its core": "essentially", "it's important to note": "note",
    "furthermore": "also", "moreover": "also", "in conclusion": "finally", "in summary": "overall",
    "let's face it": "admittedly", "but here's the kicker": "but", "when it comes to": "for", "in the realm of": "in",
    "look no further": "stop", "rest assured": "certainly", "needless to say": "clearly", "not only": "not just",
    "but also": "but", "whether you're": "whether you are", "that said": "still", "in essence": "essentially",
    "ultimately": "finally", "paradigm shift": "shift", "the dawn of": "the start of", "in today's world": "today",
}
METRIC_TERMS = ["perplexity", "ppl", "cross-entropy", "cross entropy", "log-likelihood", "log likelihood", "bleu", "rouge", "f1", "wer", "cer", "bits per byte", "bits-per-byte"]
METRIC_GROUPS = [["bits per byte", "bits-per-byte", "bpb"], ["perplexity", "ppl"], ["cross-entropy", "cross entropy"], ["log-likelihood", "log likelihood"]]
ASSERTIVE_VERBS = ["demonstrates", "demonstrated", "proves", "proven", "proved", "establishes", "established", "confirms", "confirmed", "guarantees", "guaranteed", "ensures", "ensured", "shows that", "showed that"]
CLAIM_TYPES = ["metric", "mechanism", "definition", "method", "result", "limitation"]
STRENGTHS = ["demonstrated", "hedged", "speculation-or-future-work"]
HEDGED = ["hedged", "speculation-or-future-work"]
WRITER_STOPWORDS = [
    "about", "above", "after", "again", "against", "along", "among", "around", "because", "before", "being", "below",
    "between", "beyond", "could", "does", "doing", "during", "either", "every", "framework", "further", "hence",
    "however", "into", "itself", "loops", "might", "other", "process", "rather", "result", "results", "since", "some",
    "such", "system", "than", "that", "their", "them", "then", "there", "these", "they", "those", "through", "under",
    "until", "using", "value", "when", "where", "which", "while", "with", "within", "would",
]
# Words that make no key term; only those of four letters or more are listed, as shorter ones never make any.
TERM_STOPWORDS = [
    "with", "from", "down", "about", "into", "onto", "over", "under", "after", "before", "between", "through", "during",
    "against", "within", "without", "across", "around", "among", "toward", "towards", "upon", "above", "below", "this",
    "that", "these", "those", "they", "them", "their", "theirs", "there", "here", "which", "whose", "what", "when",
    "where", "whom", "whichever", "some", "such", "each", "every", "both", "other", "another", "none", "several", "your",
    "yours", "ours", "hers", "were", "been", "being", "have", "does", "done", "will", "would", "shall", "should", "could",
    "might", "must", "wont", "cant", "dont", "isnt", "arent", "make", "makes", "made", "take", "takes", "taken", "took",
    "give", "gives", "given", "gave", "gets", "goes", "went", "come", "comes", "came", "uses", "used", "using", "turn",
    "turns", "turned", "mean", "means", "meant", "need", "needs", "needed", "want", "wants", "says", "said", "sees",
    "seen", "know", "knows", "known", "improve", "process", "provide", "provides", "keep", "keeps", "show", "shows",
    "shown", "find", "finds", "found", "look", "looks", "only", "same", "very", "much", "many", "more", "most", "less",
    "least", "than", "then", "also", "just", "like", "even", "still", "already", "often", "always", "never", "again",
    "once", "twice", "however", "therefore", "instead", "rather", "because", "since", "while", "whether", "though",
    "although", "almost", "enough", "quite", "really", "well", "thing", "things", "ways", "part", "parts", "kind",
    "kinds", "lots", "case", "cases", "point", "points", "fact", "facts", "time", "times", "year", "years", "days",
    "ones", "three", "first", "second", "third", "last", "next",
]
CATEGORIES = {"Finance": "bank[0-9A-Za-z_]*|finan[0-9A-Za-z_]*|fiduciary|ledger[0-9A-Za-z_]*", "Security": "security|dora|crypto[0-9A-Za-z_]*|audit[0-9A-Za-z_]*", "AI": "ai|agent[0-9A-Za-z_]*|model[0-9A-Za-z_]*|gemma[0-9A-Za-z_]*"}
EDIT_REASONS = ["banned word", "generic", "repeated opening", "forced choppiness", "weak ending", "filler", "factual correction"]
MIN_WORDS, MAX_WORDS = 500, 3000
MIN_QUOTE_CHARS = 12
#: Kinds of forms of an English word, each by its rules: the first whose ending the word has drops so many letters and adds its own.
INFLECTIONS = {
    "base": [("", 0, "")],
    "s": [("(?:s|x|z|ch|sh)", 0, "es"), ("", 0, "s")],
    "ed": [("e", 1, "ed"), ("", 0, "ed")],
    "ing": [("e", 1, "ing"), ("", 0, "ing")],
    "ly": [("ic", 0, "ally"), (".le", 1, "y"), ("[^aeiou]y", 1, "ily"), ("", 0, "ly")],
}
KINDS = list(INFLECTIONS)


def inflect(word: str, kind: str) -> str:
    """The form of an English word; an unknown kind leaves it as it is."""
    for ending, drop, add in INFLECTIONS.get(kind, ()):
        if re.search(rf"{ending}\Z", word):
            return word[: len(word) - drop] + add
    return word


def forms(word: str) -> list[tuple[str, str]]:
    """(form, kind) of all kinds."""
    return [(inflect(word, kind), kind) for kind in KINDS]


def metric_forms(term: str) -> list[str]:
    """Names of the same metric, the term's own group or itself."""
    return next((group for group in METRIC_GROUPS if term in group), [term])


def banned_families() -> list[list[str]]:
    """The forms of each banned word."""
    return [[form for form, _ in forms(word)] for word in BANNED_WORDS]


def banned_forms() -> list[str]:
    return [form for family in banned_families() for form in family]


def style_passes() -> list[tuple[str, str, bool]]:
    """(text to replace, replacement, whether word borders are required) in the order of the passes."""
    phrases = sorted(BANNED_PHRASES, key=lambda p: -len(p))
    passes = [(p, REPLACEMENTS[p], False) for p in phrases]
    for word in BANNED_WORDS:
        passes += [(form, inflect(REPLACEMENTS[word], kind), True) for form, kind in forms(word)]
    return passes
