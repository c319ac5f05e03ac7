"""Questions about a repository as a whole: which of nine intents a question has, if any.

A question is read as words, and each word as the classes it belongs to (``CLASSES``).  An intent is a set of *cues*, short
sequences of words and classes.  A cue in ``[...]`` speaks of the whole only if no phrase after it names one part: "an overview"
and "an overview of the project" do, "an overview of the cart" doesn't.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of each class (fixed values: what stands for the repository, its parts, its plan and what it is made with).
CLASSES = {
    "WHOLE": "project repo repository codebase code app application system software program service library package tool monorepo",
    "OWN": "this the our my",
    "IT": "this it we",
    "A": "a an",
    "THING": "app application library tool framework service cli package monorepo plugin script server api",
    "AREAS": "components modules parts packages directories folders areas layers pieces subsystems services sections blocks",
    "FOLDER": "folder folders directory directories package packages module modules",
    "PLAN": "structure layout organization architecture design",
    "MADE": "organized structured built arranged designed architected",
    "AIM": "purpose point goal aim",
    "MAIN": "main major key core important different various top-level",
    "GENERAL": "overall whole entire general full big top-level",
    "SOLVE": "solve solving address",
    "WITH": "technology technologies language languages framework frameworks library libraries tools stack",
    "TELL": "summarize describe explain",
    "ALL": "everything all",
    "EACH": "each every all",
    "JOIN": "fit work connect relate",
    "HOLD": "contain hold have mean do",
    "BE": "is are was",
    "DO": "do does",
    "MAY": "should do can would",
    "READ": "read look open check start",
    "KIND": "kind type sort",
}

#: Words that mean the same here (fixed values).
SAME = {"organised": "organized", "organisation": "organization", "summarise": "summarize", "does": "do", "are": "is", "was": "is", "fits": "fit", "works": "work", "connects": "connect", "relates": "relate", "contains": "contain", "holds": "hold", "uses": "use", "used": "use", "using": "use"}

#: Cues of each intent, in the order in which intents are tried.  ``*`` is any one word or none, ``.`` the end of a noun phrase.
CUES = {
    "identity": ("what BE OWN WHOLE .", "what do OWN WHOLE do", "what do OWN WHOLE use for", "what OWN WHOLE is", "what OWN WHOLE do"),
    "purpose": ("AIM of OWN WHOLE", "what problem do IT * SOLVE", "what problem BE IT * SOLVE", "what problem do OWN WHOLE * SOLVE"),
    "kind": ("BE IT A THING", "BE IT A * THING", "BE IT A * * THING", "KIND of WHOLE BE IT"),
    "overview": ("[overview]", "GENERAL picture", "high-level", "bird's-eye", "foot view", "feet view", "at a glance", "[tour]", "TELL OWN WHOLE .", "TELL what OWN WHOLE", "summary of OWN WHOLE .", "walk me through OWN WHOLE .", "walk me through PLAN of OWN WHOLE"),
    "structure": (
        "how BE OWN * WHOLE MADE", "how BE OWN * WHOLE laid out", "how BE OWN * WHOLE put together", "how BE IT MADE", "how BE IT laid out", "how BE IT put together",
        "PLAN of OWN WHOLE", "[GENERAL PLAN]", "[architecture]", "[WHOLE PLAN]", "FOLDER structure", "FOLDER layout",
    ),
    "parts": ("[MAIN AREAS]", "[building blocks]", "what do EACH * * FOLDER HOLD", "which FOLDER HOLD", "which FOLDER is for"),
    "fit": ("ALL JOIN together", "it all JOIN together", "AREAS JOIN together", "AREAS do JOIN together", "ALL JOIN with each other", "AREAS JOIN to each other", "[how do * * * AREAS JOIN]"),
    "stack": ("tech stack", "technology stack", "what * WITH do IT use", "which * WITH do IT use", "WITH and WITH do IT use", "what * WITH is use .", "what * WITH do OWN WHOLE use", "which * WITH do OWN WHOLE use", "WITH is IT built with", "WITH is IT written in", "what is IT built with", "what is IT written in", "what is IT made with"),
    "onboarding": ("where MAY i start", "where MAY i begin", "what MAY i READ", "getting started", "get oriented", "get familiar", "getting familiar", "get up to speed", "onboarding", "joined the team", "joined the project", "joined team", "new here", "new to this", "new to OWN WHOLE"),
}

#: Words that begin a phrase about a part, words that lead its noun, and words at which a noun phrase ends (fixed values).
ABOUT = frozenset("of in for inside within behind about on".split())
LEADS = frozenset("the a an our this these those each every".split())
AFTER = frozenset("for about do is all actually to and or in of on please me us use used what how from".split())

_OF: dict[str, frozenset[str]] = {}
for _name, _words in CLASSES.items():
    for _w in _words.split():
        _OF[SAME.get(_w, _w)] = _OF.get(SAME.get(_w, _w), frozenset()) | {_name}
_CUES = tuple((name, tuple(c.strip("[]").split()), c.startswith("[")) for name, cues in CUES.items() for c in cues)
_WORD = re.compile(r"[a-z0-9]+(?:,[0-9]+)*(?:['-][a-z]+)*|[.?!;,:]")
_FILE = re.compile(r"\.(?:py|jsx?|tsx?|java|go|json|ya?ml|md|toml|rules)\b")


def names_code(question: str) -> bool:
    """Whether a word is a quoted name, a path, a file or an identifier, so that the question has one target."""
    if re.search(r"`[^`]+`", question):
        return True
    for word in question.split():
        bare = word.strip("\"'“”‘’()[]{}.,;:!?")
        humps = any(a.islower() and b.isupper() for a, b in zip(bare, bare[1:])) and bare[:1].islower()
        snake = "_" in bare.strip("_") and bare.islower()
        if humps or snake or _FILE.search(bare) or ("/" in bare and re.search(r"/[^/]*\.\w{1,5}$", bare)):
            return True
    return False


def read(question: str) -> list[str]:
    """The words and marks of a question in plain spelling."""
    text = question.lower().replace("’", "'").replace("code base", "codebase").replace("high level", "high-level").replace("top level", "top-level").replace("bird's eye", "bird's-eye")
    out: list[str] = []
    for w in _WORD.findall(text):
        if w.endswith("'s") and w != "bird's":
            out += [SAME.get(w[:-2], w[:-2]), "is"]
        elif w.endswith(("-foot", "-feet")):
            out += w.rsplit("-", 1)
        else:
            out.append(SAME.get(w, w))
    return out


def _ends(words: list[str], at: int, cue: tuple[str, ...]) -> Iterator[int]:
    """Where a cue that begins at word ``at`` may end."""
    if not cue:
        yield at
        return
    head, rest = cue[0], cue[1:]
    if head == ".":
        if at >= len(words) or not words[at][0].isalnum() or words[at] in AFTER:
            yield from _ends(words, at, rest)
        return
    if head == "*":
        yield from _ends(words, at, rest)
        if at < len(words) and words[at][0].isalnum():
            yield from _ends(words, at + 1, rest)
    elif at < len(words) and (words[at] == SAME.get(head, head) or head in _OF.get(words[at], ())):
        yield from _ends(words, at + 1, rest)


def names_part(words: list[str], at: int) -> bool:
    """Whether a phrase from word ``at`` on ("of the ...") is about something else than the whole."""
    if at + 2 >= len(words) or words[at] not in ABOUT or words[at + 1] not in LEADS:
        return False
    return "WHOLE" not in _OF.get(words[at + 2], ())


def intent(question: str | None) -> str | None:
    """The intent of a question about the whole repository; null for all others."""
    if not question or names_code(question):
        return None
    words = read(question)
    for name, cue, narrows in _CUES:
        for at in range(len(words)):
            if any(not (narrows and names_part(words, end)) for end in _ends(words, at, cue)):
                return name
    return None


def overview_intent(question: Column) -> Column:
    """``intent`` as a column.  What follows a cue decides, so it runs in Arrow batches."""

    @F.pandas_udf("string")
    def of(questions: pd.Series) -> pd.Series:
        return questions.map(intent)

    return of(question)
