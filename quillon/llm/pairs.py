"""Broken prompt and response pairs: empty, truncated, refusing, copying and other-language answers.

Each defect has its own detector over the whole texts: a suffix automaton of the prompt measures how much of the answer is
copied from it; refusal automata over the words of a sentence find a speaker who declines; delimiter stacks and the end of
the last sentence tell truncation; votes of stopwords tell the languages of both sides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame

COPY_RUN, COPIED_ANSWER, COPIED_QUESTION = 3, 0.75, 0.6

# Word classes of the refusal automata (fixed values).  Contractions are written out before: "can't" is "can not".
SLOTS = {
    "MODAL": "can could will would may must shall should am do",
    "ACT": "help assist provide answer answering share sharing discuss discussing give giving talk comply fulfill fulfil disclose reveal walk explain explaining respond responding comment elaborate engage proceed do go",
    "AIDE": "help assist answer discuss comply respond comment",
    "DOING": "answering explaining sharing discussing helping providing assisting responding commenting complying disclosing",
    "DUTY": "must have need would will should",
    "NO": "decline refuse pass abstain",
    "RULES": "guidelines guideline rules policy policies instructions principles",
    "BAR": "permit allow let",
    "FORBID": "prevent prevents forbid forbids prohibit prohibits bar bars",
    "ABLE": "able allowed permitted going willing authorized authorised comfortable",
}

#: Sentences by which a speaker declines, as runs of words and classes; ``~`` stands for up to four words, ``?`` for one or none.
#: All name the speaker, an act of answering or a policy, so a program that "will refuse to open files" is none of them.
REFUSALS = (
    "i MODAL not ~ ACT", "i am ? not ABLE ~ ACT", "i am ? unable ~ ACT", "i MODAL not ? feel comfortable", "i am not ? comfortable", "i would rather not", "i ? prefer not to",
    "i DUTY ~ NO", "i ? NO to", "i ? decline", "i ? refuse", "i have no permission", "i MODAL not have permission", "we MODAL not ~ AIDE", "we are not ABLE ~ AIDE", "we are unable ~ AIDE", "we DUTY ? decline", "we DUTY to decline",
    "outside ~ i am ABLE", "outside ~ i may ACT", "outside ~ i can ACT", "beyond ~ i am ABLE", "beyond ~ i may ACT", "beyond ~ i can ACT", "off limits for me", "off-limits for me",
    "my RULES ~ not BAR", "my RULES FORBID", "against my ? RULES", "violates my RULES", "violate my RULES", "not BAR me to", "not permitted for me", "i am not at liberty",
    "no answer ~ given", "DOING ~ not be appropriate", "DOING ~ be inappropriate", "not ? appropriate for me", "inappropriate for me to", "request ~ blocked ~ policy", "blocked by ? content policy", "violates ? content policy", "violate ? content policy", "against ? content policy",
    "ich ~ nicht ~ helfen", "ich ~ nicht ~ weiterhelfen", "ich ~ nicht ~ beantworten", "ich ~ nicht ~ antworten", "nicht ~ helfen kann ich", "muss ich ~ ablehnen", "ich muss ~ ablehnen", "darf ich nicht", "ich darf nicht", "darf ich keine auskunft", "ich darf keine auskunft", "ich kann diese anfrage nicht", "kann ich diese anfrage nicht", "ich ~ keine auskunft",
    "je ne peux pas ~ répondre", "je ne peux pas ~ aider", "je ne peux pas ~ fournir", "je ne suis pas ~ aider", "je ne suis pas autorisé", "je ne suis pas autorisée", "je dois ? refuser", "je dois ? décliner", "je refuse de",
    "no puedo ? ayudar", "no puedo ayudarte", "no puedo ayudarle", "no puedo ~ responder", "no puedo ~ proporcionar", "no puedo ~ atender", "debo ? rechazar", "tengo que ? rechazar", "no estoy autorizado", "no estoy autorizada", "no me está permitido",
    "não posso ? ajudar", "não posso ajudá", "não posso ~ responder", "não posso ~ fornecer", "não posso ~ atender", "devo ? recusar", "tenho de ? recusar", "tenho que ? recusar", "não estou autorizado", "não estou autorizada", "não me é permitido",
    "ik ~ niet ~ helpen", "ik ~ niet ~ beantwoorden", "ik ~ niet ~ antwoorden", "moet ik ~ weigeren", "ik moet ~ weigeren", "mag ik ~ niet", "ik mag ~ niet", "kan ik ~ niet ~ helpen", "ik ben niet bevoegd",
)
GAP = 4

# Function words of each language (fixed values).  Words of two languages vote for both.
STOPWORDS = {
    "en": "the of and to in is it that was for on are as with they be at this have from or by but not what all were when we there can an which their if will each about how out them then so some would into has more no could than been its who now did get where why does uses used before after until only most while because under whenever another both same nothing else up off between back read reads gives there's here it's my your you",
    "de": "der die und das ist den von zu mit sich des auf für nicht ein dem eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn kann wir warum welche welcher welches wo was damit soll muss diese dieser dieses gibt keine kein ihr ihre bereits danach daneben leider weil geht darauf",
    "fr": "de la le et les des en un du une que est pour qui dans par plus au sur ce pas avec son se il sont sa ou aux ses mais comme ont cette ces être nous elle leur on été deux peut fait même entre quand où puis avant après sans sous pourquoi comment quel quelle quels quelles faut rien l' d' n' s' qu' c' j' tant cela parce déjà soit avez vous je ne aussi chaque",
    "es": "de la que el en y los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde cómo cuál dónde antes después luego hace solo cada trata debe estas estos archivo veces función caso falta tanto mientras",
    "pt": "de a que e o do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas me esse eles você essa num nem suas meu às minha numa pelos elas qual nós lhe deles são foi está ser tem há onde porque por que como quais antes cada ainda duas dois pode é preciso faz em arquivo vezes função trata caso falta quanto enquanto uma",
    "nl": "de het een en van ik te dat die in is niet zijn op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze u want nog zal me zij nu ge geen omdat iets worden toch al waren veel meer doen toen moet ben zonder kan hun dus alles onder ja eens hier wie werd altijd doorgaans wordt waarom welke welk waar wanneer gaat niets vlak slechts vanuit terwijl zowel staat beide zolang",
}

_ZERO_WIDTH = re.compile("[​-‏⁠﻿­]")
_CITE = re.compile(r"\s*\[(?:source\s*)?\d+(?:\s*[,\-–]\s*\d+)*\]", re.I)
_FENCE = re.compile(r"(?ms)^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1`*[ \t]*$|\Z)")
_OPEN_FENCE = re.compile(r"(?s)(?:```|~~~).*$")
_SPAN = re.compile(r"`[^`\n]*`")
_OPEN_SPAN = re.compile(r"`[^`\n]*$")
_QUOTED = re.compile(r"«[^»\n]*»|“[^”\n]*”|„[^“”\n]*[“”]|\"[^\"\n]*\"|(?<!\w)'[^'\n]{3,}'(?!\w)")
_NOTHING = re.compile(r"(?i)^(?:answer|response|reply|antwort|réponse|reponse|respuesta|resposta|antwoord|n ?/?a|none|null|nil|no answer|no response|keine antwort|empty|tbd|todo|undefined|nothing|not available|unknown)?$")
_SAYS = re.compile(r"(?!(?i:sources?)\b)[^\W\d_]{2,}")
_TOKEN = re.compile(r"[^\W_]+")
_WORD = re.compile(r"[a-zà-öø-ÿœß]+'?")


def is_empty(answer: str | None) -> bool:
    """Nothing that says anything: blanks, marks, citations alone, or a word for no answer."""
    if answer is None:
        return True
    # more words than labels of code blocks and of an empty answer could be: something is said
    enough = 8 + answer.count("```") + answer.count("~~~")
    if next(islice(_SAYS.finditer(answer), enough, None), None):
        return False
    text = _CITE.sub(" ", _ZERO_WIDTH.sub("", answer))
    text = re.sub(r"^[ \t]*(?:```+|~~~+)[\w+\-]*[ \t]*$", " ", text, flags=re.M)
    bare = re.sub(r"[\s\W_]+", " ", text.replace("/", "\0")).replace("\0", "/").strip()
    return bool(_NOTHING.match(re.sub(r"[\s\W_]+", " ", text).strip())) or bool(_NOTHING.match(bare))


class SuffixAutomaton:
    """The suffix automaton of a token sequence; every run of tokens of the sequence is a path from the start state."""

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for t in tokens:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][t]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def matches(self, tokens: list[str]) -> list[int]:
        """For each position the length of the longest run that ends there and occurs in the sequence."""
        out, state, length = [], 0, 0
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if t in self.next[state]:
                state = self.next[state][t]
                length += 1
            else:
                length = 0
            out.append(length)
        return out


@lru_cache(maxsize=4096)
def _prompt(question: str) -> tuple[list[str], frozenset[str], SuffixAutomaton]:
    """The words of a prompt and its automaton, made once for all answers to it within a task."""
    tokens = _TOKEN.findall(question.lower())
    return tokens, frozenset(tokens), SuffixAutomaton(tokens)


def _covered(automaton: SuffixAutomaton, tokens: list[str], run: int) -> float:
    hit = [False] * len(tokens)
    for i, n in enumerate(automaton.matches(tokens)):
        if n >= run:
            hit[i - n + 1 : i + 1] = [True] * n
    return sum(hit) / len(tokens)


def copies(question: str | None, answer: str | None) -> bool:
    """Whether the answer only repeats the question: most of it lies in runs of the question and most of the question in runs of it.

    Copied words are words of the question, so an answer with too few of them needs no automaton.
    """
    if not question or not answer:
        return False
    q, words, automaton = _prompt(question)
    text = _CITE.sub(" ", answer)
    label = re.match(r"\s*[^:\n`?]{2,40}:\s+(?=\S)", text)  # "You asked: ..."
    a = _TOKEN.findall((text[label.end() :] if label else text).lower())
    if not q or not a or len([t for t in a if t in words]) < COPIED_ANSWER * len(a):
        return False
    run = min(COPY_RUN, len(q))
    return _covered(automaton, a, run) >= COPIED_ANSWER and _covered(SuffixAutomaton(a), q, run) >= COPIED_QUESTION


def prose_of(text: str) -> str:
    """The text without code, citations and quotations."""
    if "```" in text or "~~~" in text:
        text = _OPEN_FENCE.sub("\n", _FENCE.sub("\n", text))
    if "[" in text:
        text = _CITE.sub(" ", _SPAN.sub(" X ", text) if "`" in text else text)
    elif "`" in text:
        text = _SPAN.sub(" X ", text)
    return _OPEN_SPAN.sub(" ", text) if "`" in text else text


_CONTRACTED = (("can't", "can not"), ("cannot", "can not"), ("won't", "will not"), ("shan't", "shall not"), ("n't", " not"), ("'m ", " am "), ("'d ", " would "), ("'ll ", " will "), ("'ve ", " have "), ("'re ", " are "), ("i'm", "i am"))
_WORDS_OF_SENTENCE = re.compile(r"[a-zà-öø-ÿœß]+(?:-[a-z]+)*")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
#: Saying what the excerpts lack is no refusal.
_ABOUT_SOURCES = re.compile(r"\b(?:excerpts?|snippets?|sources?|context|repository)\b")


class WordAutomaton:
    """Runs of words and word classes as one automaton: a set of states is moved along the words of a sentence."""

    def __init__(self, runs: tuple[str, ...], classes: dict[str, str], gap: int = GAP):
        of: dict[str, list[str]] = {}
        for name, words in classes.items():
            for w in words.split():
                of.setdefault(w, []).append(name)
        self.steps: list[dict[str, list[int]]] = [{}]  # of each state: word or class to the states after it
        self.jumps: list[list[int]] = [[]]  # states entered without a word
        self.loops: list[int | None] = [None]  # state entered by any word
        self.final: set[int] = set()
        for run in runs:
            at = 0
            for part in run.split():
                if part in "~?":
                    ends = [at]
                    for _ in range(gap if part == "~" else 1):
                        new = self._state()
                        self.loops[ends[-1]] = new
                        ends.append(new)
                    after = self._state()
                    for e in ends:
                        self.jumps[e].append(after)
                    at = after
                else:
                    new = self._state()
                    self.steps[at].setdefault(part, []).append(new)
                    at = new
            self.final.add(at)
        self.names = {w: (w, *of.get(w, ())) for w in {*of, *(p for r in runs for p in r.split())}}
        self.first = {w for w, keys in self.names.items() if any(k in self.steps[0] for k in keys)}

    def _state(self) -> int:
        self.steps.append({})
        self.jumps.append([])
        self.loops.append(None)
        return len(self.steps) - 1

    def accepts(self, words: list[str]) -> bool:
        """Whether some run occurs among the words."""
        now: set[int] = set()
        for w in words:
            if not now and w not in self.first:
                continue
            keys = self.names.get(w, ())
            after: list[int] = [s for k in keys for s in self.steps[0].get(k, ())]
            for state in now:
                for k in keys:
                    after += self.steps[state].get(k, ())
                if self.loops[state] is not None:
                    after.append(self.loops[state])
            now = set()
            while after:
                state = after.pop()
                if state in self.final:
                    return True
                if state not in now:
                    now.add(state)
                    after += self.jumps[state]
        return False


@lru_cache(maxsize=1)
def _refusal_automaton() -> tuple[WordAutomaton, re.Pattern[str]]:
    automaton = WordAutomaton(REFUSALS, SLOTS)
    return automaton, re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, automaton.first))) + r")\b")


def refuses(prose: str) -> bool:
    """Whether a sentence of plain prose (``spoken``) declines to answer; saying what the excerpts lack doesn't count."""
    automaton, begins = _refusal_automaton()
    if not begins.search(prose):
        return False
    for sentence in _SENTENCE_END.split(prose):
        if begins.search(sentence) and not _ABOUT_SOURCES.search(sentence):
            for short, long in _CONTRACTED:
                sentence = sentence.replace(short, long)
            if automaton.accepts(_WORDS_OF_SENTENCE.findall(sentence)):
                return True
    return False


def spoken(text: str | None) -> str:
    """The prose of a text in lower case, without code, citations and quotations."""
    prose = prose_of(text or "").replace("’", "'").lower()
    return _QUOTED.sub(" ", prose) if any(q in prose for q in "\"'«“„") else prose


_CLOSERS = {")": "(", "]": "[", "}": "{"}
_DELIMITER = re.compile(r"\\.|\"\"\"|'''|[\"'()\[\]{}\n]", re.S)


def _open_delimiters(code: str) -> bool:
    """Whether brackets or quotes of a piece of code are still open at its end."""
    stack: list[str] = []
    quote = ""
    for m in _DELIMITER.finditer(code):
        mark = m[0]
        if quote:
            if mark == quote or (mark == "\n" and len(quote) == 1):
                quote = ""
            elif len(mark) == 3 and mark[0] == quote:  # three single ones: closed, opened and closed
                quote = ""
        elif mark[0] in "\"'":
            quote = mark
        elif mark in "([{":
            stack.append(mark)
        elif mark in _CLOSERS and stack and stack[-1] == _CLOSERS[mark]:
            stack.pop()
    return bool(stack) or len(quote) == 3


def is_truncated(answer: str | None) -> bool:
    """Whether an answer that says something ends in the middle of a sentence or of code."""
    if not answer:
        return False
    text = (answer if answer.isascii() else _ZERO_WIDTH.sub("", answer)).rstrip()
    fences = re.findall(r"(?m)^[ \t]*(?:```+|~~~+)", text) if "```" in text or "~~~" in text else ()
    if len(fences) % 2:
        return True
    if fences and re.search(r"(?m)^[ \t]*(?:```+|~~~+)[ \t]*\Z", text):  # ends with a closed block
        return _open_delimiters(re.split(r"(?m)^[ \t]*(?:```+|~~~+)[^\n]*$", text)[-2])
    line = text.rsplit("\n", 1)[-1]
    if re.search(r"\[\d*(?:\s*[,\-–]\s*\d*)*$", line):  # an open citation
        return True
    bare = _CITE.sub("", line).strip()
    if bare.count("`") % 2 or (re.match(r"(?:[-*+]|\d+[.)])$", bare) and "\n" in text):
        return True
    if not bare:
        return False
    outside = re.sub(r"^(?:[-*+]|\d+[.)]|#{1,6}|>)\s*", "", _SPAN.sub(" ", bare)).strip()
    if not _TOKEN.search(outside):  # names and paths only
        return bool(re.search(r"[(\[{,]$", outside))
    if re.match(r"#{1,6}\s", bare):
        return False
    if re.search(r"[.!?…。:;][\"'”’»)\]*_]*$", bare):
        return bool(re.search(r"[:;]$", bare)) and len(outside.split()) > 3 and not re.match(r"[-*+]\s", bare)
    if re.match(r"(?:[-*+]|\d+[.)])\s", bare) and len(outside.split()) <= 4:
        return False
    if len(_TOKEN.findall(outside)) <= 2 and "\n" not in text:
        return len(_WORD.findall(outside.lower())) > 0 and len(text) > 60
    return True


@lru_cache(maxsize=1)
def _stop_index() -> dict[str, tuple[str, ...]]:
    index: dict[str, list[str]] = {}
    for lang, words in STOPWORDS.items():
        for w in set(words.split()):
            index.setdefault(w, []).append(lang)
    return {w: tuple(v) for w, v in index.items()}


#: Letters that only one of the languages writes (fixed values).
LETTERS = (("de", "äöüß"), ("fr", "êèëùûœîâ"), ("es", "ñ¿¡"), ("pt", "ãõ"), ("nl", "ĳ"))


def language_votes(prose: str) -> dict[str, float]:
    """Votes for each language: each stopword of the prose shares one vote among its languages, letters of one language half a vote."""
    votes = dict.fromkeys(STOPWORDS, 0.0)
    index = _stop_index()
    for w, n in Counter(_WORD.findall(prose)).items():
        langs = index.get(w)
        if langs is None and w.endswith("'"):
            langs = index.get(w[:-1])
        for lang in langs or ():
            votes[lang] += n / len(langs)
    if not prose.isascii():
        for lang, letters in LETTERS:
            votes[lang] += 0.5 * sum(prose.count(c) for c in letters)
    return votes


@lru_cache(maxsize=4096)
def _prompt_votes(question: str) -> tuple[str, dict[str, float]]:
    votes = language_votes(spoken(question))
    return max(votes, key=votes.get), votes


def answers_in_other_language(question: str | None, prose: str, least: float = 2.0, lead: float = 1.6) -> bool:
    """Whether the votes of the answer's prose (``spoken``) clearly name another language than those of the question."""
    if not question or not prose.strip():
        return False
    ql, q = _prompt_votes(question)
    a = language_votes(prose)
    al = max(a, key=a.get)
    return ql != al and q[ql] >= 1.0 and a[al] >= least and a[al] > lead * a[ql] and q[ql] > q[al]


def defects(question: str | None, answer: str | None) -> list[str]:
    """All defects of a pair; an empty answer has no other."""
    if is_empty(answer):
        return ["empty"]
    copied, prose = copies(question, answer), spoken(answer)
    out = []
    # a copied question may lack its mark; it is cut off only where a name is
    if is_truncated(answer) and not (copied and answer.count("`") % 2 == 0):
        out.append("truncated")
    if refuses(prose):
        out.append("refusal")
    if copied:
        out.append("copies_question")
    if answers_in_other_language(question, prose):
        out.append("other_language")
    return out


def broken_pairs(df: DataFrame, id_col: str = "result_id", question_col: str = "question", answer_col: str = "answer") -> DataFrame:
    """``(id, defect)``: one row per row id and defect, by the texts alone.

    A null or blank answer is ``empty`` whatever the question; a null or empty question leaves only the defects that need
    none; repeated rows count once; sound pairs give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, d) for i, q, a in b.itertuples(index=False) for d in defects(q, a)]
            yield pd.DataFrame(rows, columns=[id_col, "defect"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, question_col, answer_col).mapInPandas(run, f"`{id_col}` {kind}, defect string").distinct()
