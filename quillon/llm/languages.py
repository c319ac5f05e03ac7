"""Languages of documents and of their segments by character models.

One interpolated Kneser-Ney model of character ``ORDER``-grams is trained per language on sentences of labelled documents (at
most ``SAMPLE`` documents per language, the only bound), cleaned once by the first models' own verdicts.  The union of all
seen n-grams is one sorted array of packed codes with the log-probability in each language; unseen ones are interpolated from
the lower orders.  A sentence gets the language of the lowest cross-entropy per character, or none if that entropy lies above
what nearly all training sentences of the language have.  Consecutive sentences of a language form a segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl")
#: Labelled documents per language that the models are trained on.
SAMPLE = 400
#: Characters of the longest document that models are trained on; what is collected is bounded by both.
SAMPLE_CHARS = 50_000
ORDER, BITS = 4, 6
DISCOUNT = 0.75
#: Nats by which the best language of a sentence must lead, and letters it must have, to stand as a language of its own.
LEAST_LEAD, LEAST_LETTERS = 6.0, 24

# Names of the languages in other notations (fixed values).
NAMES = {
    "en": "en eng english englisch anglais inglés inglês engels",
    "de": "de deu ger german deutsch allemand alemán alemão duits",
    "fr": "fr fra fre french français francais französisch francés francês frans",
    "es": "es spa spanish español espanol castilian castellano spanisch espagnol espanhol spaans",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portugees",
    "nl": "nl nld dut dutch nederlands holländisch niederländisch néerlandais holandés holandês flemish",
}
UNKNOWN = ("", "unknown", "und", "undetermined", "undefined", "none", "null", "n/a", "na", "unk", "xx", "zxx", "mul", "mis", "?", "-", "other", "auto")

_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"  # each its own symbol; all others share one


def label_language(label: Column) -> Column:
    """The language a label names in any notation, ``''`` for a missing or unknown one, the label itself for another language."""
    plain = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"^[\s ]+|[\s ]+$", ""))
    whole = F.create_map(*[F.lit(x) for lang, names in NAMES.items() for n in names.split() for x in (n, lang)])
    return F.when(plain.isin(*UNKNOWN), F.lit("")).otherwise(F.coalesce(F.element_at(whole, plain), F.element_at(whole, F.regexp_extract(plain, r"^([^\W\d_]+)", 1)), plain))


_FENCE = re.compile(r"(?ms)^[ \t>]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t>]*\1[`~]*[ \t]*$|\Z)")
_HIDE = re.compile(r"`[^`\n]*`|https?://\S+|<[^<>\n]{1,200}>|«[^»\n]*»|“[^”\n]*”|„[^“”\n]*[“”]|\"[^\"\n]*\"|‘[^’\n]*’|(?<!\w)'[^'\n]{2,}'(?!\w)|\S*[_/\\@#=]\S*|\b\w+\.\w+\S*")
_MARK = re.compile(r"^[ \t]*(?:(?:>|[-*+•]|\d{1,3}[.)])[ \t]+)+")
_SENTENCE = re.compile(r"[^.!?…]+(?:[.!?…]+(?=[\s)\]\"'”’»]|$)[)\]\"'”’»]*|$|[.!?…]+)")


def prose(text: str) -> list[tuple[int, int, str]]:
    """Complete sentences of a text as ``(start, end, words)``: no code, headings, quotations, tables or indented blocks."""
    out: list[tuple[int, int, str]] = []
    blank = _FENCE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text.replace("\r", " "))
    at = 0
    paragraph: list[tuple[int, str]] = []

    def close() -> None:
        if not paragraph:
            return
        first = paragraph[0][0]
        body = "\n".join(x for _, x in paragraph)
        hidden = _HIDE.sub(lambda m: " " * len(m[0]), body)
        for m in _SENTENCE.finditer(hidden):
            words = m[0]
            if words.rstrip(" )]\"'”’»\n\t")[-1:] in {".", "!", "?", "…"} and sum(c.isalpha() for c in words) >= 12:
                lead = len(words) - len(words.lstrip())
                out.append((first + m.start() + lead, first + m.end(), words))
        paragraph.clear()

    for line in blank.split("\n"):
        bare = line.strip()
        mark = _MARK.match(line)
        if not bare or bare[0] in "#|" or re.match(r"[=\-_*]{3,}$", bare) or (line.startswith(("    ", "\t")) and not paragraph and not mark):
            close()
        else:
            if mark:
                close()
                line = " " * mark.end() + line[mark.end() :]
            paragraph.append((at, line))
        at += len(line) + 1
    close()
    return out


_LUT = np.zeros(0x250, np.uint8)
_LUT[:] = 0
for _i, _c in enumerate(_LETTERS, 2):
    _LUT[ord(_c)] = _i
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x250:
        _LUT[ord(_c.upper())] = _i
for _i in range(0xC0, 0x250):
    if not _LUT[_i] and chr(_i).isalpha():
        _LUT[_i] = 1


def encode(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all sentences in a row, blanks merged, each sentence between blanks; and the sentence of each symbol."""
    points = np.frombuffer(("\0" + "\0".join(sentences) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = np.where(points < 0x250, _LUT[np.minimum(points, 0x24F)], np.where(points > 0x370, 1, 0)).astype(np.uint8)
    owner = np.cumsum(points == 0) - 1
    keep = (symbol != 0) | (points == 0)
    keep[1:] |= (symbol[1:] == 0) & (symbol[:-1] != 0)
    return symbol[keep], owner[keep]


def _codes(symbol: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams that end at each symbol from ``order - 1`` on."""
    n = len(symbol) - order + 1
    code = np.zeros(max(n, 0), np.int32)
    for k in range(order):
        code = code << BITS | symbol[k : k + n]
    return code


@dataclass
class _Counts:
    grams: list[np.ndarray]  # by order 1..ORDER, sorted codes
    counts: list[np.ndarray]
    totals: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # contexts, sum of counts, number of different successors


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _count(symbol: np.ndarray) -> _Counts:
    grams, counts, totals = [None] * ORDER, [None] * ORDER, [None] * ORDER
    for order in range(ORDER, 0, -1):
        if order == ORDER:
            g, c = np.unique(_codes(symbol, order), return_counts=True)
        else:  # continuation counts: in how many different left neighbours an n-gram is seen
            g, c = np.unique(grams[order] & ((1 << BITS * order) - 1), return_counts=True)
        grams[order - 1], counts[order - 1] = g, c.astype(float)
        context, first = np.unique(g >> BITS, return_index=True)
        totals[order - 1] = (context, np.add.reduceat(c, first).astype(float), np.diff(np.append(first, len(g))).astype(float))
    return _Counts(grams, counts, totals)


def _probability(model: _Counts, order: int, code: np.ndarray) -> np.ndarray:
    if order == 0:
        return np.full(len(code), 1.0 / (len(_LETTERS) + 2))
    lower = _probability(model, order - 1, code & ((1 << BITS * (order - 1)) - 1))
    context, total, kinds = model.totals[order - 1]
    above = code >> BITS
    t = _look(context, total, above)
    own = np.maximum(_look(model.grams[order - 1], model.counts[order - 1], code) - DISCOUNT, 0)
    safe = np.maximum(t, 1)
    return np.where(t > 0, own / safe + DISCOUNT * _look(context, kinds, above) / safe * lower, lower)


@dataclass
class Models:
    languages: tuple[str, ...]
    grams: np.ndarray  # sorted packed n-grams seen in any language
    logp: np.ndarray  # [n-gram, language]
    parts: list[_Counts]
    limit: np.ndarray  # highest accepted cross-entropy per language
    temperature: float = 8.0  # nats of lead are divided by it where they become a confidence

    def sentence_scores(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probabilities ``[sentence, language]`` and the number of scored characters."""
        sums, lengths = np.zeros((len(sentences), len(self.languages))), np.zeros(len(sentences), np.int64)
        lo = 0
        while lo < len(sentences):
            hi, chars = lo, 0
            while hi < len(sentences) and (chars < 200_000 or hi == lo):
                chars += len(sentences[hi])
                hi += 1
            symbol, owner = encode(sentences[lo:hi])
            code, mine = _codes(symbol, ORDER), owner[ORDER - 1 :]
            same = owner[: len(code)] == mine
            code, mine = code[same], mine[same]
            if len(code):
                at = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
                values = self.logp[at]
                new = np.flatnonzero(self.grams[at] != code)
                if len(new):
                    kinds, back = np.unique(code[new], return_inverse=True)
                    values[new] = np.stack([np.log(_probability(m, ORDER, kinds)) for m in self.parts], 1)[back]
                first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                who = mine[first] + lo
                ok = who < hi
                sums[who[ok]] = np.add.reduceat(values, first, axis=0)[ok]
                lengths[who[ok]] = np.diff(np.append(first, len(mine)))[ok]
            lo = hi
        return sums, lengths


def train(sentences: dict[str, list[str]], languages: tuple[str, ...] = LANGUAGES) -> Models:
    """Models from sentences by language; a language without sentences gets flat probabilities and is hardly ever chosen."""
    parts = [_count(encode(sentences.get(lang) or ["\0"])[0]) for lang in languages]
    grams = np.unique(np.concatenate([m.grams[ORDER - 1] for m in parts]))
    logp = np.stack([np.log(_probability(m, ORDER, grams)) for m in parts], 1).astype(np.float32)
    models = Models(languages, grams, logp, parts, np.full(len(languages), np.inf))
    for k, lang in enumerate(languages):
        mine = sentences.get(lang) or []
        if mine:
            sums, n = models.sentence_scores(mine)
            entropy = -sums[n > 0, k] / n[n > 0]
            if len(entropy):
                models.limit[k] = np.quantile(entropy, 0.995) + 0.35
    return models


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE, languages: tuple[str, ...] = LANGUAGES) -> Models:
    """Train on labelled documents, those of the lowest hashed ids of each language; wrong labels are cleaned out once."""
    rows = df.select(F.xxhash64(id_col).alias("h"), label_language(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isin(*languages) & (F.length("text") <= SAMPLE_CHARS))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    share = F.element_at(F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, 1.3 * sample / max(1, counts.get(lang, 0))))]), F.col("lang"))
    picked = rows.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).orderBy("lang", "h").limit(2 * sample * len(languages)).toPandas()
    texts = {lang: picked["text"][picked["lang"] == lang].head(sample).tolist() for lang in languages}
    sentences = {lang: [s for t in ts for *_, s in prose(t)] for lang, ts in texts.items()}
    first = train(sentences, languages)
    clean = {}
    for k, lang in enumerate(languages):
        sums, _ = first.sentence_scores(sentences[lang])
        clean[lang] = [s for s, best in zip(sentences[lang], sums.argmax(1) if len(sums) else []) if best == k]
    models = train(clean, languages)
    models.temperature = calibrated(clean, languages)
    return models


def confidence(scores: np.ndarray, temperature: float) -> np.ndarray:
    """Probabilities ``[row, language]`` of summed log-probabilities."""
    odds = np.exp(np.clip((scores - scores.max(1, keepdims=True)) / temperature, -50, 0))
    return odds / odds.sum(1, keepdims=True)


def calibrated(sentences: dict[str, list[str]], languages: tuple[str, ...] = LANGUAGES) -> float:
    """The temperature at which models of every second sentence give the others the least log loss."""
    models = train({k: v[::2] for k, v in sentences.items()}, languages)
    scores, truth = [], []
    for k, lang in enumerate(languages):
        held = sentences.get(lang, [])[1::2]
        if held:
            sums, n = models.sentence_scores(held)
            scores.append(sums[n > 0])
            truth += [k] * int((n > 0).sum())
    if not scores:
        return 8.0
    flat, right = np.concatenate(scores), np.array(truth)
    loss = {t: -np.log(np.maximum(confidence(flat, t)[np.arange(len(right)), right], 1e-9)).mean() for t in (1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0)}
    return min(loss, key=loss.get)


def segments_of(texts: list[str], models: Models) -> list[list[tuple[int, int, int, float, int, bool]]]:
    """Per text its segments: ``(start, end, language index, confidence, letters, certain)``; rejected sentences end no segment."""
    found = [prose(t) if t else [] for t in texts]
    flat = [s for f in found for *_, s in f]
    sums, n = models.sentence_scores(flat)
    out: list[list[tuple[int, int, int, float, int, bool]]] = []
    i = 0
    for sentences in found:
        mine: list[list] = []  # start, end, scores, letters, certain sentences
        for start, end, words in sentences:
            score, count = sums[i], n[i]
            i += 1
            if not count:
                continue
            best = int(score.argmax())
            if -score[best] / count > models.limit[best]:
                continue
            letters = sum(c.isalpha() for c in words)
            lead = score[best] - np.partition(score, -2)[-2]
            certain = bool(lead >= LEAST_LEAD and letters >= LEAST_LETTERS)
            if mine and (mine[-1][5] == best or not certain):
                mine[-1][1], mine[-1][2], mine[-1][3] = end, mine[-1][2] + score, mine[-1][3] + letters
                mine[-1][4] += certain and mine[-1][5] == best
            else:
                mine.append([start, end, score.copy(), letters, int(certain), best])
        done = []
        for start, end, score, letters, certain, best in mine:
            done.append((start, end, best, round(float(confidence(score[None], models.temperature)[0, best]), 4), letters, certain > 0))
        out.append(done)
    return out


def language_segments(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", models: Models | None = None, sample: int = SAMPLE) -> DataFrame:
    """``(id, label, document_language, document_confidence, mixed, segment, start_char, end_char, language, confidence, letters)``.

    One row per segment.  Documents without prose in a known language (null and empty ones too) give no rows; a repeated row
    repeats its segments.  Whole texts are read.  ``label`` is the language that the given label names, '' if none.
    """
    models = models or fit(df, id_col, text_col, lang_col, sample)
    held = df.sparkSession.sparkContext.broadcast(models)  # bounded by the sample and the packed alphabet

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        names = m.languages
        for b in batches:
            ids, texts, labels = (b[c].tolist() for c in ("id", "text", "label"))
            for lo in range(0, len(ids), 200):
                rows = []
                for i, label, segs in zip(ids[lo : lo + 200], labels[lo : lo + 200], segments_of(texts[lo : lo + 200], m)):
                    if not segs:
                        continue
                    certain = {s[2] for s in segs if s[5]}
                    weight = np.zeros(len(names))
                    for s in segs:
                        weight[s[2]] += s[4] * (1.0 if s[5] or not certain else 0.1)
                    best = int(weight.argmax())
                    sure = float(np.dot([s[3] for s in segs], [s[4] for s in segs]) / max(1, sum(s[4] for s in segs)))
                    rows += [(i, label, names[best], round(sure * weight[best] / weight.sum(), 4), len(certain) > 1, k, s[0], s[1], names[s[2]], s[3], s[4], s[5]) for k, s in enumerate(segs)]
                yield pd.DataFrame(rows, columns=columns)

    columns = ["id", "label", "document_language", "document_confidence", "mixed", "segment", "start_char", "end_char", "language", "confidence", "letters", "certain"]
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, label string, document_language string, document_confidence double, mixed boolean, segment int, start_char int, end_char int, language string, confidence double, letters int, certain boolean"
    rows = df.select(F.col(id_col).alias("id"), label_language(F.col(lang_col)).alias("label"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInPandas(run, schema)


def corrected_languages(segments: DataFrame) -> DataFrame:
    """``(id, language)``: the language of documents whose label is missing or wrong; each certain language of mixed documents."""
    kept = segments.where("(not mixed and segment = 0 and label <> document_language) or (mixed and certain)")  # one pass
    return kept.select("id", F.expr("if(mixed, language, document_language)").alias("language")).distinct()
