"""Broken question and answer pairs, each with the first defect that holds.

* copies: the answer is compressed with its question as zstandard dictionary;
  what shrinks to next to nothing is then compared letter by letter;
* refusals and languages: the dictionaries of :mod:`.lexicons`;
* broken-off answers: a terminal-context model. How an answer stops (last mark,
  open brackets and fences, announced counts, the other entries of its list) is
  its context; all answers are counted as they end and as they look when cut at
  a hashed place, and the likelihood ratio of the two decides. Where a context is
  as typical of whole labels and entries as of cut ones, the last word decides:
  how often, over all answers, it closes a line or sentence or goes on.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_columns
from ..functions.unicode import letters_digits
from . import lexicons as lex

#: A clause with more words (or signs, where words aren't parted) that the question doesn't have says something besides declining.
CLAUSE_WORDS, CLAUSE_SIGNS = 26, 30
_NOT_WORD = re.compile(r"[\W_]+")
DEFECTS = ("empty", "copy", "refusal", "truncated", "wrong_language")
BUCKETS = 1 << 16

_FENCED = re.compile(r"(```|~~~).*?(?:\1|\Z)", re.S)
_TOKEN = re.compile(r"[㐀-䶿一-鿿]|[^\W_]+(?:['’][^\W_]+)*")
_TOKEN_AND_REST = re.compile(rf"({_TOKEN.pattern})([\W_]*)")
_PLAIN = frozenset(["", " ", ", ", "，", "、"])
_LATIN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLOSING = set(".!?。！？…~～‽؟।")
_AFTER = set("\"'”’」』）)】]》>*_`")
_ITEM = re.compile(r"^\s*(?:[-*+•·–—]|[(（]?(?:\d{1,3}|[a-zA-Z]|[一二三四五六七八九十]{1,3})\s*[.)、）:：．])\s*")
_CODE = re.compile(r"^\s*(?:def |class |import |from \w+ import |return\b|for .+:$|while .+:$|if .+:$|[\w.\[\]]+ ?[-+*/]?= |print\(|[{}()\[\];]+$|#include|function |const |let |var |public |SELECT )|[;{}]\s*$")
_SIGNED = re.compile(
    r"(?:^|[\s.!?,;。！？…~])(?:(?:very |most |with )*(?:yours|yours truly|yours sincerely|yours faithfully|sincerely(?: yours)?|best|best wishes|best regards|kind regards|warm regards|regards|cheers|love|warmly|cordially|respectfully|thanks|many thanks|your friend|signed)|mit freundlichen grüßen|viele grüße|herzliche grüße|liebe grüße|dein|deine|ihr|ihre|atentamente|saludos|un abrazo|cordialmente|tu amigo|此致敬礼|此致|敬上|祝好|谨上|您的|你的朋友)\s*[,，\-–—:：.]*\s*(?:\S+\s*){1,4}$",
    re.I,
)
_LABEL = re.compile(r"^[ \t]*[<\[*#(]{0,3}[ \t]*([^\W\d_]+(?:[ .'-][^\W\d_]+){0,2})[ \t]*[>\]*)]{0,3}[:：][*]{0,2}", re.M)
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+$|\S+@\S+\.\w+$")
_NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {c: i for i, c in enumerate("零一二三四五六七八九十")} | {"两": 2}
_ANNOUNCED = re.compile(r"\b(?:there are|there were|here are|follow(?:ing|s)?|takes?|needs?|in|has|have|these|list(?:s|ed)?|give|gives|consider|of) (?:the |these |only |exactly |just |about )?(\d{1,2}|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+(?:\w+\s+)?(?:steps|reasons|points|items|parts|ways|rules|stages|tips|uses|ideas|examples|things|facts|options|causes|entries|phases|lines)\b", re.I)
_ANNOUNCED_ZH = re.compile(r"([二两三四五六七八九十]|\d{1,2})\s*(?:点|条|个步骤|步|项|个原因|个理由|个方面|个方法|种方法|个要点|个部分|个阶段)\s*[：:，,。]")
_ORDINAL_ZH = re.compile(r"第([一二三四五六七八九十]|\d{1,2})(?:[，,、：:步点条是]|$)")
_ORDINAL_EN = re.compile(r"\b(first|second|third|fourth|fifth|sixth|seventh|eighth)(?:ly)?\b[,:]", re.I)
_OPEN, _SHUT = "([{（【「『《〈“", ")]}）】」』》〉”"
_SPOKEN: dict[str, tuple[str, ...]] = {}
for _code, _words in lex.STOPWORDS.items():
    for _word in _words:
        _SPOKEN[_word] = (*_SPOKEN.get(_word, ()), _code)


@lru_cache(maxsize=1 << 16)
def bucket(token: str) -> int:
    return zlib.crc32(token.casefold().encode("utf-8", "surrogatepass")) % BUCKETS


def split_pair(text: str | None) -> tuple[str | None, str | None]:
    """Question and answer of one stored text.

    With labels we don't know, the first and the next other one that open a
    line decide; a text without labels is taken as a question alone.
    """
    if not text:
        return None, None
    for first, second in lex.PAIR_LABELS:
        opened = first.match(text)
        if not opened:
            continue
        answer = second.search(text, opened.end())
        if answer:
            return text[opened.end() : answer.start()].strip(), lex.PAIR_END.sub("", text[answer.end() :])
        return text[opened.end() :].strip(), None
    for _, second in lex.PAIR_LABELS:
        answer = second.search(text)
        if answer:
            return text[: answer.start()].strip(), lex.PAIR_END.sub("", text[answer.end() :])
    opened = _LABEL.match(text)
    for answer in _LABEL.finditer(text, opened.end()) if opened else ():
        if answer[1].casefold() != opened[1].casefold():
            return text[opened.end() : answer.start()].strip(), lex.PAIR_END.sub("", text[answer.end() :])
    return text.strip(), None


def message_pairs(payload: str | None):
    """``(answer_index, question, answer)`` of a conversation: answers without tool calls and the nearest question before them."""
    try:
        messages = json.loads(payload)["conversations"]
    except (TypeError, ValueError, KeyError):
        return
    if not isinstance(messages, list):
        return
    question, index = None, 0
    for m in messages:
        if not isinstance(m, dict):
            continue
        if m.get("role") == "user":
            question = m.get("content") if isinstance(m.get("content"), str) else None
        elif m.get("role") == "assistant":
            if not m.get("tool_calls"):
                yield index, question, m.get("content") if isinstance(m.get("content"), str) else None
            index += 1


def is_empty(answer: str | None) -> bool:
    core = letters_digits(answer, nfkc=True)
    return not core or core in lex.PLACEHOLDERS


def squeezed(question: bytes, answer: bytes) -> int:
    """Bytes left of the answer when it is compressed with the question, which must not be empty, as dictionary."""
    question *= -(-8 // len(question))  # shorter dictionaries aren't taken
    settings = zstandard.ZstdCompressionParameters.from_level(1, window_log=min(30, max(17, (len(question) + len(answer)).bit_length())), write_content_size=False, write_checksum=False, write_dict_id=False)
    known = zstandard.ZstdCompressionDict(question, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(dict_data=known, compression_params=settings).compress(answer))


#: A copy leaves at most this much: frame, a few matches and the letters of a label.
COPY_BYTES = 72


def is_copy(question: str | None, answer: str) -> bool:
    """The answer is the question again, once or repeated, apart from a leading label.

    Copies are what the question as dictionary compresses to next to nothing (a
    match for each repetition at most, and one in every block of 128 KB); those
    are then compared letter by letter.
    """
    q, a = letters_digits(question), letters_digits(answer)
    if not q or len(a) < len(q):
        return False
    qb, ab = q.encode("utf-8", "surrogatepass"), a.encode("utf-8", "surrogatepass")
    if squeezed(qb, ab) > COPY_BYTES + len(ab) // 1024:
        return False
    rest = a
    while rest.endswith(q):
        rest = rest[: -len(q)]
    if len(rest) == len(a):
        return False
    if not rest:
        return True
    label = re.match(r"\s*[<\[(*#\s]*([^:：\n>\])]{1,40})[:：\n>\])]", answer)
    return bool(label and letters_digits(label[1]) == rest) or (len(rest) <= 16 and len(rest) * 2 <= len(q))


def _clauses(text: str) -> list[str]:
    return [c for c in re.split(r"[.!?;:。！？；：…\n]+|[,，、]+|\s[-–—]+\s", text) if letters_digits(c)]


def is_refusal(answer: str, question: str | None = None) -> bool:
    """It declines, and every clause declines, apologises, explains or takes leave.

    A clause that declines may say again what was asked: words of the question
    give nothing of an answer. It is content if more than CLAUSE_WORDS others
    stand in it.
    """
    text = unicodedata.normalize("NFKC", answer).casefold().replace("’", "'")
    dense = sum(len(lex.SCRIPTS[code].findall(text)) for code in ("zh", "ja", "ko"))
    declined, rest = 0, 0
    if dense * 3 > len(letters_digits(text)):
        text = re.sub(r"\s+", "", text)
        if not any(p.search(text) for p in lex.DECLINES_DENSE):
            return False
        asked = set(letters_digits(question, nfkc=True))
        for clause in _clauses(text):
            clause = letters_digits(clause)
            if any(p.search(clause) for p in lex.DECLINES_DENSE) and sum(ch not in asked for ch in clause) <= CLAUSE_SIGNS:
                declined += 1
            elif not any(p.match(clause) for p in lex.FILLERS_DENSE):
                rest += len(clause)
        return declined > 0 and rest <= 5
    flat = _NOT_WORD.sub(" ", text.replace("'", "")).strip()
    if lex.DECLINE_WORDS.isdisjoint(flat.split()) or not any(p.search(flat) for p in lex.DECLINES):
        return False
    asked = set(_NOT_WORD.sub(" ", (question or "").casefold().replace("’", "'").replace("'", "")).split())
    for clause in _clauses(re.sub(r"\s+", " ", text)):
        words = re.sub(r"[\W_]+", " ", clause.replace("'", "")).strip()
        new = sum(w not in asked for w in words.split())
        if any(p.search(words) for p in lex.DECLINES) and new <= CLAUSE_WORDS:
            declined += 1
        elif not any((m := p.match(words)) and len(words) - m.end() <= 12 for p in lex.FILLERS):
            rest += len(words.split())
    if not declined and sum(w not in asked for w in flat.split()) <= CLAUSE_WORDS:
        declined, rest = 1, 0
    return declined > 0 and rest <= 3


def weights(text: str) -> dict[str, float]:
    """How much of the text is in which language; code and JSON count for nothing."""
    text = _FENCED.sub(" ", text)
    if re.fullmatch(r"\s*[\[{].*[\]}]\s*", text, re.S):
        return {}
    out: dict[str, float] = {}
    if not text.isascii():
        for code, script in lex.SCRIPTS.items():
            n = len(script.findall(text))
            if n:
                out[code] = float(n)
        if "ja" in out:
            out["ja"] += out.pop("zh", 0.0)
    words = _LATIN.findall(text.casefold())
    if not text.isascii():
        words = [w for w in words if ord(w[0]) < 0x250 or 0x1E00 <= ord(w[0]) < 0x1F00]
    if len(words) >= 3:
        hits = dict.fromkeys(lex.STOPWORDS, 0)
        for codes in filter(None, map(_SPOKEN.get, words)):
            for code in codes:
                hits[code] += 1
        best = max(hits, key=hits.get)
        second = max(v for k, v in hits.items() if k != best)
        if hits[best] >= max(1, 0.12 * len(words)) and (hits[best] > second or best == "en"):
            out[best] = out.get(best, 0.0) + 2.2 * len(words)
        else:
            out["?"] = 2.2 * len(words)
    return out


def language(text: str) -> str | None:
    """The language most of the text is in; None for labels, numbers, code and what can't be told."""
    found = weights(text)
    if not found:
        return None
    best = max(found, key=found.get)
    return best if best != "?" and found[best] >= (6 if best != "zh" else 4) and found[best] >= 0.5 * sum(found.values()) else None


def is_foreign(question: str | None, answer: str) -> bool:
    """The answer's language is neither one of the question's nor one that the question asks for."""
    if not question:
        return False
    mine = language(answer)
    if mine is None:
        return False
    theirs = weights(question)
    total = sum(theirs.values())
    known = {k for k, v in theirs.items() if v >= 0.2 * total and k != "?"}
    if not known or mine in known or "?" in theirs and theirs["?"] > 0.5 * total:
        return False
    return not (lex.ASKED[mine].search(question) if mine in lex.ASKED else False)


#: What the contexts count for before any data: logarithm of how much more typical of ends (above 0) or of cut places (below) they are.
PRIOR = {
    "fence shut": 4, "whole": 4, "odd": 2, "full stop": 4, "signature": 2, "unit or quotation": 2, "address or row": 2, "marks only": 2, "label with a mark": 1,
    "fence open": -4, "open": -4, "short of its number": -4, "bracket": -4, "quote": -4, "mark that goes on": -4, "words": -4, "entry among sentences": -4, "entry without a word": -4,
    "entry shorter than all": -3, "long lone entry": -2, "blank": 2,
}
#: Contexts in which something is open by definition, whatever answers are like.
OPEN_CONTEXTS = frozenset(["fence open", "short of its number", "bracket"])
#: The prior counts as much as this many observations.
PRIOR_SIZE = 50
#: A context decides alone if it is this much (as a logarithm: 5 times) more typical of either; else the last word does.
CLEAR = math.log(5)
#: A word goes on if it closes less than this share of the usual.
RARELY_CLOSES = 0.12


class Endings:
    """Terminal-context model: how answers end against how they look where they are cut, and which words close or go on.

    ``ends`` holds for each (form, context) how many answers stop in it and how
    many stop in it once they are cut at a place between two characters.
    """

    def __init__(self, closes: np.ndarray, goes_on: np.ndarray, ends: dict[tuple[str, str], tuple[int, int]] | None = None):
        self.closes, self.goes_on, self.ends = closes, goes_on, ends or {}
        total = closes.sum() + goes_on.sum()
        self.prior = float(closes.sum() / total) if total else 0.5
        self.sums = [sum(v[k] for v in self.ends.values()) + 1 for k in (0, 1)]

    def closing(self, token: str) -> float:
        """Share of its occurrences where the word closes, in multiples of the usual share; 1 for unknown words."""
        k = bucket(token)
        return float((self.closes[k] + 4 * self.prior) / (self.closes[k] + self.goes_on[k] + 4) / max(self.prior, 1e-9))

    def ratio(self, form: str, context: str) -> float:
        """Logarithm of the likelihood ratio of end against cut, drawn towards the prior where there is little to count."""
        prior = float(PRIOR.get(context, 0))
        if context in OPEN_CONTEXTS:
            return prior
        end, cut = self.ends.get((form, context), (0, 0))
        counted = math.log((end + 0.5) / self.sums[0]) - math.log((cut + 0.5) / self.sums[1])
        return ((end + cut) * counted + PRIOR_SIZE * prior) / (end + cut + PRIOR_SIZE)

    def breaks_off(self, form: str, context: str, word: str | None) -> bool:
        ratio = self.ratio(form, context)
        if word is None or abs(ratio) >= CLEAR and context not in WORD_CONTEXTS:
            return ratio < 0
        return self.closing(word) < RARELY_CLOSES


#: Contexts that whole labels and entries have in common with cut ones: the last word decides.
WORD_CONTEXTS = frozenset(["label", "field", "entry", "lone entry", "signature"])


def ending_counts(answers: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Closing and continuing occurrences of each token bucket; the last word of an answer, which is to be judged, isn't counted."""
    closes, goes_on = [], []
    for answer in answers:
        if not answer:
            continue
        text = _FENCED.sub(" \n", answer)
        for token, between in _TOKEN_AND_REST.findall(text)[:-1]:
            (goes_on if between in _PLAIN or "\n" not in between and _CLOSING.isdisjoint(between) else closes).append(bucket(token))
    return np.bincount(np.array(closes, dtype=np.int64), minlength=BUCKETS), np.bincount(np.array(goes_on, dtype=np.int64), minlength=BUCKETS)


def _number(word: str) -> int:
    return int(word) if word.isdigit() else _NUMBER_WORDS.get(word.lower(), 0)


def _left_open(text: str) -> str | None:
    """``bracket`` or ``quote`` if one is still open at the end, ``bracket long ago`` if several sentences have ended since."""
    stack: list[tuple[str, int]] = []
    for at, ch in enumerate(text):
        if ch in _OPEN:
            stack.append((ch, at))
        elif ch in _SHUT:
            if stack and _OPEN.index(stack[-1][0]) == _SHUT.index(ch):
                stack.pop()
    whole = text.rstrip("".join(_AFTER) + " ")[-1:] in _CLOSING
    stack = [x for x in stack if x[0] in "([{（【" or not whole]
    if stack:
        since = text[stack[-1][1] :]
        return "bracket long ago" if whole and sum(map(since.count, _CLOSING)) > 2 else "bracket"
    if not whole and text.rstrip()[-1:] != '"' and text.count('"') % 2 == 1 and not re.search(r'\d"', text):
        return "quote"
    return None


def terminal_context(answer: str) -> tuple[str, str, str | None]:
    """How an answer stops: ``(form, context, last word)``; the word is given where it says more than the context.

    Forms are what stays the same if an answer is cut: an object, fenced text,
    bare code, a list, running text. The context is what the last mark, the open
    brackets, the other entries and the announced counts amount to.
    """
    text = answer.strip().strip("\u200b\ufeff")
    if text.count("```") % 2 or text.count("~~~") % 2:
        return "fenced", "fence open", None
    if text[:1] in ("{", "[") and (text[0] == "{" or re.match(r'\[\s*["\d{\[\-]', text)):
        try:
            json.loads(text)
            return "object", "whole", None
        except ValueError:
            if text[0] == "{" or re.match(r'\[\s*[{"]', text):
                open_ = text[-1] not in "}]" or text.count("{") > text.count("}") or text.count("[") > text.count("]")
                return "object", "open" if open_ else "odd", None
    prose = _FENCED.sub("\n```\n", text)
    lines = [x for x in prose.split("\n") if x.strip()]
    if not lines:
        return "text", "blank", None
    last = lines[-1].strip()
    items = [x for x in lines if _ITEM.match(x)]
    form = "fenced" if "```" in prose else "list" if len(items) > 1 or items and len(lines) > 1 else "text"
    if _falls_short(prose, items):
        return form, "short of its number", None
    if last == "```":
        return form, "fence shut", None
    if all(_CODE.search(x) or x.startswith((" ", "\t")) for x in lines):
        return "code", "open" if _left_open(text) or last[-1] in ":=,+-*/([{" else "whole", None
    open_ = _left_open(prose.replace("```", ""))
    if open_:
        return form, open_, None
    stem = last
    while stem and stem[-1] in _AFTER:
        stem = stem[:-1].rstrip()
    if not stem:
        return form, "marks only", None
    is_item = bool(_ITEM.match(last))
    body = _ITEM.sub("", last, count=1) if is_item else last
    if is_item and not letters_digits(body):
        if len(items) > 1 or not last[:1].isalnum():
            return form, "entry without a word", None
        is_item, body = False, last
    if items and not is_item:  # the last entry goes on over several lines
        is_item, body = True, _ITEM.sub("", " ".join(x.strip() for x in lines[max(i for i, x in enumerate(lines) if x is items[-1]) :]), count=1)
    whole = _TOKEN.findall(prose)
    if stem[-1] in _CLOSING:
        return form, "full stop", None
    if stem[-1] in ",，、;；:：-–—(（=+&/\\":
        return form, "mark that goes on" if len(whole) > 1 else "label with a mark", None
    if _ADDRESS.search(last) or last.endswith("|"):
        return form, "address or row", None
    if stem[-1] in "%°€$£" or last[-1] in "\"”’」』":
        return form, "unit or quotation", None
    tokens = _TOKEN.findall(body)
    if not tokens:
        return form, "marks only", None
    if _SIGNED.search(" ".join(x.strip() for x in lines[-3:])):
        return form, "signature", tokens[-1]
    if is_item:
        others = [_ITEM.sub("", x, count=1).strip() for x in items[:-1]]
        if others:
            full = sum(bool(x) and x.rstrip("\"'”’」）)*")[-1:] in _CLOSING for x in others)
            if full * 2 > len(others):
                return form, "entry among sentences", None
            counts = sorted(len(_TOKEN.findall(x)) for x in others)
            if len(others) >= 2 and counts[0] == counts[-1] and counts[0] >= 3 and len(tokens) < counts[0] - 1:
                return form, "entry shorter than all", None
            return form, "entry", tokens[-1]
        return form, "long lone entry" if len(tokens) > 12 else "lone entry", tokens[-1]
    han = sum("㐀" <= w <= "鿿" for w in whole)
    if len(lines) == 1 and (len(whole) <= 3 if not han else len(whole) <= 6):
        return form, "label", tokens[-1]
    if len(lines) == 1 and re.fullmatch(r"[^:：]{1,30}[:：]\s*\S+(?:\s\S+)?", last):
        return form, "field", tokens[-1]
    return form, "words", tokens[-1]


def _falls_short(prose: str, items: list[str]) -> bool:
    """A number of steps, points or the like is announced, and fewer have come."""
    told = _ANNOUNCED.search(prose)
    if told and 0 < max(len(items), len(_ORDINAL_EN.findall(prose[told.end() :]))) < _number(told[1]):
        return True
    told = _ANNOUNCED_ZH.search(prose)
    if told:
        said = {_number(n) for n in _ORDINAL_ZH.findall(prose[told.end() :])}
        return 0 < max(len(said), len(items)) < _number(told[1])
    return False


def is_truncated(answer: str, endings: Endings) -> bool:
    """The answer stops before its sentence, list, code block or object is complete: its terminal context is one of cut texts."""
    return endings.breaks_off(*terminal_context(answer))


def end_and_cut(answer: str) -> tuple[tuple[str, str], tuple[str, str] | None]:
    """Form and context at the end of an answer, and where it is cut at a place that its own hash picks."""
    core = answer.strip()
    cut = core[: 1 + zlib.crc32(core.encode("utf-8", "surrogatepass")) % (len(core) - 1)] if len(core) > 1 else ""
    return terminal_context(answer)[:2], terminal_context(cut)[:2] if letters_digits(cut) and len(cut.rstrip()) < len(core) else None


def defect(question: str | None, answer: str | None, endings: Endings) -> str | None:
    """The first defect that holds, in the order of DEFECTS, or None for a whole pair."""
    if is_empty(answer):
        return "empty"
    if is_copy(question, answer):
        return "copy"
    if is_refusal(answer, question):
        return "refusal"
    if is_truncated(answer, endings):
        return "truncated"
    return "wrong_language" if is_foreign(question, answer) else None


def _stored(candidates: DataFrame | None, raw_pairs: DataFrame | None) -> DataFrame:
    parts = []
    if candidates is not None:
        parts.append(candidates.select(F.lit("candidates").alias("t"), F.col("candidate_id").cast("string").alias("k"), F.col("payload_json").alias("x")))
    if raw_pairs is not None:
        parts.append(raw_pairs.select(F.lit("raw_pairs").alias("t"), F.col("record_id").cast("string").alias("k"), F.col("text").alias("x")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.filter("k is not null")


def _unfolded(tables: list, texts: list):
    for row, (name, text) in enumerate(zip(tables, texts)):
        if name == "candidates":
            for index, question, answer in message_pairs(text):
                yield row, index, question, answer
        else:
            question, answer = split_pair(text)
            yield row, 0, question, answer


def fit_endings(rows: DataFrame) -> Endings:
    """Count the terminal contexts of all answers; at most BUCKETS rows and one for each context come to the driver."""

    def count(tables: list, texts: list) -> dict:
        answers = [a for _, _, _, a in _unfolded(tables, texts) if not is_empty(a)]
        closes, goes_on = ending_counts(answers)
        seen = np.flatnonzero(closes + goes_on)
        ends: dict[str, list[int]] = {}
        for answer in answers:
            for k, context in enumerate(end_and_cut(answer)):
                if context:
                    ends.setdefault("\t".join(context), [0, 0])[k] += 1
        return {"b": [*seen.tolist(), *[None] * len(ends)], "x": [*[None] * len(seen), *ends], "c": [*closes[seen].tolist(), *(v[0] for v in ends.values())], "g": [*goes_on[seen].tolist(), *(v[1] for v in ends.values())]}

    closes, goes_on, ends = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64), {}
    counted = map_columns(rows.select("t", "x"), count, "b long, x string, c long, g long").groupBy("b", "x").agg(F.sum("c").alias("c"), F.sum("g").alias("g"))
    for r in counted.toLocalIterator():
        if r.x is None:
            closes[r.b], goes_on[r.b] = r.c, r.g
        else:
            ends[tuple(r.x.split("\t"))] = (r.c, r.g)
    return Endings(closes, goes_on, ends)


def defective_pairs(candidates: DataFrame | None = None, raw_pairs: DataFrame | None = None) -> DataFrame:
    """``(record_table, record_key, answer_index, defect)`` for every defective pair of either table.

    Pairs: an assistant message without tool calls and the nearest user message
    before it (null if there is none: then neither copy nor language is judged),
    or the question and answer of a raw text. A null answer, or a raw text
    without an answer, is ``empty``; a payload that isn't readable JSON with
    ``conversations`` has no pairs; rows with a null key are left out. Records
    delivered several times are reported once. One scan fits the model of
    endings, one judges; only defective rows are shuffled.
    """
    rows = _stored(candidates, raw_pairs)
    shared = rows.sparkSession.sparkContext.broadcast(fit_endings(rows))

    def judge(tables: list, keys: list, texts: list) -> dict:
        out: dict = {"record_table": [], "record_key": [], "answer_index": [], "defect": []}
        for row, index, question, answer in _unfolded(tables, texts):
            kind = defect(question, answer, shared.value)
            if kind:
                for name, value in zip(out, (tables[row], keys[row], index, kind)):
                    out[name].append(value)
        return out

    return map_columns(rows, judge, "record_table string, record_key string, answer_index long, defect string").distinct()


def pair_counts(candidates: DataFrame | None = None, raw_pairs: DataFrame | None = None) -> DataFrame:
    """``(record_table, defect, pairs)``: how many pairs have which defect."""
    return defective_pairs(candidates, raw_pairs).groupBy("record_table", "defect").agg(F.count(F.lit(1)).alias("pairs"))
