"""Personal data with offset-preserving deobfuscation.

Base detectors find plain identifiers.  Texts that hold homoglyphs, invisible
characters, spelled digits or at/dot disguises also pass through transducers
that rewrite them to plain characters and keep, for each character written, the
source span it came from; the same detectors run on the rewritten text and
their spans are mapped back.

"Noun at domain" is plain prose, so a bare at before a plainly written domain is
read as a sign only where the place tells a person: marks in the name, or words
that address somebody right before it.  A lone number word counts as a digit only
where digits go on, or end, beside it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import told

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot start inside a run of digits, so the lookbehind only saves rescans.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Look-alike letters outside NFKC, by the ASCII letter they show.
LOOK_ALIKES = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "іιı", "j": "ј", "k": "кκ", "l": "ӏ", "o": "оο",
    "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υ", "v": "ν", "w": "ԝ", "x": "хχ", "y": "у", "A": "АΑ", "B": "ВΒ", "C": "С",
    "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ",
    "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", ".": "․。", "-": "‐‑‒–−", "@": "＠﹫",
}
#: Spelled digits in four languages.
DIGITS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
#: Words that stand for the at sign, the dot and the plus sign.
AT, DOT, PLUS = "at|arroba|chez", "dot|punkt|point|punto", "plus|más"

#: Last labels that tell an address after a bare at without other evidence: generic ones
#: and those of countries, but for words of the four languages.
TOP_LEVEL = (
    "com|org|net|edu|gov|mil|int|info|biz|io|co|eu|de|fr|es|uk|us|example|test|dev|app|name|mobi|cloud|online|"
    "ad|ae|af|ag|al|ao|aq|ar|aw|ax|az|ba|bb|bd|bf|bg|bh|bi|bj|bm|bn|bo|br|bs|bt|bw|bz|ca|cc|cd|cf|cg|ch|ci|ck|cl|cm|"
    "cn|cr|cu|cv|cw|cx|cy|cz|dj|dk|dm|dz|ec|ee|eg|er|fi|fj|fk|fm|fo|ga|gb|gd|ge|gf|gg|gh|gi|gl|gm|gn|gp|gq|gr|gs|gt|"
    "gu|gw|gy|hk|hm|hn|hr|ht|hu|id|ie|im|iq|ir|je|jm|jo|jp|ke|kg|kh|ki|km|kn|kp|kr|kw|ky|kz|lb|lc|li|lk|lr|ls|lt|lu|"
    "lv|ly|mc|md|mg|mh|mk|ml|mm|mn|mo|mp|mq|mr|ms|mt|mv|mw|mx|mz|nc|nf|ng|ni|nl|np|nr|nz|om|pe|pf|pg|ph|pk|pl|pm|"
    "pn|pr|ps|pt|pw|py|qa|ro|rs|ru|rw|sb|sc|sd|sg|sh|sk|sl|sm|sn|sr|ss|st|sv|sx|sy|sz|tc|td|tf|tg|th|tj|tk|tl|tm|"
    "tn|tr|tt|tv|tw|tz|ua|ug|uy|uz|va|vc|vg|vi|vn|vu|wf|ws|ye|yt|za|zm|zw")
#: Words that speak of an address soon after them, and words that are no name before or domain after an at.
CUES = r"e-?mails?|mail(?:to|s)?|contact|write|reach|address|kontakt|schreib\w*|adresse|courriel|[ée]cri\w*|correo|escrib\w*"
NO_NAME = ("us|me|him|her|them|it|is|are|was|were|be|been|available|found|find|look|looking|looked|hosted|visit|online|"
           "website|site|sites|page|pages|here|there|more|out|up|down|live|work|works|read|see|met|and|or|not")
#: Words that address the person named right after them.
ADDRESSED = (r"ask|ping|message|contact|e-?mail(?:\s+to)?|mail(?:\s+to|to)|write\s+to|reach(?:\s+out\s+to)?|kontakt|"
             r"schreib\w*\s+an|[ée]cri\w*\s+à|escrib\w*\s+a|demande\w*\s+à|frag\w*|pregunt\w*\s+a")
NO_DOMAIN = "which|what|whom|whose|where|when|who|why|some|any|all|no|once|least|most|first|last|the|a|an|this|that|these|those|my|your|his|our|their|each|every|der|die|das|dem|den|ein|eine|le|la|les|un|une|el|los|las"

_INVISIBLE = "­​‌‍⁠﻿"
_PLAIN = {c: a for a, cs in LOOK_ALIKES.items() for c in cs} | dict.fromkeys(_INVISIBLE, "")
_DIGIT_OF = {w: str(d) for words in DIGITS.values() for d, w in enumerate(words.split())}
_DIGIT_WORD = "(?:" + "|".join(sorted(_DIGIT_OF, key=lambda w: (-len(w), w))) + ")"
_DIGIT_RUN = re.compile(rf"(?i)(?<!\w){_DIGIT_WORD}(?:[\s-]+{_DIGIT_WORD})*(?!\w)")
_ONE_DIGIT = re.compile(rf"(?i){_DIGIT_WORD}")
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
# A match starts where white space starts: else every place of a long blank would be tried.
_BOXED_AT = re.compile(rf"(?i)(?<!\s)\s*{_OPEN}\s*(?:{AT}|@)\s*{_CLOSE}\s*")
_BOXED_DOT = re.compile(rf"(?i)(?<!\s)\s*{_OPEN}\s*(?:{DOT}|\.)\s*{_CLOSE}\s*")
_END = r"(?![A-Z0-9-]|\.[A-Z0-9])"
_MANY = rf"(?:[A-Z0-9-]+\s+(?:{DOT})\s+){{0,126}}"
_TAIL = rf"{_MANY}(?:{TOP_LEVEL}){_END}"
_SPELLED = rf"(?:[A-Z0-9-]+\.)*[A-Z0-9-]+\s+(?:{DOT})\s+"
_NOT_THE = rf"(?!(?:{NO_DOMAIN})(?![A-Z0-9-]))"
_BARE_AT = re.compile(rf"(?i)(?<=[A-Z0-9._%+-])\s+(?:{AT})\s+(?={_NOT_THE}{_SPELLED}{_TAIL})")
# Any ending of two or more letters: what else the place tells is weighed by _told.
_ANY_AT = re.compile(rf"(?i)(?<=[A-Z0-9._%+-])\s+(?:{AT})\s+(?={_NOT_THE}"
                     rf"(?P<domain>{_SPELLED}{_MANY}(?:(?!(?:{DOT})\b)[A-Z]{{2,}}){_END}"
                     rf"|(?!www\.)(?:[A-Z0-9-]+\.)+(?-i:[a-z]{{2,}}|[A-Z]{{2,}}){_END}(?![/:@])))")
_BARE_DOT = re.compile(rf"(?i)(?<=[A-Z0-9-])\s+(?:{DOT})\s+(?={_TAIL}|[0-9])")
# After an at sign the domain is known to be one: its dots are read up to the last label.
_AFTER_AT = re.compile(rf"(?i)(?<=@)[A-Z0-9.-]*[A-Z0-9-](?:\s+(?:{DOT})\s+[A-Z0-9-]*[A-Z0-9])+")
_SPACED_DOT = re.compile(rf"(?i)\s+(?:{DOT})\s+")
# Signs set apart by blanks, single characters set apart, and digits set apart in four dotted groups.
_LABEL = r"[A-Z0-9-]{1,63}"
_BLANK_AT = re.compile(rf"(?i)(?<=[A-Z0-9._%+-])[\x20\t]+@[\x20\t]+{_LABEL}(?:[\x20\t]?\.[\x20\t]?{_LABEL}){{0,9}}"
                       rf"[\x20\t]+\.[\x20\t]+(?:{TOP_LEVEL}){_END}")
_SPREAD = re.compile(r"(?i)(?<!\S)[A-Z0-9._%+-](?:\x20[A-Z0-9._%+-]){1,63}\x20@(?:\x20[A-Z0-9-]){1,63}"
                     r"(?:\x20\.(?:\x20[A-Z0-9-]){1,63}){1,9}(?!\S)")
_BYTE = r"[0-9](?:\x20?[0-9]){0,2}"
_SPREAD_IP = re.compile(rf"(?i)(?<![0-9])(?<![0-9]\x20){_BYTE}(?:\s+(?:{DOT})\s+{_BYTE}){{3}}(?!\x20?[0-9])")
_REFERENCE = re.compile(r"(?i)&(?:#(?:0{0,5}(?:64|46)|x0{0,4}(?:40|2e))|commat|period);")
_SIGN_APART = re.compile(r"[\x20\t]@[\x20\t]")
_BEFORE = re.compile(rf"(?i)(?:[0-9][\x20().-]*|(?<!\w)(?:{DOT}|{PLUS})\s+)$")
_BEHIND = re.compile(rf"(?i)[\x20().-]*[0-9]|\s+(?:{DOT})(?!\w)")
_ADDRESSED = re.compile(rf"(?i)(?<!\w)(?:{ADDRESSED})\s*[:\s]\s*$")
_CUE = re.compile(rf"(?i)(?<!\w)(?:{CUES})(?!\w)")
_WORDS = re.compile(r"\w+")
_STOPS = frozenset(NO_NAME.split("|"))
_PLUS = re.compile(rf"(?i)(?<!\w)(?:{PLUS})\s+(?=[0-9])")


def _emails(text: str):
    """Leftmost non-overlapping addresses, in one pass over the at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        head = text[done:at]
        start = done + len(head.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of plain identifiers, by start, then kind."""
    out = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@lru_cache(maxsize=65536)
def _plain(c: str) -> str:
    """What a look-alike shows: a mapped letter, nothing, an ASCII form, or itself."""
    if c < "­":
        return c
    if c in _PLAIN:
        return _PLAIN[c]
    form = unicodedata.normalize("NFKC", c)
    return form if len(form) == 1 and "!" <= form <= "~" else str(unicodedata.digit(c)) if c.isdigit() and \
        unicodedata.category(c) == "Nd" else c


class Tape:
    """A rewritten text; character k stands for source characters start[k] to end[k]."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def characters(self, write) -> None:
        """Transducer over single characters; each writes one character or none."""
        new = [write(c) for c in self.text]
        kept = [k for k, c in enumerate(new) if c]
        self.text = "".join(new)
        self.start, self.end = [self.start[k] for k in kept], [self.end[k] for k in kept]

    def spans(self, pattern: re.Pattern, write) -> None:
        """Transducer over matches; ``write`` gives (character, from, to) in the match."""
        text, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            text.append(self.text[at:m.start()])
            start += self.start[at:m.start()]
            end += self.end[at:m.start()]
            for c, s, e in write(m):
                text.append(c)
                start.append(self.start[m.start() + s])
                end.append(self.end[m.start() + e - 1])
            at = m.end()
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end = start + self.start[at:], end + self.end[at:]


def _as(sign: str):
    return lambda m: [(sign, 0, len(m[0]))]


def _same(m: re.Match):
    return [(c, k, k + 1) for k, c in enumerate(m[0])]


def _digits(m: re.Match):
    words = [(_DIGIT_OF[w[0].lower()], w.start(), w.end()) for w in _ONE_DIGIT.finditer(m[0])]
    return words if len(words) > 1 or _counts(m) else _same(m)


def _counts(m: re.Match) -> bool:
    """Whether a lone number word is a digit: it goes on, or ends, what digits or signs beside it began."""
    head, tail = m.string[max(0, m.start() - 24):m.start()], m.string[m.end():m.end() + 24]
    before, behind = _BEFORE.search(head), _BEHIND.match(tail)
    if before and (behind or before[0][0].isalpha()):
        return True
    if before:
        return not re.match(r"\s+\w", tail)
    return bool(behind) and (behind[0][-1].isalpha() or not re.search(r"\w\s+$", head))


def _name(m: re.Match) -> tuple[str, str]:
    """The name before a bare at, and what stands before that."""
    head = m.string[max(0, m.start() - 60):m.start()]
    before = head.rstrip(_LOCAL)
    return head[len(before):], before


def _told(m: re.Match) -> bool:
    """Whether what stands around a bare at tells an address: a name that is no common
    word, and before a plainly written domain marks in the name or words that address
    somebody; before a spelled one a cue, marks in the name or domain, or an end after."""
    text, domain = m.string, m["domain"]
    name, before = _name(m)
    if name.lower() in _STOPS:
        return False
    if not _SPACED_DOT.search(domain):
        return any(c in "0123456789._%+-" for c in name) or bool(_ADDRESSED.search(before))
    return bool(_CUE.search(before + name)) or any(c in "0123456789._%+-" for c in name + domain) \
        or not re.match(r"[^\S\n]+\w", text[m.end("domain"):m.end("domain") + 40])


def _as_named(m: re.Match):
    return _same(m) if _name(m)[0].lower() in _STOPS else [("@", 0, len(m[0]))]


def _joined(m: re.Match):
    """The match without its blanks."""
    return [(c, k, k + 1) for k, c in enumerate(m[0]) if not c.isspace()]


def _joined_dots(m: re.Match):
    return [x for x in _dots(m) if not x[0].isspace()]


def _as_told(m: re.Match):
    return [("@", 0, len(m[0]))] if _told(m) else _same(m)


def _dots(m: re.Match):
    out, at = [], 0
    for d in _SPACED_DOT.finditer(m[0]):
        out += [(m[0][k], k, k + 1) for k in range(at, d.start())] + [(".", d.start(), d.end())]
        at = d.end()
    return out + [(m[0][k], k, k + 1) for k in range(at, len(m[0]))]


def _reference(m: re.Match):
    return [("@" if re.search("(?i)64|40|commat", m[0]) else ".", 0, len(m[0]))]


def deobfuscate(text: str) -> Tape:
    """All transducers in order: characters, references, spelled digits, at and dot (boxed, bare, set apart), plus."""
    tape = Tape(text)
    if _odd(text):
        tape.characters(_plain)
    if _REFERENCE.search(tape.text):
        tape.spans(_REFERENCE, _reference)
    for pattern, write in _possible(tape.text):
        tape.spans(pattern, write)
    return tape


_DIGIT_WORDS, _AT_WORDS, _DOT_WORDS, _PLUS_WORDS = frozenset(_DIGIT_OF), *(
    frozenset(words.split("|")) for words in (AT, DOT, PLUS))
_BOX = re.compile(rf"(?i){_OPEN}\s*(?:{AT}|{DOT}|[@.])\s*{_CLOSE}")
#: The transducers over matches, in order, and the words one of which, or the pattern that, each needs.
SPANS = ((_DIGIT_RUN, _digits, _DIGIT_WORDS), (_BOXED_AT, _as("@"), _BOX), (_BOXED_DOT, _as("."), _BOX),
         (_SPREAD_IP, _joined_dots, _DOT_WORDS), (_SPREAD, _joined, _SIGN_APART), (_BLANK_AT, _joined, _SIGN_APART),
         (_BARE_AT, _as_named, _AT_WORDS), (_ANY_AT, _as_told, _AT_WORDS), (_AFTER_AT, _dots, _DOT_WORDS),
         (_BARE_DOT, _as("."), _DOT_WORDS), (_PLUS, _as("+"), _PLUS_WORDS))


def _possible(text: str) -> list:
    """Transducers whose words the text holds, each as a whole word; transducers make no new words."""
    # The dotted capital I counts as an i to the patterns.
    words = set(_WORDS.findall(text.lower().replace("i\u0307", "i")))
    met = {need: bool(need.search(text)) if isinstance(need, re.Pattern) else not need.isdisjoint(words)
           for _, _, need in SPANS}
    return [(p, w) for p, w, need in SPANS if met[need]]


def _odd(text: str) -> bool:
    return not text.isascii() and any(_plain(c) != c for c in set(text))


def disguised(text: str) -> bool:
    """Whether a transducer writes anything: none does if none matches the text itself."""
    return _odd(text) or bool(_REFERENCE.search(text)) or any(p.search(text) for p, _ in _possible(text))


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base): base spans, then those the method adds, in order.

    An added span is one that no base span covers.
    """
    text = text or ""
    base = detect(text)
    added = set()
    if disguised(text):
        tape = deobfuscate(text)
        for kind, s, e in detect(tape.text):
            span = min(tape.start[s:e]), max(tape.end[s:e])
            if not any(b <= span[0] and span[1] <= t for _, b, t in base):
                added.add((kind, *span))
    return sorted([(*s, True) for s in base] + [(*s, False) for s in added],
                  key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str | None) -> str | None:
    """The text with every found span, overlapping ones merged, replaced by ``[KIND]``."""
    if text is None:
        return None
    out, at, merged = [], 0, []
    for kind, s, e, _ in find(text):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans), one per input row; spans are (kind, start, end, base) in
    code points of the whole text, end exclusive.  Null texts are empty; repeated
    rows stay repeated; an empty table gives no rows; other columns are ignored."""
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "spans": [
                [dict(zip(("kind", "start", "end", "base"), s)) for s in find(t)] for t in b["text"]]})

    return told(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, "id string, spans array<struct<kind:string,start:long,end:long,base:boolean>>"))


def redact_docs(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with redacted texts (null stays null) and their new lengths; same columns."""
    schema = docs.schema

    at = docs.columns.index(text_col)

    def run(batches):       # the other columns pass as they are
        for b in batches:
            texts = pa.array([redact(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), texts)

    out = docs.mapInArrow(run, schema)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(
            F.length(text_col)).cast(schema[chars_col].dataType))
    return out


def spans_text(spans: Column, base_only: bool = False) -> Column:
    """``kind:start:end`` of the spans in order, comma-joined."""
    chosen = F.filter(spans, lambda s: s["base"]) if base_only else spans
    return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
