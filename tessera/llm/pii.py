"""Personal data, plain and disguised, with offsets into the source text.

Plain e-mail addresses, IPv4 addresses, card numbers and phone numbers are
found first. A text that has signs of a disguise then goes through two
transducers: one folds homoglyphs, letters in circles, fullwidth and other digits,
blanks and hyphens of all kinds between digits, and drops invisible characters,
one reads spelled numbers and "at", "dot" and "underscore" written out, set off
by blanks, or as references of HTML.
Each normalised character keeps the source span it came from, so what is found
in the normalised text maps back to source characters. Such a span is added if
it holds a changed character and isn't inside another span of its kind.

A number word counts as a digit wherever a digit, number word, dot or plus is
next to it; what it then belongs to is left to the plain patterns. As a word at
the edge of an identifier may be prose, there are readings without those, too.

Offsets are code points, the end is exclusive. Null and empty texts have no
spans and stay as they are. Rows are judged each for itself, with any or equal
ids. An empty table gives no rows. All scans are linear in the text.
"""

from __future__ import annotations

import copy
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _spark

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:long,end:long>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match never begins inside a run of digits
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _luhn(digits: list[int]) -> bool:
    return sum(digits[-1::-2]) % 10 == -sum(d * 2 - 9 * (d > 4) for d in digits[-2::-2]) % 10


def plain(text: str) -> list[Span]:
    """The undisguised spans by start, then kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 40 and 14 <= len(digits := [int(c) for c in m[0] if c.isdigit()]) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁԛԝһкмтв" "АВЕКМНОРСТУХІЈЅ" "αορνικυ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ɑɡɩʏոսօհցԼ",
        "aeopcyxijsdqwhkmtb" "ABEKMHOPCTYXIJS" "aopviku" "ABEZHIKMNOPTYX" "agiynuohgL",
        strict=True,
    )
)
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _folded() -> dict[str, str]:
    table = dict(_LOOKALIKES) | dict.fromkeys(_INVISIBLE, "")
    for c in map(chr, [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2070, 0x208A), *range(0x2460, 0x2469), *range(0x24B6, 0x24EA), 0xFE52, 0xFE6B]):
        if len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii():
            table[c] = n
    for c in map(chr, range(0x80, 0x20000)):  # digits of every script
        if unicodedata.category(c) == "Nd":
            table[c] = str(unicodedata.digit(c))
    return table | dict.fromkeys("\u3002\uff61", ".") | {"\u0130": "I", "\u0131": "i", "\u017f": "s", "\u212a": "K"}  # patterns that ignore case take these for ASCII letters


def _ranges(characters: set[int]) -> str:
    """A class of the ranges that hold them; ranges that are near each other become one, as a class of few is quick to search."""
    out: list[list[int]] = []
    for c in sorted(characters):
        if out and c - out[-1][1] <= 12 and out[-1][0] >= 0x80:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out) + "]"


# Blanks and hyphens of other kinds: between digits they stand for plain ones.
_BLANK, _HYPHEN = "\u00a0\u2000-\u200a\u202f\u3000\t", "\u2010-\u2015\u2212\ufe63\uff0d"
_BETWEEN = re.compile(rf"(?<=[^\W_)])[{_BLANK}{_HYPHEN} -]?[{_BLANK}{_HYPHEN}][{_BLANK}{_HYPHEN} -]?(?=[^\W_(])")
_BLANKS = re.compile(f"[{_BLANK}]")
_FOLD = _folded()
_FOLD_CHARS = re.compile(_ranges(set(map(ord, _FOLD))))

# Digits, at and dot as written out in the corpus's languages.
_DIGITS = {
    word: str(n)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for n, word in enumerate(words.split())
} | {"oh": "0", "une": "1", "zwo": "2", "fuenf": "5"}
_TENS = {w: str(n) for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_DIGITS |= {w: str(n) for n, w in enumerate("ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), 10)} | {w: f"{d}0" for w, d in _TENS.items()}
_NUMBER = "(?:" + "|".join(sorted(_DIGITS, key=lambda w: (-len(w), w))) + ")"
_AT_WORD, _AT_NAME, _DOT_WORD = "(?:at|ät)", "(?:arobase|arroba|klammeraffe)", "(?:dot|point|punkt|punto)"
_AT_CODE, _DOT_CODE = r"&(?:#0{0,6}64|#x0{0,6}40|commat);", r"&(?:#0{0,6}46|#x0{0,6}2e|period);"
_OPEN, _CLOSE = r"[ ]{0,2}[\[({<][ ]{0,2}", r"[ ]{0,2}[\])}>][ ]{0,2}"
# An "at" without brackets may be prose: these endings, after dots written out, make it an address with any word before it.
_ENDS = "(?:com|org|net|edu|gov|info|io|co|uk|us|eu|de|fr|es|it|nl|ch|at|ru|cn|jp|in|br|ca|au|test)"
_DOT = rf"(?:\.|[ ]{{1,2}}{_DOT_WORD}[ ]{{1,2}}|{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE})"
# Other endings need only the shape of one, but then _is_address looks at the words around.
_HOST = rf"[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,63}}){{0,8}}{_DOT}[a-z]{{2,24}}\b"
_DISGUISE = re.compile(
    rf"(?P<at>{_AT_CODE}|{_OPEN}(?:{_AT_WORD}|{_AT_NAME}|@){_CLOSE}|(?<=[a-z0-9])[ ]{{1,2}}at[ ]{{1,2}}(?=[a-z0-9-]{{1,63}}(?:(?:[ ]{{1,2}}{_DOT_WORD}[ ]{{1,2}}[a-z0-9-]{{1,63}}){{0,4}}[ ]{{1,2}}{_DOT_WORD}[ ]{{1,2}}{_ENDS}\b|{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}[a-z0-9]))"
    rf"|(?<=[a-z0-9])[ ]{{1,2}}{_AT_NAME}[ ]{{1,2}}(?={_HOST}))"
    rf"|(?P<bare>(?<=[a-z0-9])(?:[ ]{{1,2}}at[ ]{{1,2}}|[ ]{{1,2}}@[ ]{{0,2}}|@[ ]{{1,2}})(?={_HOST}))"
    rf"|(?P<under>(?<=[a-z0-9])[ ]{{1,2}}(?:underscore|unterstrich)[ ]{{1,2}}(?=[a-z0-9]))"
    rf"|(?P<dot>{_DOT_CODE}|(?<=[a-z0-9])(?:[ ]{{1,2}}\.[ ]{{0,2}}|\.[ ]{{1,2}})(?={_ENDS}\b)|{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}|(?<=[a-z0-9])[ ]{{1,2}}{_DOT_WORD}[ ]{{1,2}}(?=[a-z0-9]))"
    rf"|(?P<plus>\bplus[ -]{{1,2}}(?={_NUMBER}\b|[0-9]))"
    rf"|(?P<digits>\b{_NUMBER}\b(?:[ -]{{1,2}}{_NUMBER}\b)*)",
    re.IGNORECASE,
)
_HOSTS = re.compile(_HOST, re.IGNORECASE)
_LABEL = re.compile("[a-z0-9-]+", re.IGNORECASE)
_KEPT = re.compile("[a-z0-9.-]+", re.IGNORECASE)
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_MAILBOX = re.compile(r"(?=.*[a-z])[a-z0-9+%-]+(?:[._%+][a-z0-9+%-]+)+\Z|[a-z-]+[0-9]+\Z", re.IGNORECASE)
_CUE = re.compile(r"\b(?:e-?mail|mail|mailto|contact|reach|address|write|send|message|ping)(?:[ ]to|[ ]is)?[ ]?:?[ ]?[<(\[\x22']?\Z", re.IGNORECASE)
# Words that stand before "at" in prose, and those that begin what it points to.
_BEFORE_AT = frozenset(
    "a about again aim aimed all and am angry are aren't arrive arrived arrives available back based be been best better bought but by call called come day directed down early even "
    "ever everyone first found from glance glanced go good had half has have held her here him his hosted i in is it just last late laugh laughed least left listed live lived lives "
    "located look looked looking looks made me meet meeting meets met more most much my no not now of off on once one only open or our out over people point pointed points posted "
    "published read registered right seen sent she shop shout sit site sits so sold some stand stands stare stared start started starts stay stayed stays still stop stopped stops "
    "study that the their them there they thing things this time to today together up us visit was we were what when where which while who will with work worked working works yet you".split()
)
_AFTER_AT = frozenset("a all an any both each every her his its least most my no one our some that the their these this those two what which your".split())
_WORD = re.compile(r"[^\W\d_]+")
_ALONE_BEFORE, _ALONE_AFTER = re.compile(r"(?:^|[\n(<\[,;:|])[ ]*\Z"), re.compile(r"[ ]*(?:\Z|[\n)>\],;|])")
# What makes a number word a digit: text before it that ends so, or after it that begins so.
_BEFORE = re.compile(rf"(?:[0-9+\])}}>]|\b(?:{_NUMBER}|{_DOT_WORD}|plus))[ ().-]*\Z", re.IGNORECASE)
_AFTER = re.compile(rf"[ ().-]*(?:[0-9\[({{<]|(?:{_NUMBER}|{_DOT_WORD})\b)", re.IGNORECASE)
_JOINT = re.compile("[ -]{1,2}(?=[0-9])")
_BACK_JOINT = re.compile(r"(?<=[0-9])[ -]{1,2}\Z")
_KEPT_DOT = re.compile(r" at {1,2}[a-z0-9-]{1,63}\.[a-z0-9]")
_AT_APART = re.compile("[a-z0-9](?: {1,2}@|@ )")
_DOT_APART = re.compile(rf"[a-z0-9](?: {{1,2}}\.|\. ) {{0,2}}{_ENDS}\b")
_NEAR = 12  # characters that are looked at on each side
# What a text has that can be rewritten, by plain searches first. A sign of its own stands for each alternative of _DISGUISE.
_BRACKETED_AT = re.compile(rf"[\[({{<][ ]{{0,2}}(?:at|ät|{_AT_NAME}|@)")
_NAMED_AT = re.compile(rf"[a-z0-9][ ]{{1,2}}{_AT_NAME}[ ]{{1,2}}[a-z0-9-]")
_CODED_AT, _CODED_DOT = re.compile(_AT_CODE), re.compile(_DOT_CODE)
_PLUS = re.compile(rf"plus[ -]{{1,2}}(?:{_NUMBER}|[0-9])")
_BRACKETED_DOT = re.compile(rf"[\[({{<][ ]{{0,2}}(?:\.|{_DOT_WORD})")
_SPACED_DOT = re.compile(rf"[a-z0-9][ ]{{1,2}}{_DOT_WORD}[ ]{{1,2}}[a-z0-9-]")
_DOTTED_NUMBER = re.compile(rf"(?:{_NUMBER}|[0-9])(?:[ ]{{0,2}}[\[({{<][ ]{{0,2}}(?:\.|{_DOT_WORD})|[ ]{{1,2}}{_DOT_WORD}[ ]|{_DOT_CODE})")
_NUMBER_WORD = re.compile(rf"\W{_NUMBER}(?!\w)")
_TOUCHED_BEFORE, _TOUCHED_AFTER = re.compile(rf"(?:{_NUMBER}|[0-9])[ ().+-]+\Z"), re.compile(rf"[ ().+-]+(?:{_NUMBER}|[0-9])")
_OTHER_BLANK, _OTHER_JOINT = re.compile("[\t    　]"), re.compile(f"[{_BLANK}{_HYPHEN}]")
_LINE_END = re.compile(r"(?<=[ \n]at)\n(?=[a-z0-9])|(?<=[a-z0-9])\n(?=at[ \n]|@[a-z0-9]|dot )|(?<= dot)\n(?=[a-z0-9])", re.IGNORECASE)
_AT_NAMES, _DOT_NAMES = ("arobase", "arroba", "klammeraffe"), ("dot", "point", "punkt", "punto")
_BROKEN = ("at\n", "\nat", "\n@", "dot\n", "\ndot ")


def _flat(text: str) -> str:
    """The text with blanks of all kinds as plain ones, and with line ends beside "at" and "dot" as blanks; as long as the text."""
    text = _OTHER_BLANK.sub(" ", text)
    if "\n" in text:
        folded = text.lower()
        if any(b in folded for b in _BROKEN):
            text = _LINE_END.sub(" ", text)
    return text


def _touching(folded: str) -> bool:
    """Whether a number word has another or a digit beside it."""
    for m in _NUMBER_WORD.finditer(" " + folded):
        if _TOUCHED_AFTER.match(folded, m.end() - 1) or _TOUCHED_BEFORE.search(folded, max(0, m.start() - 24), m.start()):
            return True
    return False


def _signs(text: str) -> bool:
    """Whether a text can hold a disguise: a quick test, which may say yes in vain. Plain searches come before patterns.

    A dot written out matters in an address, which has an @ or an "at", and between numbers.
    """
    if not text.isascii() and _FOLD_CHARS.search(text):
        return True
    folded = text.lower()
    if _BRACKETED_AT.search(folded) or ("&" in folded and _CODED_AT.search(folded)) or ("plus" in folded and _PLUS.search(folded)):
        return True
    if any(n in folded for n in _AT_NAMES) and _NAMED_AT.search(folded):
        return True
    if _touching(folded):
        return True
    at, at_word = "@" in folded, " at " in folded
    if at and (_AT_APART.search(folded) or _DOT_APART.search(folded)) or at_word and _KEPT_DOT.search(folded):
        return True
    named = any(n in folded for n in _DOT_NAMES)
    dotted = _BRACKETED_DOT.search(folded) or ("&" in folded and _CODED_DOT.search(folded)) or (named and _SPACED_DOT.search(folded))
    return bool(dotted and (at or at_word or _DOTTED_NUMBER.search(folded)))


class Normalised:
    """A text with the source span of each character, and whether it was changed."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.changed = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Each [start, end) of the present text becomes the given characters, which all come from that span."""
        if not edits:
            return
        text, start, end, changed, at = [], [], [], [], 0
        for low, high, new in edits:
            text += [self.text[at:low], new]
            start += [self.start[at:low], np.full(len(new), self.start[low])]
            end += [self.end[at:low], np.full(len(new), self.end[high - 1])]
            changed += [self.changed[at:low], np.ones(len(new), bool)]
            at = high
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end, self.changed = (np.concatenate([*x, y[at:]]) for x, y in ((start, self.start), (end, self.end), (changed, self.changed)))


Edit = tuple[int, int, str]


def _is_address(text: str, start: int, end: int) -> bool:
    """Whether " at " from start to end, which a host follows, stands for @: by the word before, and the host's first."""
    found = _LOCAL_END.search(text, max(0, start - 64), start)
    if not found:
        return False
    local, host = found[0], _HOSTS.match(text, end)[0]
    if _MAILBOX.match(local):
        return True
    if "@" in text[start:end] and not local.isdigit():
        return local.lower() not in _BEFORE_AT
    if local.lower() in _BEFORE_AT or _LABEL.match(host)[0].lower() in _AFTER_AT:
        return False
    # A kept dot is how prose names a site, too: a bare word needs a cue before it, or to stand alone with its host.
    if not _KEPT.fullmatch(host) or _CUE.search(text, max(0, found.start() - 24), found.start()):
        return True
    # A name in capitals that stands alone before a site is as likely its author.
    return not local[0].isupper() and bool(_ALONE_BEFORE.search(text, max(0, found.start() - 24), found.start()) and _ALONE_AFTER.match(text, end + len(host)))


def _readings(text: str) -> list[tuple[list[Edit], str]]:
    """Sets of edits, each with its name. Number words are read in runs of three or more, near digits, joined to these, or without runs at an edge."""
    signs: list[Edit] = []
    runs: dict[str, list[Edit]] = {k: [] for k in ("long", "near", "joined", "begun", "ended", "inner")}
    for m in _DISGUISE.finditer(text):
        if m.lastgroup == "bare" and not _is_address(text, m.start(), m.end()):
            continue
        if m.lastgroup != "digits":
            signs.append((m.start(), m.end(), {"at": "@", "bare": "@", "dot": ".", "plus": "+", "under": "_"}[m.lastgroup]))
            continue
        words = list(_WORD.finditer(m[0]))
        low, high = text[max(0, m.start() - _NEAR) : m.start()], text[m.end() : m.end() + _NEAR]
        begun, ended = bool(_BEFORE.search(low)), bool(_AFTER.match(high))
        if len(words) == 1 and not (begun or ended):
            continue
        # A blank after a number word belongs to no digit: it goes with the word before, but for the last.
        stops = [m.start() + w.start() for w in words[1:]] + [m.end()]
        named = [w[0].lower() for w in words]
        # "forty nine" is 49, "forty" alone 40.
        digits = [_TENS[n] if n in _TENS and after in _DIGITS and _DIGITS[after] in "123456789" else _DIGITS[n] for n, after in zip(named, [*named[1:], ""], strict=True)]
        edits = [(m.start() + w.start(), stop, d) for w, stop, d in zip(words, stops, digits, strict=True)]
        for name, wanted in (("long", len(words) > 2), ("near", True), ("begun", begun), ("ended", ended), ("inner", begun and ended)):
            runs[name] += edits if wanted else []
        if gap := _BACK_JOINT.search(low):
            runs["joined"].append((m.start() - len(gap[0]), m.start(), ""))
        gap = _JOINT.match(high)
        runs["joined"] += [*edits[:-1], (edits[-1][0], m.end() + (len(gap[0]) if gap else 0), edits[-1][2])]
    unlike = {tuple(edits): name for name, edits in reversed(runs.items())}
    return [(sorted([*signs, *edits]), name) for edits, name in unlike.items()]


def disguised(text: str, known: list[Span]) -> list[Span]:
    """Spans that only the normalised text shows."""
    flat = _flat(text)
    between = _OTHER_JOINT.search(text)
    joints = [m for m in _BETWEEN.finditer(text) if m[0] and (text[m.start() - 1].isdigit() or text[m.start() - 1] == ")") and (text[m.end()].isdigit() or text[m.end()] == "(")] if between else []
    if not joints and not _signs(flat):
        return []
    folded = Normalised(flat)
    folds = [(m.start(), m.end(), _FOLD[m[0]]) for m in _FOLD_CHARS.finditer(text) if m[0] in _FOLD] if not text.isascii() else []
    spaced = [(k, k + 1, " " if c == " " or _BLANKS.match(c) else "-") for m in joints for k, c in enumerate(m[0], m.start()) if c not in " -"]
    folded.rewrite(sorted([*folds, *spaced]))
    plain_ones = [[(s, e) for s, k, e in known if k == kind] for kind in range(len(KINDS))]
    found = set()
    for edits, reading in _readings(folded.text):
        n = copy.copy(folded)
        n.rewrite(edits)
        changed = np.r_[0, np.cumsum(n.changed)]
        dropped = np.r_[n.start[1:] > n.end[:-1], False] if len(n.start) else n.changed  # an invisible character goes after this one
        gaps = np.r_[0, np.cumsum(dropped)]
        for low, kind, high in plain(n.text):
            start, end = int(n.start[low]), int(n.end[high - 1])
            if not changed[high] - changed[low] + gaps[high - 1] - gaps[low]:
                continue
            if reading != "long" and kind == 0:  # digits don't make an address, but would join the words before it
                continue
            if reading == "joined":
                k = bisect_left(plain_ones[kind], (start, start))
                if k < len(plain_ones[kind]) and plain_ones[kind][k][1] <= end:  # "two 10.0.0.1" is no 210.0.0.1
                    continue
            found.add((start, kind, end))
    out, reach = [], [-1] * len(KINDS)
    for start, end, added, kind in sorted([*((s, -e, False, k) for s, k, e in known), *((s, -e, True, k) for s, k, e in found)]):
        if added and -end > reach[kind]:
            out.append((start, kind, -end))
        reach[kind] = max(reach[kind], -end)
    return sorted(out)


def find(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (plain spans), spans (plain and disguised ones), each by start, then kind, for every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, full = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                known = plain(text)
                more = disguised(text, known)
                for out, spans in ((base, known), (full, sorted([*known, *more]) if more else known)):
                    out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, _ARROW), pa.array(full, _ARROW)], names=["doc_id", "base", "spans"])

    source = _spark.columns(docs, doc_id=id, text=text)
    return source.mapInArrow(_spark.freed(scan), f"doc_id {source.schema[0].dataType.simpleString()}, base {SPANS}, spans {SPANS}")


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The same rows and columns with each span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    _spark.text_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def hide(value: str | None) -> str | None:
        if not value:
            return value
        known = plain(value)
        spans = sorted([*known, *disguised(value, known)])
        out, done = [], 0
        for start, kind, end in spans:
            if start >= done:
                out += [value[done:start], f"[{KINDS[kind].upper()}]"]
            done = max(done, end)
        return "".join([*out, value[done:]])

    def hidden(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array([hide(x.as_py()) for x in batch.column(at)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], column, *batch.columns[at + 1 :]], schema=batch.schema)

    return docs.mapInArrow(_spark.freed(hidden), docs.schema)


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
