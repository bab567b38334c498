"""Secrets in texts, by lexing assignments.

Source and configuration syntax (name = literal, "name": literal, NAME := literal, name => literal,
name += literal, export, let and typed forms, subscripts and chains alike) is lexed into name-literal
pairs in one pass: the lexer goes from one assignment operator to the next, reads its target backwards to
where the last token ended and its value forwards, so no character is read more than a few times and time
is linear in the text. A value is a literal (quoted, triple-quoted, template, a block of indented lines
after `|` or `>`, bare), a name, or a concatenation of these by `+`, `.`, `..`, `&` or by standing side
by side. A name stands for what was last assigned to it in the same text: constants are propagated, also
through several names and concatenations. On a configuration line, which begins with the name, an unquoted
value runs to the next white space, and one word that ends the line and is no known name is a literal, too.
A pair scores by its target's name (whole sensitive words, split at underscores, dashes, dots and
capitals) and by its literal (length, kinds of characters, no placeholder). A pair of at least
`THRESHOLD` gives the spans of the literals that reach it, of kind "literal", unless a base span covers
them already. The base spans are those of three fixed patterns: assign, access and hex.

Cases: a null or empty text has no spans; equal spans are given once; repeated rows give equal rows;
positions count code points, ends are exclusive; other columns pass.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")
#: An assignment operator; those of comparisons, paths and arrows to the left are none.
OPERATOR = re.compile(r"::+|===?|[!<>~]=|:=|=>|[:=]")
NO_ASSIGNMENT = re.compile(r"::+|===?|[!<>~]=")
#: What names are made of; a word of letters alone; names, also with attributes; types that stand after a name.
NAME = f"{string.ascii_letters}{string.digits}_.-"
LETTERS_ONLY, NAMES = re.compile(r"[A-Za-z_]+"), re.compile(r"[A-Za-z_]+|[A-Za-z_]\w*+(?:\.[A-Za-z_]\w*+)++", re.ASCII)
TYPES = ("string", "str")
BLANKS, GAP = re.compile(r"[ \t]*+"), re.compile(r"(?:\s|\\\n)*+")
QUOTED = {q: re.compile(rf"{q}(?:[^{q}\\{end}]++|\\.)*+{q}", re.DOTALL) for q, end in (('"', r"\n"), ("'", r"\n"), ("`", ""))}
OPENING = re.compile(r"""[rRbBuUfF@$]{0,2}(?:(?P<triple>\"\"\"|''')|(?P<quote>["'`]))""")
BARE = re.compile(r"[A-Za-z0-9+/_.-]++(?:={1,2}(?![A-Za-z0-9+/_.=\"'-]))?")
JOINED = re.compile(r"\+(?!=)|\.{1,2}(?![A-Za-z0-9_.])|&(?!&)")
BLOCK = re.compile(r"[|>][+-]?[ \t]*+\r?\n(?P<lines>(?:[ \t]++[^\n]*+(?:\n|\Z))++)")
#: A type between a name's colon and the equals sign, of these characters; two words side by side are no type, unless the first one qualifies.
TYPE, ASIDE, QUALIFIES = re.compile(r"[ \t]*+[A-Za-z_&*\[][A-Za-z0-9_.:<>\[\],|&*?!' \t]*+"), re.compile(r"[A-Za-z0-9_\])>?][ \t]++[A-Za-z0-9_]"), re.compile(r"(?:'[a-z]++|\b(?:mut|const|unsigned|readonly))[ \t]++")
#: What may stand before the name of a configuration line; the rest of a value; and what only looks like one.
BEFORE = re.compile(r"""[ \t]*+(?:export[ \t]++|set[ \t]++|-[ \t]++)?["']?\Z""")
TOKEN, LAST, EXPRESSION = re.compile(r"\S*+"), re.compile(r"[ \t\r]*+(?:,[ \t\r]*+)?(?:(?<=[ \t])[#;][^\n]*+)?(?:\n|\Z)"), re.compile(r"[A-Za-z_][\w.]*+[(\[{].*|\$\{?[A-Za-z_]\w*+\}?")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Fixed weights of the words in a target's name.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "auth": 2, "private": 2, "key": 1, "access": 1, "api": 1, "signing": 1, "encryption": 1, "client": 1}
PLACEHOLDER = re.compile(r"(?:none|null|true|false|changeme|example|placeholder|undefined|todo|x+|\*+|<.*>|\$\{.*\}|\{\{.*\}\})\Z", re.IGNORECASE)
CHARACTERS = tuple(re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
THRESHOLD = 4


class Value(NamedTuple):
    """What a name stands for: of all its literals the length, kinds of characters and what speaks against them; the literals' spans, and the values it was put together from."""

    length: int
    kinds: int
    vain: bool
    spans: tuple[tuple[int, int], ...]
    of: tuple[Value, ...] = ()

    def score(self) -> int:
        if self.length < 6 or self.vain:
            return -9
        kinds = self.kinds.bit_count()
        return (self.length >= 8) + (kinds >= 2) + (kinds >= 3 or self.length >= 24)


class Pair(NamedTuple):
    name: str
    value: Value


def name_score(name: str) -> int:
    return sum({w: SENSITIVE.get(w, 0) for w in map(str.lower, WORDS.findall(name))}.values())


def literal(text: str, start: int, end: int) -> Value:
    content = text[start:end]
    kinds = sum(1 << k for k, p in enumerate(CHARACTERS) if p.search(content))
    return Value(end - start, kinds, " " in content or bool(PLACEHOLDER.match(content)), ((start, end),))


def together(parts: list[Value]) -> Value:
    if len(parts) == 1:
        return parts[0]
    kinds = 0
    for p in parts:
        kinds |= p.kinds
    return Value(min(sum(p.length for p in parts), 1 << 20), kinds, all(p.vain for p in parts), (), tuple(parts))


class Lexer:
    """pairs(): the names and values of a text's assignments, in order."""

    def __init__(self, text: str) -> None:
        self.text, self.known = text, {}
        self.open = {mark: True for mark in ('"""', "'''", "`")}  # whether one may still be closed
        self.block = 0  # where the last block of lines ends

    def pairs(self) -> Iterator[Pair]:
        text, at, floor, begin, seen = self.text, 0, 0, 0, None
        targets: list[str] = []
        value = declared = chain = None  # the targets' value; where a colon's value began; where a lone name that was a value did
        while m := OPERATOR.search(text, at):
            start, at = m.span()
            if NO_ASSIGNMENT.fullmatch(m[0]):
                floor, declared, chain = at, None, None
                continue
            newline = text.rfind("\n", seen or 0, start)
            first = newline >= 0 or seen is None  # of its line
            begin, seen = (newline + 1 if newline >= 0 else begin), start
            name, where = self.target(floor, start)
            if m[0] == "=" and declared is not None and self.is_type(declared, start):
                where = -1  # what stands here is the type of the colon's targets
            elif name and m[0] == "=" and where == chain:
                targets.append(name)
            else:
                yield from self.assigned(targets, value)
                targets = [name] if name else []
            place = BLANKS.match(text, at).end()
            value, end, lone = self.value(place, first and where >= 0 and bool(name) and BEFORE.match(text, begin, where) is not None)
            declared, chain = (at if m[0] == ":" and targets else None), (place if lone else None)
            floor = end if text[end - 1] in QUOTED else at
            at = max(at, end)
        yield from self.assigned(targets, value)

    def assigned(self, targets: list[str], value: Value | None) -> Iterator[Pair]:
        for target in targets:
            if value is None:
                self.known.pop(target, None)
            else:
                self.known[target] = value
                yield Pair(target, value)

    def is_type(self, start: int, stop: int) -> bool:
        return TYPE.fullmatch(self.text, start, stop) is not None and ASIDE.search(QUALIFIES.sub("", self.text[start:stop].strip())) is None

    def target(self, floor: int, stop: int) -> tuple[str, int]:
        """The name before an operator, and where it begins; floor: where the token before ended."""
        before = self.text[floor:stop].rstrip(" \t").removesuffix("?")
        if before.endswith("+"):
            before = before[:-1].rstrip(" \t")
        before = before.removesuffix("]")
        if before.endswith(('"', "'")):
            before = before[:-1]
        rest = before.rstrip(NAME)
        name = before[len(rest) :]
        if name in TYPES and rest.endswith((" ", "\t")):  # name type = value
            earlier = rest.rstrip(" \t")
            ahead = earlier.rstrip(NAME)
            if earlier[len(ahead) :] not in ("", "var", "let", "const", "final", "static", "private", "public"):
                name, rest = earlier[len(ahead) :], ahead
        short = name.lstrip("0123456789.-")
        return short, floor + len(rest) + len(name) - len(short)

    def value(self, place: int, config: bool) -> tuple[Value | None, int, bool]:
        """The value from here (None: no literal reaches it), where it ends, and whether it is but one name."""
        text = self.text
        quoted = OPENING.match(text, place)
        if config and not quoted:
            if place >= self.block and (m := BLOCK.match(text, place)):
                lines, self.block = m["lines"], m.end()
                return literal(text, m.start("lines") + len(lines) - len(lines.lstrip()), m.start("lines") + len(lines.rstrip())), m.start("lines"), False
            if (made := self.whole(place)) is not None:
                return made, place, False
        parts, at, end, lone, deep = [], place, place, False, False
        while text.startswith("(", at):
            deep, at = True, GAP.match(text, at + 1).end()
        while (term := self.term(at)) is not None:
            value, stop, name = term
            lone = not parts and name
            if value is None:
                end = stop if lone else end
                break
            parts.append(value)
            end = stop
            after = (GAP if deep else BLANKS).match(text, end).end()
            if text.startswith("\\\n", after):
                after = GAP.match(text, after).end()
            if m := JOINED.match(text, after):
                at = GAP.match(text, m.end()).end()
            elif after > end and text[end - 1] in QUOTED and text[after : after + 1] in (*QUOTED,):  # literals side by side
                at = after
            else:
                break
        return (together(parts) if parts else None), end, bool(lone) and len(parts) < 2

    def whole(self, at: int) -> Value | None:
        """A configuration line's unquoted value up to the next white space; a word of letters only if it ends the line."""
        text = self.text
        if text[at : at + 1] in ("[", "(", "{"):
            return None
        word = TOKEN.match(text, at)[0].rstrip(",;")
        end = at + len(word)
        if not word or word in self.known or EXPRESSION.fullmatch(word) or text.startswith(";", end):
            return None
        if LETTERS_ONLY.fullmatch(word) and not LAST.match(text, end) or JOINED.match(text, BLANKS.match(text, end).end()) or word.endswith("+"):
            return None
        return literal(text, at, end)

    def term(self, at: int) -> tuple[Value | None, int, bool] | None:
        """One literal or name from here: its value (None: unknown), its end, and whether it is a name."""
        text = self.text
        if m := OPENING.match(text, at):
            mark, start = m["triple"] or m["quote"], m.end()
            if not self.open.get(mark, True):
                return None
            closed = text.find(mark, start) if m["triple"] else found.end() - 1 if (found := QUOTED[mark].match(text, m.start("quote"))) else -1
            if closed < 0:
                if mark in self.open:
                    self.open[mark] = False
                return None
            content = text[start:closed]
            if m["triple"] and content.strip():  # without the white space around it
                return literal(text, start + len(content) - len(content.lstrip()), start + len(content.rstrip())), closed + 3, False
            return literal(text, start, closed), closed + len(mark), False
        if not (m := BARE.match(text, at)):
            return None
        word, end = m[0], m.end()
        if word.endswith("+") and text[BLANKS.match(text, end).end() :][:1] in (*QUOTED,):  # name+"literal"
            word, end = word[:-1], end - 1
        if (known := self.known.get(word)) is not None:
            return known, end, True
        if NAMES.fullmatch(word) or text[end : end + 1] in ("(", "[", "{"):
            return None, end, True
        return literal(text, at, end), end, False


def lexed(text: str) -> set[tuple[int, int]]:
    """The spans of literals that reach a sensitive name."""
    reached = []
    for name, value in Lexer(text).pairs():
        score = name_score(name.rsplit(".", 1)[-1])
        if score and score + value.score() >= THRESHOLD:
            reached.append(value)
    found, seen = set(), {}
    while reached:  # each value once, however often it was put together with others
        value = reached.pop()
        if id(value) not in seen:
            seen[id(value)] = value
            found.update(value.spans)
            reached.extend(value.of)
    return found


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind's number, end), sorted: the base spans, and all spans."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    low = text.lower()
    more = lexed(text) if any(w in low for w in SENSITIVE) else ()  # else no name is sensitive
    starts, upto = [s for s, *_ in base], [0, *accumulate((e for *_, e in base), max)]
    return base, sorted([*base, *((s, 3, e) for s, e in more if e > upto[bisect_right(starts, s)])])


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, base and spans: arrays of kind:start:end, by start and then by kind."""

    def make():
        def work(texts: list[str]) -> list[list]:
            both = [spans(t) for t in texts]
            return [[[f"{KINDS[k]}:{s}:{e}" for s, k, e in x[i]] for x in both] for i in (0, 1)]

        return work

    return map_texts(docs, text, keep, "base array<string>, spans array<string>", make)


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping spans replaced by `mask`; a null text stays null."""
    keep = tuple(c for c in docs.columns if c != text)

    def cover(t: str) -> str:
        parts, at, upto = [], 0, -1
        for s, _, e in spans(t)[1]:
            if s > upto:
                parts += [t[at:s], mask]
            upto = max(upto, e)
            at = max(at, e)
        return "".join(parts) + t[at:]

    flagged = docs.withColumn("__null", F.col(text).isNull())
    made = map_texts(flagged, text, (*keep, "__null"), "__clean string", lambda: lambda texts: [[cover(t) for t in texts]])
    return made.select(*(F.when(~F.col("__null"), F.col("__clean")).alias(text) if c == text else F.col(c) for c in docs.columns))


def of_kind(kind: str, column: str = "base") -> Column:
    return F.size(F.filter(column, lambda s: s.startswith(f"{kind}:"))).cast("long")
