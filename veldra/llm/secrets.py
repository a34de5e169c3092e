"""Secret scans (operator 9): fixed base patterns, and assignment-aware lexing with constant propagation."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, texts

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "literal")

#: Parts of a target name and how far they mark it as sensitive.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8}
#: "key" is sensitive after one of these.
KEY_AFTER = {"api", "access", "private", "secret", "signing", "encryption", "auth", "master"}
PLACEHOLDER = re.compile(r"(?i)^(?:true|false|null|none|nil|undefined|changeme|example|placeholder|your.*|<.*>|\$\{?.*|%.*%|x+|\*+|\.+)$")
LEAST = 0.5

#: Last parts of a name that say what a secret is like, where it lies or what it is called, not what it is.
ABOUT = {"file", "path", "type", "name", "length", "len", "size", "url", "uri", "field", "label", "id", "count", "expiry", "expires", "ttl", "policy", "hint", "prompt", "regex", "pattern", "min", "max", "enabled", "required", "format"}
#: Last parts that leave the part before them the last.
PLAIN = {"value", "default", "data", "text", "raw", "plain", "str", "string"}

CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
LEXEME = re.compile(
    r"""(?P<gap>[^\S\n]+)|(?P<line>\n)|(?P<string>[rbufRBUF]{0,2}(?:\"{3}|'{3}|["'`]))|(?P<block>/\*|<!--)|(?P<end>\*/|-->)"""
    r"""|(?P<define>\#[^\S\n]*define[^\S\n]+[^\W\d]\w*[^\S\n]+|define\s*\(\s*["'][^\W\d]\w*["']\s*,)|(?P<note>//|\#|--(?=[^\S\n]))|(?P<element><[^\W\d][\w.\-]*>)"""
    r"""|(?P<rule>~{16,}|\.{16,}|-{16,}|\*{16,}|={16,}|%{16,}|\^{16,}|&{16,}|@{16,}|!{16,}|\?{16,}|\|{16,}|\+{16,}|<{16,}|>{16,}|\${16,}|:{16,}|\\{16,})"""
    r"""|(?P<number>\d\w*)|(?P<name>[^\W\d][\w$]*(?:(?:\.|-|::|->|\?\.)[^\W\d][\w$]*)*)|(?P<other>[=!]==?|<=|>=|=>|:=|::|\+=|\.\.|\|\||\?\?|\\\n|.)""",
    re.DOTALL,
)
#: The rest of a string after its opening quote.
REST = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*{q}", re.DOTALL) for q in "\"'`"}
BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
KEY = re.compile(r"[^\W\d][\w.\- ]*")
DEFINED = re.compile(r"define[\s(\"']*(\w+)")


#: A constant inside a string: ${name} and $name, or {name} in a string that is marked as a template.
INSERTED = re.compile(r"\$\{[^\S\n]*(?P<braced>[^\W\d][\w.]*)[^\S\n]*\}|\$(?P<plain>[^\W\d]\w*)|\{[^\S\n]*(?P<field>[^\W\d][\w.]*)[^\S\n]*(?:![rsa])?(?::[^{}\n]*)?\}")
VARIABLE = re.compile(r"\$(?:\{([^\W\d]\w*)\}|([^\W\d]\w*))")
#: A sign that opens indented lines as a value, at the end of its line.
BLOCK = re.compile(r"[+\-0-9]{0,3}[^\S\n]*(?:\n|\Z)")
#: Last parts of calls that give a named setting, or what follows its name; and of calls that give their argument in another form.
GETTERS = {"getenv", "get", "env", "config", "setting", "setdefault", "getOrDefault", "getOrElse", "getProperty", "fetch", "lookup", "get_or_default"}
FORMS = {"b64", "base64", "b64decode", "b64encode", "decode", "encode", "bytes", "str", "String", "valueOf", "unhexlify", "fromhex", "fromHex", "from_hex", "fromBase64", "atob", "btoa", "strip", "trim", "quote", "SecretStr", "Secret", "Some"}
#: Keys whose value names the setting that a later VALUE_KEYS key of the same list item or object holds.
NAME_KEYS, VALUE_KEYS = {"name", "key"}, {"value"}


def name_weight(name: str) -> float:
    """How far a target's name marks its value as a secret: by the last part of a dotted name."""
    parts: list[str] = []
    for piece in reversed(re.split(r"\.|::|->", name)):
        parts = [p.lower() for p in CAMEL.findall(piece)]
        while len(parts) > 1 and parts[-1] in PLAIN:
            parts.pop()
        if parts and (len(parts) > 1 or parts[0] not in PLAIN):
            break
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    for a, b in zip(parts, parts[1:], strict=False):
        if b in ("key", "keys") and a in KEY_AFTER or (a, b) == ("pass", "phrase"):
            best = 1.0
    return 0.3 * best if parts and parts[-1] in ABOUT else best


class Value:
    """A literal, or values joined: spans of its own, the values it is made of, and what its weight is told from.

    Joined values are referred to, never copied, and all else has a fixed size, so a chain of constants costs as much as its
    text is long, whatever it would spell.
    """

    __slots__ = ("kinds", "length", "letters", "parts", "span", "text", "told")

    def __init__(self, parts: list[Value], span: tuple[int, int] | None = None, text: str = ""):
        self.parts, self.span, self.text, self.told = parts, span, text, False
        self.length = -1  # not told yet

    def summed(self) -> Value:
        """Itself, with length, kinds and letters told for it and all that it is made of, each once."""
        stack = [self]
        while stack:
            v = stack[-1]
            if v.length < 0 and (open_ := [p for p in v.parts if p.length < 0]):
                stack += open_
                continue
            stack.pop()
            if v.length < 0:
                v._sum()
        return self

    def _sum(self) -> None:
        self.length = self.kinds = self.letters = 0
        text = self.text
        if self.span and not PLACEHOLDER.match(text):
            found = set(text)
            self.length = min(40, len(text.strip()))
            self.kinds = (text != text.upper()) | (text != text.lower()) << 1 | any(map(str.isdigit, found)) << 2 | (not text.isalnum()) << 3
            for c in found:
                self.letters |= 1 << ord(c) % 64
        for p in self.parts:
            self.length = min(40, self.length + p.length)
            self.kinds |= p.kinds
            self.letters |= p.letters

    def weight(self) -> float:
        """How far the value looks like a secret: 0 for short or placeholder texts, up to 1 for long, varied ones.

        White space stands in quoted literals only, and doesn't speak against a passphrase.
        """
        return 0.0 if self.summed().length < 6 else min(1.0, 0.25 * self.kinds.bit_count() + 0.1 * math.log2(self.letters.bit_count()) + 0.01 * self.length)


def literal_weight(value: str) -> float:
    return Value([], (0, len(value)), value).weight()


class Lexer:
    """One pass over a text, that tells strings, comments, names and operators apart and follows assignments.

    A statement's pairs are read as they come: a target (a name, a quoted or bracketed key, an annotated name, an element, a macro)
    and the value behind its operator, joined of literals and of constants that were assigned before.
    """

    def __init__(self, text: str):
        self.text, self.known, self.found = text, {}, []
        self.dead: dict[str, int] = {}
        self.before: list[tuple[str, str]] = []  # the last lexemes of the statement
        self.comment = self.label = ""
        self.quoted = (-1, -1)  # the last string
        self.bare = self.solid = self.spoken = -1  # end of the last bare run, and its last characters that aren't punctuation or are letters
        self.weights: dict[str, float] = kept(("weights of names",), dict)
        self.stop()

    def weight(self, name: str) -> float:
        """name_weight(), kept in this worker for a bounded number of names."""
        if name not in self.weights:
            if len(self.weights) >= 10_000:
                self.weights.clear()
            self.weights[name] = name_weight(name)
        return self.weights[name]

    def stop(self) -> None:
        """No value is being read."""
        self.targets: list[tuple[str, bool]] = []
        self.parts: list[Value] = []
        self.wanted = self.typed = self.choice = False
        self.depth = self.getter = 0
        self.taken = ""  # the last name that was taken as a part

    def finish(self) -> None:
        """The value that was being read is whole."""
        if self.parts:
            seen = {id(p): p for p in self.parts}
            value = next(iter(seen.values())) if len(seen) == 1 else Value(list(seen.values()))
            for name, variable in self.targets:
                if variable and not self.comment:
                    self.known[name] = value
                if (weight := self.weight(name)) >= LEAST and weight * value.weight() >= LEAST:
                    self.tell(value)
        self.stop()

    def tell(self, value: Value) -> None:
        stack = [value]
        while stack:
            v = stack.pop()
            if not v.told:
                v.told = True
                stack += v.parts
                if v.span and v.span[1] > v.span[0] and v.length:
                    self.found.append(v.span)

    def string(self, at: int, mark: str) -> int:
        """End of the string whose opening quote ends at a place; -1 if there is none, which is looked for once in a line (or text)."""
        if at <= self.dead.get(mark, 0):
            return -1
        if len(mark) == 3:
            if (end := self.text.find(mark, at)) >= 0:
                return end + 3
            self.dead[mark] = len(self.text) + 1
        elif m := REST[mark].match(self.text, at):
            return m.end()
        else:
            end = self.text.find("\n", at)
            self.dead[mark] = len(self.text) if end < 0 else end
        return -1

    def target(self) -> tuple[str, bool] | None:
        """(name, whether it is a variable) of what is assigned here, from the lexemes before."""
        last = self.before[-1:]
        if last and last[0][0] == "name":
            return last[0][1], True
        if last and last[0][0] == "string":
            return (last[0][1], True) if KEY.fullmatch(last[0][1]) else None
        if last and last[0][1] == "]":
            inside = self.before[-2:-1]
            if inside and inside[0][0] == "string" and self.before[-3:-2] == [("other", "[")] and KEY.fullmatch(inside[0][1]):
                return inside[0][1], False
            for k in (2, 3):  # name[] and name[32]
                if self.before[-k : -k + 1] == [("other", "[")] and (named := self.before[-k - 1 : -k]) and named[0][0] == "name":
                    return named[0][1], True
        return None

    def assigned(self, op: str) -> None:
        if op == ":" and self.choice:
            self.wanted = True
            return
        new = self.target()
        if self.parts and self.parts[-1].span == self.quoted and self.before[-1:] and self.before[-1][0] == "string":  # the last string is a key, not a part of the value before it
            self.parts.pop()
        if self.parts and self.taken and self.before[-1:] == [("name", self.taken)]:  # nor is a name on a line behind a comma
            self.parts.pop()
        if op != "=" or self.parts or not self.targets:  # else a chain, or name: type = value
            self.finish()
        if new:
            self.targets.append(new)
            if new[0].lower() in VALUE_KEYS and self.label:
                self.targets.append((self.label, False))
                self.label = ""
        if self.targets:
            self.wanted, self.typed = True, op == ":"
            if op == "+=" and new and new[0] in self.known:
                self.parts = [self.known[new[0]]]

    def operand(self, kind: str, word: str, start: int, end: int) -> int:
        """Takes a name or bare word where a value may stand; returns where to go on."""
        if kind == "name" and word in ("or", "else"):
            self.wanted = True
            return end
        if not self.wanted:
            if not self.typed and not (kind == "name" and word in ("if", "and", "not")):
                self.finish()
            return end
        if word == "$" and (m := VARIABLE.match(self.text, start)) and (value := self.known.get(m[1] or m[2])) is not None:
            self.parts.append(value)
            self.wanted = False
            return m.end()
        run = self.run_end(start, end)
        if self.solid < end:
            run = end
        if kind == "name" and run == end:
            if self.text[end : end + 1] == "(":
                return self.call(word, end)
            if self.targets[-1][0].lower() in NAME_KEYS and not self.parts:
                self.label = word
            if (value := self.known.get(word)) is not None:
                self.parts.append(value)
                self.wanted, self.taken = False, word
                return end
            if not any(c.isdigit() for c in word):
                self.wanted = False
                return end
        if kind == "name" or (self.spoken >= start if run > end else any(c.isalnum() for c in word)):
            self.parts.append(Value([], (start, run), self.text[start:run]))
            self.wanted, self.taken = False, word if kind == "name" and run == end else ""
            return run
        return end

    def run_end(self, start: int, end: int) -> int:
        """End of the bare run from a place on, end at least. A run is read once, however many of its places are asked for."""
        if start >= self.bare:
            m = BARE.match(self.text, start)
            self.bare = m.end() if m else end
            self.solid = self.spoken = -1
            for at in range(self.bare - 1, start - 1, -1):
                if self.solid < 0 and self.text[at] not in ".:=+-|?":
                    self.solid = at
                if self.text[at].isalnum():
                    self.spoken = at
                    break
        return max(end, self.bare)

    def call(self, word: str, end: int) -> int:
        """A call where a value may stand. What it gives isn't known, nor are its arguments the value, but for a getter's default behind the
        name of what it gets, and for calls that give their argument in another form."""
        name = re.split(r"\.|::|->", word)[-1]
        if name in FORMS:
            self.depth += 1
            return end + 1
        if name in GETTERS and not self.getter:
            self.depth += 1
            self.getter, self.wanted = self.depth, False
            return end + 1
        self.finish()
        return end

    def block(self, start: int, end: int) -> int:
        """The indented lines under the line of a place, as a value: its end, or -1 where there are none."""
        line = self.text.rfind("\n", 0, start) + 1
        depth = len(self.text[line:start]) - len(self.text[line:start].lstrip())
        first, last, at = -1, -1, self.text.find("\n", end) + 1
        while 0 < at < len(self.text):
            stop = self.text.find("\n", at)
            stop = len(self.text) if stop < 0 else stop
            said = self.text[at:stop]
            if said.strip():
                if len(said) - len(said.lstrip()) <= depth:
                    break
                first = at + len(said) - len(said.lstrip()) if first < 0 else first
                last = at + len(said.rstrip())
            at = stop + 1
        if first < 0:
            return -1
        self.parts.append(Value([], (first, last), self.text[first:last]))
        self.finish()
        return last

    def spelt(self, lo: int, hi: int, template: bool) -> list[Value]:
        """Values of a string between two places: itself, or the constants that are put into it and what stands between."""
        found = [m for m in INSERTED.finditer(self.text, lo, hi) if (m["braced"] or m["plain"] or template and m["field"]) and (m["braced"] or m["plain"] or m["field"]) in self.known]
        if not found:
            return [Value([], (lo, hi), self.text[lo:hi])]
        out, at = [], lo
        for m in found:
            if m.start() > at:
                out.append(Value([], (at, m.start()), self.text[at : m.start()]))
            out.append(self.known[m["braced"] or m["plain"] or m["field"]])
            at = m.end()
        return [*out, Value([], (at, hi), self.text[at:hi])] if at < hi else out

    def other(self, word: str, start: int, end: int) -> int:
        if word in ("=", ":", ":=", "=>", "+="):
            if word == ":" and self.text[end : end + 2] == "//":  # an address
                return end
            self.assigned(word)
            self.before = []
            return end
        if not self.targets:
            return end
        if word in ("+", ".", "..", "||", "??") and self.parts:
            self.wanted = True
        elif word == "?":
            self.choice = self.wanted = True
        elif word == "(" or word == "[" and (self.wanted or self.typed):
            self.depth += 1
        elif word in ")]" and self.depth:
            if self.getter == self.depth:
                self.getter = 0
                if not self.parts:  # without a default what it gives isn't known
                    self.finish()
                    return end
            self.depth -= 1
        elif word == "," and self.getter:
            self.wanted = self.depth == self.getter
        elif word == "," and (self.depth or self.typed):
            self.wanted = self.wanted or bool(self.parts)
        elif word in "|>" and self.wanted and self.typed and not self.parts and BLOCK.match(self.text, end) and (stop := self.block(start, end)) > 0:
            return stop
        elif word in ",;{})]":
            self.finish()
        elif self.wanted and word not in "\\&*|<>":
            return self.operand("bare", word, start, end)
        return end

    def run(self) -> list[tuple[int, int]]:
        text, at, size = self.text, 0, len(self.text)
        match = LEXEME.match
        while at < size:
            m = match(text, at)
            kind, word, start, at = m.lastgroup, m[0], at, m.end()
            if kind in ("gap", "rule"):  # a long run of one sign is a line between things
                continue
            if kind == "line":
                if self.comment == "line":
                    self.finish()
                    self.comment = ""
                if not self.depth and not (self.wanted and self.parts):
                    self.finish()
                self.before = []
                continue
            if kind == "string":
                mark = word.lstrip("rbufRBUF")
                inside = start and (text[start - 1].isalnum() or text[start - 1] == "_")
                end = -1 if inside else self.string(at, mark)
                if end < 0 and len(mark) == 3 and not inside:  # an empty string, or a lone quote
                    mark, at = mark[0], at - 2
                    end = self.string(at, mark)
                if end < 0:
                    if len(word) > len(mark) and not inside:
                        kind, at = "name", start + len(word) - len(mark)
                        word = text[start:at]
                    else:
                        continue
                else:
                    value = text[at : end - len(mark)]
                    self.quoted = (at, end - len(mark))
                    if self.targets and (self.wanted or self.parts and self.before[-1:] and self.before[-1][0] == "string"):
                        template = "f" in word[: -len(mark)].lower()
                        if "$" in value and mark != "'" or template:
                            self.parts += self.spelt(at, end - len(mark), template)
                        else:
                            self.parts.append(Value([], (at, end - len(mark)), value))
                        if self.targets[-1][0].lower() in NAME_KEYS and len(self.parts) == 1 and len(value) <= 400:
                            self.label = value
                        self.wanted = False
                    self.before = [*self.before[-3:], ("string", value if len(value) <= 400 else "")]
                    at = end
                    continue
            if kind in ("block", "note", "end"):
                opens = kind == "block" or kind == "note" and (word != "#" and text[start - 1 : start] != ":" or word == "#" and (not start or text[start - 1].isspace()))
                if kind == "end" and self.comment == "block" or opens and not self.comment:
                    self.finish()
                    self.comment = {"block": "block", "note": "line", "end": ""}[kind]
                    self.before = []
                    continue
                if self.wanted:
                    at = self.operand("bare", word, start, at)
                continue
            if kind == "define":
                self.finish()
                self.targets, self.wanted = [(DEFINED.search(word)[1], True)], True
                self.depth = word.count("(")
            elif kind == "element":
                self.finish()
                end = text.find("<", at)
                if end > at and text.startswith("</" + word[1:], end) and "\n" not in text[at:end]:
                    self.targets, self.parts = [(word[1:-1], False)], [Value([], (at, end), text[at:end])]
                    self.finish()
                    at = end
            elif kind == "name":
                if text[start - 1 : start] == "$" and start and self.wanted and text[start - 2 : start - 1] == "{":
                    continue
                if self.targets:
                    at = self.operand(kind, word, start, at)
                self.before = [*self.before[-3:], (kind, word)]
            elif kind == "number":
                if self.targets:
                    at = self.operand("bare", word, start, at)
                self.before = [*self.before[-3:], (kind, word)]
            else:
                at = self.other(word, start, at)
                if word not in ("=", ":", ":=", "=>", "+="):
                    self.before = [*self.before[-3:], (kind, word)]
        self.finish()
        return sorted(self.found)


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive target by assignment, directly or through named constants."""
    if "=" not in text and ":" not in text and "define" not in text and "</" not in text:
        return []
    return Lexer(text).run()


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(base spans, literal spans): base spans as (start, index of the kind, end), in order."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(base), lexed(text)


#: The maximal runs of HEX with at least 24 characters: a shorter run can't hold a longer match.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def added(base: list[tuple[int, int, int]], literal: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """All spans, of two sorted lists; a literal inside a base span adds nothing."""
    out, k, reach = [], 0, 0
    for s, e in literal:
        while k < len(base) and base[k][0] <= s:
            reach = max(reach, base[k][2])
            k += 1
        if e > reach:
            out.append((s, 3, e))
    return sorted(base + out)


def redact(text: str, mark: str = "[REDACTED]") -> str:
    """The text with every secret replaced: of an assignment its value, else the whole span."""
    base, literal = scan(text)
    if not base and not literal:
        return text
    spans = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(s, e) for s, k, e in base if k] + literal
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in texts(batch.column(1)):
            base, literal = scan(text)
            counts = Counter(k for _, k, _ in base)
            rows.append((counts[0], counts[1], counts[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(added(base, literal))))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text, in code points, end exclusive.

    Base kinds: assign, access, hex. Kind literal: the text is lexed (strings, comments, names, operators) for name-literal pairs:
    name = "literal", name: literal, JSON, YAML, INI and := forms, chains, annotated targets, keys in brackets, elements, macros, joined
    and alternative literals, defaults of getters, arguments of calls that only change a value's form, indented blocks, and pairs of a key "name" and a
    key "value". Names bound to literals outside comments are constants and carry them to later assignments, also from inside
    strings that name them; a literal that reaches a name with a sensitive part and looks like a secret is a span where it is written.

    Nulls: a null text is empty (no spans); a null id is carried. Repeated rows each get a result; an empty table an empty one.
    Ties: spans are ordered by start, then kind. Very long texts are scanned whole, in time in proportion to their length.
    Extra columns are ignored, whatever their names; ids are of any type.

    Returns id_col, n_assign, n_access, n_hex, base_sha256, spans.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_rows, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _redacted(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(at)
            new = pa.array([None if not x.is_valid else redact(x.as_py()) for x in col], col.type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return run


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets replaced by a mark; n_chars, where there is one, follows a text that isn't null.

    Null and empty texts stay as they are, as do rows without an id; repeated rows are treated alike, an empty table stays empty,
    other columns pass unchanged whatever their names.
    """
    out = docs.mapInArrow(_redacted(docs.columns.index("text")), docs.schema)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)))
