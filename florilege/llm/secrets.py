"""Secret scans: base patterns, and a lexer of assignments.

Three base patterns give spans of their own. Beside them, the lexer reads source
and configuration syntax (name = "literal", "name": "literal", export NAME=word,
name: word) into name-literal pairs, of any length and over several lines where the
syntax has that (triple quotes, YAML blocks, quoted values of shell and .env), resolves names on the right-hand side and
joined literals by constant propagation, and scores each literal by how
sensitive the names are that it reaches and how random it looks. Literals that
score high enough are spans of kind "literal".
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Parts of names and their weight.
SENSITIVE = {"password": 4, "passwd": 4, "passphrase": 4, "pwd": 3, "secret": 4, "token": 3, "apikey": 4, "privatekey": 4, "accesskey": 3, "credential": 3, "auth": 2, "bearer": 3, "signing": 2, "salt": 1, "key": 1}
HARMLESS = re.compile(r"(?i)^(?:change[-_ ]?me|example|sample|placeholder|dummy|test|none|null|true|false|your[-_ ].*|x+|\*+|<.*>|\$\{.*\}|%\(.*\)s)$")
THRESHOLD = 5.0
HEAD = re.compile(r"""(?<![\w.-])["']?(?P<name>[A-Za-z_][\w.-]*+)["']?[ \t]*+(?P<sign>:=|=>|[=:])(?![=:/])[ \t]*+""", re.A)
QUOTED = {q: re.compile(rf"{q}([^{q}\\\n]*+(?:\\(?s:.)[^{q}\\\n]*+)*+){q}") for q in "\"'"}
TRIPLE = {q: re.compile(rf"{q}{q}{q}([^{q}\\]*+(?:(?:\\(?s:.)|{q}(?!{q}{q}))[^{q}\\]*+)*+){q}{q}{q}") for q in "\"'"}
#: A quoted value over several lines (shell, .env): its end is the end of a line, and no sign stands before that.
SPREAD = {q: re.compile(rf"{q}([^{q}\\]*+(?:\\(?s:.)[^{q}\\]*+)*+)(?<![=:]){q}(?=[ \t;,)]*(?:\r?\n|\Z))") for q in "\"'"}
BARE = re.compile(r"""[^\s"',;{}()\[\]]++""")
WORD = re.compile(r"[^+]+")
JOIN = re.compile(r"""[ \t]*+[+.][ \t]*+(?=["'$A-Za-z_])""")
BLOCK = re.compile(r"[|>][-+0-9]{0,2}[ \t]*+(?:#[^\n]*+)?\r?\n")
LINE = re.compile(r"([ \t]*+)([^\n]*+)\n?")
NAME = re.compile(r"[$]?[A-Za-z_]\w*+", re.A)
#: $NAME, ${NAME}, ${NAME:-word}; after a bare value's "$", and what may follow a reference in it.
REFERENCE = re.compile(r"""(?<!\\)[$](?:\{(?P<braced>[A-Za-z_][\w.-]*+)(?::[-=]?(?P<default>[^{}\s"']*+))?\}|(?P<plain>[A-Za-z_]\w*+))""", re.A)
BRACED = re.compile(r"""\{[A-Za-z_][\w.-]*+(?P<default>:[^{}\s"']*+)?\}""", re.A)
TAIL = re.compile(r"""[^\s"',;{}()\[\]=:?&]*+""")
IDENTIFIER = re.compile(r"[$]?\{?([A-Za-z_][\w.-]*+)\}?$", re.A)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in code points."""
    out = []
    low = text.lower()
    if "password" in low or "passwd" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def name_weight(name: str) -> int:
    flat = re.sub(r"[^a-z]", "", name.lower())
    return max((w for part, w in SENSITIVE.items() if part in flat), default=0)


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def literal_score(weight: int, value: str) -> float:
    """Weight of the names, plus what the literal's length and randomness add; 0 for placeholders and words."""
    if not weight or len(value) < 8 or HARMLESS.match(value):
        return 0.0
    return weight + min(2.0, len(value) / 16) + (entropy(value) - 3.0) + (any(c.isdigit() for c in value) and any(c.isalpha() for c in value))


class _Lexer:
    """Reads values at places of a text, of any length. A quote that opens a later value ends an earlier one, so that no two searches for an end cover the same stretch: reading is linear."""

    def __init__(self, text: str):
        self.text, self.block_end = text, 0

    def quoted(self, at: int, spread: bool) -> tuple[int, int, int, int] | None:
        """(start, end) of a quoted literal, where its value ends, where names are looked for next: inside, if it may hold lines."""
        text, q = self.text, self.text[at]
        if text.startswith(q * 3, at) and (m := TRIPLE[q].match(text, at)):
            return m.start(1), m.end(1), m.end(), m.start(1)
        if m := QUOTED[q].match(text, at):
            return m.start(1), m.end(1), m.end(), m.end()
        if spread and (m := SPREAD[q].match(text, at)):
            return m.start(1), m.end(1), m.end(), m.start(1)
        return None

    def bare(self, at: int, first: bool) -> tuple[int, int] | None:
        """Where a value without quotes ends, and where names are looked for next."""
        text = self.text
        if not (m := (BARE if first else NAME).match(text, at)):
            return None
        end = resume = m.end()
        while first and text[end - 1] == "$" and (r := BRACED.match(text, end)):
            end = r.end()
            if r["default"] is not None:
                return end, r.start() + 1
            resume, end = end, TAIL.match(text, end).end()
        # Of name+"literal", the sign belongs to what follows.
        if text[end - 1] in "+." and end - at > 1 and text[end : end + 1] in ("'", '"'):
            end, resume = end - 1, min(resume, end - 1)
        return end, resume

    def block(self, name_at: int, at: int) -> tuple[int, int, str] | None:
        """The literal of a YAML block: the lines after its sign that are indented more than the name's. Blocks in blocks are text."""
        text = self.text
        if at < self.block_end or not (m := BLOCK.match(text, at)):
            return None
        lead = text[text.rfind("\n", 0, name_at) + 1 : name_at]
        if lead.strip(" \t-\"'?"):
            return None
        indent, p, lines, start, end = len(lead.rstrip("\"'")), m.end(), [], -1, -1
        while p < len(text):
            line = LINE.match(text, p)
            if body := line[2].rstrip():
                if len(line[1]) <= indent:
                    break
                start, end = (line.start(2) if start < 0 else start), line.start(2) + len(body)
                lines.append(body)
            p = line.end()
        self.block_end = p
        return (start, end, "\n".join(lines)) if lines else None


def pairs(text: str) -> list[tuple[str, list[tuple[int, int, str]], list[str]]]:
    """(name, literals with their places, names that the value refers to) of every assignment, in order."""
    out, lexer, at = [], _Lexer(text), 0
    while m := HEAD.search(text, at):
        literals, names, p = [], [], m.end()
        at, first = p, True

        def references(a: int, b: int, literals=literals, names=names) -> None:
            for r in REFERENCE.finditer(text, a, b):
                names.append(r["braced"] or r["plain"])
                if r["default"]:
                    literals.append((*r.span("default"), r["default"]))

        while p < len(text):
            if text[p] in "\"'":
                if not (found := lexer.quoted(p, m["sign"] == "=" and first)):
                    break
                a, b, p, resume = found
                literals.append((a, b, text[a:b]))
                if text[b] == '"':
                    references(a, b)
            elif first and (found := lexer.block(m.start("name"), p)):
                literals.append(found)
                break
            elif found := lexer.bare(p, first):
                q, (p, resume) = p, found
                for part in WORD.finditer(text, q, p):
                    if part[0].strip("."):
                        literals.append((part.start(), part.end(), part[0]))
                        if i := IDENTIFIER.match(part[0]):
                            names.append(i[1])
                        else:
                            references(*part.span())
            else:
                break
            # Lines inside a literal may hold assignments: they are read from the first such literal on.
            at, inside = (resume, resume < p) if first or not inside else (at, True)
            first = False
            if not (j := JOIN.match(text, p)):
                break
            p = j.end()
        if literals:
            out.append((m["name"], literals, names))
    return out


class _Joined:
    """What scoring needs of a joined text: its length, ends and character counts."""

    ENDS = 32  # longer than every fixed form of HARMLESS

    def __init__(self):
        self.n, self.head, self.tail, self.counts = 0, "", "", Counter()

    def copy(self) -> _Joined:
        out = _Joined()
        out.n, out.head, out.tail, out.counts = self.n, self.head, self.tail, self.counts.copy()
        return out

    def add(self, n: int, head: str, tail: str, counts) -> None:
        if self.n < self.ENDS:
            self.head = (self.head + head)[: self.ENDS]
        self.tail = (self.tail + tail)[-self.ENDS :] if n < self.ENDS else tail
        self.n += n
        self.counts.update(counts)

    def add_text(self, text: str) -> None:
        self.add(len(text), text[: self.ENDS], text[-self.ENDS :], text)

    def add_joined(self, o: _Joined) -> None:
        self.add(o.n, o.head, o.tail, o.counts)

    def harmless(self) -> bool:
        if self.n <= self.ENDS:
            return bool(HARMLESS.match(self.head))
        # The ends decide, and of the middle whether it holds newlines or anything but x or *.
        kinds = set(self.counts)
        middle = "\n" if self.counts["\n"] > self.tail.count("\n") else "x" if kinds <= {"x", "X"} else "*" if kinds == {"*"} else "a"
        return bool(HARMLESS.match(self.head + middle + self.tail))

    def score(self, weight: int) -> float:
        """literal_score of the joined text."""
        if not weight or self.n < 8 or self.harmless():
            return 0.0
        shares = [c / self.n for c in self.counts.values()]
        varied = any(c.isdigit() for c in self.counts) and any(c.isalpha() for c in self.counts)
        return weight + min(2.0, min(self.n, 32) / 16) - sum(p * math.log2(p) for p in shares if p) - 3.0 + varied


def _stands_for(text: str, literal: tuple[int, int, str], known) -> bool:
    """Whether a literal is nothing but a reference to a known name, or with a default, which is a literal of its own."""
    a, b, value = literal
    return value[:1] == "$" and text[a - 1] != "'" and bool(r := REFERENCE.fullmatch(text, a, b)) and (bool(r["default"]) or (r["braced"] or r["plain"]) in known)


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, directly or through constants.

    Every assignment is a version of its name and refers to the versions that its value names. A
    literal's names are those of all versions that can be reached from its own: versions come in
    order, so one pass backwards gives each the best of what it reaches, however long the chain.
    """
    if "=" not in text and ":" not in text:
        return []
    versions, current = [], {}
    for name, literals, names in pairs(text):
        held = [current[n] for n in names if n in current]
        versions.append((name_weight(name), held, [x for x in literals if x[2] not in current and not _stands_for(text, x, current)]))
        current[name] = len(versions) - 1
    # The largest weight that each version reaches, and how many needed versions join its text.
    weight, users = [v[0] for v in versions], [0] * len(versions)
    for i in range(len(versions) - 1, -1, -1):
        for h in versions[i][1] if weight[i] else ():
            weight[h] = max(weight[h], weight[i])
            users[h] += 1
    # Texts are joined in order; one that nothing else needs grows in place.
    joined, score = {}, [0.0] * len(versions)
    for i, (w, held, own) in enumerate(versions):
        if not weight[i]:
            continue
        whole = None
        for h in held:
            users[h] -= 1
            if whole is None:
                whole = joined[h] if users[h] else joined.pop(h)
                whole = whole.copy() if users[h] else whole
            else:
                whole.add_joined(joined[h] if users[h] else joined.pop(h))
        whole = whole or _Joined()
        for x in own:
            whole.add_text(x[2])
        score[i] = whole.score(w)
        if users[i]:
            joined[i] = whole
    best: dict[tuple[int, int], float] = {}
    for i in range(len(versions) - 1, -1, -1):
        for h in versions[i][1]:
            score[h] = max(score[h], score[i])
        for a, b, value in versions[i][2] if weight[i] else ():
            best[a, b] = max(best.get((a, b), 0), literal_score(weight[i], value), score[i] if len(value) >= 8 else 0)
    return sorted((a, b, "literal") for (a, b), s in best.items() if s >= THRESHOLD)


def spans(text: str) -> tuple[list, list]:
    """(base spans, all spans), each by start, then kind."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text), key=order)
    more = literal_spans(text)
    return base, sorted([*base, *more], key=order) if more else base


def redacted(text: str, mark: str = "[secret]") -> str:
    """The text with every span replaced; overlapping and touching spans become one mark."""
    _, found = spans(text)
    out, at = [], 0
    for a, b, _ in sorted(found):
        if a >= at:
            if a > at or not out:
                out.append(text[at:a])
                out.append(mark)
        at = max(at, b)
    return "".join([*out, text[at:]]) if found else text


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: str = "spans", extra: list[str] | None = None) -> DataFrame:
    """Find secrets in whole texts; a null text has none.

    outputs "spans": doc_id, spans array<struct<kind,start,end>>, redacted; "redacted": doc_id,
    text with the spans replaced (null stays null), and the columns in extra; "digests":
    doc_id, counts of the base kinds, the base spans' sha256, all spans joined.
    """
    joined = lambda found: ",".join(f"{k}:{a}:{b}" for a, b, k in found)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = batch.column(0).cast(pa.int64())
            if outputs == "redacted":
                yield pa.RecordBatch.from_arrays([ids, pa.array([None if t is None else redacted(t) for t in texts], pa.string()), *batch.columns[2:]], [id_col, text_col, *batch.schema.names[2:]])
                continue
            found = [spans(t or "") for t in texts]
            if outputs == "spans":
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                cols = {"spans": pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in x] for _, x in found], kind), "redacted": pa.array([redacted(t) if x[1] else t for t, x in zip(texts, found, strict=True)], pa.string())}
            else:
                cols = {f"n_{k}": pa.array([sum(s[2] == k for s in x) for x, _ in found], pa.int64()) for k in KINDS[:3]}
                cols |= {"base_sha256": pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x, _ in found], pa.string()), "spans": pa.array([joined(x) for _, x in found], pa.string())}
            yield pa.RecordBatch.from_pydict({"doc_id": ids, **cols})

    own = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col), *(extra or []))
    schema = {
        "spans": "doc_id long, spans array<struct<kind:string,start:long,end:long>>, redacted string",
        "digests": "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
        "redacted": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema),
    }
    return own.mapInArrow(run, schema[outputs])
