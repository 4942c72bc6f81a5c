"""Secrets in texts: fixed patterns, and literals that reach sensitive names.

Base spans come from three patterns (assign, access, hex). The method adds spans of kind "literal": a lexer reads
strings, names and operators of source and configuration syntax into name-literal pairs ("a = 'x'", "a: x" in
quotes, "a := x", "a => x", typed declarations, subscripts, XML elements, and the unquoted rest of environment, INI,
properties and YAML lines unless it names a constant or is code: a call, a subscript, or a dotted name without
digits; after NAME= in capitals nothing counts as code). Constants propagate through names and concatenations in the
order of the text: a name stands for what it was given last, or else for what it is given first further down. Literals
that together reach a sensitive name are scored by that name and by the length, entropy and kinds of characters of
their concatenation. With white space a literal counts for authorization and connection strings by its longest part,
after an auth scheme, and as a quoted passphrase of three words or more without it. A literal that a base span covers
adds none.

A name is sensitive by whole words ("db_password", "apiKey", "authtoken", but not "tokenizer" or "secretary"), unless
its last word says that it holds something about a secret ("token_path", "password_hint").

Defined results: null and empty texts have no spans and the digest of the empty string; repeated rows are scanned
one by one; an empty table gives an empty result; other columns aren't read. Spans count code points, ends are
exclusive. Lexing is linear in the text, and only texts that hold a sensitive name and "=", ":" or "<" are lexed.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# The base patterns, least lengths and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

# What makes a target name sensitive, and how much.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "secret": 1.0, "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0,
    "token": 0.9, "pwd": 0.9, "credential": 0.9, "connectionstring": 0.8, "authorization": 0.7, "signingkey": 0.9, "encryptionkey": 0.9,
    "passwords": 1.0, "secrets": 1.0, "credentials": 0.9,
}
# Literals that stand for a secret rather than being one.
PLACEHOLDER = re.compile(r"(?i)^(?:none|null|true|false|nil|undefined|string|str|text|required|optional|your.*|example.*|placeholder.*|x{4,}|\*+|\.+|-+)$|\$\{|\{\{|%\(|^<.*>$|^\$")

# Last words of names that hold something about a secret rather than a secret.
ABOUT = set("count field file filename folder hint id label length limit name path pattern policy prompt regex size title ttl type uri url".split())

_GATE = ("pass", "pwd", "secret", "token", "key", "credential", "connection", "authorization")
_SQUASH = re.compile(r"[^a-z]")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_LEX = re.compile(
    r"""(?P<string>"(?:[^"\\\n]|\\.)*"|(?<![A-Za-z0-9_])'(?:[^'\\\n]|\\.)*'|(?<![A-Za-z0-9_])`[^`\n]*`)"""
    r"""|(?P<name>[A-Za-z_$][A-Za-z0-9_$-]*(?:\.[A-Za-z_$][A-Za-z0-9_$-]*)*)"""
    r"""|(?P<op>:=|=>|->|==|!=|<=|>=|[=:+,;()\[\]{}<>\n&|?])"""
)
#: A line that sets a name to something without quotes, where a comment starts in it, and values that are code.
_LINE = re.compile(r"""^[ \t]*(?:-[ \t]+)?(?:(?:export|set|ENV)[ \t]+)?["']?([A-Za-z_][\w.-]*)["']?[ \t]*(?:[?:+]?=(?![=>])|:(?![:=]))[ \t]*([^\s"'`][^\n]*)""", re.MULTILINE)
_COMMENT = re.compile(r"(?<=[ \t])(?:#|;|//)")
_CODE = re.compile(r"(?:[A-Za-z_$]\w*(?:\.|->|::))*(?:[A-Za-z_$]\w*[(\[<].*[)\]>]|[A-Za-z_$]\w*)")
_ENVIRONMENT = re.compile(r"[ \t]*(?:(?:export|set|ENV)[ \t]+)?[A-Z_][A-Z0-9_]*=")
#: Schemes before credentials, and what asks for a passphrase rather than being one.
_SCHEME = re.compile(r"\s*(?:bearer|basic|digest|token|negotiate|apikey)\s", re.IGNORECASE)
_PROMPT = re.compile(r"(?i)\b(?:enter|passphrase|password|please)\b|[?:]\s*$")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)>([^<>\n]{8,})</\1>")
#: Score from which a literal is a secret: the name's weight plus up to 1 for the literal.
LEAST_SCORE = 1.4


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "apikey", "api_key")):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def name_weight(name: str) -> float:
    """How sensitive a target name is, 0 to 1: the most that a run of its words, or the end of one, stands for."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in ABOUT:
        return 0.0
    runs = {"".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(i + 3, len(words)) + 1)}
    return max((w for stem, w in SENSITIVE.items() if any(run == stem or run in words and run.endswith(stem) for run in runs)), default=0.0)


def literal_weight(value: str) -> float:
    """How much a literal looks like a secret, 0 to 1."""
    if len(value) < 8 or any(c.isspace() for c in value) or PLACEHOLDER.search(value):
        return 0.0
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.4 * min(1.0, entropy / 3.5) + 0.15 * kinds + 0.2 * (n >= 16))


def spaced_weight(name: str, value: str, quoted: bool) -> float:
    """The same for a literal that holds white space: only some names take one, and what is scored depends on them."""
    flat, parts = _SQUASH.sub("", name.lower()), value.split()
    if "passphrase" in flat and quoted and len(parts) > 2 and not PLACEHOLDER.search(value) and not _PROMPT.search(value):
        return literal_weight("".join(parts))
    if "authorization" in flat or ("connectionstring" in flat and "=" in value):
        return literal_weight(max(parts[1:] if _SCHEME.match(value) else parts, key=len, default=""))
    return 0.0


Literal = tuple[int, int]  # where it stands, without quotes


def pairs(text: str) -> list[tuple[int, str, list[Literal | str]]]:
    """(place, target name, parts) of each assignment, in order; a part is a literal's place or the name of a constant."""
    tokens = [(m.lastgroup, m.start(), m.end()) for m in _LEX.finditer(text)]
    word = lambda k: text[tokens[k][1] : tokens[k][2]]
    kind = lambda k: tokens[k][0] if 0 <= k < len(tokens) else None
    out: list[tuple[int, str, list[Literal | str]]] = []
    for k in range(1, len(tokens)):
        if kind(k) != "op" or word(k) not in ("=", ":", ":=", "=>"):
            continue
        t = k - 1
        while t >= 0 and kind(t) == "op" and word(t) in "])":
            t -= 1
        if kind(t) not in ("name", "string"):
            continue
        target = word(t).strip("\"'`")
        if kind(t - 1) == "op" and word(t - 1) == ":" and kind(t - 2) in ("name", "string") and word(k) == "=":
            target = word(t - 2).strip("\"'`")  # a declaration with a type
        parts: list[Literal | str] = []
        at = k + 1
        while True:
            while kind(at) == "op" and word(at) in "(":
                at += 1
            if kind(at) == "string":
                parts.append((tokens[at][1] + 1, tokens[at][2] - 1))
            elif kind(at) == "name" and not (kind(at + 1) == "op" and word(at + 1) in ("(", "=", ":")):
                parts.append(word(at))
            else:
                break
            at += 1
            while kind(at) == "op" and word(at) == ")":
                at += 1
            if kind(at) == "op" and word(at) == "+":
                at += 1
            elif kind(at) != "string" or isinstance(parts[-1], str):
                break
        if parts or word(k) in ("=", ":="):  # a name that is given something else is no constant from there on
            out.append((tokens[k][1], target, parts))
    for m in _ELEMENT.finditer(text):
        out.append((m.start(), m[1], [(m.start(2), m.end(2))]))
    lines = [(m, *_unquoted(m)) for m in _LINE.finditer(text)]
    quoted = sorted(part[0] for _, _, parts in out for part in parts if isinstance(part, tuple))
    known = {target for _, target, _ in out} | {m[1] for m, _, _ in lines}
    for m, start, end in lines:
        value, at = text[start:end], bisect_left(quoted, start)
        if at < len(quoted) and quoted[at] < end:
            continue  # an expression with literals, which is read above
        if value in known:
            out.append((m.start(2), m[1], [value]))
        elif _ENVIRONMENT.match(m[0]) or not _is_code(value):
            out.append((m.start(2), m[1], [(start, end)]))
    return sorted(out, key=lambda pair: pair[0])


def _unquoted(line: re.Match) -> tuple[int, int]:
    """Where the value of a line stands, without a comment and the sign that ends it."""
    value = line[2]
    if comment := _COMMENT.search(value):
        value = value[: comment.start()]
    return line.start(2), line.start(2) + len(value.rstrip().rstrip(",;"))


def _is_code(value: str) -> bool:
    """Whether a value is a call, a subscript, or a dotted name without digits."""
    found = _CODE.fullmatch(value)
    return bool(found) and (value[-1] in ")]>" or not any(c.isdigit() for c in value))


def literal_spans(text: str) -> list[tuple[str, int, int]]:
    """Literals that reach a sensitive name and score enough."""
    low = text.lower()
    if not any(g in low for g in _GATE) or not ("=" in text or ":" in text or "<" in text):
        return []
    found = pairs(text)
    if not any(name_weight(target) for _, target, _ in found):
        return []
    # Each assignment is a version of its name; names within it mean their version at that place.
    versions: list[list[Literal | str | int]] = []
    last: dict[str, int] = {}
    first: dict[str, int] = {}
    for k, (_, target, parts) in enumerate(found):
        versions.append([last.get(p, p) if isinstance(p, str) else p for p in parts])
        last[target] = k
        first.setdefault(target, k)
    out = set()
    for k, (_, target, _) in enumerate(found):
        weight = name_weight(target)
        if not weight:
            continue
        reached: list[Literal] = []
        todo, seen = [k], {k}
        while todo:
            part = todo.pop()
            if isinstance(part, tuple):
                reached.append(part)
                continue
            version = first.get(part) if isinstance(part, str) else part
            if version is not None and (version == k or version not in seen):
                seen.add(version)
                todo += [p for p in reversed(versions[version]) if p != k and (not isinstance(p, str) or first.get(p) != k)]
        value = "".join(text[i:j] for i, j in reached)
        if len(reached) == 1 and any(c.isspace() for c in value):
            score = spaced_weight(target, value, text[reached[0][0] - 1 : reached[0][0]] in ('"', "'", "`"))
        else:
            score = literal_weight(value)
        if weight + score >= LEAST_SCORE:
            out.update(("literal", *part) for part in reached if part[0] < part[1])
    return sorted(out)


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, both by start and then kind."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    more = [s for s in literal_spans(text) if not any(b[1] < s[2] and s[1] < b[2] for b in base)]
    return base, sorted([*base, *more], key=order)


def redact(text: str, mark: str = "[secret]") -> str:
    """text with every span replaced by mark; overlapping spans count as one."""
    out, at, upto = [], 0, -1
    for _, start, end in spans(text)[1]:
        if start < upto:
            upto = max(upto, end)
            continue
        if upto >= 0:
            at = upto
        out.append(text[at:start] + mark)
        upto = end
    return "".join(out) + text[max(at, upto) :] if out else text


def _join(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each text."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make(block: pa.RecordBatch) -> list[pa.Array]:
        counts: dict[str, list[int]] = {kind: [] for kind in KINDS[:3]}
        digests, all_spans = [], []
        for text in block.column("text").to_pylist():
            base, every = spans(text or "")
            for kind in counts:
                counts[kind].append(sum(s[0] == kind for s in base))
            digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
            all_spans.append(_join(every))
        return [block.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())]

    return map_texts(slim, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted_documents(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with secrets in text_col replaced, all other columns as they are.

    Null and empty texts stay as they are, ids aren't read, repeated rows are redacted alike, an empty table stays empty.
    """

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t if t is None else redact(t, mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
