"""Secret scans: base patterns, and multipart credentials linked by an interval join.

Weak candidates (access identifiers, plain secrets, endpoints) are found as spans; spans of different
kinds are joined where both stand in the same scope (a stretch of text without an empty line), and, if
``reach`` is given, one begins within so many code points of the other's end. Names may have a prefix
(DB_USER, AWS_ACCESS_KEY_ID); spans begin at the name without it. A weak secret is reported only next to an
identifier or an endpoint, an identifier or endpoint only next to a secret. Null texts count as empty; texts
may be of any length; repeated rows are scanned each, whatever their id; spans that begin at one place go in
the order of the kinds; other columns pass through ``redact``.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import over_texts, record

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
# Weak candidates of the method: they count only together.
IDENT = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:_?name|_?id)?|login|client_?id|account(?:_?id)?|(?<!secret_)access_?key(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.=-]{3,})""", re.I | re.A)
WEAK = re.compile(r"""(?<![A-Za-z0-9])(?:pass|pwd|pw|auth|credential|secret_?(?:access_?)?key|private_?key|client_?key|signature|sig)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", re.I | re.A)
ENDPOINT = re.compile(r"""(?<![A-Za-z0-9])(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh)://[^\s"'<>]+|(?<![A-Za-z0-9])(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?""", re.I | re.A)
SIGNS_OF_WEAK = (":", "=")
SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")


@dataclass(frozen=True)
class SecretConfig:
    reach: int | None = None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns in code points, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # runs are maximal, so that the long ones are the same without the short ones
    out += [("hex", m.start(), m.end()) for m in HEX_LONG.finditer(text)]
    return ordered(out)


def ordered(spans: list) -> list:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def interval_join(left: list, right: list, reach: int | None, scopes: list[int]) -> set[int]:
    """Places in ``left`` of spans with a span of ``right`` in the same scope, within reach if given; both by start.

    One binary search a span: existence is asked for, so a crowd of parts costs no pairs.
    """
    reach = 1 << 62 if reach is None else reach
    starts = [s for _, s, _ in right]
    far = []  # the largest end so far, to look back from a start
    for _, _, e in right:
        far.append(max(e, far[-1]) if far else e)
    found = set()
    for i, (_, s, e) in enumerate(left):
        scope = bisect.bisect_right(scopes, s)
        low = scopes[scope - 1] if scope else 0
        high = scopes[scope] if scope < len(scopes) else 1 << 62
        k = bisect.bisect_left(starts, s)
        after = k < len(starts) and starts[k] <= min(e + reach, high - 1)
        before = k > 0 and starts[k - 1] >= low and far[k - 1] >= s - reach
        if after or before:
            found.add(i)
    return found


def linked_spans(text: str, base: list, config: SecretConfig = SecretConfig()) -> list[tuple[str, int, int]]:
    """Spans the method adds: weak parts that complement each other or a base span."""
    if not any(c in text for c in SIGNS_OF_WEAK):
        return []
    ident = [("ident", m.start(), m.end()) for m in IDENT.finditer(text)]
    weak = [("weak", m.start(), m.end()) for m in WEAK.finditer(text)]
    if not (ident or weak) and not base:
        return []
    ends = [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    scopes = [0, *(m.end() for m in SCOPE_END.finditer(text))]
    access = [s for s in base if s[0] == "access"]
    strong = [s for s in base if s[0] == "assign"]
    identifiers = sorted(ident + access, key=lambda s: s[1])
    reported = interval_join(weak, sorted(identifiers + ends, key=lambda s: s[1]), config.reach, scopes)
    weak = [weak[i] for i in sorted(reported)]
    secrets = sorted(weak + strong, key=lambda s: s[1])
    out = weak + [ident[i] for i in interval_join(ident, secrets, config.reach, scopes)]
    out += [ends[i] for i in interval_join(ends, secrets, config.reach, scopes)]
    return out


def scan(text: str, config: SecretConfig = SecretConfig()) -> tuple[list, list]:
    """Base spans, and all spans, each by start, then kind."""
    base = base_spans(text)
    return base, ordered(base + linked_spans(text, base, config))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame, config: SecretConfig = SecretConfig(), doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""

    def rows(part, texts):
        n, digests, spans = {"assign": [], "access": [], "hex": []}, [], []
        for t in texts:
            base, every = scan(t, config)
            for kind in n:
                n[kind].append(sum(s[0] == kind for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        return record(doc_id=part.column(doc_id), n_assign=n["assign"], n_access=n["access"], n_hex=n["hex"], base_sha256=digests, spans=spans)

    kind = docs.schema[doc_id].dataType.simpleString()
    return over_texts(docs.select(doc_id, text), text, rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, config: SecretConfig = SecretConfig()) -> str:
    """The text with every secret span (not the endpoints) replaced by its kind in brackets; overlaps merge."""
    spans = [s for s in scan(text, config)[1] if s[0] != "endpoint"]
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, config: SecretConfig = SecretConfig(), text="text", n_chars="n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with secrets replaced in the text, and n_chars, if there, made to fit; null stays null."""

    def rows(part, texts):
        new = [None if old is None else redacted(t, config) for t, old in zip(texts, part.column(text).to_pylist(), strict=True)]
        own = dict(zip(part.schema.names, part.columns, strict=True))
        own[text] = pa.array(new, pa.string())
        if n_chars in own:
            old = own[n_chars].to_pylist()
            own[n_chars] = pa.array([n if t is None or was is None or t == w else len(t) for n, t, was, w in zip(old, new, part.column(text).to_pylist(), texts, strict=True)], part.schema.field(n_chars).type)
        return record(**own)

    return over_texts(docs, text, rows, docs.schema)
