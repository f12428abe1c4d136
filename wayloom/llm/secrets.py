"""Secret scans: all rules in one deterministic automaton, one pass over the bytes.

A rule is a head followed by a run (tail) with a least length.  All rules compile
into one minimal automaton that finds, without anchors, every stretch of text
that holds some rule's secret.  Bytes after which the automaton is always back
at its start cut a text into independent stretches, and numpy advances thousands
of them together, a byte a step.  In the few stretches that the pass flags, the
rules' own anchored automata give the exact spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wayloom.llm.memory import bounded
from wayloom.llm import textvec as tv
from wayloom.llm.automaton import Dfa, Nfa, anchored, determinise, parse


@dataclass(frozen=True)
class Rule:
    """Longest head, then longest run of ``tail``; the match holds if both least lengths do."""

    kind: str
    head: str
    tail: str
    least_tail: int = 1
    least_all: int = 0
    ignore_case: bool = False
    counted: int = 64
    block: bool = False  # the secret goes on to the line that ends a private key

    @property
    def need(self) -> int:
        """Tail bytes that the combined automaton counts: all that a passing match
        has at least, or ``counted`` if that is less (then it flags some stretches
        too many, which the exact spans put right)."""
        fixed = len(self.head) if self.head.isalnum() else 0
        return min(self.counted, max(self.least_tail, self.least_all - fixed))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=\-]", 6, 0, True),
    Rule("access", "AKIA", "[A-Z0-9]", 1, 20),
    Rule("hex", "", "[0-9a-f]", 1, 24),
)
#: What the method adds to the base kinds.
ADDED = (
    Rule("code_host", "gh[opsu]_", "[A-Za-z0-9]", 36, counted=2),
    Rule("chat", "xox[abps]\\-", r"[A-Za-z0-9\-]", 10, counted=2),
    Rule("cloud", "AIza", r"[A-Za-z0-9_\-]", 1, 39, counted=2),
    Rule("key_block", r"\-\-\-\-\-BEGIN ([A-Z]+ )*PRIVATE KEY", r"\-", 5, counted=2, block=True),
)
RULES = BASE + ADDED
KINDS = tuple(r.kind for r in RULES)


@lru_cache(maxsize=8)
def combined(rules: tuple[Rule, ...] = RULES) -> Dfa:
    nfa, accepts = Nfa(), {}
    start = nfa.new()
    for i, rule in enumerate(rules):
        at = nfa.new()
        nfa.free[start].append(at)
        at = nfa.add(parse(rule.head, rule.ignore_case), at)
        tail = parse(rule.tail, rule.ignore_case)
        for count in range(1, rule.need + 1):
            was = len(nfa.step)
            at = nfa.add(tail, at)
            for s in range(was, len(nfa.step)):
                nfa.rank[s] = (i, 2 * count + (s == at))
        accepts[at] = i
    # a longer tail of a rule makes its shorter ones needless for the question whether it holds
    return determinise(nfa, start, accepts, True)


@lru_cache(maxsize=8)
def _parts(rules: tuple[Rule, ...]) -> list[tuple[Dfa, list, list, set]]:
    out = []
    for rule in rules:
        head = anchored(rule.head, rule.ignore_case)
        tail = anchored(rule.tail, rule.ignore_case)
        allowed = {b for b in range(256) if tail.accept[tail.next[0, tail.class_of[b]]]}
        out.append((head, head.next[:, head.class_of].tolist(), head.accept.tolist(), allowed, set(np.flatnonzero(head.dead).tolist())))
    return out


def _matches(rule: Rule, part, text: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of one rule that reach its least lengths."""
    _, step, accept, allowed, dead = part
    i, n = 0, len(text)
    while i < n:
        state, j, head_end = 0, i, i if accept[0] else -1
        while j < n:
            state = step[state][text[j]]
            if state in dead:
                break
            j += 1
            if accept[state]:
                head_end = j
        if head_end < 0 or head_end >= n or text[head_end] not in allowed:
            i += 1
            continue
        end = head_end
        while end < n and text[end] in allowed:
            end += 1
        if end - head_end >= rule.least_tail and end - i >= rule.least_all:
            yield i, end
        i = end


def flagged(buf: np.ndarray, offs: np.ndarray, dfa: Dfa) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, rule bits) of the stretches in which some rule holds."""
    cut = dfa.resets[buf]
    first, last = ~cut, ~cut
    first[1:] &= cut[:-1]
    last[:-1] &= cut[1:]
    full = offs[1:] > offs[:-1]
    first[offs[:-1][full]] = ~cut[offs[:-1][full]]
    last[offs[1:][full] - 1] = ~cut[offs[1:][full] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    order = np.argsort(start - end, kind="stable")
    start, end = start[order], end[order]
    size = end - start
    kind, width = dfa.class_of[buf], dfa.next.shape[1]
    table, accept = (dfa.next * width).ravel(), np.repeat(dfa.accept, 1)
    state, seen = np.zeros(len(start), np.int32), np.zeros(len(start), np.int64)
    alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for j, n in enumerate(alive.tolist()):
        state[:n] = table[state[:n] + kind[start[:n] + j]]
        seen[:n] |= accept[state[:n] // width]
    hit = np.flatnonzero(seen)
    hit = hit[np.argsort(start[hit])]
    return start[hit], end[hit], seen[hit]


def find(buf: np.ndarray, offs: np.ndarray, rules: tuple[Rule, ...] = RULES) -> dict[int, list[tuple[int, int, int]]]:
    """text index: (start, end, rule index) in code points, by start, then rule."""
    starts, ends, bits = flagged(buf, offs, combined(rules))
    parts, out = _parts(rules), {}
    doc = np.searchsorted(offs, starts, side="right") - 1
    for d, a, b, m in zip(doc.tolist(), starts.tolist(), ends.tolist(), bits.tolist()):
        text = buf[a:b].tobytes()
        for i, rule in enumerate(rules):
            if m >> i & 1:
                out.setdefault(d, []).extend((a + x, a + y, i) for x, y in _matches(rule, parts[i], text))
    for d, spans in out.items():
        if any(rules[i].block for _, _, i in spans):
            text, low = buf[offs[d] : offs[d + 1]].tobytes(), int(offs[d])
            spans[:] = [(a, low + _block_end(text, b - low) if rules[i].block else b, i) for a, b, i in spans]
        lead = np.concatenate([[0], np.cumsum((buf[offs[d] : offs[d + 1]] & 0xC0) != 0x80)])
        out[d] = sorted((int(lead[a - offs[d]]), int(lead[b - offs[d]]), i) for a, b, i in spans)
        out[d].sort(key=lambda s: (s[0], s[2]))
    return out


_EDGE = re.compile(rb"-----(BEGIN|END) (?:[A-Z]+ )*PRIVATE KEY-----+")
_GAP = rb"(?:[\s\"'>|#*,;]|\\[nrt])"
#: What is left of a key without an end: header lines, base64 of some length, and the word after it, which may be its last line.
_OPEN = re.compile(rb"(?:%(gap)s*+[A-Z][A-Za-z0-9-]*+:[^\n\\]*+)*+(?:%(gap)s*+[A-Za-z0-9+/=]{16,}+)++(?:%(gap)s++[A-Za-z0-9+/=]++)?+|(?:%(gap)s*+[A-Za-z0-9+/=]++)?+\s*+\Z" % {b"gap": _GAP})


def _block_end(text: bytes, at: int) -> int:
    """End of the private key whose first line ends at ``at``."""
    edge = _EDGE.search(text, at)
    if edge and edge[1] == b"END":
        return edge.end()
    rest = _OPEN.match(text, at)
    return rest.end() if rest else at


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, buf, offs in tv.slices(batch.column(1)):
            got = find(buf, offs)
            spans = [[{"kind": KINDS[i], "start": a, "end": b} for a, b, i in got.get(d, ())] for d in range(end - first)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, spans (kind, start, end; code points, end exclusive), by start, then rule.

    Defined cases: null and empty texts have no spans; ids may be null or
    repeat; rules are independent, so spans of different kinds may overlap; an
    empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(bounded(_scan), f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def mask_text(text: str, spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    """Overlapping spans become one, named by the first; each is replaced by its name."""
    out, at = [], 0
    for a, b, i in spans:
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{kinds[i]}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; secrets in the text are replaced by their kind in brackets."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(at)
            changed: dict[int, str] = {}
            for first, _, buf, offs in tv.slices(col):
                for d, spans in find(buf, offs).items():
                    changed[first + d] = mask_text(buf[offs[d] : offs[d + 1]].tobytes().decode(), spans)
            if changed:
                texts = col.to_pylist()
                for d, t in changed.items():
                    texts[d] = t
                col = pa.array(texts, col.type)
            arrays = [col if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(bounded(run), docs.schema)


def digest(table: DataFrame) -> DataFrame:
    """Counts and the joined forms of the spans, base kinds hashed apart."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return table.select(
        "doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"),
    )
