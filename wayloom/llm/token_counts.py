"""Token counts by field or section, from one encoding of the whole document.

Token byte lengths give every token's character span; an interval join of these
spans with the sections says which sections a token touches.  A token inside
one section counts there.  One that crosses a boundary counts once, in the
section that holds most of its characters (ties: the earlier), so the sections'
counts always add up to the document's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wayloom.llm.memory import bounded

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text is encoded in pieces of about so many characters, cut only where the
#: pattern always cuts: before a space that stands between two letters.
PIECE = 100_000


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """(encoding, byte length of each token) of the lines of a vocabulary file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    size = np.zeros(max(ranks.values()) + 1, np.int32)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("wayloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_ends(text: str, vocabulary: bytes) -> np.ndarray:
    """Byte offsets at which the text's tokens end."""
    enc, size = encoder(vocabulary)
    at, ends, done = 0, [], 0
    while at < len(text):
        cut = min(len(text), at + PIECE)
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        part = size[np.array(enc.encode_ordinary(text[at:cut]), np.int64)]
        ends.append(done + np.cumsum(part, dtype=np.int64))
        done, at = int(ends[-1][-1]), cut
    return np.concatenate(ends) if ends else np.zeros(0, np.int64)


def attribute(ends: np.ndarray, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, int]:
    """(tokens by section, crossing tokens); bounds are the sections' byte ends, the last the text's."""
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends, side="left")
    counts = np.bincount(first[first == last], minlength=len(bounds)).astype(np.int64)
    crossing = np.flatnonzero(first != last)
    for i in crossing.tolist():
        edges = [int(starts[i]), *(int(b) for b in bounds[first[i] : last[i]]), int(ends[i])]
        held = [sum((c & 0xC0) != 0x80 for c in raw[a:b]) for a, b in zip(edges, edges[1:])]
        counts[int(first[i]) + held.index(max(held))] += 1
    return counts, len(crossing)


def _bounds(sizes: list, length: int) -> np.ndarray:
    """Ends of the sections in code points: cut at the text's end, the rest of the text a section more."""
    out = np.minimum(np.cumsum([max(0, s or 0) for s in sizes], dtype=np.int64), length)
    return out if out[-1] == length else np.append(out, length)


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, per, cross = [], [], []
            for text, sizes in zip(batch.column(1), batch.column(2)):
                text, sizes = text.as_py() or "", sizes.as_py() or []
                ends = token_ends(text, shared.value)
                n.append(len(ends))
                if not sizes:
                    per.append([])
                    cross.append(0)
                    continue
                raw = text.encode()
                bounds = _bounds(sizes, len(text))
                if len(raw) != len(text):
                    lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                    bounds = np.append(lead, len(raw))[bounds]
                counts, c = attribute(ends, raw, bounds)
                per.append(counts.tolist())
                cross.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(per, pa.list_(pa.int64())), pa.array(cross, pa.int64())], ["doc_id", "n_tokens", "section_tokens", "n_crossing"])

    return run


def line_sections(text: Column) -> Column:
    """Sizes in code points of a text's lines; a line end belongs to the line before it."""
    return F.filter(F.transform(F.split(text, "(?<=\n)"), F.length), lambda n: n > 0)


def count_tokens(docs: DataFrame, sections: Column | None = None, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """One row a document: doc_id, n_tokens, section_tokens (array), n_crossing.

    ``sections`` holds the sizes (code points) of consecutive sections; by
    default the text's lines.  What they leave of the text is one section more,
    what they have beyond it is cut.  The vocabulary is read from ``path`` on the
    driver and broadcast (a file of fixed size).  Fields of several columns are
    attributed by joining the columns and giving their lengths.  Defined cases:
    null and empty texts have 0 tokens and no sections; sections of size 0 get
    none; ids may be null or repeat; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    sizes = line_sections(F.col(text_col)) if sections is None else sections
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(sizes, F.array().cast("array<int>")).alias("sizes"))
    return rows.mapInArrow(bounded(_count(shared)), f"doc_id {kind}, n_tokens long, section_tokens array<long>, n_crossing long")
