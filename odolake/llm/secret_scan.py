"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A long run of credential characters that a byte-pair vocabulary can only spell
in short tokens is random text: few characters per token. Known digests (hex of
the usual lengths, UUIDs), numbers and identifiers (short words joined by
separators) are left out first; letters alone are tested like any other run. Each text
is read whole; a vectorised regular-expression filter finds the few texts with a
candidate at all, and only those are scanned match by match.

Cases: null and empty texts have no span. Repeated rows are scanned one by one.
Spans are code points, end exclusive; found spans never overlap a fixed one.
Only the named columns are read.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
MARK = "[SECRET]"

# The patterns of the three base kinds with their least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

LEAST = 20
"""Characters of a run that the efficiency test looks at."""
RATIO = 2.1
"""Characters per token below which a run counts as random."""
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", re.I)
_NUMBER = re.compile(r"[0-9+/_=-]+")
_IDENTIFIER = re.compile(r"[_/-]*[A-Za-z]{1,14}(?:[_/-]+[A-Za-z]{1,14})+[_/-]*[0-9]{0,4}")

# What a text must hold to have a match of each kind at all.
_HINTS = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    r"AKIA[A-Z0-9]{14}",
    r"[0-9a-f]{16}",
    r"[A-Za-z0-9+/_=-]{20}",
)


@functools.lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def vocabulary() -> tuple[str, str]:
    """(path of the ranks, split pattern) of the default public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _random_runs(text: str, taken: list[tuple[int, int]], encoding) -> list[tuple[int, int]]:
    found = []
    for m in _RUN.finditer(text):
        run = m[0]
        if any(p.fullmatch(run) for p in (_NUMBER, _DIGEST, _IDENTIFIER)) or any(s < m.end() and m.start() < e for s, e in taken):
            continue
        if len(run) / len(encoding.encode_ordinary(run)) < RATIO:
            found.append(m.span())
    return found


def spans(text: str, encoding, hints=(True, True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans, in order. ``hints``: which kinds may occur."""
    base = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12] if hints[0] else []
    base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18] if hints[1] else []
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)] if hints[2] else []
    taken = [(s, e) for s, _, e in base]
    return sorted(base + ([(s, 3, e) for s, e in _random_runs(text, taken, encoding)] if hints[3] else []))


def _candidates(texts: pa.Array) -> list[tuple[int, np.ndarray]]:
    """The rows that may have a match, each with its hints."""
    hit = np.array([pc.fill_null(pc.match_substring_regex(texts, h), False).to_numpy(zero_copy_only=False) for h in _HINTS])
    return [(int(k), hit[:, k]) for k in np.flatnonzero(hit.any(0))]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocab: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: id and ``spans`` as an array of (kind, start, end) in order."""
    path, pattern = vocab or vocabulary()
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batches):
        encoding = _encoding(path, pattern)
        for batch in batches:
            found = [[] for _ in range(batch.num_rows)]
            for k, hints in _candidates(batch.column(1)):
                found[k] = [{"kind": KINDS[n], "start": s, "end": e} for s, n, e in spans(batch.column(1)[k].as_py(), encoding, hints)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], names=["id", "spans"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>").select(F.col("id").alias("doc_id"), "spans")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def digest(found: DataFrame) -> DataFrame:
    """The counts, digest and listing of ``scan``'s result."""
    line = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return found.selectExpr(
        "doc_id",
        *(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint) as n_{k}" for k in KINDS[:3]),
        f"sha2({line.format("filter(spans, s -> s.kind <> 'random')")}, 256) as base_sha256",
        f"{line.format('spans')} as spans",
    )


def redact(docs: DataFrame, vocab: tuple[str, str] | None = None) -> DataFrame:
    """The documents with every span (overlaps merged) replaced by MARK and ``n_chars`` set anew where one was."""
    path, pattern = vocab or vocabulary()
    names = docs.columns

    def work(batches):
        encoding = _encoding(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, changed = batch.column(at), {}
            for k, hints in _candidates(texts):
                text, out, done = texts[k].as_py(), [], 0
                for s, _, e in spans(text, encoding, hints):
                    if s >= done:
                        out += [text[done:s], MARK]
                    done = max(done, e)
                if out:
                    changed[k] = "".join(out) + text[done:]
            columns = list(batch.columns)
            if changed:
                columns[at] = pa.array([changed.get(k, t) if k in changed else t.as_py() for k, t in enumerate(texts)], texts.type)
                if "n_chars" in names:
                    c = batch.schema.get_field_index("n_chars")
                    columns[c] = pa.array([len(changed[k]) if k in changed else v for k, v in enumerate(columns[c].to_pylist())], columns[c].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(work, docs.schema)

