"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting: each task adds up a sparse count per (language, bucket); Spark sums
them with map-side combine. The model has ``languages x BUCKETS`` cells, a bound
that does not depend on the number of rows, and is broadcast as one matrix of
log-probabilities. Scoring gathers the rows of that matrix for all n-grams of a
slice of texts and adds them up per text.

Cases: null, empty or letterless text gives ``und`` with score 0; with nothing
learned every text gives ``und``. Repeated rows are counted and scored one by
one. Ties go to the language that sorts first. Texts of any length are read
whole. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
ALPHA = 0.5
SLICE = 1 << 17
"""Characters whose n-grams a task holds at a time, a longer text excepted."""
REJECT_BELOW = 0.3
FLOOR, ERRORS = 0.001, 3.0
"""The share of a language's labelled texts that may fit it worse than a text must; standard errors granted for length."""
UNKNOWN = "und"

def has_letter(text: str) -> bool:
    """Whether a character has the letter property (numbers in circles, raised figures and fractions have not)."""
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


_ASCII_LETTER = re.compile("[A-Za-z]")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the lower-cased texts, text by text, and where each text starts (one more)."""
    lower = [t.lower() for t in texts]
    at = np.cumsum([0, *map(len, lower)])
    c = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(c))  # characters up to the end of the text
    out = np.full((len(c), len(ORDERS)), -1, np.int32)
    for k, n in enumerate(ORDERS):
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, 0x27D4EB2F * n & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h = (h ^ c[j : len(c) - n + 1 + j]) * _FACTORS[j]
            h ^= h >> np.uint32(15)
        fits = left[: len(h)] >= n
        out[: len(h), k][fits] = (h & np.uint32(BUCKETS - 1))[fits]
    return out, at


def _counts(batches):
    total: dict[str, np.ndarray] = {}

    def flush():
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "bucket": used.astype(np.int32), "n": n[used]})
        total.clear()

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for first, texts in slices(batch, "text", SLICE):
            grams, at = ngram_buckets(texts)
            mine = np.array(langs[first : first + len(texts)], dtype=object)
            for lang in set(mine):
                rows = np.concatenate([grams[at[k] : at[k + 1]].ravel() for k in np.flatnonzero(mine == lang)])
                n = np.bincount(rows[rows >= 0], minlength=BUCKETS)
                total[lang] = total[lang] + n if lang in total else n
            if len(total) > 64:
                yield from flush()
    yield from flush()


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in order, matrix of BUCKETS x languages log-probabilities with the log-priors as last row)."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    prior = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(prior)
    n = np.zeros((BUCKETS, len(langs)))
    if counts.num_rows:
        index = {x: k for k, x in enumerate(langs)}
        column = np.array([index[x] for x in counts["lang"].to_pylist()])
        n[counts["bucket"].to_numpy(), column] = counts["n"].to_numpy()
    table = np.log((n + ALPHA) / (n.sum(0) + ALPHA * BUCKETS))
    first = np.log(np.array([prior[x] for x in langs], float) / max(1, sum(prior.values())))
    return langs, np.vstack([table, first])


def scores(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Log-posterior (not normalised) of each text under each language."""
    grams, at = ngram_buckets(texts)
    out = np.tile(table[-1], (len(texts), 1))
    filled = np.flatnonzero(np.diff(at))
    if len(filled):
        grams[grams < 0] = BUCKETS + 1
        padded = np.vstack([table, np.zeros(table.shape[1])])
        gathered = padded[grams[:, 0]]
        for k in range(1, len(ORDERS)):
            gathered += padded[grams[:, k]]
        out[filled] += np.add.reduceat(gathered, at[filled], axis=0)
    return out


def deviations(table: np.ndarray) -> np.ndarray:
    """The standard deviation of an n-gram's log-likelihood under each language."""
    p = np.exp(table[:-1])
    return np.sqrt(np.maximum(0, (p * table[:-1] ** 2).sum(0) - (p * table[:-1]).sum(0) ** 2))


def fits(texts: list[str], s: np.ndarray, table: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """How well each language explains each text: log-likelihood per n-gram, plus ERRORS standard errors for its length."""
    n = np.array([sum(max(0, len(t.lower()) - k + 1) for k in ORDERS) for t in texts]).clip(1)[:, None]
    return (s - table[-1]) / n + ERRORS * deviation / np.sqrt(n)


def floors(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", lang: str = "lang") -> np.ndarray:
    """What a text of each language must reach: the FLOOR quantile of the fits of the texts that carry its label."""
    langs = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")

    def fit(batches):
        langs, table = shared.value
        deviation = deviations(table)
        index = {x: k for k, x in enumerate(langs)}
        for batch in batches:
            own = batch.column(1).to_pylist()
            for first, texts in slices(batch, "text", SLICE):
                mine = [k for k, t in enumerate(texts) if own[first + k] in index and has_letter(t)]
                if mine:
                    texts = [texts[k] for k in mine]
                    column = np.array([index[own[first + k]] for k in mine])
                    value = fits(texts, scores(texts, table), table, deviation)[np.arange(len(mine)), column]
                    yield pa.RecordBatch.from_arrays([pa.array([langs[c] for c in column], pa.string()), pa.array(value)], names=["lang", "fit"])

    least = rows.mapInArrow(fit, "lang string, fit double").groupBy("lang").agg(F.percentile_approx("fit", FLOOR, 100000).alias("least"))
    found = {r["lang"]: r["least"] for r in least.collect()} if langs else {}
    return np.array([found.get(x, -np.inf) for x in langs]) - 1e-9


def _label(texts: list[str], langs: list[str], table: np.ndarray, least: np.ndarray | None = None, deviation: np.ndarray | None = None) -> tuple[list[str], list[float]]:
    if not langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    s = scores(texts, table)
    best = s.argmax(1)
    p = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
    letters = [has_letter(t) for t in texts]
    if least is not None:
        fit = fits(texts, s, table, deviation)[np.arange(len(texts)), best]
        letters = [a and bool(b) for a, b in zip(letters, fit >= least[best])]
    return [langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)], [float(x) if ok else 0.0 for x, ok in zip(p, letters)]


def _labelled(docs: DataFrame, model: tuple, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` as k0, k1, ... with ``lang_pred`` and ``score`` (posterior of the chosen language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys([*keep, text]))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)))
    name = f"k{columns.index(text)}"

    def label(batches):
        langs, table, *least = shared.value
        if least:
            least.append(deviations(table))
        for batch in batches:
            for first, texts in slices(batch, name, SLICE):
                pred, score = _label(texts, langs, table, *least)
                kept = [c.slice(first, len(texts)) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[: len(keep)], "lang_pred", "score"])

    kept = "".join(f"k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    return rows.mapInArrow(label, f"{kept}lang_pred string, score double")


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    return _labelled(docs, model, text, [doc_id]).withColumnRenamed("k0", "doc_id")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out, then predict every document."""
    train = docs.where(f"not {held_out(doc_id, 4, 2)}").where(F.col(doc_id).isNotNull())
    out = predict(docs, learn(train, text, lang), doc_id, text)
    return out.selectExpr("doc_id", f"{held_out('doc_id', 4, 2)} as held_out", "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents in a language that the model knows; the columns stay as they are.

    A document goes if its text has no letter, if no language reaches REJECT_BELOW
    or if the one chosen explains its n-grams worse than the ``floors`` of that
    language: the posterior only compares the learned languages, so that text in
    none of them needs this second look.
    """
    train = docs.where(f"not {held_out('doc_id', 4, 2)}").where("doc_id is not null")
    model = learn(train)
    out = _labelled(docs, (*model, floors(docs, model)), "text", docs.columns).where(f"lang_pred <> '{UNKNOWN}' and score >= {REJECT_BELOW}")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)))
