"""Language ID by multilingual mixture inference.

A language is a distribution over hashed letter trigrams, counted over all labelled documents that may
be read. For each document, expectation-maximisation estimates the proportions of the languages that
best explain its trigrams. Language sets of growing size, by descending proportion, are refitted on
their own as long as the likelihood less a penalty for each language rises, up to all
languages; the last set that raised it is the document's, with its proportions. The
largest of them names the document's language. The score is that language's proportion
among all languages.

Letters are a-z (A-Z folded) and all bytes past ASCII; other bytes are spaces, and so is the edge of a
document.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if no
language could be learned; its set is empty. Rows with a null lang teach nothing, a blank one is a value. Repeated rows are predicted
each, and each counts in training. Memory in a task follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.labelled import doc_sums, remainder

#: Hash width of trigrams, counts added to each.
BITS, SMOOTHING = 15, 0.5
#: EM ends when no proportion of a slice's documents moves by more, or after so many rounds.
MOVED, ROUNDS = 5e-3, 40
#: Log likelihood, for each unit of log(trigrams), that one more language must gain.
PENALTY = 3.0

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_LETTERS[65:91] = np.arange(97, 123)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams with at least one letter, and the document of each."""
    n = len(offsets) - 1
    padded = np.insert(_LETTERS[data], offsets, 0x20)
    owner = np.insert(np.repeat(np.arange(n), np.diff(offsets)), offsets, np.arange(n + 1))
    a, b, c = (padded[k : len(padded) - 2 + k].astype(np.uint32) for k in range(3))
    letters = (a != 0x20) | (b != 0x20) | (c != 0x20)
    # The space between two documents belongs to both; a trigram around it has its middle there.
    letters &= ~((b == 0x20) & (a != 0x20) & (c != 0x20) & (owner[:-2] != owner[2:]))
    code = a | b << np.uint32(8) | c << np.uint32(16)
    hashed = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    of = np.where(b != 0x20, owner[1:-1], np.where(a != 0x20, owner[:-2], owner[2:]))
    return hashed[letters].astype(np.int64), of[letters]


def counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all of ``text, lang``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lo, hi, data, offsets in T.slices(batch.column(0)):
                grams, of = trigrams(data, offsets)
                own = langs[lo:hi]
                for lang in set(own):
                    here = np.bincount(grams[(own == lang)[of]], minlength=1 << BITS)
                    total[lang] = total.get(lang, 0) + here
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])],
                ["lang", "gram", "n"],
            )

    found = docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, and for each trigram its probability in each: a table of bounded size."""
    rows = counts(docs.filter("text IS NOT NULL AND lang IS NOT NULL")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((1 << BITS, len(langs)), SMOOTHING)
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        table[own["gram"].to_numpy(), k] += own["n"].to_numpy()
    return langs, table / np.maximum(table.sum(0), 1)


def mixture(
    p: np.ndarray, n: np.ndarray, first: np.ndarray, share: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after EM from ``share`` (zeros stay), and log likelihood, of each document."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.maximum(doc_sums(n, first), 1.0)
    for _ in range(ROUNDS):
        part = p * share[owner]
        part *= (n / part.sum(1))[:, None]
        before, share = share, doc_sums(part, first) / total[:, None]
        if np.abs(share - before).max(initial=0.0) <= MOVED:
            break
    return share, doc_sums(n * np.log((p * share[owner]).sum(1)), first)


def infer(
    data: np.ndarray, offsets: np.ndarray, p: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each document: language number, its proportion among all, the proportions in the chosen set
    (0 outside it), and whether there is any trigram."""
    docs, langs = len(offsets) - 1, p.shape[1]
    grams, of = trigrams(data, offsets)
    key, n = np.unique(of << BITS | grams, return_counts=True)
    first = np.searchsorted(key, np.arange(docs + 1) << BITS)
    own, n = p[key & ((1 << BITS) - 1)], n.astype(float)
    even = np.full((docs, langs), 1.0 / langs)
    share, _ = mixture(own, n, first, even)
    single = doc_sums(n[:, None] * np.log(own), first)
    cost = PENALTY * np.log(np.maximum(doc_sums(n, first), 2.0))
    chosen = np.zeros((docs, langs))
    chosen[np.arange(docs), single.argmax(1)] = 1.0
    value = single.max(1) - cost
    order = np.argsort(-share, axis=1)
    rising = np.diff(first) > 0  # documents whose set still grows
    for size in range(2, langs + 1):
        at = np.flatnonzero(rising)
        if not len(at):
            break
        entries = rising[np.repeat(np.arange(docs), np.diff(first))]
        bounds = np.append(0, np.cumsum(np.diff(first)[at]))
        allowed = np.zeros((len(at), langs))
        np.put_along_axis(allowed, order[at, :size], 1.0 / size, axis=1)
        fitted, likelihood = mixture(own[entries], n[entries], bounds, allowed)
        gained = likelihood - size * cost[at] > value[at]
        chosen[at[gained]] = fitted[gained]
        value[at[gained]] = (likelihood - size * cost[at])[gained]
        rising[at[~gained]] = False
    best = chosen.argmax(1)
    return best, share[np.arange(docs), best], chosen, np.diff(first) > 0


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def languages(docs: DataFrame, modulus: int = 4, out: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, langs, proportions`` of every document.

    ``langs`` is the chosen set by falling ``proportions``.

    Languages are learned of documents only whose crc32 remainder is not ``out``.
    """
    held = remainder(F.col("doc_id"), modulus) == out
    names, table = learn(docs.filter(~held))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        plain = np.zeros(256, bool)
        plain[[*range(65, 91), *range(97, 123)]] = True
        for batch in batches:
            texts = batch.column(2)
            said, score, sets, parts = [], [], [], []
            for lo, hi, data, offsets in T.slices(texts):
                letters = doc_sums(plain[data].astype(np.int64), offsets) > 0
                if names:
                    best, share, chosen, some = infer(data, offsets, p)
                for k in range(hi - lo):
                    sure = letters[k] or (offsets[k + 1] > offsets[k] and has_letter(texts[lo + k].as_py()))
                    known = bool(names) and sure and some[k]
                    said.append(names[best[k]] if known else "und")
                    score.append(float(min(max(share[k], 0.0), 1.0)) if known else 0.0)
                    held_by = [i for i in np.argsort(-chosen[k], kind="stable") if chosen[k, i] > 0] if known else []
                    sets.append([names[i] for i in held_by])
                    parts.append([float(chosen[k, i]) for i in held_by])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(score, pa.float64()),
                    pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64())),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "langs", "proportions"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), "text"
    )
    return rows.mapInArrow(
        run,
        "doc_id long, held_out boolean, lang_pred string, score double, langs array<string>, proportions array<double>",
    )
