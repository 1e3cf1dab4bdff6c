"""Language identification with interpolated Kneser-Ney character models.

Each learned language has a character model of order ``ORDER`` over the letters of its words, word ends included. The probabilities of all n-grams
seen in any language are interpolated once, when the model is fitted, and kept in one sorted hash array per order with a column per language; backoff
weights of contexts are kept the same way. A text's cross-entropy under a language is the mean cost in bits per letter (ends included) of all
its words; the language with the lowest one is chosen. A text is rejected when even that is far above what texts of the language need.

Every language value of the labelled rows is learned. The model is fitted on a bounded sample: about ``sample_docs`` documents per language, drawn by a hash of
their id, until ``sample_chars`` characters are reached; when there are many languages, each gets its even part of ``total_docs`` and ``total_chars``
instead (never less than ``least_docs`` documents). Every other figure covers all rows. Languages are modelled in blocks of ``BLOCK`` by name, since rows of a
hash array hold a column per language of the block: what is stored grows with the sample, not with its product with all languages.

Defined cases: a null text or one without letters is ``und`` with score 0 and rejected; a table without labelled rows teaches nothing, so every
text is ``und`` and only texts without letters are rejected; equal costs go to the first language by name; repeated rows are judged
each; an empty table gives no rows. Input columns whose names equal an output column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, give_back, map_arrow, schema_with, without
from .segment import span_hashes, split_words

ORDER = 5
BEGIN, END = 2, 3  # signs around a word
SAMPLE_DOCS, SAMPLE_CHARS = 600, 1_500_000
TOTAL_DOCS, TOTAL_CHARS, LEAST_DOCS = 9_600, 12_000_000, 8
BLOCK = 8
MARGIN_BITS, DEVIATIONS = 0.8, 6.0
PART_CHARS = 2_000_000
UNKNOWN = "und"


@dataclass
class Table:
    """Rows of numbers by 64-bit key, keys sorted."""

    keys: np.ndarray
    rows: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), bool)


@dataclass
class Model:
    """Models of a block of languages, or of all of them: then ``blocks`` holds the models and the languages are theirs in order."""

    languages: list[str]
    blocks: list[Model] = field(default_factory=list)
    grams: list[Table] = field(default_factory=list)  # log2 probabilities, orders 1 to ORDER
    backoff: list[Table] = field(default_factory=list)  # log2 weights of contexts
    floor: np.ndarray | None = None  # log2 probability of an unknown letter
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None


@dataclass
class Sequences:
    """Words with their begin and end signs, one behind the other."""

    signs: np.ndarray
    first: np.ndarray
    last: np.ndarray  # place of the end sign


def _sequences(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Sequences:
    sizes = ends - starts + 2
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    signs = np.zeros(int(sizes.sum()), np.uint32)
    inner = np.ones(len(signs), bool)
    inner[first] = inner[last] = False
    signs[first], signs[last] = BEGIN, END
    lengths = ends - starts
    source = np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    signs[inner] = points[source]
    return Sequences(signs, first, last)


def _targets(s: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the predicted signs, how many signs stand before each in its word, and the word."""
    counts = s.last - s.first
    word = np.repeat(np.arange(len(counts)), counts)
    depth = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    return s.first[word] + depth, depth, word


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of one of each, and the sums of their weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0)
    u, at, back = np.unique(keys, return_index=True, return_inverse=True)
    return u, at, np.bincount(back, weights, len(u))


@dataclass
class Counts:
    """Counts of one order in one language: n-grams, their contexts and suffixes."""

    keys: np.ndarray
    context: np.ndarray
    suffix: np.ndarray
    count: np.ndarray


def _count(s: Sequences, word_weights: np.ndarray) -> list[Counts]:
    """Counts for orders 1 to ORDER. Below the highest order an n-gram counts the different signs before it; n-grams at a word's
    begin have none and count as often as they occur."""
    place, depth, word = _targets(s)
    weight = word_weights[word].astype(float)
    out: list[Counts] = []
    above: Counts | None = None
    for k in range(ORDER, 0, -1):
        rows = depth + 1 >= k if k == ORDER else depth + 1 == k
        p = place[rows]
        keys = span_hashes(s.signs, p - k + 1, p + 1)
        u, at, c = _sums(keys, weight[rows])
        q = p[at]
        context, suffix = span_hashes(s.signs, q - k + 1, q), span_hashes(s.signs, q - k + 2, q + 1)
        if above is not None:
            v, first, n = _sums(above.suffix, np.ones(len(above.suffix)))
            # contexts and suffixes of these come from places too: any place of the longer n-gram will do
            src = above_place[first]
            u, c = np.concatenate([u, v]), np.concatenate([c, n])
            q = np.concatenate([q, src])
            context, suffix = span_hashes(s.signs, q - k + 1, q), span_hashes(s.signs, q - k + 2, q + 1)
            if k == 1:
                keep = np.arange(len(u)) >= len(u) - len(v)  # a word's begin is not predicted
                u, c, q, context, suffix = u[keep], c[keep], q[keep], context[keep], suffix[keep]
        above, above_place = Counts(u, context, suffix, c), q
        out.append(above)
    return out[::-1]


def _discount(count: np.ndarray) -> float:
    one, two = float((count == 1).sum()), float((count == 2).sum())
    return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5


def _fit(languages: list[str], counts: list[list[Counts]]) -> Model:
    """The models of all languages, in blocks; letters are counted over all of them."""
    letters = np.unique(np.concatenate([c[0].keys for c in counts]))
    uniform = 1.0 / (len(letters) + 1)
    return Model(languages, [_fit_block(languages[i:i + BLOCK], counts[i:i + BLOCK], uniform) for i in range(0, len(languages), BLOCK)])


def _fit_block(languages: list[str], counts: list[list[Counts]], uniform: float) -> Model:
    model = Model(languages)
    n = len(languages)
    for k in range(ORDER):
        keys, at = np.unique(np.concatenate([c[k].keys for c in counts]), return_index=True)
        context = np.concatenate([c[k].context for c in counts])[at]
        suffix = np.concatenate([c[k].suffix for c in counts])[at]
        lower = np.full((len(keys), n), uniform)
        if k:
            where, found = model.grams[k - 1].find(suffix)
            lower[found] = np.exp2(model.grams[k - 1].rows[where[found]])
        contexts = np.unique(np.concatenate([c[k].context for c in counts]))
        weights = np.ones((len(contexts), n))
        probs = np.empty((len(keys), n))
        for j, c in enumerate(k_counts[k] for k_counts in counts):
            d = _discount(c.count)
            own, back = np.unique(c.context, return_inverse=True)
            total, kinds = np.bincount(back, c.count, len(own)), np.bincount(back, minlength=len(own))
            weights[np.searchsorted(contexts, own), j] = d * kinds / total
            part = np.zeros(len(keys))
            part[np.searchsorted(keys, c.keys)] = np.maximum(c.count - d, 0) / total[back]
            probs[:, j] = part + weights[np.searchsorted(contexts, context), j] * lower[:, j]
        model.grams.append(Table(keys, np.log2(probs)))
        model.backoff.append(Table(contexts, np.log2(weights)))
    model.floor = model.backoff[0].rows[0] + np.log2(uniform)
    return model


def word_costs(model: Model, s: Sequences) -> np.ndarray:
    """Bits of each word under each language."""
    if model.blocks:
        return np.hstack([word_costs(block, s) for block in model.blocks])
    place, depth, word = _targets(s)
    n = len(model.languages)
    bits = np.zeros((len(place), n))
    open_at, order = np.arange(len(place)), np.minimum(depth + 1, ORDER)
    for k in range(ORDER, 0, -1):
        rows = np.flatnonzero(order == k)
        p = place[open_at[rows]]
        where, found = model.grams[k - 1].find(span_hashes(s.signs, p - k + 1, p + 1))
        hit = open_at[rows[found]]
        bits[hit] -= model.grams[k - 1].rows[where[found]]
        lost = rows[~found]
        if k > 1:
            p = place[open_at[lost]]
            where, known = model.backoff[k - 1].find(span_hashes(s.signs, p - k + 1, p))
            bits[open_at[lost[known]]] -= model.backoff[k - 1].rows[where[known]]
            order[lost] = k - 1
        else:
            bits[open_at[lost]] -= model.floor
    return np.add.reduceat(bits, s.first - np.arange(len(s.first)), axis=0) if len(s.first) else np.zeros((0, n))


def text_entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean bits per sign under each language, and the number of signs, of each text."""
    w = split_words(texts, letters_only=True)
    n = len(model.languages)
    total, signs = np.zeros((len(texts), n)), np.zeros(len(texts))
    if not len(w.starts):
        return total, signs
    _, at, back = np.unique(span_hashes(w.points, w.starts, w.ends), return_index=True, return_inverse=True)
    words = _sequences(w.points, w.starts[at], w.ends[at])
    some = np.flatnonzero(w.counts)
    cuts = (np.cumsum(w.counts) - w.counts)[some]
    j = 0
    for block in model.blocks or [model]:
        for cost in word_costs(block, words).T:
            total[some, j] = np.add.reduceat(cost[back], cuts)
            j += 1
    signs[some] = np.add.reduceat(w.ends - w.starts + 1, cuts)
    total[some] /= signs[some, None]
    return total, signs


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """A model from ``(language, text)`` rows: three of four rows give the counts, the fourth the expected entropy of a text."""
    by: dict[str, list[str]] = {}
    for language, text in rows:
        by.setdefault(language, []).append(text.lower())
    names, counts = [], []
    for language in sorted(by):
        texts = [t for i, t in enumerate(by[language]) if i % 4 != 3]
        w = split_words(texts, letters_only=True)
        if not len(w.starts):
            continue
        _, at, n = np.unique(span_hashes(w.points, w.starts, w.ends), return_index=True, return_counts=True)
        names.append(language)
        counts.append(_count(_sequences(w.points, w.starts[at], w.ends[at]), n))
    if not names:
        return None
    model = _fit(names, counts)
    model.mean, model.spread = np.zeros(len(names)), np.zeros(len(names))
    for j, language in enumerate(names):
        test = [t for i, t in enumerate(by[language]) if i % 4 == 3] or by[language]
        bits, signs = text_entropies(model, test)
        own, signs = bits[signs > 0, j], signs[signs > 0]
        if not len(own):
            bits, signs = text_entropies(model, by[language])
            own, signs = bits[signs > 0, j], signs[signs > 0]
        model.mean[j] = np.median(own)
        model.spread[j] = 1.4826 * np.median(np.abs(own - model.mean[j]) * np.sqrt(signs))
    return model


def labelled_sample(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS,
                    sample_chars: int = SAMPLE_CHARS, total_docs: int = TOTAL_DOCS, total_chars: int = TOTAL_CHARS, least_docs: int = LEAST_DOCS) -> list[tuple[str, str]]:
    """The bounded sample a model is fitted on, collected: rows drawn by a hash of their id; the last text of a language ends where its characters do."""
    known = docs.where(F.col(lang_col).isNotNull() & allowed)
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # one number a language
    if not sizes:
        return []
    sample_docs = min(sample_docs, max(least_docs, total_docs // len(sizes)))
    sample_chars = min(sample_chars, max(1, total_chars // len(sizes)))
    span = 1 << 30
    limits = known.sparkSession.createDataFrame([(k, min(span, span * sample_docs // v)) for k, v in sorted(sizes.items())], "_lang string, _limit long")
    draw = F.pmod(F.xxhash64(id_col), F.lit(span))
    rows = known.where(F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"), F.col(id_col).cast("string").alias("id"))
    drawn = rows.join(F.broadcast(limits), (F.col("lang") == F.col("_lang")) & (F.col("draw") < F.col("_limit"))).drop("_lang", "_limit")  # a row a language
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("draw", "id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = drawn.withColumn("before", before).where(F.col("before") < sample_chars).withColumn("text", F.left("text", (F.lit(sample_chars) - F.col("before")).cast("int")))
    return [(r["lang"], r["text"]) for r in sorted(kept.collect(), key=lambda r: (r["lang"], r["draw"], r["id"] or "", r["text"]))]


FIELDS = "lang_pred string, score double, rejected boolean, bits_per_letter double"


def identify(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred, score, rejected, bits_per_letter``. The score is the chosen language's share when costs of a dozen letters compete."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    keep = without(df, *names)
    give_back()  # of the sample and of the fit; the driver works on in later stages
    held = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kinds = [pa.string(), pa.float64(), pa.bool_(), pa.float64()]

    def judge(texts: list[str], model: Model | None) -> list[tuple]:
        if model is None:
            w = split_words(texts, letters_only=True)
            return [(UNKNOWN, 0.0, not n, None) for n in w.counts.tolist()]
        bits, signs = text_entropies(model, texts)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best]
        share = 1 / np.exp2(-(bits - low[:, None]) * np.minimum(signs, 12)[:, None]).sum(axis=1)
        limit = model.mean[best] + MARGIN_BITS + DEVIATIONS * model.spread[best] / np.sqrt(np.maximum(signs, 1))
        return [(model.languages[b], s, r, v) if n else (UNKNOWN, 0.0, True, None)
                for b, s, r, v, n in zip(best.tolist(), share.tolist(), (low > limit).tolist(), low.tolist(), signs.tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            texts, out, k = [(t or "").lower() for t in b.column(text_col).to_pylist()], [], 0
            while k < len(texts):
                first, size = k, 0
                while k < len(texts) and (size == 0 or size + len(texts[k]) <= PART_CHARS):
                    size += len(texts[k])
                    k += 1
                out += judge(texts[first:k], model)
            cols = [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + cols, names=[*keep, *names])

    return map_arrow(df, run, schema_with(df, keep, FIELDS))


def op8(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(labelled_sample(docs, ~F.coalesce(held_out, F.lit(False))))
    found = identify(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), model).drop("text")
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected", "bits_per_letter")
