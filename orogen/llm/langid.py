"""Language identification by unigram pieces, summed over all segmentations.

A model has, for every language, a probability for each piece of a fixed public vocabulary.  A word's probability is the
sum over all ways to write it as pieces, by the forward algorithm over the whole word, however long; its sums are scaled
every STEPS characters, so that none vanishes.  A text's probability is the product over its words, and the languages are
compared with equal priors.  A worker keeps the outcome per word in a bounded table, for words repeat.

Training takes at most ``sample`` labelled documents per language, those with the smallest hash of their doc_id, and runs
``rounds`` of expectation-maximisation over their counted words.  Prediction reads every text whole, and only it.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing could be learned;
equal probabilities give the first language by name; repeated rows are predicted each; an empty table gives an empty
result; a text of any length is scored whole; other columns are not read, so they may have any names.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
STEPS = 16  # characters after which forward sums are scaled
UNDETERMINED = "und"
GROUP_BYTES = 4 << 20  # texts whose unseen words are scored together
FORWARD_CHARS = 1 << 15  # characters in words of one length that the forward sums take at a time, one word at least
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def pieces(vocabulary: str) -> dict[str, int]:
    """Lower-cased pieces of a sentencepiece vocabulary; a leading space mark stays as a space, and pieces with others, which no word holds, are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found = (sp.id_to_piece(k).replace("▁", " ").lower() for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_byte(k) or sp.is_unknown(k)))
    return {p: k for k, p in enumerate(dict.fromkeys(p for p in found if p == " " or p.strip(" ") and " " not in p[1:]))}


def longest(index: dict[str, int]) -> int:
    return max(map(len, index), default=1)


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def _train(counts: dict[str, Counter], index: dict[str, int], rounds: int, alpha: float) -> dict[str, tuple[dict[str, float], float]]:
    """Per language: probabilities of the pieces that occur, and that of any other piece or unknown character."""
    model, most = {}, longest(index)
    for lang, counted in sorted(counts.items()):
        weight: dict[str, float] = {}
        for w, n in counted.items():  # at first every piece that occurs counts, longer ones more
            for i in range(len(w)):
                for j in range(i + 1, min(len(w), i + most) + 1):
                    if w[i:j] in index:
                        weight[w[i:j]] = weight.get(w[i:j], 0.0) + n * (j - i)
        model[lang] = _normalised(weight, len(index), alpha)
        for _ in range(rounds):
            expected: dict[str, float] = {}
            for w, n in counted.items():
                _expect(w, n, model[lang], expected, index, most)
            model[lang] = _normalised(expected, len(index), alpha)
    return model


def _normalised(weight: dict[str, float], size: int, alpha: float) -> tuple[dict[str, float], float]:
    total = sum(weight.values()) + alpha * size
    return {x: (v + alpha) / total for x, v in weight.items()}, alpha / total


def _expect(w: str, n: int, model: tuple[dict[str, float], float], out: dict[str, float], index: dict[str, int], most: int) -> None:
    """Add the expected use of each piece in n occurrences of w.

    Sums that end or begin at a character are kept as a number and the logarithm of its scale, which changes every STEPS
    characters.
    """
    probs, rare = model
    size = len(w)
    edges = [(i, j, probs.get(w[i:j], rare)) for i in range(size) for j in range(i + 1, min(size, i + most) + 1) if w[i:j] in index or j == i + 1]
    ahead, behind = _sums(size, edges, most), _sums(size, sorted((size - j, size - i, p) for i, j, p in edges), most)
    total = math.log(ahead[0][size]) + ahead[1][size]
    for i, j, p in edges:
        if w[i:j] in index and ahead[0][i] and behind[0][size - j]:
            out[w[i:j]] = out.get(w[i:j], 0.0) + n * ahead[0][i] * p * behind[0][size - j] * math.exp(ahead[1][i] + behind[1][size - j] - total)


def _sums(size: int, edges: list[tuple[int, int, float]], most: int) -> tuple[list[float], list[float]]:
    """Sums over all ways from 0 to each place, scaled, and the logarithms of the scales; edges come by their beginning."""
    sums, scale, at, base = [0.0] * (size + 1), [0.0] * (size + 1), 0, 0.0
    sums[0] = 1.0
    for i, j, p in edges:
        if i >= at + STEPS:  # all that ends at i is summed; what lies ahead takes over its scale
            at, top = i, sums[i]
            base += math.log(top)
            scale[i:] = [base] * (size + 1 - i)
            for k in range(i, min(size, i + most) + 1):
                sums[k] /= top
        sums[j] += sums[i] * p
    return sums, scale


class Scorer:
    """log P(word | language) for all languages at once, kept per word.

    Unseen words of a group of texts are scored together: substrings are looked up by a 64-bit rolling hash, and the
    forward sums run over all words of one length at a time.
    """

    def __init__(self, model: dict[str, tuple[dict[str, float], float]], index: dict[str, int], limit: int = 200_000):
        self.langs, self.limit, self.longest = sorted(model), limit, longest(index)
        k = len(self.langs)
        rare = np.array([model[x][1] for x in self.langs])
        seen = sorted(set().union(*(model[x][0] for x in self.langs))) if model else []
        # Row 0: not a piece; row 1: a piece of the vocabulary, or a character, that training didn't meet.
        self.probs = np.zeros((len(seen) + 2, k))
        self.probs[1] = rare
        for c, x in enumerate(self.langs):
            self.probs[2:, c] = [model[x][0].get(p, rare[c]) for p in seen]
        row = {p: 1 for p in index} | {p: r for r, p in enumerate(seen, 2)}
        by_size: dict[int, list[str]] = {}
        for p in row:
            by_size.setdefault(len(p), []).append(p)
        hashed = [(next(h for m, h in _hashes(_codes(ps).reshape(-1, n), n) if m == n)[:, 0], [row[p] for p in ps]) for n, ps in by_size.items()]
        keys = np.concatenate([h for h, _ in hashed]) if hashed else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], np.array([r for _, rs in hashed for r in rs], np.int64)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True
        self._clear()

    def _clear(self) -> None:
        self.held: dict[str, int] = {}  # row of a word in scores; 0 without a letter
        self.scores = np.zeros((1, len(self.langs)))

    def _find(self, hashed: np.ndarray) -> np.ndarray:
        out = np.zeros(hashed.size, np.int64)
        flat = hashed.ravel()
        at = np.flatnonzero(self.maybe[flat >> np.uint64(44)])
        if at.size:
            sought = flat[at]
            near = np.minimum(np.searchsorted(self.keys, sought), self.keys.size - 1)
            out[at] = np.where(self.keys[near] == sought, self.rows[near], 0)
        return out.reshape(hashed.shape)

    def _forward(self, words: list[str]) -> np.ndarray:
        """log P of each word, a column per language."""
        out, sizes = np.empty((len(words), len(self.langs))), np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes).tolist():
            which = np.flatnonzero(sizes == size)
            for own in np.array_split(which, min(which.size, -(-which.size * size // FORWARD_CHARS))):
                found = {}
                for m, h in _hashes(_codes([words[x] for x in own]).reshape(-1, size), self.longest):
                    r = self._find(h)
                    found[m] = np.maximum(r, 1) if m == 1 else r
                # Only the last sums are needed; they share a scale, which is taken out every STEPS characters.
                ring = np.zeros((self.longest + 1, own.size, len(self.langs)))
                ring[0], scale = 1.0, np.zeros((own.size, len(self.langs)))
                for j in range(1, size + 1):
                    now = np.zeros((own.size, len(self.langs)))
                    for m in range(1, min(j, self.longest) + 1):
                        r = found[m][:, j - m]
                        if r.any():
                            now += ring[(j - m) % len(ring)] * self.probs[r]
                    ring[j % len(ring)] = now
                    if j % STEPS == 0:
                        top = ring.max(axis=0)
                        ring /= top
                        scale += np.log(top)
                out[own] = np.log(ring[size % len(ring)]) + scale
        return out

    def word(self, w: str) -> tuple[float, ...]:
        """log P of one word with its space mark."""
        return tuple(self._forward([w])[0])

    def _hold(self, words: set[str]) -> None:
        """Score the words that aren't held; the table starts anew where they would exceed its limit."""
        new = words - self.held.keys()
        if self.held and len(self.held) + len(new) > self.limit:
            self._clear()
            new = words
        lettered = []
        for w in new:
            if has_letter(w):
                lettered.append(w)
            else:
                self.held[w] = 0
        if lettered:
            scores = self._forward([" " + w for w in lettered])
            self.held |= zip(lettered, range(len(self.scores), len(self.scores) + len(lettered)), strict=True)
            self.scores = np.concatenate([self.scores, scores])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if not self.langs or not texts:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        counted = [Counter(WORD.findall((t or "").lower())) for t in texts]
        self._hold(set().union(*counted))
        sizes = np.fromiter(map(len, counted), np.int64, len(counted))
        rows = np.fromiter((self.held[w] for c in counted for w in c), np.int64, sizes.sum())
        times = np.fromiter((n for c in counted for n in c.values()), np.float64, sizes.sum())
        total, found = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        if some := np.flatnonzero(sizes).tolist():
            starts = (np.cumsum(sizes) - sizes)[some]
            total[some] = np.add.reduceat(self.scores[rows] * times[:, None], starts, axis=0)
            found[some] = np.logical_or.reduceat(rows > 0, starts)
        best = total.argmax(axis=1)
        score = 1.0 / np.exp(np.maximum(-700.0, total - total.max(axis=1, keepdims=True))).sum(axis=1)
        return [self.langs[b] if f else UNDETERMINED for b, f in zip(best.tolist(), found.tolist(), strict=True)], np.where(found, score, 0.0)


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashes(codes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length m up to ``most``: hashes of the substrings of that length of every row, by start."""
    h = np.zeros(codes.shape, np.uint64)
    for m in range(1, min(codes.shape[1], most) + 1):
        h = h[:, : codes.shape[1] - m + 1] * STEP + (codes[:, m - 1 :] + np.uint64(1))
        yield m, (h ^ (h >> np.uint64(32))) * MIX


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, vocabulary: str, sample: int = 300, rounds: int = 2, alpha: float = 0.05) -> tuple[dict, dict]:
    """(model, pieces) from labelled documents; sample: documents per language at most, those with the smallest hash of doc_id."""
    index = pieces(vocabulary)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    held = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row per language
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.lit(0)
    for lang, n in held.items():  # twice the share that is needed, so that only that much is ranked
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 30, (2 * sample + 50) * (1 << 30) // n))).otherwise(share)
    near = labelled.filter(h <= share).select("lang", "text", "doc_id", h.alias("h"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"))
    rows = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample).select("lang", "text").collect()
    counts: dict[str, Counter] = {}
    for r in rows:
        own = counts.setdefault(r["lang"], Counter())
        for w, n in Counter(WORD.findall(r["text"].lower())).items():
            if has_letter(w):
                own[" " + w] += n
    return _train(counts, index, rounds, alpha), index


def predict(docs: DataFrame, model: dict, index: dict) -> DataFrame:
    """doc_id, lang_pred and score of every document, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast((model, index))  # bounded by the vocabulary and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for b in batches:
            ids, texts = b.column(0).cast(pa.int64()), b.column(1)
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // GROUP_BYTES
            for first, after in itertools.pairwise([0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), b.num_rows]):
                langs, scores = scorer.predict(texts.slice(first, after - first).to_pylist())
                yield pa.record_batch([ids.slice(first, after - first), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
