"""Subject areas of pages by interpolated n-gram language models.

For every language and subject there is a model of words and word pairs, P(w | v, s) = l * ML(w | v, s) + (1 - l) * P(w | s), the word
part itself interpolated with the words of all pages; a background model of the same form holds what is said on any subject.
A line speaks for a subject by the difference of its cross-entropies under the background and the subject's model. Labels are of pages,
so the models are trained by EM: the lines of a page are shared out among its labels and the background. Acceptance is
calibrated on pages that the models did not see: a page gets every subject whose probability passes a common threshold.
"""

from __future__ import annotations

import json
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spellings of the languages in which pages are labelled; other values train nothing.
LANGUAGES = {"en": "en", "eng": "en", "de": "de", "ger": "de", "deu": "de", "fr": "fr", "fra": "fr", "fre": "fr"}
# Signs that recognisers put in the place of letters.
MISREAD = {"0": "o", "1": "l", "5": "s", "4": "a", "9": "g", "6": "b", "8": "b", "(": "c", "$": "s", "|": "l", "+": "t", "ſ": "s"}

_BROKEN = re.compile(r"[-­‐‑–—¬]+[ \t\r]*\n\s*")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """``pages``: the models are fitted on about as many labelled pages, chosen by a hash of doc_id; there is no other bound. ``least``: a word counts from so many
    of these pages on, a pair from one more. ``stretch`` and ``window``: the lines over which evidence is summed up, on pages of any length; ``near``: the lines before and after that tell a line's language."""

    pages: int = 4000
    least: int = 2
    stretch: int = 150
    window: int = 8
    near: int = 20
    rounds: int = 5
    pair_weight: float = 0.5
    word_weight: float = 0.9
    folds: int = 3


def lines_of(text: str | None) -> list[list[str]]:
    """Words of each line: lower case, words broken at line ends joined, misread signs taken for letters; lines without words are left out."""
    if not text:
        return []
    plain = text.lower()
    for sign, letter in MISREAD.items():  # faster than one translate over characters that aren't ASCII
        plain = plain.replace(sign, letter)
    joined = _BROKEN.sub("", plain.replace("\r", "\n"))
    return [words for words in map(_WORD.findall, joined.split("\n")) if words]


@dataclass
class Batch:
    """Pages as flat arrays: word ids (-1: unknown), the pair id of each word with the one before it, and where lines and pages begin."""

    words: np.ndarray
    pairs: np.ndarray
    line_at: np.ndarray
    page_at: np.ndarray


@dataclass
class Vocabulary:
    words: dict[str, int]
    pairs: np.ndarray  # sorted keys: first * len(words) + second

    def batch(self, texts: list[str | None]) -> Batch:
        pages = [lines_of(t) or [[""]] for t in texts]
        lines = list(chain.from_iterable(pages))
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        words = np.fromiter(map(self.words.get, chain.from_iterable(lines), repeat(-1)), np.int64, int(sizes.sum()))
        line_at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        page_at = np.concatenate([[0], np.cumsum([len(p) for p in pages])[:-1]]).astype(np.int64)
        before = np.roll(words, 1)
        key = np.where((words >= 0) & (before >= 0), before * len(self.words) + words, -1)
        key[line_at[page_at]] = -1
        pairs = np.full(len(words), -1)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            pairs = np.where(self.pairs[at] == key, at, -1)
        return Batch(words, pairs, line_at, page_at)


def vocabulary(texts: list[str], cfg: Settings) -> Vocabulary:
    pages = [[w for line in lines_of(t) for w in line] for t in texts]
    counts = Counter(chain.from_iterable(map(set, pages)))
    kept = sorted(w for w, n in counts.items() if n >= cfg.least)
    ids = {w: i for i, w in enumerate(kept)}
    pairs: Counter = Counter()
    for page in pages:
        known = [ids.get(w, -1) for w in page]
        pairs.update({a * len(ids) + b for a, b in zip(known, known[1:], strict=False) if a >= 0 and b >= 0})
    return Vocabulary(ids, np.array(sorted(k for k, n in pairs.items() if n > cfg.least), np.int64))


def _rowsum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at, axis=0) if len(at) else values[:0]


def _page_bounds(page_at: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the page of each line begins and ends."""
    sizes = np.diff(np.append(page_at, lines))
    return np.repeat(page_at, sizes), np.repeat(page_at + sizes, sizes)


def _around(values: np.ndarray, page_at: np.ndarray, near: int) -> np.ndarray:
    """Per line the sum over the lines of its page that are at most ``near`` lines off."""
    at = np.arange(len(values))
    begin, end = _page_bounds(page_at, len(values))
    sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, 0, dtype=np.float64)])
    return sums[np.minimum(at + near + 1, end)] - sums[np.maximum(at - near, begin)]


@dataclass
class Models:
    """``word``, ``pair``: [language, id + 1, subject] log ratios to the background; row 0 is for what is unknown. ``lang``: [id + 1, language] log probabilities."""

    word: np.ndarray
    pair: np.ndarray
    lang: np.ndarray
    near: int

    def languages(self, b: Batch) -> np.ndarray:
        """The language of each line, by the words of the lines around it: a page may change its language."""
        near = _around(_rowsum(self.lang[b.words + 1], b.line_at), b.page_at, self.near)
        return near.argmax(1)

    def evidence(self, b: Batch, language: np.ndarray) -> np.ndarray:
        """Per line and subject: background cross-entropy less the subject's, in nats, summed over the line's words."""
        g = np.repeat(language, np.diff(np.append(b.line_at, len(b.words))))
        token = np.where((b.pairs >= 0)[:, None], self.pair[g, b.pairs + 1], self.word[g, b.words + 1])
        return _rowsum(token, b.line_at)


def _logs(b: Batch, share: np.ndarray, language: np.ndarray, n_lang: int, vocab: Vocabulary, cfg: Settings) -> tuple[np.ndarray, np.ndarray]:
    """[language, id + 1, class] log probabilities of words and of pairs, from each line's shares among the classes (the last is the background)."""
    classes, v, p = share.shape[1], len(vocab.words), len(vocab.pairs)
    line_of = np.repeat(np.arange(len(b.line_at)), np.diff(np.append(b.line_at, len(b.words))))
    lang_of = language[line_of]
    word = np.zeros((n_lang, v + 1, classes), np.float32)
    pair = np.zeros((n_lang, p + 1, classes), np.float32)
    first = vocab.pairs // max(v, 1)
    second = vocab.pairs % max(v, 1)
    for g in range(n_lang):
        here = lang_of == g
        one = np.stack([np.bincount(b.words[here] + 1, share[line_of[here], c], v + 1) for c in range(classes)], 1)
        two = np.stack([np.bincount(b.pairs[here] + 1, share[line_of[here], c], p + 1) for c in range(classes)], 1)
        one[0] = two[0] = 0
        base = one.sum(1, keepdims=True) + 0.05
        base /= base.sum()
        uni = cfg.word_weight * one / (one.sum(0) + 1.0) + (1 - cfg.word_weight) * base
        bi = cfg.pair_weight * two[1:] / (one[first + 1] + 1.0) + (1 - cfg.pair_weight) * uni[second + 1]
        word[g, 1:], pair[g, 1:] = np.log(uni[1:]), np.log(bi)
        # a pair that was seen is weighed against one that wasn't: the word part is multiplied by 1 - pair_weight there
        pair[g, 1:] -= np.log(1 - cfg.pair_weight)
    return word, pair


def train_models(texts: list[str], langs: list[str | None], labels: list[set[int]], subjects: int, vocab: Vocabulary, cfg: Settings) -> Models:
    """EM over the lines of labelled pages. Pages without label are all background."""
    b = vocab.batch(texts)
    names = sorted(set(LANGUAGES.values()))
    per_page = np.append(b.page_at, len(b.line_at))
    known = np.array([names.index(LANGUAGES[x.lower()]) if x and x.lower() in LANGUAGES else -1 for x in langs], np.int64)
    line_page = np.repeat(np.arange(len(texts)), np.diff(per_page))
    word_page = np.repeat(line_page, np.diff(np.append(b.line_at, len(b.words))))
    counts = np.stack([np.bincount(b.words[known[word_page] == g] + 1, minlength=len(vocab.words) + 1) for g in range(len(names))], 1) + 0.1
    counts[0] = 1
    lang = np.log(counts / counts.sum(0)).astype(np.float32)
    models = Models(np.empty(0), np.empty(0), lang, cfg.near)
    language = models.languages(b)
    allowed = np.zeros((len(texts), subjects + 1))
    for i, s in enumerate(labels):
        allowed[i, list(s)] = 0.7 / max(len(s), 1)
        allowed[i, subjects] = 0.3 if s else 1.0
    prior = allowed[line_page]
    share = prior
    for _ in range(cfg.rounds):
        word, pair = _logs(b, share, language, len(names), vocab, cfg)
        scored = Models(word, pair, lang, cfg.near).evidence(b, language)
        scored -= scored.max(1, keepdims=True)
        share = np.exp(np.maximum(scored, -60)) * prior
        share /= share.sum(1, keepdims=True)
    word, pair = _logs(b, share, language, len(names), vocab, cfg)
    return Models(word[:, :, :-1] - word[:, :, -1:], pair[:, :, :-1] - pair[:, :, -1:], lang, cfg.near)


def features(models: Models, b: Batch, cfg: Settings) -> np.ndarray:
    """[page, subject, 5]: of the best stretch of lines the expected and the clear lines of the subject, their part of the stretch and the evidence; and the best window's evidence.

    Every stretch of a page is looked at, wherever it begins, so what is measured of an article doesn't depend on its place or on how much else stands on the page. A
    page shorter than a stretch has one.
    """
    evidence = models.evidence(b, models.languages(b))
    odds = np.exp(np.clip(evidence, -30, 30))
    share = odds / (1 + odds.sum(1, keepdims=True))
    sizes = np.diff(np.append(b.page_at, len(b.line_at)))
    start, ends = np.arange(len(b.line_at)), _page_bounds(b.page_at, len(b.line_at))[1]

    def best(values: np.ndarray, lines: int) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, 0)])
        return np.maximum.reduceat(sums[np.minimum(start + lines, ends)] - sums[start], b.page_at, axis=0)

    expected, clear = best(share, cfg.stretch), best((share > 0.5).astype(np.float64), cfg.stretch)
    total, window = best(np.clip(evidence, 0, 8) * (share > 0.3), cfg.stretch), best(np.clip(evidence, -4, 8), cfg.window)
    return np.stack([np.log1p(expected), np.log1p(clear), expected / np.minimum(sizes, cfg.stretch)[:, None], window / 10, np.log1p(total)], 2)


@dataclass
class Classifier:
    subjects: list[str]
    vocab: Vocabulary
    models: Models | None
    weights: np.ndarray
    threshold: float
    cfg: Settings

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        score = features(self.models, self.vocab.batch(texts), self.cfg) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(score, -60, 60)))

    def accepted(self, texts: list[str | None]) -> np.ndarray:
        """[page, subject]; blank pages have none."""
        if not texts or self.models is None:
            return np.zeros((len(texts), len(self.subjects)), bool)
        blank = np.array([not t or not t.strip() for t in texts])
        return (self.probabilities(texts) >= self.threshold) & ~blank[:, None]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    mean, dev = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([(x - mean) / dev, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
        w += np.linalg.solve(hessian, a.T @ (y - p) - 0.1 * w)
    out = w[:-1] / dev
    return np.append(out, w[-1] - out @ mean)


def fit_part(part: int, texts: list[str], langs: list[str | None], votes: list[dict[str, float]], subjects: list[str], cfg: Settings) -> tuple | None:
    """One of cfg.folds + 1 independent parts of fitting: of a fold the features and labels of its pages under models that did not see them, and last the vocabulary and the models of all pages."""
    if not any(votes):
        return None
    place = {s: i for i, s in enumerate(subjects)}
    labels = [{place[s] for s in v if s in place} for v in votes]
    vocab = vocabulary(texts, cfg)
    fold = np.arange(len(texts)) % cfg.folds
    seen, unseen = np.flatnonzero(fold != part), np.flatnonzero(fold == part)
    if part < cfg.folds and not (len(seen) and len(unseen)):
        return None
    models = train_models([texts[i] for i in seen], [langs[i] for i in seen], [labels[i] for i in seen], len(subjects), vocab, cfg)
    if part == cfg.folds:
        return vocab, models
    truth = np.array([[votes[i].get(s, 0.0) >= 0.5 for s in subjects] for i in unseen], float)
    return features(models, vocab.batch([texts[i] for i in unseen]), cfg), truth


def finish(parts: list[tuple | None], subjects: list[str], cfg: Settings) -> Classifier:
    """The classifier of all parts of a fit: weights and threshold come of the folds, models of the last part. Without labels nothing is accepted."""
    folds, last = [p for p in parts[:-1] if p], parts[-1] if parts else None
    if last is None:
        return Classifier(subjects, Vocabulary({}, np.empty(0, np.int64)), None, np.zeros(1), 1.0, cfg)
    flat = np.concatenate([x.reshape(-1, x.shape[2]) for x, _ in folds]) if folds else np.zeros((1, 5))
    y = np.concatenate([t.reshape(-1) for _, t in folds]) if folds else np.zeros(1)
    weights = _logistic(flat, y)
    p = 1 / (1 + np.exp(-(flat @ weights[:-1] + weights[-1])))
    grid = np.arange(0.2, 0.71, 0.02)
    score = [2 * (y * (p >= t)).sum() / max(1e-9, y.sum() + (p >= t).sum()) for t in grid]
    return Classifier(subjects, *last, weights, float(grid[int(np.argmax(score))]), cfg)


def fit(texts: list[str], langs: list[str | None], votes: list[dict[str, float]], subjects: list[str], cfg: Settings | None = None) -> Classifier:
    """``votes``: per page the share of its annotators that gave each subject. Half or more counts as a label for calibration, any for training."""
    cfg = cfg or Settings()
    return finish([fit_part(k, texts, langs, votes, subjects, cfg) for k in range(cfg.folds + 1)], subjects, cfg)


def train(docs: DataFrame, labels: DataFrame, subjects: DataFrame, cfg: Settings | None = None) -> Classifier:
    """Fit on about ``cfg.pages`` labelled pages at most.

    Pages are chosen by a hash of doc_id before any text is moved, so neither the tasks nor the driver see more with a larger corpus. Each part of the fit is a task that gets
    all chosen pages; the driver collects what the parts come to (models, and features of the pages) and the subject list, a table that people write.
    """
    cfg = cfg or Settings()
    names = sorted(r.subject for r in subjects.select("subject").where("subject is not null").distinct().collect())
    labelled = labels.select("doc_id").distinct().count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = labels.where(draw < math.ceil((1 << 20) * min(1.0, cfg.pages / max(labelled, 1))))
    per = chosen.groupBy("doc_id").agg(F.count_distinct("annotator").alias("annotators"), F.to_json(F.collect_set(F.struct("subject", "annotator"))).alias("given"))
    pages = docs.select("doc_id", "text", "lang").where(F.trim("text") != "").join(per, "doc_id")
    parts = pages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(cfg.folds)))).repartitionById(cfg.folds + 1, F.col("part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task has the pages of one part: about cfg.pages of them."""
        groups = list(batches)
        if not sum(map(len, groups)):
            return
        rows = pd.concat(groups).sort_values(["doc_id", "text"])
        votes = []
        for annotators, given in zip(rows["annotators"], rows["given"], strict=True):
            counts = Counter(g["subject"] for g in json.loads(given) if g.get("subject") is not None)
            votes.append({s: n / max(annotators, 1) for s, n in counts.items()})
        part = int(rows["part"].iloc[0])
        made = fit_part(part, list(rows["text"]), [x if isinstance(x, str) else None for x in rows["lang"]], votes, names, cfg)
        yield pd.DataFrame({"part": [part], "made": [pickle.dumps(made)]})

    done = {r.part: pickle.loads(r.made) for r in parts.mapInPandas(run, "part int, made binary").collect()}
    return finish([done.get(k) for k in range(cfg.folds + 1)], names, cfg)


def areas(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, chars, subjects): the characters and the subject areas of every page, none for null, empty and blank texts; repeated rows repeat.

    The models travel as one broadcast whose size the pages of the fit bound. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = c.accepted(part.column("text").to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(found.sum(1))]).astype(np.int32))
                subjects = pa.ListArray.from_arrays(offsets, pa.array([c.subjects[s] for s in np.nonzero(found)[1]], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("chars"), subjects], names=["doc_id", "chars", "subjects"])

    sized = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("chars"), "text")
    return sized.mapInArrow(run, "doc_id bigint, chars bigint, subjects array<string>")


def assign(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, subject): a row for every subject area of every page."""
    return areas(docs, classifier).select("doc_id", F.explode("subjects").alias("subject"))


def composition(pages: DataFrame) -> DataFrame:
    """Per subject (null: pages without any) of ``areas``: pages and characters; a page counts in each of its subjects."""
    return pages.select("chars", F.explode_outer("subjects").alias("subject")).groupBy("subject").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"))
