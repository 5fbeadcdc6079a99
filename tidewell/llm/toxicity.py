"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM (operator 10).

Kernel. The features of a window of characters are its subsequences of ORDER characters within a span of ORDER + GAPS,
each weighted by DECAY to the number of skipped characters, over the window with a mark at either end and scaled by
a norm that only the length sets. So `idiot`, `id.iot` and `idjiot`, or a stem with any ending, share most of their weight.

Windows. A labelled text is a bag of windows: its words, words without their inner signs, neighbouring short words
joined (`id iot`), and runs of single characters joined (`i d i o t`). A text's decision is that of its worst window.

Training is that of a multiple-instance SVM: only texts have labels, never words. The first decision weighs each
feature by the logarithm of how much more often toxic texts have it than clean ones. Then, in rounds, a toxic text is
stood for by its windows that the decision so far calls toxic, or by the worst one; clean texts by a sample of their
windows and those that score high. The VIRTUAL most frequent windows that only toxic texts have count once more with a
character put in. The SVM is fitted on the Nyström features K(landmarks, landmarks)^(-1/2) k(window, landmarks), with
landmarks from both. As the kernel is an inner product of explicit features, the decision is one table of weights over
subsequences, which is what executors get.

It is fitted on a bounded sample of labelled rows: SAMPLE_DOCS of them, in the order of a hash, of at most SAMPLE_BYTES bytes
each. Within it, clean windows start as NEGATIVES and grow by HARD each round; these bound memory. A logistic curve, fitted
on a quarter of the sample that is kept out of the SVM, turns margins into scores; there, toxic texts weigh COST_MISSED
times as much as clean ones. Empty and null texts have no windows and the lowest margin. Labels, language and source
are no inputs. Repeated rows of labels are one; a doc_id with both labels is toxic; texts of a repeated doc_id share its label.
"""

from __future__ import annotations

import hashlib
import multiprocessing
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import pick, stored, text_slices, trim

ORDER, GAPS, DECAY = 4, 3, 0.6
SAMPLE_DOCS, SAMPLE_BYTES = 8_000, 20_000
LANDMARKS, NEGATIVES, ROUNDS, HARD = 320, 12_000, 5, 3_000
COST_TOXIC, COST_CLEAN, COST_MISSED, VIRTUAL = 2.0, 10.0, 3.0, 24
#: What is added to counts of a feature, and the share of clean texts that the first decision may put above its level.
SMOOTH, FEW = 0.3, 0.2
CUT = 0.7
#: Characters of a window at most, and what neighbouring pieces of a longer word share; characters of a word that is joined with its neighbour.
LONGEST, OVERLAP, SHORT = 32, 10, 3
NO_WORD = -4.0
SLICE_BYTES = 4 << 20

#: 32 classes of characters. 0 is the mark at either end, 1 to 26 are letters.
DIGIT, SIGN, ACUTE_E, ACCENTED, OTHER = 27, 28, 29, 30, 31
ACCENTS = "àáâãäåæçèêëìíîïñòóôõöøùúûüýÿœß"


def _classes() -> np.ndarray:
    out = np.full(0x10000, OTHER, np.uint8)
    out[:128] = SIGN
    for c in range(128):
        if chr(c).isdigit():
            out[c] = DIGIT
        elif chr(c).isalpha():
            out[c] = ord(chr(c).lower()) - 96
    for c in ACCENTS:
        out[ord(c)] = ACCENTED
    out[ord("é")] = ACUTE_E
    return out


CLASSES = _classes()


@lru_cache(maxsize=64)
def shape(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of a marked word with that many characters, and their weights, scaled by the norm."""
    size = length + 2
    rows = [(a, *rest) for a in range(size) for rest in combinations(range(a + 1, min(size, a + ORDER + GAPS)), ORDER - 1)]
    if not rows:
        return np.zeros((0, ORDER), np.int64), np.zeros(0, np.float32)
    places = np.array(rows)
    weight = DECAY ** (places[:, -1] - places[:, 0] - ORDER + 1)
    return places, (weight / np.sqrt((weight**2).sum())).astype(np.float32)


def clean(word: str) -> str:
    """Without signs at either end."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def pieces(word: str) -> list[str]:
    """Long words as overlapping pieces; nothing is left out."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - OVERLAP, LONGEST - OVERLAP)]


def views(word: str) -> list[str]:
    """What of a word is scored: it without signs at its ends, and without any, in pieces."""
    w = clean(word)
    if not w:
        return []
    bare = w if w.isalnum() else "".join(c for c in w if c.isalnum())
    return pieces(w) if bare == w else pieces(w) + pieces(bare)


def coded(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words by length: their numbers, the codes of their subsequences, and the subsequences' weights."""
    by: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        by[len(w)].append(i)
    for n, own in by.items():
        places, weight = shape(n)
        if not len(weight):
            continue
        step = max(1, 2_000_000 // len(weight))
        for a in range(0, len(own), step):
            some = own[a : a + step]
            letters = np.zeros((len(some), n + 2), np.int32)
            if n:
                points = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le"), np.uint32).reshape(len(some), n)
                letters[:, 1:-1] = CLASSES[np.minimum(points, 0xFFFF)]
            code = letters[:, places[:, 0]]
            for k in range(1, ORDER):
                code = code * 32 + letters[:, places[:, k]]
            yield np.array(some), code, weight


def margins(words: list[str], table: np.ndarray) -> np.ndarray:
    """The decision for each word (at most LONGEST characters)."""
    out = np.full(len(words), NO_WORD, np.float32)
    for some, code, weight in coded(words):
        out[some] = table[code] @ weight + table[-1]
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The kernel between words and landmarks."""
    number = np.full(32**ORDER, -1, np.int64)
    rows: list[tuple[int, np.ndarray, np.ndarray]] = []
    for some, code, weight in coded(landmarks):
        rows += [(int(i), c, weight) for i, c in zip(some, code)]
    seen = np.unique(np.concatenate([c for _, c, _ in rows]))
    number[seen] = np.arange(len(seen))
    features = np.zeros((len(seen) + 1, len(landmarks)), np.float32)
    for i, c, weight in rows:
        np.add.at(features[:, i], number[c], weight)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for some, code, weight in coded(words):
        at = number[code]
        for i, a in zip(some, at):
            hit = a >= 0
            if hit.any():
                out[i] = weight[hit] @ features[a[hit]]
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 25, seed: int = 7) -> np.ndarray:
    """A linear SVM (squared hinge) by dual coordinate descent; y is 1 or -1, cost is per row."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square = (x * x).sum(1) + 0.5 / cost
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + 0.5 * alpha[i] / cost[i]
            new = max(0.0, alpha[i] - gradient / square[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def stretched(word: str) -> list[str]:
    """The word with a letter put in, and with one doubled, at places that its hash chooses."""
    h = hashed(word)
    at = 1 + h % max(1, len(word) - 1)
    return [word[:at] + chr(97 + (h >> 8) % 26) + word[at:], word[:at] + word[at - 1] + word[at:]]


def bags(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct windows of texts, and for each place a window has in a text the text's number and the window's."""
    parts = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    coded_words = parts.values.dictionary_encode()
    word = coded_words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    known = coded_words.dictionary.to_pylist()
    number: dict[str, int] = {}
    seen = [[number.setdefault(p, len(number)) for p in views(w)] for w in known]
    size = np.array([len(x) for x in seen] or [0])
    flat, first = np.array([i for x in seen for i in x] or [0]), np.cumsum(size) - size
    count = size[word]
    unit = flat[np.arange(int(count.sum())) + np.repeat(first[word] - (np.cumsum(count) - count), count)]
    texts_of, units = [np.repeat(text, count)], [unit]
    bare = [clean(w) if len(w) <= SHORT + 2 else "" for w in known]
    letters = np.array([len(b) if len(b) <= SHORT else 0 for b in bare] or [0])[word]
    # neighbours of few characters each, joined
    at = np.flatnonzero((letters[:-1] > 0) & (letters[1:] > 0) & (text[:-1] == text[1:]))
    if len(at):
        pairs, of = np.unique(word[at] * len(known) + word[at + 1], return_inverse=True)
        joined = np.array([number.setdefault(bare[p // len(known)] + bare[p % len(known)], len(number)) for p in pairs.tolist()])
        texts_of.append(text[at])
        units.append(joined[of])
    # runs of single characters
    single = np.concatenate([[0], (letters == 1).astype(np.int8), [0]])
    starts, stops = np.flatnonzero(np.diff(single) == 1), np.flatnonzero(np.diff(single) == -1)
    for a, b in zip(starts[stops - starts > 2].tolist(), stops[stops - starts > 2].tolist()):
        for c in np.split(np.arange(a, b), np.flatnonzero(np.diff(text[a:b])) + 1):
            own = [number.setdefault(p, len(number)) for p in pieces("".join(bare[i] for i in word[c].tolist()))]
            texts_of.append(np.full(len(own), text[c[0]]))
            units.append(np.array(own))
    return list(number), np.concatenate(texts_of), np.concatenate(units)


def worst(n: int, text: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The largest value of each of n texts."""
    out = np.full(n, NO_WORD)
    np.maximum.at(out, text, values)
    return out


def summed(words: list[str], weights: np.ndarray) -> np.ndarray:
    """The weighted sum of the words' features."""
    out = np.zeros(32**ORDER)
    for some, code, weight in coded(words):
        out += np.bincount(code.ravel(), np.outer(weights[some], weight).ravel(), 32**ORDER)
    return out


def whitening(landmarks: list[str]) -> np.ndarray:
    """The inverse root of the landmarks' kernel."""
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64) + 1e-6 * np.eye(len(landmarks)))
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T


def as_table(landmarks: list[str], beta: np.ndarray, bias: float) -> np.ndarray:
    """The decision bias + sum of beta k(., landmark) as weights of subsequences; the last entry is the bias."""
    table = np.zeros(32**ORDER)
    for some, code, weight in coded(landmarks):
        for i, c in zip(some, code):
            np.add.at(table, c, beta[i] * weight)
    return np.append(table, bias).astype(np.float32)


def train(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, float, float]:
    """From texts and their labels: the table of weights, and the curve's slope and shift."""
    order = sorted(range(len(texts)), key=lambda i: hashed(texts[i].as_py() or ""))
    texts, labels = texts.take(pa.array(order, pa.int64())), labels[order]
    n, held = len(texts), np.arange(len(texts)) % 4 == 0
    names, text, unit = bags(texts)
    once = np.unique(text * max(1, len(names)) + unit)
    text, unit = once // max(1, len(names)), once % max(1, len(names))
    bad, good = (labels[text] == 1) & ~held[text], (labels[text] != 1) & ~held[text]
    if not bad.any() or not good.any():
        return np.append(np.zeros(32**ORDER, np.float32), np.float32(-1)), 1.0, 0.0

    # the first decision: the logarithm of how often toxic texts have a feature over how often clean ones do, smoothed
    n_bad, n_good = (len(np.unique(text[x])) for x in (bad, good))
    mean_bad, mean_good = (summed(names, np.bincount(unit[x], minlength=len(names)) / m) for x, m in ((bad, n_bad), (good, n_good)))
    first = np.log((mean_bad + SMOOTH / n_bad) / (mean_good + SMOOTH / n_bad))
    f = margins(names, np.append(first, 0.0).astype(np.float32))
    bad_text, bad_unit, clean_units = text[bad], unit[bad], np.unique(unit[good])
    clean_times = np.bincount(unit[good], minlength=len(names))
    clean_names = {names[u] for u in clean_units.tolist()}
    by_hash = sorted(clean_units.tolist(), key=lambda u: hashed(names[u]))
    chosen, before = by_hash[:NEGATIVES], None
    level = np.quantile(worst(n, text[good], f[unit[good]])[np.unique(text[good])], 1 - FEW)
    for _ in range(ROUNDS):
        # a toxic text is stood for by its worst window and others above the level, and clean windows that score high are added
        rank = np.lexsort((bad_unit, -f[bad_unit], bad_text))
        top = rank[np.unique(bad_text[rank], return_index=True)[1]]
        above = np.union1d(top, np.flatnonzero(f[bad_unit] > level))
        witness, times = np.unique(bad_unit[above], return_counts=True)
        level = 0.0
        hard = clean_units[np.argsort(-f[clean_units], kind="stable")[:HARD]]
        fresh = np.setdiff1d(hard if before is None else hard[f[hard] > -0.6], chosen).tolist()
        if before is not None and not fresh and np.array_equal(before, witness):
            break
        chosen, before = chosen + fresh, witness
        often = witness[np.lexsort((witness, -times))].tolist()
        spread = sorted(often, key=lambda u: hashed(names[u]))
        marks = list(dict.fromkeys(often[: LANDMARKS // 3] + spread[: LANDMARKS // 3]))
        rest = (LANDMARKS - len(marks)) // 2
        marks = list(dict.fromkeys(marks + hard[:rest].tolist() + by_hash[:rest]))
        landmarks = [names[u] for u in marks]
        whiten = whitening(landmarks)
        own = [names[u] for u in often if names[u] not in clean_names and len(names[u]) >= ORDER]
        virtual = [v for name in own[:VIRTUAL] for v in stretched(name) if v not in clean_names]
        x = kernel([*(names[u] for u in witness.tolist()), *virtual, *(names[u] for u in chosen)], landmarks) @ whiten.astype(np.float32)
        y = np.concatenate([np.ones(len(witness) + len(virtual)), -np.ones(len(chosen))])
        cost = np.concatenate([COST_TOXIC * times, np.full(len(virtual), COST_TOXIC), COST_CLEAN * clean_times[chosen]])
        w = svm(x, y, cost)
        table = as_table(landmarks, whiten @ w[:-1], w[-1])
        f = margins(names, table)
    # the curve, on texts kept out: regularised logistic regression by Newton's steps; all toxic texts together weigh COST_MISSED times the clean ones
    top = worst(n, text, f[unit].astype(np.float64))[held]
    y = (labels[held] == 1).astype(float)
    weight = np.where(y == 1, 0.5 * COST_MISSED / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    theta, design = np.array([1.0, 0.0]), np.stack([top, np.ones(len(top))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + np.array([0.02 * theta[0], 0])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([0.02, 1e-3])
        theta = theta - np.linalg.solve(hessian, gradient)
    return table, float(max(theta[0], 0.1)), float(theta[1])


def apart(f, *arguments):
    """Call f in a process of its own, so that what it needs is gone afterwards; workers are used again."""
    context = multiprocessing.get_context("fork")
    here, there = context.Pipe(False)

    def call() -> None:
        try:
            there.send((True, f(*arguments)))
        except BaseException as error:  # noqa: BLE001  told to the caller
            there.send((False, repr(error)))
        os._exit(0)

    child = context.Process(target=call)
    child.start()
    there.close()
    try:
        good, result = here.recv()
    finally:
        child.join()
    if not good:
        raise RuntimeError(f"training failed: {result}")
    return result


def slice_margins(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """The margin of each text: the largest of its windows'."""
    names, text, unit = bags(texts)
    return worst(len(texts), text, margins(names, table)[unit]) if names else np.full(len(texts), NO_WORD)


def fold(id_column: str) -> "F.Column":
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def fit(docs: DataFrame, labels: DataFrame, work: str, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, float, float]:
    """Train on labelled rows whose fold is not 1."""
    d = docs.select(*[c.alias(n) for c, n in zip(pick(docs, "doc_id", "text"), ("doc_id", "text"))]).where(F.octet_length("text") <= SAMPLE_BYTES)
    known = labels.select(*[c.alias(n) for c, n in zip(pick(labels, "doc_id", "toxic"), ("doc_id", "toxic"))]).where("toxic in (0, 1) and doc_id is not null").where(fold("doc_id") != 1)
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = stored(d.join(chosen, "doc_id").select("text", "toxic"), f"{work}/sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            sample = pa.Table.from_batches(got).combine_chunks()
            texts, labels = sample.column(0).combine_chunks(), sample.column(1).to_numpy().astype(np.int64)
            del got, sample
            table, slope, shift = apart(train, texts, labels)
            yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([slope]), pa.array([shift])], ["table", "slope", "shift"])
            del texts
        trim()

    # the sample is bounded, so one task can hold it, and the driver needs no more than the model
    made = sample.coalesce(1).mapInArrow(run, "table binary, slope double, shift double").first()
    if made is None:
        return train(pa.array([], pa.string()), np.zeros(0, np.int64))
    return np.frombuffer(made["table"], np.float32), made["slope"], made["shift"]


def scores(texts: pa.Array, model: tuple[np.ndarray, float, float]) -> np.ndarray:
    table, slope, shift = model
    return 1 / (1 + np.exp(-(slope * slice_margins(texts, table) + shift)))


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], id_column: str = "doc_id", text_column: str = "text", cut: float = CUT) -> DataFrame:
    """id, score and predicted for every row; no shuffle. A null id stays null, repeated rows are repeated, other columns
    are ignored; texts are scored whole, long ones in a slice of their own."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most_bytes=SLICE_BYTES):
                p = scores(part.column(1), held.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["id", "score", "predicted"])

    out = docs.select(*[c.alias(n) for c, n in zip(pick(docs, id_column, text_column), ("id", "text"))]).mapInArrow(run, f"id {dict(docs.dtypes)[id_column]}, score double, predicted int")
    return out.withColumnRenamed("id", id_column)


def without_toxic(docs: DataFrame, model: tuple[np.ndarray, float, float], text_column: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of docs, with all columns, whose score is below cut; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_column, SLICE_BYTES):
                yield part.filter(pa.array(scores(part.column(at), held.value) < cut))

    return docs.mapInArrow(run, docs.schema)


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3
