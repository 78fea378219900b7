"""Language-model scoring by a hashed maximum-entropy model.

A word's chance is that of its class given the words before it, times that of the word in its class given the last word. Classes are
predicted by a softmax over hashed features: a bias, the last word, the last two, and two skips. Weights are trained by
distributed gradient updates: every partition runs adaptive gradient steps over its documents from the common weights, and the
partitions' weights are averaged by their tokens, round by round, each round on another part of the training documents.
Within a class, a softmax over the class's words weighs each by its share and by a feature of the last word and the word
(``CONTEXTS`` last words, frequent ones alone, others by hash; ``SLOTS`` hashes of words). Exactly one feature is active for a word, so
the counts of features and classes, summed over the same rounds, are all that its fit needs, and sums over a class's words are
one matrix product. Word counts come from all training documents. The ``TOP`` most frequent words are known to every task; the counts of
other words are joined per document. Scoring runs in numpy over sparse rows of feature ids.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import mix64, need, quoted, slices, tree_sum, word_hashes
from plumbline.session import cut_lineage

TOP = 1 << 17
GROUPS, BINS = 6, 4
#: Classes: bins of frequency for each group of words, the end of a text, and all words beyond the top.
N_CLASSES = GROUPS * BINS + 2
END_CLASS, TAIL_CLASS = GROUPS * BINS, GROUPS * BINS + 1
ROWS = 1 << 14
ROUNDS, RATE, BATCH = 2, 0.3, 4096
#: Last words and words told apart inside classes; observations that the shares count as in each context; scaling steps of the fit.
CONTEXTS, SLOTS = 256, 4096
PRIOR, SCALINGS = 32.0, 30
START_CONTEXT, OWN_CONTEXTS = CONTEXTS - 1, CONTEXTS // 2
CHUNK, COUNTS = 1024, 32
NEVER = -60.0
END = np.uint64(0x1234567812345678)
LN10 = float(np.log(10.0))


def in_training(id_col: Column) -> Column:
    """Documents whose crc32 of the id's text isn't 2 modulo 7; a null id hashes as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 != 2


@dataclass
class Model:
    """Top words (sorted hashes) with class, count, log share in the class and number as a last word; class weights; weights of
    (last word, word) and the log of their classes' sums; corpus figures."""

    words: np.ndarray
    classes: np.ndarray
    counts: np.ndarray
    shares: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray
    ties: np.ndarray
    sums: np.ndarray
    train_tokens: int
    n_types: int
    tail_mass: float
    vocabulary: DataFrame | None = None

    def portable(self) -> Model:
        return replace(self, vocabulary=None)


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, and the end of each text in that array."""
    words, ends = word_hashes(texts)
    with_end = np.insert(words, ends, END) if len(ends) else words
    return with_end, ends + np.arange(1, len(ends) + 1)


def _features(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of the weight table for each token: bias, last word, last two, skip to the second and to the third last."""
    place = np.arange(len(tokens))
    starts = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(np.concatenate([[0], ends])))
    back = []
    for k in (1, 2, 3):
        earlier = np.concatenate([np.zeros(min(k, len(tokens)), np.uint64), tokens[:-k] if k < len(tokens) else tokens[:0]])
        back.append(np.where(place - starts >= k, earlier, np.uint64(k)))
    with np.errstate(over="ignore"):
        rows = [
            mix64(back[0] + np.uint64(0x51)), mix64(back[0] * np.uint64(31) + mix64(back[1] + np.uint64(0x77))),
            mix64(back[1] + np.uint64(0xA3)), mix64(back[2] + np.uint64(0xC9)),
        ]
    hashed = [(r % np.uint64(ROWS - 1)).astype(np.uint16) + np.uint16(1) for r in rows]
    return np.stack([np.zeros(len(tokens), np.uint16), *hashed], axis=1)


def _known(model: Model, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each token in the top words, and whether it is one."""
    at = np.minimum(np.searchsorted(model.words, tokens), max(len(model.words) - 1, 0))
    return at, (model.words[at] == tokens) if len(model.words) else np.zeros(len(tokens), bool)


def _class_of(model: Model, tokens: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
    out = np.full(len(tokens), TAIL_CLASS, np.int16)
    out[known] = model.classes[at[known]]
    out[tokens == END] = END_CLASS
    return out


def _last_context(model: Model, tokens: np.ndarray, ends: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Number of the last word before each token; the start of a text has its own."""
    own = _hashed_context(tokens)
    own[known] = model.contexts[at[known]]
    last = np.empty(len(tokens), np.int64)
    last[1:] = own[:-1]
    last[np.concatenate([[0], ends[:-1]])[: len(ends)]] = START_CONTEXT
    return last


def _hashed_context(tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        spread = mix64(tokens + np.uint64(0x3D))
    return OWN_CONTEXTS + (spread % np.uint64(START_CONTEXT - OWN_CONTEXTS)).astype(np.int64)


def _slot(tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(tokens * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SLOTS)).astype(np.int64)


def _logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the features' weights, one column a token."""
    out = weights.take(rows[:, 0], axis=0)
    for j in range(1, rows.shape[1]):
        out += weights.take(rows[:, j], axis=0)
    return np.ascontiguousarray(out.T)


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Chances of the classes, in place."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def _descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
    """One adaptive gradient step on a batch, in place."""
    grad = _softmax(_logits(weights, rows))
    grad[labels, np.arange(len(labels))] -= 1.0
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")  # 16-bit keys: a radix sort
    sorted_rows = flat[order]
    first = np.append(True, sorted_rows[1:] != sorted_rows[:-1])
    touched = sorted_rows[first]
    place = np.empty(len(flat), np.intp)
    place[order] = np.cumsum(first) - 1
    place = np.ascontiguousarray(place.reshape(rows.shape).T).ravel()
    sums = np.empty((len(grad), len(touched)), weights.dtype)
    for k, one in enumerate(grad.astype(np.float64)):
        sums[k] = np.bincount(place, weights=np.tile(one, rows.shape[1]), minlength=len(touched))
    sums = np.ascontiguousarray(sums.T)
    square = squares.take(touched, axis=0)
    square += sums * sums
    squares[touched] = square
    square += 1e-6
    sums /= np.sqrt(square, out=square)
    sums *= RATE
    weights[touched] -= sums


def _ties(pairs: np.ndarray, seen: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of (last word, slot) and the log of each class's sum after each last word.

    ``pairs`` counts words by last word and slot, ``seen`` by last word and class; ``mass`` holds the shares of the classes' words by
    slot. As one feature is active for each word, log(observed / expected) is a step that never lowers the likelihood. ``PRIOR``
    observations that follow the shares are added to each context.
    """
    total = seen.sum(axis=1, keepdims=True)
    usual = np.divide(seen, total, out=np.zeros_like(seen), where=total > 0)
    pairs, seen = pairs + PRIOR * (usual @ mass), seen + PRIOR * usual
    ties = np.zeros_like(pairs)
    for _ in range(SCALINGS):
        lift = np.exp(ties)
        each = lift @ mass.T
        expected = lift * (np.divide(seen, each, out=np.zeros_like(seen), where=each > 0) @ mass)
        some = (expected > 0) & (pairs > 0)
        ties += np.log(np.divide(pairs, expected, out=np.ones_like(pairs), where=some))
    ties = ties.astype(np.float32)
    each = np.exp(ties.astype(np.float64)) @ mass.T
    return ties, np.log(np.where(each > 0, each, 1.0))


def _log_chances(model: Model, tokens: np.ndarray, ends: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Natural logs of the tokens' chances; of a word beyond the top, of its class only."""
    rows, labels = _features(tokens, ends), _class_of(model, tokens, at, known)
    chance = np.empty(len(tokens))
    for k in range(0, len(tokens), BATCH):
        logits, mine = _logits(model.weights, rows[k : k + BATCH]).astype(np.float64), labels[k : k + BATCH]
        logits -= logits.max(axis=0)
        own = logits[mine, np.arange(len(mine))]
        chance[k : k + BATCH] = own - np.log(np.exp(logits, out=logits).sum(axis=0))
    if len(model.shares):
        last, words = _last_context(model, tokens, ends, at, known)[known], tokens[known]
        chance[known] += model.shares[at[known]] + model.ties[last, _slot(words)] - model.sums[last, labels[known]]
    return chance


def _count_words(docs: DataFrame) -> DataFrame:
    """(word, group, n): tokens of the training documents by hash and group column."""

    def count(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            groups = np.array([g or "" for g in batch.column("group").to_pylist()], dtype=object)
            for lo, hi in slices(texts):
                tokens, ends = _tokens(texts[lo:hi])
                owner = np.repeat(np.arange(hi - lo), np.diff(np.concatenate([[0], ends])))
                names, codes = np.unique(groups[lo:hi].astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    values, n = np.unique(tokens[codes[owner] == k], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"word": pa.array(values.view(np.int64)), "group": pa.array([str(name)] * len(values), pa.string()), "n": pa.array(n.astype(np.int64))})

    return docs.mapInArrow(count, "word bigint, group string, n bigint")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = "lang", top: int = TOP, rounds: int = ROUNDS) -> Model:
    """Count all training documents and train the weights. ``group_col`` (a language, say) may shape the classes."""
    group = quoted(group_col).cast("string") if group_col and group_col in docs.columns else F.lit("")
    train = docs.filter(in_training(quoted(id_col))).select(
        quoted(text_col).alias("text"), group.alias("group"), F.pmod(F.xxhash64(quoted(id_col), quoted(text_col)), F.lit(rounds)).alias("turn")
    )
    by_group = _count_words(train).groupBy("word", "group").agg(F.sum("n").alias("n"))
    vocabulary = cut_lineage(by_group.groupBy("word").agg(F.sum("n").alias("n"), F.max_by("group", F.struct("n", "group")).alias("group")))
    end = int(np.array([END]).view(np.int64)[0])
    totals = vocabulary.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types")).first()
    words = vocabulary.filter(F.col("word") != end)
    best = words.orderBy(F.desc("n"), "word").limit(top).toPandas()  # bounded by ``top``
    sizes = best.groupby("group")["n"].sum().sort_values(ascending=False, kind="stable")
    place = {g: min(k, GROUPS - 1) for k, g in enumerate(sizes.index)}
    hashes = best["word"].to_numpy(np.int64).view(np.uint64)
    counts = best["n"].to_numpy(np.int64)
    groups = np.array([place[g] for g in best["group"]], np.int64)
    classes = np.zeros(len(best), np.int16)
    for g in range(GROUPS):  # bins of about equal mass, frequent words first
        mine = np.flatnonzero(groups == g)
        if len(mine):
            mass = np.cumsum(counts[mine]) / counts[mine].sum()
            classes[mine] = g * BINS + np.minimum((mass - counts[mine] / counts[mine].sum()) * BINS, BINS - 1).astype(int)
    class_mass = np.bincount(classes, weights=counts, minlength=N_CLASSES) if len(best) else np.ones(N_CLASSES)
    shares = np.log(counts / class_mass[classes]) if len(best) else np.zeros(0)
    order = np.argsort(hashes)
    n_words = int(totals["types"] or 0) - (1 if totals["types"] else 0)
    end_count = vocabulary.filter(F.col("word") == end).agg(F.sum("n")).first()[0] or 0
    tail_words = max(n_words - len(best), 0)
    tail_tokens = int(totals["tokens"] or 0) - int(end_count) - int(counts.sum())
    contexts = np.where(np.arange(len(best)) < OWN_CONTEXTS, np.arange(len(best)), _hashed_context(hashes))  # words are in order of their counts
    model = Model(
        hashes[order], classes[order], counts[order], shares[order], contexts[order], np.zeros((ROWS, N_CLASSES), np.float32),
        np.zeros((CONTEXTS, SLOTS), np.float32), np.zeros((CONTEXTS, N_CLASSES)), int(totals["tokens"] or 0),
        int(totals["types"] or 0), float(tail_tokens + tail_words + 1), vocabulary,
    )
    model.counts = np.append(model.counts, end_count)  # the last count is the end's
    model.weights[0, : GROUPS * BINS][np.bincount(classes, minlength=N_CLASSES)[: GROUPS * BINS] == 0] = NEVER  # no word to give their chance to
    pairs, seen = np.zeros((CONTEXTS, SLOTS)), np.zeros((CONTEXTS, N_CLASSES))
    for turn in range(rounds):
        model.weights = _round(train.filter(F.col("turn") == turn).select("text"), model, pairs, seen)
    mass = np.zeros((N_CLASSES, SLOTS))
    np.add.at(mass, (classes, _slot(hashes)), np.exp(shares))
    model.ties, model.sums = _ties(pairs, seen, mass)
    return model


def _round(train: DataFrame, model: Model, pairs: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Average of the weights that each partition reaches, by its tokens; adds up words by last word and slot, and by last word and class."""
    shared = train.sparkSession.sparkContext.broadcast(model.portable())  # bounded: top words and the weight table

    def learn(batches):
        base = shared.value
        weights, squares, n = base.weights.copy(), np.zeros_like(base.weights), 0
        by_slot, by_class = np.zeros(CONTEXTS * SLOTS, np.int64), np.zeros(CONTEXTS * N_CLASSES, np.int64)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for lo, hi in slices(texts, 1 << 19):
                tokens, ends = _tokens(texts[lo:hi])
                at, known = _known(base, tokens)
                rows, labels = _features(tokens, ends), _class_of(base, tokens, at, known)
                for k in range(0, len(tokens), BATCH):
                    _descend(weights, squares, rows[k : k + BATCH], labels[k : k + BATCH])
                last = _last_context(base, tokens, ends, at, known)[known]
                by_slot += np.bincount(last * SLOTS + _slot(tokens[known]), minlength=len(by_slot))
                by_class += np.bincount(last * N_CLASSES + labels[known], minlength=len(by_class))
                n += len(tokens)
        part = TaskContext.get().partitionId()
        if not n:
            return
        # chunks of weights are numbered by their first row, those of the counts below zero
        found = [(k, np.append((weights[k : k + CHUNK] * n).ravel(), n)) for k in range(0, ROWS, CHUNK)]
        found += [(-2 - k, by_slot[k * SLOTS : (k + COUNTS) * SLOTS]) for k in range(0, CONTEXTS, COUNTS)] + [(-1, by_class)]
        for k, data in found:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "data": [data.astype(np.float32).tobytes()]})

    weights = model.weights.copy()
    for chunk, total in tree_sum(train.mapInArrow(learn, "chunk int, part int, data binary"), "float32").items():
        if chunk >= 0:
            weights[chunk : chunk + CHUNK] = (total[:-1] / total[-1]).reshape(CHUNK, N_CLASSES)
        elif chunk == -1:
            seen += total.reshape(seen.shape)
        else:
            pairs[-2 - chunk : -2 - chunk + COUNTS] += total.reshape(COUNTS, SLOTS)
    return weights


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, key, n_tokens, n_known, train_tokens, base_score, score), scores in log10.

    A null text has the end token only. Repeated rows get equal scores; rows of one id with different texts are told apart by
    the text's hash. With no training documents every word is unknown. Extra columns are ignored.
    """
    need(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model.portable())

    def run(batches):
        base = shared.value
        log_total = np.log10(base.train_tokens + base.n_types + 1)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for lo, hi in slices(texts, 1 << 19):
                tokens, ends = _tokens(texts[lo:hi])
                at, known = _known(base, tokens)
                chance = _log_chances(base, tokens, ends, at, known)
                is_end = tokens == END
                tail = ~known & ~is_end
                c = np.zeros(len(tokens))
                if len(base.words):
                    c[known] = base.counts[at[known]]
                c[is_end] = base.counts[-1]
                plain = np.where(tail, 0.0, np.log10(c + 1.0) - log_total)
                begins = np.concatenate([[0], ends[:-1]])
                rare, rare_n = [], []
                for b, e in zip(begins.tolist(), ends.tolist()):
                    values, n = np.unique(tokens[b:e][tail[b:e]], return_counts=True)
                    rare.append(values.view(np.int64))
                    rare_n.append(n.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo), batch.column("key").slice(lo, hi - lo), pa.array(ends - begins),
                        pa.array(np.add.reduceat(((c > 0) & ~tail).astype(np.int64), begins)), pa.array(np.add.reduceat(plain, begins)),
                        pa.array(np.add.reduceat(chance, begins) / LN10), pa.array(rare, pa.list_(pa.int64())), pa.array(rare_n, pa.list_(pa.int64())),
                    ],
                    names=["id", "key", "n_tokens", "known", "base", "chance", "rare", "rare_n"],
                )

    shape = "id bigint, key bigint, n_tokens bigint, known bigint, base double, chance double, rare array<bigint>, rare_n array<bigint>"
    rows = docs.select(quoted(id_col).cast("bigint").alias("id"), F.xxhash64(quoted(id_col), quoted(text_col)).alias("key"), quoted(text_col).alias("text"))
    scored = cut_lineage(rows.mapInArrow(run, shape))
    tails = scored.filter(F.size("rare") > 0).dropDuplicates(["key"]).select("key", F.explode(F.arrays_zip("rare", "rare_n")).alias("r"))
    vocabulary = model.vocabulary.select(F.col("word").alias("rare"), F.col("n").alias("c"))
    counted = tails.select("key", "r.rare", "r.rare_n").join(vocabulary, "rare", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log_total = float(np.log10(model.train_tokens + model.n_types + 1))
    log_tail = float(np.log10(model.tail_mass))
    n, seen = F.col("rare_n"), F.log10(F.col("c") + 1.0)
    sums = counted.groupBy(F.col("key").alias("k")).agg(
        F.sum(F.when(F.col("c") > 0, n).otherwise(0)).alias("more_known"), F.sum(n * (seen - log_total)).alias("more_base"), F.sum(n * (seen - log_tail)).alias("more_chance"),
    )
    none = F.lit(0.0)
    return scored.join(sums, F.col("key") == F.col("k"), "left").select(
        "id", "key", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", none)).alias("base_score"), (F.col("chance") + F.coalesce("more_chance", none)).alias("score"),
    )
