"""Toxicity scores from subword embeddings, averaged over bags of words into a linear softmax.

A word is the mean of the vectors of its character n-grams, which are hashed into a table, so a misspelling not met
before shares most vectors with the word it comes from. A text's bag holds its ``BAG`` most toxic words, each occurrence
counting and a run of one word once; the bag's vector is the sum of their vectors over ``BAG`` (missing words are zero).
So a long text is not diluted, and words that are toxic only when they come again and again add up. Table, softmax and
bias are trained together. Tasks turn the training texts into word hashes and n-gram buckets; only those come to the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import chunks, cut, map_arrow, split_words

BAG = 4
SIZES = range(3, 6)
BUCKETS, DIMS = 1 << 20, 8
#: Distinct words that are scored at once inside a task.
AT_ONCE = 20_000
#: Most labelled rows a model is trained on: those with the smallest hashes of their ids.
MAX_TRAIN = 4000
#: The first steps train on larger bags, before it is known which words are toxic.
STEPS, WIDE_STEPS, WIDE_BAG = 100, 25, 64
#: Share of the distinct words that a training step leaves out, so that each toxic word learns to suffice without the others.
LEFT_OUT = 0.1
RATE, DECAY, EPSILON = 0.2, 1e-8, 1e-4
#: Rows of the table that a training step updates at once.
ROWS_AT_ONCE = 1 << 16
_PRIME = np.uint64(0x100000001B3)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``<word>`` and the whole word, word after word, and how many each word has."""
    joined = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(lengths)
    word_of = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))  # characters from here to the word's end
    rolled = np.zeros(len(points), dtype=np.uint64)
    owners, found = [], []
    for n in range(1, max(SIZES) + 1):
        head = len(points) - n + 1
        if head <= 0:
            break
        rolled = rolled[:head] * _PRIME + points[n - 1 :] + np.uint64(1)
        if n in SIZES:
            inside = left[:head] >= n
            found.append(rolled[inside] ^ np.uint64(n << 56))
            owners.append(word_of[:head][inside])
    whole = np.zeros(len(words), dtype=np.uint64)
    if len(points):
        at = np.arange(len(points)) - np.repeat(ends - lengths, lengths)
        weight = (at.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (points + np.uint64(7)) * weight
        whole = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), ends - lengths)
    found.append(whole)
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    value = np.concatenate(found)
    value = (value ^ (value >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    order = np.argsort(owner, kind="stable")
    buckets = ((value >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)
    return buckets[order].astype(np.int32), np.bincount(owner, minlength=len(words))


def _sliced(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`subwords` of any number of words, hashed in slices."""
    parts = [subwords(words[i : i + AT_ONCE]) for i in range(0, len(words), AT_ONCE)]
    none = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(found) for found in zip(none, *parts))


def runs_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lower-case words of many texts, as ``split_words`` gives them, but a run of one word counts once."""
    offsets, codes, words = split_words(pc.utf8_lower(pc.fill_null(texts, "")))
    if len(codes):
        again = np.concatenate([[False], codes[1:] == codes[:-1]])
        again[offsets[:-1][offsets[:-1] < len(codes)]] = False
        offsets = np.concatenate([[0], np.cumsum(~again)])[offsets]
        codes = codes[~again]
    return offsets, codes, words


def first_of_each(offsets: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` entries of each text."""
    taken = np.minimum(np.diff(offsets), most)
    return np.arange(taken.sum()) + np.repeat(offsets[:-1] - (np.cumsum(taken) - taken), taken)


def most_toxic(by_word: np.ndarray, offsets: np.ndarray, codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words with the greatest scores of each text, and their texts; ``places`` are :func:`first_of_each`.

    Words are ranked once, and the ranks are sorted text by text. Equal scores take the smaller code.
    """
    order = np.argsort(-by_word, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    key = np.repeat(np.arange(len(offsets) - 1) * len(order), np.diff(offsets))
    key += rank[codes]
    key.sort()
    key = key[places]
    return order[key % max(len(order), 1)], key // max(len(order), 1)


def _word_scores(table: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(counts):
        return np.zeros(0)
    return np.add.reduceat(table[buckets], np.cumsum(counts) - counts) / counts


@dataclass
class Model:
    """``table`` has each bucket's vector projected on the difference of the two softmax rows, all that scoring needs."""

    table: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        offsets, codes, words = runs_of(texts)
        slices = [words[i : i + AT_ONCE] for i in range(0, len(words), AT_ONCE)]
        by_word = np.concatenate([np.zeros(0), *(_word_scores(self.table, *subwords(part)) for part in slices)])
        word, text = most_toxic(by_word, offsets, codes, first_of_each(offsets, BAG))
        logits = np.bincount(text, by_word[word], minlength=len(offsets) - 1) / BAG + self.bias
        return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def train(offsets: np.ndarray, codes: np.ndarray, buckets: np.ndarray, counts: np.ndarray, toxic: np.ndarray, seed: int = 7) -> Model:
    """Adam over all rows on the cross entropy of each text's bag; constant if only one class is given.

    The words of text i are ``codes[offsets[i] : offsets[i + 1]]``; ``buckets`` and ``counts`` are those of
    :func:`subwords` for the words that the codes stand for.
    """
    rate = (toxic.sum() + 0.5) / (len(toxic) + 1)
    bias = float(np.log(rate / (1 - rate)))
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(np.zeros(BUCKETS), bias)
    places = np.flatnonzero(np.bincount(buckets, minlength=BUCKETS))
    buckets = np.searchsorted(places, buckets)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.01, (len(places), DIMS)).astype(np.float32)
    softmax = rng.normal(0, 1.0, (2, DIMS))
    offset = np.array([0.0, -3.0])
    parameters = [vectors, softmax, offset]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    narrow, wide = first_of_each(offsets, BAG), first_of_each(offsets, WIDE_BAG)

    def update(p, g, m, v, step):
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + EPSILON)

    for step in range(1, STEPS + 1):
        direction = softmax[1] - softmax[0]
        by_word = _word_scores(vectors @ direction.astype(np.float32), buckets, counts)
        by_word[rng.random(len(by_word)) < LEFT_OUT] = -np.inf
        word, text = most_toxic(by_word, offsets, codes, wide if step <= WIDE_STEPS else narrow)
        met = np.isfinite(by_word[word])
        word, text = word[met], text[met]
        logits = np.bincount(text, by_word[word], minlength=len(toxic)) / BAG + offset[1] - offset[0]
        chance = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        slope = (chance - toxic) / len(toxic)  # of the loss by each text's difference of logits
        by_word = np.bincount(word, slope[text] / BAG, minlength=len(counts))
        by_bucket = np.bincount(buckets, np.repeat(by_word / counts, counts), minlength=len(places)).astype(np.float32)
        turn = (by_bucket @ vectors).astype(np.float64)
        for i in range(0, len(places), ROWS_AT_ONCE):
            p, m, v = (a[i : i + ROWS_AT_ONCE] for a in (vectors, first[0], second[0]))
            update(p, by_bucket[i : i + ROWS_AT_ONCE, None] * direction.astype(np.float32) + DECAY * p, m, v, step)
        gradients = [np.stack([-turn, turn]), np.array([-slope.sum(), slope.sum()])]
        for p, g, m, v in zip(parameters[1:], gradients, first[1:], second[1:]):
            update(p, g, m, v, step)
    table = np.zeros(BUCKETS)
    table[places] = vectors @ (softmax[1] - softmax[0]).astype(np.float32)
    return Model(table, float(offset[1] - offset[0]))


#: A text has ``_id``, ``_toxic`` and the hashes of its words; a word has no id, but its hash and its buckets.
_FEATURES = "_id long, _toxic long, hash long, data binary"


def _features(batches):
    for batch in chunks(batches):
        offsets, codes, words = runs_of(batch.column("text"))
        buckets, counts = _sliced(words)
        hashes = np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for w in words], dtype=np.int64)
        of_texts = [hashes[codes[i:j]].astype("<i8").tobytes() for i, j in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id").cast(pa.int64()), batch.column("_toxic").cast(pa.int64()), pa.nulls(len(of_texts), pa.int64()), pa.array(of_texts, pa.binary())],
            ["_id", "_toxic", "hash", "data"],
        )
        ends = np.cumsum(counts)
        for i in range(0, len(words), AT_ONCE):
            of_words = [buckets[e - n : e].astype("<i4").tobytes() for e, n in zip(ends[i : i + AT_ONCE], counts[i : i + AT_ONCE])]
            nothing = pa.nulls(len(of_words), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [nothing, nothing, pa.array(hashes[i : i + AT_ONCE]), pa.array(of_words, pa.binary())], ["_id", "_toxic", "hash", "data"]
            )


def _flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all binary rows end to end, and how many each row has."""
    width = np.dtype(kind).itemsize
    values = [np.frombuffer(v.as_buffer(), dtype=kind) for part in column.chunks for v in part]
    sizes = np.asarray(pc.binary_length(column), dtype=np.int64) // width
    return np.concatenate([np.zeros(0, dtype=kind), *values]), sizes


def fit(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model of the labelled documents (``doc_id``, ``toxic``), at most ``max_train`` of them.

    Labels or ids that are null are not used; an id with several labels counts as toxic if one of them is 1. Of repeated rows
    and of an id's several texts each is learned from. Without any labelled row there is no model, which is an error.
    """
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    documents = documents.select("doc_id", "text")
    one = usable.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    chosen = one.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = documents.join(F.broadcast(chosen), documents["doc_id"] == chosen["_id"])  # max_train rows of 12 bytes
    rows = rows.select("_id", F.col("_toxic").cast("long").alias("_toxic"), F.col("text").cast("string").alias("text"))
    found = cut(map_arrow(rows, _features, _FEATURES), "features")
    texts = found.where("_id IS NOT NULL").select("_id", "_toxic", "data").orderBy("_id", "data").limit(max_train).toArrow()
    toxic = (texts.column("_toxic").to_numpy() > 0).astype(float)
    of_texts, lengths = _flat(texts.column("data"), "<i8")
    del texts
    words = found.where("hash IS NOT NULL").groupBy("hash").agg(F.min("data").alias("data")).orderBy("hash").toArrow()
    codes = np.searchsorted(words.column("hash").to_numpy(), of_texts)
    del of_texts
    buckets, sizes = _flat(words.column("data"), "<i4")
    del words
    return train(np.concatenate([[0], np.cumsum(lengths)]), codes, buckets, sizes, toxic)


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row, from its whole text alone; a null text is scored like an empty one."""

    def rate(batches):
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(model.score(batch.column("text")))], ["doc_id", "score"]
            )

    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_arrow(texts, rate, "doc_id long, score double")


def without_toxic(documents: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose texts score below ``limit``."""
    texts = documents.withColumn("text", F.col("text").cast("string"))

    def keep(batches):
        for batch in chunks(batches):
            yield batch.filter(pa.array(model.score(batch.column("text")) < limit))

    return map_arrow(texts, keep, texts.schema)
