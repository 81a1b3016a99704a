"""Packing of documents into sequences along a Hilbert curve.

Every token id adds a fixed random direction to its document's vector (a hashed bag of tokens, projected to
``dims`` dimensions). The direction of the sum is put on a grid, its place on the Hilbert curve is the sort key,
and documents are range-partitioned by it. Each range is packed end to end, so neighbours on the curve share
sequences. A range ends with sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import chunks, cut, gather, map_arrow, split_words

#: Fixed values of the word tokenizer: how it cuts normalised text into pieces (here for Latin-1 text).
LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")
WORD_END = "</w>"

#: Words and pieces whose ids a Python worker keeps; more are encoded again each time they are met.
KEPT_WORDS = 150_000
KEPT_PIECES = 250_000
#: Pieces that are encoded in one call.
AT_ONCE = 1000


class WordEncoder:
    """Ids of white-space words, equal to the tokenizer's ids of the whole text.

    Word pieces never reach over white space, so a text's ids are those of its words. Words of printable Latin-1
    characters are cut into pieces here, and pieces not met before are encoded many at a time; all other words go
    to the tokenizer as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        found = {}
        for i in range(0, len(pieces), AT_ONCE):
            part = pieces[i : i + AT_ONCE]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype=self.kind)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                found.update(zip(part, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))
            else:
                found.update((p, self.whole(p)) for p in part)
        return found

    def encode(self, words: list[str]) -> list[bytes]:
        out = list(map(self.words.get, words))
        missing = [i for i, ids in enumerate(out) if ids is None]
        pieces, single, plain, several, new = self.pieces, [], [], [], {}
        for i in missing:
            word = words[i]
            if word.isalpha() and (word.isascii() or max(word) < "\u0100"):
                piece = word.lower()
                ids = out[i] = pieces.get(piece)
                if ids is None:
                    single.append(i)
                    plain.append(piece)
                    new[piece] = None
            elif word.isprintable() and "<|" not in word and (word.isascii() or max(word) < "\u0100"):
                own = PIECE.findall(word.lower())
                several.append((i, own))
                for p in own:
                    if p not in pieces:
                        new[p] = None
            else:
                out[i] = self.whole(word)
        fresh = self.encode_pieces(list(new))
        if len(pieces) < KEPT_PIECES:
            pieces.update(fresh)
        for i, piece in zip(single, plain):
            out[i] = fresh[piece]
        for i, own in several:
            out[i] = b"".join([fresh[p] if p in fresh else pieces[p] for p in own])
        if len(self.words) < KEPT_WORDS:
            self.words.update((words[i], out[i]) for i in missing)
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of grid cells (rows of ``dims`` numbers below ``2**bits``)."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the coarser levels
        low = q - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _directions(size: int, buckets: int, dims: int) -> np.ndarray:
    """A direction for each token id: ids are hashed into buckets, and each bucket has a fixed random one."""
    bucket = (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets)
    return np.random.default_rng(20).standard_normal((buckets, dims))[bucket.astype(np.int64)].astype(np.float32)


def tokenized(
    documents: DataFrame, tokenizer_path: str, end_id: int, dims: int = 3, bits: int = 10, buckets: int = 4096
) -> DataFrame:
    """``doc_id``, ``key`` on the curve, ``n_tokens`` and ``ids`` (little-endian, 2 bytes each if the vocabulary allows)."""

    def encode(batches) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        directions = _directions(len(coder.ends), buckets, dims)
        for batch in chunks(batches):
            offsets, codes, words = split_words(batch.column("text"))
            parts = coder.encode(words)
            lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // coder.kind.itemsize
            flat = np.frombuffer(b"".join(parts), dtype=coder.kind)
            ids, at = gather(flat, np.cumsum(lengths) - lengths, lengths, codes)
            bounds = at[offsets]
            sums = np.zeros((batch.num_rows, dims))
            full = offsets[1:] > offsets[:-1]
            if full.any():  # of each distinct word first
                of_word, some = np.zeros((len(words), dims), dtype=np.float32), lengths > 0
                of_word[some] = np.add.reduceat(directions[flat], (np.cumsum(lengths) - lengths)[some], axis=0) if len(flat) else 0
                sums[full] = np.add.reduceat(of_word[codes], offsets[:-1][full], axis=0, dtype=np.float64)
            norm = np.maximum(np.sqrt((sums**2).sum(1)), 1e-9)[:, None]
            cells = np.clip(((sums / norm + 1) * (1 << bits - 1)).astype(np.int64), 0, (1 << bits) - 1)
            tail = np.array([end_id], dtype=coder.kind)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(hilbert_key(cells, bits)),
                    pa.array(np.diff(bounds) + 1),
                    pa.array([ids[i:j].tobytes() + tail.tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary()),
                ],
                ["doc_id", "key", "n_tokens", "ids"],
            )

    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_arrow(texts, encode, "doc_id long, key long, n_tokens long, ids binary")


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " sequence_length long, ids binary"
)


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    length: int = 4096,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``length`` ids (a power of two).

    A document is its text's ids and ``end_id``; a null or empty text is ``end_id`` alone. Documents are laid end to
    end in curve order within each range, equal keys in ``doc_id`` order (null first); repeated rows are packed as
    often as they occur. Columns of ``documents`` other than ``doc_id`` and ``text`` are not used. Without rows the
    result is empty. ``ids`` has the piece's ids, 4 bytes each, or is null without ``with_ids``.
    """
    ids = cut(tokenized(documents, tokenizer_path, end_id), "packing")
    from_bytes = 2 if encoder(tokenizer_path).kind.itemsize == 2 else 4

    def lay(batches) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        sequence, held, filled = 0, [], 0

        def rows(pieces, number, size):
            offset = 0
            for doc_id, start, ids, total in pieces:
                raw = ids.astype("<u4").tobytes()
                yield (doc_id, start, len(ids), zlib.crc32(raw), total, base + number, offset, size, raw if with_ids else None)
                offset += len(ids)

        def out(found):
            columns = list(zip(*found))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if i == 8 else pa.int64()) for i, c in enumerate(columns)], names
            )

        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            found = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), dtype=f"<u{from_bytes}")
                start = 0
                while start < len(ids):
                    part = ids[start : start + length - filled]
                    held.append((doc_id, start, part, len(ids)))
                    start, filled = start + len(part), filled + len(part)
                    if filled == length:
                        found.extend(rows(held, sequence, length))
                        sequence, held, filled = sequence + 1, [], 0
            held = [(d, s, x.copy(), n) for d, s, x, n in held]  # lets the batch go
            if found:
                yield out(found)
        found = []
        while filled:  # the rest: largest powers of two first
            size, room, taken = 1 << filled.bit_length() - 1, 1 << filled.bit_length() - 1, []
            while room:
                doc_id, start, ids, total = held.pop(0)
                part, rest = ids[:room], ids[room:]
                taken.append((doc_id, start, part, total))
                room -= len(part)
                if len(rest):
                    held.insert(0, (doc_id, start + len(part), rest, total))
            found.extend(rows(taken, sequence, size))
            sequence, filled = sequence + 1, filled - size
        if found:
            yield out(found)

    ranged = ids.select("doc_id", "key", "ids").repartitionByRange("key", "doc_id")
    return map_arrow(ranged.sortWithinPartitions("key", "doc_id", "ids"), lay, PIECES)
