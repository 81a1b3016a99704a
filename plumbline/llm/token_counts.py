"""Token counts under a unigram model, with pre-tokens in a trie.

A task puts the distinct pre-tokens of its texts into a trie. A trie node is a prefix, and the best score and number
of pieces that end there depend on the prefix alone, so they are computed once however many pre-tokens share it; the
nodes where pre-tokens end hold their counts.

The given vocabulary is that of a BPE model, whose scores are merge ranks and no log probabilities. With it a count is
the number of pieces on the path with the best sum of ranks, which is not the number of tokens the BPE model makes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import chunks, map_arrow, split_words

#: Trie nodes of a Python worker after which a new trie is begun.
MAX_NODES = 400_000
#: Score of one byte of a character that no piece covers.
BYTE_SCORE = -1e6
SPACE = "▁"


class Trie:
    """Forward scores of prefixes; ``scores`` are added along a path, as log probabilities are."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self):
        self.children: list[dict[str, int]] = [{}]
        self.best: list[tuple[float, int]] = [(0.0, 0)]

    def count(self, word: str) -> int:
        """Pieces of the best segmentation of a word; of equal scores, the one with fewest pieces."""
        if len(self.best) > MAX_NODES:
            self.clear()
        node, path = 0, [(0.0, 0)]
        for i, char in enumerate(word, 1):
            child = self.children[node].get(char)
            if child is None:
                child = len(self.best)
                self.children[node][char] = child
                self.children.append({})
                self.best.append(self._forward(word, i, path))
            node = child
            path.append(self.best[node])
        return -self.best[node][1]

    def _forward(self, word: str, end: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        size = len(word[end - 1].encode("utf-8", "surrogatepass"))
        score, pieces = path[end - 1]
        best = (score + BYTE_SCORE * size, pieces - size)
        for start in range(max(0, end - self.longest), end):
            own = self.scores.get(word[start:end])
            if own is not None:
                score, pieces = path[start]
                best = max(best, (score + own, pieces - 1))
        return best


def piece_scores(model_path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file and their scores, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    skipped = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not skipped(i)}


_tries: dict[str, Trie] = {}


def count_tokens(documents: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, ``n_pretokens`` and ``n_tokens`` of every row.

    Pre-tokens are the words between white space (space, U+0009 to U+000D), each with a space mark before it. A
    character that no piece covers counts as its bytes in UTF-8. Null and empty texts have no tokens. Repeated rows are
    counted each; columns other than ``doc_id`` and ``text`` are not used. The scores are taken from the file as they are: of a
    BPE file, ``n_tokens`` is not the count of its tokenizer.
    """

    def count(batches):
        if model_path not in _tries:
            _tries[model_path] = Trie(piece_scores(model_path))
        trie = _tries[model_path]
        for batch in chunks(batches):
            offsets, codes, words = split_words(batch.column("text"))
            each = np.zeros(len(words), dtype=np.int64)
            for i in sorted(range(len(words)), key=words.__getitem__):  # shared prefixes one after the other
                each[i] = trie.count(SPACE + words[i])
            sums = np.concatenate([[0], np.cumsum(each[codes])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(sums[offsets[1:]] - sums[offsets[:-1]])],
                ["doc_id", "n_pretokens", "n_tokens"],
            )

    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_arrow(texts, count, "doc_id long, n_pretokens long, n_tokens long")
