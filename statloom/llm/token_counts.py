"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

The vocabulary is that of a sentencepiece BPE model with byte fallback. A text is cut where no piece of the
vocabulary spans two neighbouring characters: no merge can cross such a place, so the parts merge alone.
Tasks remember the counts of the parts they met; forgetting them changes only the speed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import texts, tidy

#: Parts whose counts a task remembers at most before it starts afresh.
REMEMBERED = 300_000


class PieceCounter:
    """Counts the pieces of texts for one sentencepiece BPE model."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.seen: dict[str, int] = {}
        inner = {piece[i : i + 2] for piece in self.rank for i in range(len(piece) - 1)}
        letters = sorted({c for pair in inner for c in pair})
        self.group = np.zeros(0x110000, np.uint16)
        self.group[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        size = len(letters) + 1
        self.joined = np.zeros((size, size), bool)
        for pair in inner:
            self.joined[self.group[ord(pair[0])], self.group[ord(pair[1])]] = True

    def symbols(self, part: str) -> int:
        """Symbols before any merge: a character, or its bytes where the vocabulary lacks it."""
        return sum(1 if c in self.rank else len(c.encode()) for c in part)

    def merges(self, part: str) -> int:
        """Merges done on one part: always the adjacent pair of lowest rank, the leftmost of equals."""
        rank, n = self.rank, len(part)
        end = list(range(1, n + 1))  # of the symbol that begins here; 0 once it is merged into its left neighbour
        left = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(part[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 1, i + 2))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if end[a] != b or end[b] != stop:
                continue
            done += 1
            end[a], end[b] = stop, 0
            if stop < n:
                left[stop] = a
                r = rank.get(part[a : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, a, stop, end[stop]))
            before = left[a]
            if before >= 0:
                r = rank.get(part[before:stop])
                if r is not None:
                    heapq.heappush(heap, (r, before, a, stop))
        return done

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = "▁" + text.replace(" ", "▁")
        groups = self.group[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        cuts = (np.flatnonzero(~self.joined[groups[:-1], groups[1:]]) + 1).tolist()
        seen, total, begin = self.seen, 0, 0
        cuts.append(len(text))
        for end in cuts:
            part = text[begin:end]
            begin = end
            n = seen.get(part)
            if n is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                n = seen[part] = self.symbols(part) - self.merges(part)
            total += n
        return total


@lru_cache(maxsize=2)
def counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document, repeated rows included.

    A null text is empty and has no tokens. One pass without a shuffle; texts of any length are
    counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(model_path)
        for batch in batches:
            column = batch.column("text")
            counts = [pieces.count(t.as_py()) for t in column]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = sized.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
