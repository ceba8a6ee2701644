"""Byte-pair encoding through a table of distinct words, and decoding through an id-to-piece join.

Encoding: texts are split into words (the pieces that merges cannot cross) in blocks of documents. A block keeps
for each document its words' numbers, and deals its distinct words to buckets by their hash. A bucket sees each
distinct word of the whole corpus and encodes it once; its ids go back to every block that has the word, and
the block joins them to its documents by position. What is shuffled are numbers and distinct words, not texts.

Decoding: every id meets its piece in the vocabulary's table, whose size the vocabulary file bounds; the pieces of a
document are put together by position.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import texts, tidy

#: Bytes of text that a block of documents holds at least before it is closed.
BLOCK_BYTES = 12_000_000
#: Documents for each bucket of distinct words; and the most buckets.
BUCKET_DOCUMENTS, MOST_BUCKETS = 2_000, 100_000

_BLOCKS = "block long, bucket int, doc_id long, payload binary"


class Vocabulary:
    """One byte-level BPE vocabulary file: how it splits texts, encodes words and spells ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        specials = [t["content"] for t in parts["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.splitter = self.tokenizer.pre_tokenizer
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        spelled = dict(self._byte_letters())
        pieces = [self.tokenizer.id_to_token(i) for i in range(self.size)]
        added = set(specials)
        #: The id-to-piece table: the bytes of every id.
        self.pieces = [
            p.encode() if p in added or any(c not in spelled for c in p) else bytes(spelled[c] for c in p) for p in pieces
        ]

    #: Fixed by the file format and this pattern's letters, digits and blanks; used for texts of common letters only.
    plain_words = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    #: Letters on which the pattern above and the library's own splitting agree: ASCII and Latin letters without signs.
    plain_text = re.compile(r"[\t\n\r -~À-ÖØ-öø-ſ]*")

    @staticmethod
    def _byte_letters() -> Iterator[tuple[str, int]]:
        """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
        beyond = 0x100
        for byte in range(256):
            if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or 0xAE <= byte <= 0xFF:
                yield chr(byte), byte
            else:
                yield chr(beyond), byte
                beyond += 1

    def _split(self, text: str) -> list[str]:
        if self.plain_text.fullmatch(text):
            return self.plain_words.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        """The words of a text, in order; a special string inside it is a word of its own."""
        if self.special is None or not self.special.search(text):
            return self._split(text)
        out = []
        for part in self.special.split(text):
            if self.special.fullmatch(part):
                out.append(part)
            elif part:
                out += self._split(part)
        return out

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: the low bytes first, as many planes as the largest needs."""
    values = values.astype("<u4")
    planes = values.view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def _unpack(payload: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _pack_words(words: list[str]) -> bytes:
    data = [w.encode() for w in words]
    head = np.array([len(words), *map(len, data)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(data))


def _unpack_words(payload: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)).tolist()
    body, begin, out = raw[4 + 4 * n :], 0, []
    for end in ends:
        out.append(body[begin:end].decode())
        begin = end
    return out


class _Numbers(dict):
    """Words to numbers in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class _Block:
    """Documents whose words are numbered together, common words first."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.doc_ids: list[int | None] = []
        self.docs: list[np.ndarray] = []
        self.size = 0
        self.seal = hashlib.blake2b(digest_size=8)

    def add(self, doc_id: int | None, text: str, words: list[str]) -> None:
        self.docs.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.doc_ids.append(doc_id)
        self.size += len(text)
        self.seal.update(b"%d:%d:" % (doc_id or 0, len(text)) + text.encode())

    def rows(self, buckets: int, of_words: bool) -> Iterator[tuple]:
        """The block's distinct words, a row for each bucket; or its documents, as bucket -1."""
        key = int.from_bytes(self.seal.digest(), "little", signed=True)
        words = list(self.numbers)
        order = np.argsort(-np.bincount(np.concatenate(self.docs), minlength=len(words)), kind="stable")
        if not of_words:
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            for doc_id, numbers in zip(self.doc_ids, self.docs):
                yield key, -1, doc_id, _pack(rank[numbers])
            return
        dealt = np.array([zlib.crc32(w.encode()) % buckets for w in words], np.int32)[order]
        by_bucket = np.argsort(dealt, kind="stable")
        for places in np.split(by_bucket, np.flatnonzero(np.diff(dealt[by_bucket])) + 1):
            if len(places):
                head = _pack(np.diff(places, prepend=0))
                yield key, int(dealt[places[0]]), None, len(head).to_bytes(4, "little") + head + _pack_words([words[i] for i in order[places].tolist()])


def _blocks(path: str, buckets: int, of_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, block = vocabulary(path), _Block()

        def close() -> Iterator[pa.RecordBatch]:
            chunk, size = [], 0
            for row in block.rows(buckets, of_words):
                chunk.append(row)
                size += len(row[3])
                if size > 2_000_000:
                    yield _batch(chunk)
                    chunk, size = [], 0
            if chunk:
                yield _batch(chunk)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                block.add(doc_id, text, vocab.words(text))
                if block.size >= BLOCK_BYTES:
                    yield from close()
                    block = _Block()
        if block.docs:
            yield from close()

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    block, bucket, doc_id, payload = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(payload, pa.binary())],
        ["block", "bucket", "doc_id", "payload"],
    )


def _encode_words(path: str):
    """Rows of a bucket stand together; each distinct word of a bucket is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known, current = vocabulary(path), {}, None
        for batch in batches:
            blocks, buckets, payloads = (batch.column(c) for c in ("block", "bucket", "payload"))
            out = []
            for block, bucket, payload in zip(blocks.to_pylist(), buckets.to_pylist(), payloads):
                payload = payload.as_py()
                if bucket != current:
                    known, current = {}, bucket
                size = int.from_bytes(payload[:4], "little")
                words = _unpack_words(payload[4 + size :])
                new = [w for w in words if w not in known]
                known.update(zip(new, vocab.ids(new)))
                ids = [known[w] for w in words]
                lengths = _pack(np.fromiter(map(len, ids), np.int64, len(ids)))
                flat = _pack(np.fromiter((i for x in ids for i in x), np.int64, sum(map(len, ids))))
                back = payload[: 4 + size] + len(lengths).to_bytes(4, "little") + lengths + flat
                out.append((block, bucket, None, back))
            yield _batch(out)

    return run


def _take_runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after the other."""
    if not len(starts):
        return values[:0]
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return values[np.arange(int(ends[-1])) + shift]


class _Words:
    """The ids of a block's distinct words, by rank."""

    def __init__(self, payloads: list[bytes]) -> None:
        places, lengths, flats = [], [], []
        for payload in payloads:
            a = 4 + int.from_bytes(payload[:4], "little")
            b = a + 4 + int.from_bytes(payload[a : a + 4], "little")
            places.append(np.cumsum(_unpack(payload[4:a])))
            lengths.append(_unpack(payload[a + 4 : b]))
            flats.append(_unpack(payload[b:]))
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.flat = np.concatenate(flats) if flats else np.zeros(0, np.int64)
        start = np.cumsum(length) - length
        self.start, self.length = np.zeros_like(start), np.zeros_like(length)
        self.start[place], self.length[place] = start, length

    def ids(self, ranks: np.ndarray) -> np.ndarray:
        if len(ranks) and int(ranks.max()) >= len(self.start):
            raise ValueError("a block lacks its words: the documents were read in another order the second time")
        return _take_runs(self.flat, self.start[ranks], self.length[ranks])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block stand together, its words (bucket 0 and up, sorted downwards) before its documents (-1)."""
    current, payloads, words = None, [], None
    for batch in batches:
        doc_ids, rows, size = [], [], 0
        for block, bucket, doc_id, payload in zip(*(batch.column(c) for c in ("block", "bucket", "doc_id", "payload"))):
            block, bucket = block.as_py(), bucket.as_py()
            if block != current:
                current, payloads, words = block, [], None
            if bucket >= 0:
                payloads.append(payload.as_py())
                continue
            if words is None:
                words, payloads = _Words(payloads), []
            doc_ids.append(doc_id.as_py())
            rows.append(words.ids(_unpack(payload.as_py())))
            size += len(rows[-1])
            if size > 1_000_000:
                yield _id_lists(doc_ids, rows)
                doc_ids, rows, size = [], [], 0
        if rows:
            yield _id_lists(doc_ids, rows)


def _id_lists(doc_ids: list, rows: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])


def _coded_blocks(docs: DataFrame, vocabulary_path: str, id_col: str, text_col: str) -> DataFrame:
    """The rows of all blocks, their words encoded, dealt and sorted for `_assemble`."""
    rows = texts(docs, id_col, text_col)
    buckets = int(min(max(rows.count() // BUCKET_DOCUMENTS, 16), MOST_BUCKETS))
    of_words = rows.mapInArrow(tidy(_blocks(vocabulary_path, buckets, True)), _BLOCKS)
    of_documents = rows.mapInArrow(tidy(_blocks(vocabulary_path, buckets, False)), _BLOCKS)
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_bucket = of_words.repartition(max(spread, min(buckets, 4 * spread)), "bucket").sortWithinPartitions("bucket")
    together = of_documents.unionByName(by_bucket.mapInArrow(tidy(_encode_words(vocabulary_path)), _BLOCKS))
    return together.repartition("block").sortWithinPartitions("block", F.desc("bucket"))


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row: those of the whole text, special strings inside it included.

    A null text is empty and has no ids; a null doc_id stays null; repeated rows come out as often as they
    came in; an empty table gives an empty one. A hot word is one entry per block, so no group grows
    with a word's frequency. Texts are read twice, once for the words and once for the documents; a block's name is a
    hash of its contents, so that documents read in another order the second time raise an error.
    """
    return _coded_blocks(docs, vocabulary_path, id_col, text_col).mapInArrow(tidy(_assemble), "doc_id long, ids array<int>")


@lru_cache(maxsize=2)
def _piece_table(path: str) -> pa.Array:
    return pa.array(vocabulary(path).pieces, pa.large_binary())


@lru_cache(maxsize=2)
def _decimal_table(path: str) -> pa.Array:
    return pa.array([b"%d," % i for i in range(vocabulary(path).size)], pa.large_binary())


def _joined(table: pa.Array, ids: pa.Array, offsets: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The entries of all ids, one after the other, and where each row's begin."""
    taken = table.take(ids)
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
    return memoryview(taken.buffers()[2] or b""), ends[offsets]


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _piece_table(path)
        for batch in batches:
            lists = batch.column("ids")
            length = pa.compute.list_value_length(lists).fill_null(0).to_numpy()
            data, at = _joined(pieces, lists.flatten(), np.concatenate([[0], np.cumsum(length)]))
            text = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return run


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimals = _decimal_table(path)
        for batch in batches:
            lists = batch.column("ids")
            length = pa.compute.list_value_length(lists).to_numpy()
            data, at = _joined(decimals, lists.flatten(), np.concatenate([[0], np.cumsum(length)]))
            of_ids = [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            of_text = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(length, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids and text of every row: the pieces of its ids, specials kept, bytes that are no UTF-8 replaced.

    A row without ids has an empty text.
    """
    return encoded.mapInArrow(tidy(_decode(vocabulary_path)), "doc_id long, ids array<int>, text string")


def decoded_documents(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, encoded and decoded again.

    The steps after the last shuffle run one after the other in one Python worker.
    """
    back, digest = _decode(vocabulary_path), _digest(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return digest(back(_assemble(batches)))

    blocks = _coded_blocks(docs, vocabulary_path, "doc_id", "text")
    return blocks.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
