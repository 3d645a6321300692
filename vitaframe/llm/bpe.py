"""Byte-level BPE over Arrow batches with the tokenizers library, and the way back to bytes.

A rank file lists byte strings in order of their merges. The library works on characters, so every
byte stands as a printable character (the byte table below, made by its rule), a merge is the pair
of tokens that a rank's bytes fall into under the smaller ranks, and the library's own byte-level
splitter cuts texts by the pattern that the rank files are made for. Ids then equal those of the
rank file. Offsets are in characters of the text; tokens that share a character bear its offset.

Encoding and decoding are row by row: nothing is shuffled, and a task holds one Arrow batch. Long
texts are handed over in pieces cut before white space that follows a word character, where no
match of the pattern can span the cut, so memory does not grow with the longest text.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

PIECE = 1 << 16
CALL = 1 << 19

#: Fixed value: the pattern that the rank files are made for; each match is encoded by itself.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Matches whose ids are remembered, and the longest of them.
KNOWN = 300_000
LONGEST = 64

_MATCH = regex.compile(PATTERN)
_CUT = re.compile(r"(?<=\w)[ \n]")


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def _halves(token: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
    """What the merges below ``rank`` leave of a token's bytes."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if ranks.get(a + b, rank) < rank]
        if not found:
            break
        at = min(found)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        table = byte_table()
        name = {token: "".join(table[b] for b in token) for token in ranks}
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) > 1:
                halves = _halves(token, rank, ranks)
                if len(halves) != 2:
                    raise ValueError(f"rank {rank} is not a merge of two smaller ranks")
                merges.append((name[halves[0]], name[halves[1]]))
        self.tokenizer = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, cache_capacity=200_000))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
        self.by_match = Tokenizer(self.tokenizer.model)
        self.by_match.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)
        self.ids_of: dict[str, str] = {}
        self.bytes_of: dict[str, bytes] = {}
        back = {char: byte for byte, char in enumerate(table)}
        self.bytes = {i: bytes(back[c] for c in t) for t, i in self.tokenizer.get_vocab().items()}

    def encode(self, texts: list[str], offsets: bool = False) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
        """Ids (and offsets, else an empty list) of each text, in order."""
        run = self.tokenizer.encode_batch if offsets else self.tokenizer.encode_batch_fast
        waiting: list[tuple[int, int, str]] = []  # text, first character, piece
        size = 0
        done = 0
        ids: list[int] = []
        spans: list[tuple[int, int]] = []

        def flush():
            nonlocal done, ids, spans
            for (owner, first, _), got in zip(waiting, run([p for _, _, p in waiting], add_special_tokens=False), strict=True):
                while done < owner:
                    yield ids, spans
                    ids, spans, done = [], [], done + 1
                ids += got.ids
                if offsets:
                    spans += [(a + first, b + first) for a, b in got.offsets]
            waiting.clear()

        for owner, text in enumerate(texts):
            for first, piece in _pieces(text):
                waiting.append((owner, first, piece))
                size += len(piece)
                if size >= CALL:
                    yield from flush()
                    size = 0
        yield from flush()
        if texts:
            yield ids, spans

    def _learn(self, wanted: list[str]) -> None:
        """Ids as decimal text, joined by commas, and decoded bytes of whole matches of the pattern."""
        encoded = self.by_match.encode(wanted, is_pretokenized=True, add_special_tokens=False)
        ids, owners = encoded.ids, encoded.word_ids
        texts, values = list(map(str, ids)), list(map(self.bytes.__getitem__, ids))
        borders = [*(i for i, owner in enumerate(owners) if not i or owner != owners[i - 1]), len(ids)]
        for match, a, b in zip(wanted, borders[:-1], borders[1:], strict=True):
            self.ids_of[match] = ",".join(texts[a:b])
            self.bytes_of[match] = b"".join(values[a:b])

    def round_trips(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids joined by commas and of the decoded bytes, of each text in order.

        A match that came before is not encoded again. What is remembered is bounded, and long texts are
        worked on piece by piece.
        """
        waiting: list[tuple[int, list[str]]] = []
        size = done = n = 0
        ids_sha, raw_sha = hashlib.sha256(), hashlib.sha256()

        def flush() -> Iterator[tuple[int, str, str]]:
            nonlocal done, n, ids_sha, raw_sha
            all_matches = set().union(*[matches for _, matches in waiting])
            lacking = [m for m in all_matches if m not in self.ids_of]
            if len(self.ids_of) + len(lacking) > KNOWN:
                self.ids_of.clear()
                self.bytes_of.clear()
                lacking = list(all_matches)
            if lacking:
                self._learn(lacking)
            for owner, matches in waiting:
                while done < owner:
                    yield n, ids_sha.hexdigest(), raw_sha.hexdigest()
                    ids_sha, raw_sha, n, done = hashlib.sha256(), hashlib.sha256(), 0, done + 1
                if matches:
                    ids = ",".join(map(self.ids_of.__getitem__, matches))
                    ids_sha.update(("," + ids if n else ids).encode())
                    n += ids.count(",") + 1
                    raw_sha.update(b"".join(map(self.bytes_of.__getitem__, matches)))
            waiting.clear()
            for match in [m for m in lacking if len(m) > LONGEST]:
                del self.ids_of[match], self.bytes_of[match]

        for owner, text in enumerate(texts):
            for _, piece in _pieces(text):
                waiting.append((owner, _MATCH.findall(piece)))
                size += len(piece)
                if size >= CALL:
                    yield from flush()
                    size = 0
        yield from flush()
        if texts:
            yield n, ids_sha.hexdigest(), raw_sha.hexdigest()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; they need not end at a character's end."""
        return b"".join(map(self.bytes.__getitem__, ids))


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    first = 0
    while len(text) - first > PIECE:
        cut = _CUT.search(text, first + PIECE)
        if not cut:
            break
        yield first, text[first : cut.start()]
        first = cut.start()
    yield first, text[first:]


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One encoder per worker process and file."""
    return ByteBpe(path)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # text that is no valid UTF-8 gets replacement characters; null counts as empty
    return docs.select(F.col(id_col).alias("id"), F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>, starts array<int>, ends array<int>``: tokens with their character offsets."""
    rows = _texts(docs, id_col, text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            got = list(bpe.encode(batch.column(1).to_pylist(), offsets=True))
            kind = pa.list_(pa.int32())
            columns = [[i for i, _ in got], [[a for a, _ in s] for _, s in got], [[b for _, b in s] for _, s in got]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, kind) for c in columns]], names=["id", "ids", "starts", "ends"]
            )

    schema = rows.select("id").schema
    for name in ("ids", "starts", "ends"):
        schema = schema.add(name, ArrayType(IntegerType()))
    return rows.mapInArrow(task, schema)


def decode(tokens: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, bytes, text``: the bytes of the tokens, and their text with U+FFFD for characters cut apart."""
    rows = tokens.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            raw = [bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())],
                names=["id", "bytes", "text"],
            )

    return rows.mapInArrow(task, rows.select("id").schema.add("bytes", "binary").add("text", "string"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: digests of a text's ids and of the bytes they decode to.

    One row per row of ``docs``, also of repeated rows and null ids; null and empty text have no tokens, a text of any
    length is encoded whole. An empty table stays empty. Tokens do not leave the task.
    """
    rows = _texts(docs, id_col, text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            found: list[tuple[int, str, str]] = []
            for start in range(0, batch.num_rows, 256):  # a few texts as Python strings at a time
                found += bpe.round_trips(batch.column(1).slice(start, 256).to_pylist())
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = rows.select("id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return rows.mapInArrow(task, schema)
