"""Byte-level BPE encoding and decoding.

The merges run in the tokenizers library's BPE model, which works on characters: each byte of a text is mapped to a
printable character before, and back after decoding. Texts come in Arrow batches. A text is cut where a space stands
between two visible characters: no match of the pattern reaches over such a place, so the pieces encode separately, and
repeated pieces are encoded once for each worker, in caches that are bounded by bytes and hold no long piece. Null texts
count as empty; an empty text has no ids; repeated rows encode alike, and very long texts and pieces as a whole. A .json
file's added tokens, where a text holds their strings, are these tokens, as the library's plain call has it; .tiktoken files
hold none, so there such strings are text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from .shared import arrays, map_batches, text_of

#: Bytes of the largest of a worker's caches, at most; characters of the longest piece that is kept, and bytes that an entry of so many takes at most.
CACHED, LONGEST, ENTRY = 256 << 20, 24, 512

_TWO_SPACES = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Beyond these characters, Unicode versions of pattern libraries may differ; the tokenizers library splits such pieces.
_PLAIN = re.compile(r"[\x00-ɏͰ-ϿЀ-ӿ‐-‧]*\Z")


def byte_table() -> dict[int, str]:
    """The character of each byte: itself where it is printable and no space, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Cache(dict):
    """Values by key, computed where missing; long keys aren't kept, and a full cache is emptied. limit: bytes."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.most = make, max(1, limit // ENTRY)

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two parts of each token of more than one byte, in rank order: what remains when only lower ranks merge."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


class Codec:
    """Encodes texts to ids and decodes ids. path: a .tiktoken file of ranks, or a tokenizers .json file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, cached: int = CACHED):
        char = byte_table()
        self.char = [char[b] for b in range(256)]
        byte = {ord(c): b for b, c in char.items()}
        if path.endswith(".tiktoken"):
            ranks = ranks_of(path)
            shown = {token: "".join(map(char.__getitem__, token)) for token in ranks}
            self.library = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, [(shown[a], shown[b]) for a, b in merges_of(ranks)]))
            self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.library.decoder = decoders.ByteLevel()
        else:
            self.library = Tokenizer.from_file(path)
            self.library.encode_special_tokens = True  # pieces between added tokens are plain text
        self.added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.added_at = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.size = self.library.get_vocab_size()
        self.token = [b""] * self.size
        for shown_token, i in self.library.get_vocab().items():
            self.token[i] = bytes(byte[ord(c)] for c in shown_token) if all(ord(c) in byte for c in shown_token) else shown_token.encode()
        self.digits = [str(i) for i in range(self.size)]
        self.split, self.model = regex.compile(pattern).findall, self.library.model
        self.words = _Cache(self._word, cached // 8)
        self.head = _Cache(self._piece, cached // 8)
        self.tail = _Cache(self._behind_space, cached)

    def _word(self, word: str) -> bytes:
        """One match of the pattern."""
        shown = "".join(map(self.char.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if _PLAIN.match(piece):
            tail, words = self.tail, self.words
            return b"".join([tail[w[1:]] if w[0] == " " and w[1:].isalpha() else words[w] if len(w) < 20 else self._word(w) for w in self.split(piece)])
        return array("I", self.library.encode(piece, add_special_tokens=False).ids).tobytes()

    def _behind_space(self, piece: str) -> bytes:
        if piece.isalpha() and _PLAIN.match(piece):
            return self._word(" " + piece)
        if piece[:-1].isalpha() and piece[-1] in ".,!?;:":
            return self.tail[piece[:-1]] + self.words[piece[-1]]
        return self._piece(" " + piece)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers in the machine's order. Strings of the file's added tokens are these tokens, as in the library."""
        if self.added_at is None or not self.added_at.search(text):
            return self._plain_bytes(text)
        return b"".join([array("I", [self.added[x]]).tobytes() if x in self.added else self._plain_bytes(x) for x in self.added_at.split(text)])

    def _plain_bytes(self, text: str) -> bytes:
        pieces = _CUT.split(text) if _TWO_SPACES.search(text) else text.split(" ")
        return self.head[pieces[0]] + b"".join(map(self.tail.__getitem__, pieces[1:]))

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_bytes(text)).tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Bytes of a character that tokens split come together again; what isn't UTF-8 gives U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, ids: list[int]) -> list[tuple[int, int]]:
        """First character of each token and the one behind its last; tokens that share a character overlap."""
        data = self.decode_bytes(ids)
        character, at = [], -1
        for b in data:
            at += b & 0xC0 != 0x80
            character.append(at)
        out, start = [], 0
        for i in ids:
            end = start + len(self.token[i])
            out.append((character[start], character[end - 1] + 1) if end > start else (start, start))
            start = end
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each file and worker, so that its caches last over batches and tasks."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """df with a column of ids (array of int) and, if named, one of character offsets; equal names are replaced."""
    kept = df.select(*[c for c in df.columns if c not in (ids, offsets)], text_of(text).alias("__text"))
    add = [(ids, "array<int>")] + ([(offsets, "array<struct<start:int,end:int>>")] if offsets else [])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        lists = [c.encode(x) for x in batch.column("__text").to_pylist()]
        new = [pa.array(lists, pa.list_(pa.int32()))]
        if offsets:
            spans = [[{"start": a, "end": b} for a, b in c.offsets(x)] for x in lists]
            new.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
        old = [(n, batch.column(n)) for n in batch.schema.names if n != "__text"]
        return pa.RecordBatch.from_arrays([x for _, x in old] + new, names=[n for n, _ in old] + [n for n, _ in add])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"] + [f"`{n}` {t}" for n, t in add])
    return map_batches(kept, run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of a column of ids; null ids give an empty text."""
    kept = df.select(*[c for c in df.columns if c != text])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        new = pa.array([c.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, text])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{text}` string"])
    return map_batches(kept, run, schema)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, number of tokens, and digests of the ids and of the bytes that the ids decode to."""
    types = {"key": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        n, a, b = [], [], []
        for x in batch.column("text").to_pylist():
            ids = c.encode(x)
            n.append(len(ids))
            a.append(hashlib.sha256(" ".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(c.decode_bytes(ids)).hexdigest())
        return arrays(types, {"key": batch.column("key").to_pylist(), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b})

    out = map_batches(df.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text")), run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
