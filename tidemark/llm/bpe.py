"""BPE encoding and decoding (operator 6).

Each piece of a text (split as GPT-2's byte-level pre-tokeniser does) is merged
with a segment tree over the ranks of its adjacent pairs, `FAN` children a node. A leaf
holds rank and position, rank first, so the root yields the leftmost pair of the lowest
rank; a merge changes at most three leaves, each carried up in logarithmic time,
until the root holds no rank. A piece whose leaves fit one node is merged in that node,
which shrinks with each merge. Results of pieces and of space-free chunks are
remembered in caches bounded in entries and in the length of each, some 100 MB a
worker, which changes the time only.

Defined results: a null or empty text has no token, and the digests are those of
the empty string; a special token's string in a text becomes that token's id, as
the tokenizers library does it; very long runs without a space are encoded whole
in O(n log n); repeated rows give repeated results.
"""

from __future__ import annotations

import gc
import hashlib
import json
from contextlib import contextmanager
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import binaries

#: Fixed value: the public pre-tokenisation pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CHUNKS = 150_000  # entries of one cache generation, of some 300 bytes each
PIECES = 50_000
LONG = 64  # longer chunks are not remembered
FAN = 16  # children of a node of the tree
NONE = 1 << 40  # above every rank
NOTHING = ("", b"")  # the result of a word that another chunk holds

#: Unicode's White_Space property, spelt out so that no library's \s is relied on.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"


def byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte in a byte-level vocabulary, by its published rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    symbols = {chr(b): b for b in plain}
    spare = iter(range(256, 512))
    symbols |= {chr(next(spare)): b for b in range(256) if b not in set(plain)}
    return symbols


def load(path: str) -> dict:
    """Vocabulary of a tokenizers JSON file; its size bounds what is broadcast.

    Returns ``vocab`` (id to bytes), ``first`` (byte to id), ``merges`` (left id,
    right id, merged id, in order of rank) and ``special`` (string to id).
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
        raise ValueError(f"not a plain byte-level BPE file: {path}")
    back = byte_symbols()
    ids = spec["model"]["vocab"]
    vocab = {i: bytes(back[c] for c in s) for s, i in ids.items()}
    merges = []
    for merge in spec["model"]["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        merges.append((ids[left], ids[right], ids[left + right]))
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab |= {i: s.encode() for s, i in special.items()}
    return {"vocab": vocab, "first": [ids[s] for s, _ in sorted(back.items(), key=lambda x: x[1])], "merges": merges, "special": special}


class Encoder:
    """Encodes and decodes texts with one vocabulary; lives in a worker process."""

    def __init__(self, model: dict):
        self.vocab, self.first, self.special = model["vocab"], model["first"], model["special"]
        self.said = {i: f",{i}" for i in self.vocab}
        self.rank = {(a << 20) | b: r for r, (a, b, _) in enumerate(model["merges"])}
        self.into = [c for _, _, c in model["merges"]]
        self.begin = [self.rank.get((a << 20) | b, NONE) for a in self.first for b in self.first]  # by pair of bytes
        space = SPACES
        self.find = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{space}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)", rf"[{space}]+(?![^{space}])").replace(r"|\s+", rf"|[{space}]+")).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.pieces: dict = {}
        self.old_pieces: dict = {}
        self.chunks: dict = {}
        self.old_chunks: dict = {}
        self.spaces = frozenset(SPACES)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece; the tree's root yields the leftmost lowest pair until none is left."""
        return self.merge_node(piece) if len(piece) <= FAN + 1 else self.merge_tree(piece)

    def merge_node(self, piece: bytes) -> list[int]:
        """The same where the root is the only node: its leaves hold ranks alone, and a merged pair's leaf goes."""
        first, begin, rank, into = self.first, self.begin, self.rank.get, self.into
        ids = [first[b] for b in piece]
        leaves = [begin[a << 8 | b] for a, b in pairwise(piece)]
        low = min(leaves, default=NONE)
        while low < NONE:
            i = leaves.index(low)
            ids[i] = merged = into[low]
            del leaves[i], ids[i + 1]
            if not leaves:
                break
            if i < len(leaves):
                leaves[i] = rank(merged << 20 | ids[i + 1], NONE)
            if i:
                leaves[i - 1] = rank(ids[i - 1] << 20 | merged, NONE)
            low = min(leaves)
        return ids

    def merge_tree(self, piece: bytes) -> list[int]:
        first, begin, n = self.first, self.begin, len(piece)
        ids = [first[b] for b in piece]
        shift = n.bit_length()
        leaves = [begin[a << 8 | b] << shift | i for i, (a, b) in enumerate(pairwise(piece))]
        none = NONE << shift  # and above
        root, levels = leaves, []
        while len(root) > FAN:
            levels.append(root)
            root = [min(root[k : k + FAN]) for k in range(0, len(root), FAN)]
        low = min(root, default=none)
        if low >= none:
            return ids
        rank, into, mask = self.rank.get, self.into, (1 << shift) - 1
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while low < none:
            i = low & mask
            j = after[i]
            ids[i] = merged = into[low >> shift]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                leaves[j] = none
            if k < n:
                before[k] = i
                leaves[i] = rank(merged << 20 | ids[k], NONE) << shift | i
            else:
                leaves[i] = none
            h = before[i]
            if h >= 0:
                leaves[h] = rank(ids[h] << 20 | merged, NONE) << shift | h
            if levels:
                at = {j, i, h} if h >= 0 else {j, i}
                for lower, upper in zip(levels, [*levels[1:], root], strict=True):
                    at = {x // FAN for x in at if x < len(lower)}
                    for x in at:
                        upper[x] = min(lower[x * FAN : (x + 1) * FAN])
            low = min(root)
        return [i for i in ids if i >= 0]

    def piece(self, piece: str) -> tuple[str, bytes]:
        """Ids as ',1,2' of one piece, and the bytes they decode to."""
        if (found := self.pieces.get(piece)) is None:
            if (found := self.old_pieces.get(piece)) is None:
                ids = self.merge(piece.encode())
                said, vocab = self.said, self.vocab
                found = "".join([said[i] for i in ids]), b"".join([vocab[i] for i in ids])
            if len(piece) <= LONG:
                if len(self.pieces) >= PIECES:
                    self.old_pieces, self.pieces = self.pieces, {}
                self.pieces[piece] = found
        return found

    def chunk(self, chunk: str) -> tuple[str, bytes]:
        """The same of a chunk cut at safe places."""
        pieces = self.find(chunk)
        if len(pieces) == 1:
            return self.piece(pieces[0])
        found = [self.piece(p) for p in pieces]
        return "".join([p[0] for p in found]), b"".join([p[1] for p in found])

    def part(self, text: str, out: list) -> None:
        """Appends the chunks of a text without special tokens.

        A piece never holds a space after a non-space, so a text may be cut before
        any space that follows a non-space character.
        """
        words = text.split(" ")
        spaces = self.spaces
        held = words[0]
        begun = 1
        while begun < len(words) and (not held or held[-1] in spaces):  # the run goes on: cut later
            held += " " + words[begun]
            begun += 1
        if held:
            out.append(self.chunk(held))
        del words[:begun]
        chunks = self.chunks
        found = list(map(chunks.get, words))  # words that end a run of spaces are never kept there
        i, n = 0, len(words)
        try:
            while True:
                i = found.index(None, i)
                word = words[i]
                if not word or word[-1] in spaces:
                    at, held = i, [word]
                    while i + 1 < n:
                        i += 1
                        word = words[i]
                        held.append(word)
                        found[i] = NOTHING
                        if word and word[-1] not in spaces:
                            break
                    found[at] = self.chunk(" " + " ".join(held))
                    continue
                if (own := chunks.get(word)) is None:
                    if (own := self.old_chunks.get(word)) is None:
                        own = self.chunk(" " + word)
                    if len(word) <= LONG:
                        if len(chunks) >= CHUNKS:
                            self.old_chunks, self.chunks = chunks, {}
                            chunks = self.chunks
                        chunks[word] = own
                found[i] = own
        except ValueError:  # none is left
            pass
        out += found

    def parts(self, text: str) -> list[tuple[str, bytes]]:
        out: list = []
        for k, part in enumerate(self.split(text) if self.split else [text]):
            if k % 2:
                i = self.special[part]
                out.append((self.said[i], self.vocab[i]))
            elif part:
                self.part(part, out)
        return out

    def encode(self, text: str | None) -> list[int]:
        joined = "".join([p[0] for p in self.parts(text or "")])
        return [int(i) for i in joined[1:].split(",")] if joined else []

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD, as in the tokenizers library."""
        vocab = self.vocab
        return b"".join([vocab[i] for i in ids]).decode("utf-8", errors="replace")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids joined by commas, sha256 of the decoded text."""
        parts = self.parts(text or "")
        ids = "".join([p[0] for p in parts])
        decoded = b"".join([p[1] for p in parts])
        try:
            decoded.decode("utf-8")
        except UnicodeDecodeError:
            decoded = decoded.decode("utf-8", errors="replace").encode()
        return ids.count(","), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def digest_of(path: str) -> str:
    """Name of a vocabulary by its content."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


_ENCODERS: dict = {}


def worker_encoder(key: str, model) -> Encoder:
    """The worker process's encoder of a broadcast vocabulary, kept from task to task."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model.value)
    return _ENCODERS[key]


@contextmanager
def uncollected():
    """Without passes of the cycle collector, which would walk the caches; encoding makes no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _texts(column: pa.Array) -> list:
    return [None if b is None else b.decode("utf-8", errors="replace") for b in binaries(column)]


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): token ids of each whole text, and their decoding."""
    model = docs.sparkSession.sparkContext.broadcast(load(path))
    key = digest_of(path)

    def run(batches):
        encoder = worker_encoder(key, model)
        for batch in batches:
            ids = [encoder.encode(t) for t in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([encoder.decode(i) for i in ids], pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_column)


def digest_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each whole text."""
    model = docs.sparkSession.sparkContext.broadcast(load(path))
    key = digest_of(path)

    def run(batches):
        encoder = worker_encoder(key, model)
        for batch in batches:
            with uncollected():
                rows = [encoder.digest(t) for t in _texts(batch.column(1))]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)
