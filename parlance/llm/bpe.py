"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

Texts are cut at white space into pieces that never share a token; the distinct pieces of a chunk
of documents are encoded together. The symbols of all their words lie in one flat array; a round
finds every adjacent pair's rank by binary search over the sorted pair keys and merges each word's
lowest-ranked pair, until no word has a known pair.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: the pre-tokenizer's published pattern
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
CHUNK_CHARS, CACHE, LONG = 2_000_000, 400_000, 200
NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files: itself if printable Latin-1, else the next from code point 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class ByteBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbol = np.array([vocab[c] for c in letters], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (not empty)."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.symbol[np.frombuffer(b"".join(words), np.uint8)]
        ids = np.arange(len(words))
        while len(ids):
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            word = np.repeat(np.arange(len(ids)), sizes)
            rank = np.full(len(sym), NEVER)
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][fits] = self.rank[at[fits]]
            least = np.minimum.reduceat(rank, starts)
            pick = (rank == least[word]) & (rank != NEVER)
            # of overlapping equal pairs (a a a) every other one, from the left
            runs = np.flatnonzero(pick)
            head = np.r_[True, (np.diff(runs) != 1) | (word[runs[1:]] != word[runs[:-1]])] if len(runs) else np.zeros(0, bool)
            nth = np.arange(len(runs)) - np.maximum.accumulate(np.where(head, np.arange(len(runs)), 0))
            runs = runs[nth % 2 == 0]
            sym[runs] = self.merged[at[runs]]
            stay = np.ones(len(sym), bool)
            stay[runs + 1] = False
            sizes = sizes - np.bincount(word[runs], minlength=len(ids))
            sym, word = sym[stay], word[stay]
            done = least == NEVER
            if done.any():
                ends = np.cumsum(sizes)
                for i in np.flatnonzero(done):
                    out[ids[i]] = sym[ends[i] - sizes[i] : ends[i]]
                sym = sym[~done[word]]
                ids, sizes = ids[~done], sizes[~done]
        return out

    def learn(self, pieces: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """For each piece: its ids joined by commas, their number and the bytes they decode to."""
        words = {p: WORD.findall(p) for p in pieces}
        distinct = list({w for ws in words.values() for w in ws})
        coded = {}
        for w, ids in zip(distinct, self.encode_words([w.encode("utf-8", "surrogatepass") for w in distinct])):
            ids = ids.tolist()
            coded[w] = (",".join(map(str, ids)), len(ids), self.decode_bytes(ids))
        return {p: (",".join([coded[w][0] for w in ws]), sum(coded[w][1] for w in ws), b"".join([coded[w][2] for w in ws])) for p, ws in words.items()}

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def pieces(self, text: str) -> list[str]:
        if self.special_split is None or not any(t in text for t in self.special):
            return PIECE.findall(text)
        return [x for part in self.special_split.split(text) for x in ([part] if part in self.special else PIECE.findall(part))]

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """For each text: the number of ids, the ids joined by commas, the decoded bytes."""
        cut = [self.pieces(t) for t in texts]
        new = {p for p in set().union(*cut) if p not in self.known and p not in self.special}
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = set().union(*cut) - self.special.keys()
        here = self.known
        here.update(self.learn(new))
        here.update({t: (str(i), 1, self.bytes_of[i]) for t, i in self.special.items()})
        for ps in cut:
            if not ps:
                yield 0, "", b""
                continue
            ids, counts, raw = zip(*map(here.__getitem__, ps))
            yield sum(counts), ",".join(ids), b"".join(raw)
        for p in new:
            if len(p) > LONG:
                del here[p]

    def encode(self, text: str) -> list[int]:
        ((_, ids, _),) = self.encode_texts([text])
        return [int(i) for i in ids.split(",")] if ids else []


@functools.lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs`` (doc_id, text).

    ``path`` names a byte-level BPE file that every executor has. Null texts are encoded as empty
    ones: no ids, and the digests of no bytes. Strings of special tokens inside a text become those
    tokens. Repeated rows and null ids are rows of their own; an empty table gives an empty result;
    other columns are left out. Documents go through in chunks, each whole, so memory is bounded by
    a chunk and the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            texts, n = batch.column("text"), len(batch)
            sizes = np.diff(np.append(0, np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in texts])))
            group = np.cumsum(sizes) // CHUNK_CHARS
            for g in np.unique(group):
                lo, hi = np.searchsorted(group, g), np.searchsorted(group, g, "right")
                rows = [(k, sha(ids.encode()), sha(raw.decode("utf-8", "replace").encode())) for k, ids, raw in bpe.encode_texts([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])]
                k, ids, raw = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(k, pa.int64()), pa.array(ids), pa.array(raw)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
