"""Encoding a corpus with a public byte-level BPE vocabulary (problem 7).

A streaming transducer instead of repeated merging. For BPE over a list whose
tokens are all built by its merges, the encoding of a prefix of length i ends in
exactly one token t(i), and the encoding of the prefix is that of length
i - |t(i)| followed by t(i). t(i) is the one vocabulary token ending at i that
stands next to t(i - |t(i)|), that is, the two encoded together stay two tokens.
So one left-to-right pass gives t(1), t(2), ... looking at no byte twice as far
back as the longest token.

Lookahead: a later token starts at most (longest token - 1) bytes before the end
of what was read, so a boundary is settled once the chains t from all these
starts pass through it. `window` is that reach, computed from the merge list;
tokens before the settled boundary are emitted and forgotten, whatever the
length of the text. Splitting into words by the vocabulary's pattern comes first and
words are remembered in a table of bounded size.
"""

from __future__ import annotations

import base64
import codecs
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of the rank files: a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered by an encoder, and the bytes up to which a word is remembered.
WORDS, WORD_BYTES = 200_000, 256
#: Bytes between two looks for a settled boundary.
SETTLE = 512
#: Characters up to which a text's words are split all at once, and characters of a word that enter the transducer at once.
WHOLE, CHUNK = 65_536, 4_096


class Vocabulary:
    """Ranks of a rank file, with what the transducer needs of them."""

    def __init__(self, path: str = DEFAULT) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.window = max(map(len, self.ranks))
        self.tails = {b[k:] for b in self.ranks for k in range(len(b))}
        self.pattern = regex.compile(PATTERN)
        self.beside: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent pair of least rank, the leftmost of equals, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, left: int, right: int) -> bool:
        """Whether the two tokens, encoded as one string, stay as they are."""
        key = (left, right)
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) > 4 * WORDS:
                self.beside.clear()
            known = self.beside[key] = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
        return known

    def word(self, text: str) -> tuple[int, ...]:
        ids = self.words.get(text)
        if ids is None:
            if len(text) > CHUNK:
                return tuple(self.stream(text[i : i + CHUNK].encode("utf-8", "surrogatepass") for i in range(0, len(text), CHUNK)))
            data = text.encode("utf-8", "surrogatepass")
            one = self.ranks.get(data)
            ids = (one,) if one is not None else tuple(self.stream([data]))
            if len(data) <= WORD_BYTES:
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[text] = ids
        return ids

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one word given in chunks of bytes, each as soon as it is settled."""
        buf, base = b"", 0  # the bytes not yet emitted or still within reach of a token; the place of the first
        last: dict[int, int] = {}  # end -> t(end), for ends after `done`
        done = end = 0
        ranks, tails, stands = self.ranks, self.tails, self.stands
        for chunk in chunks:
            buf += chunk
            while end < base + len(buf):
                end += 1
                k = end - base
                found = -1
                for start in range(k - 1, max(-1, done - base - 1), -1):
                    piece = buf[start:k]
                    if piece not in tails:
                        break
                    t = ranks.get(piece)
                    if t is not None:
                        at = base + start
                        before = last.get(at)
                        if before is None and at == done or before is not None and stands(before, t):
                            found = t
                last[end] = found
                if end - done > SETTLE + self.window and (end - done) % SETTLE == 0:
                    new, ids = self._settled(last, done, end)
                    if ids:
                        yield from ids
                        last = {i: t for i, t in last.items() if i >= new}  # t(new) itself still decides who may follow
                        buf, base, done = buf[new - base :], new, new
        yield from self._chain(last, done, end)

    def _chain(self, last: dict[int, int], done: int, end: int) -> list[int]:
        ids = []
        while end > done:
            ids.append(last[end])
            end -= len(self.bytes[last[end]])
        return ids[::-1]

    def _settled(self, last: dict[int, int], done: int, end: int) -> tuple[int, list[int]]:
        """The last boundary on the chains of all places from which a later token can start."""
        live = set(range(max(done + 1, end - self.window + 1), end + 1))
        while len(live) > 1:
            i = max(live)
            if i <= done:
                return done, []
            live.discard(i)
            live.add(max(done, i - len(self.bytes[last[i]])))
        at = live.pop()
        return at, self._chain(last, done, at)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens; of an empty or null text none."""
        out: list[int] = []
        if text:
            words, word = self.words, self.word
            for m in self.pattern.findall(text) if len(text) <= WHOLE else (m.group() for m in self.pattern.finditer(text)):
                out.extend(words.get(m) or word(m))
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of a stream of ids, piece by piece; bytes of a split character wait for the rest."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            piece = state.decode(self.bytes[i])
            if piece:
                yield piece
        rest = state.decode(b"", True)
        if rest:
            yield rest


def vocabulary(path: str = DEFAULT) -> Vocabulary:
    """One vocabulary per Python process and path: later tasks of a worker find its word table filled."""
    kept = sys.__dict__.setdefault("_skein_vocabularies", {})
    if path not in kept:
        kept[path] = Vocabulary(path)
    return kept[path]


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT) -> DataFrame:
    """Rows (id_col, ids ARRAY<INT>), one for each row; empty and null texts give an empty list.

    Other columns don't matter and aren't read. Rows keep their split; nothing is shuffled.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            texts = b.column(1)
            for k in range(0, len(texts), 1000):
                ids = [v.encode(t) for t in texts.slice(k, 1000).to_pylist()]
                offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, offs[-1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1000), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=[id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(f, f"`{id_col}` {kind}, ids array<int>")


def decode_corpus(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = DEFAULT) -> DataFrame:
    """Rows (id_col, text); a null or empty list gives an empty text, bytes that are no UTF-8 U+FFFD."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            texts = ["".join(v.decode(x or ())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = dict(ids.dtypes)[id_col]
    return ids.select(id_col, ids_col).mapInArrow(f, f"`{id_col}` {kind}, text string")
