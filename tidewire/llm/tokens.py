"""Token ids of whole texts by a public byte-level BPE file.

A pre-token of this tokenizer never holds a white-space character after another character, so
a text may be cut before every single space between two other characters: the ids of the parts,
joined, are the ids of the text. The parts are words, and words recur. A block of texts is split
and its distinct words found by Arrow; only words that the worker has not met lately go through
the tokenizer, many in one call, which tells them apart by the tokens that begin with a space.
Texts with any other mix of spaces, or with a special token, are encoded as they are.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept a worker; beyond it, the table starts afresh. It bounds memory, never a result.
KEPT_WORDS = 800_000
BLOCK_BYTES = 8 << 20
#: Any white space but single inner spaces and line feeds, or the start of a special token.
_ODD = r"[ \n][ \n]|^[ \n]|[ \n]$|[\x09\x0b-\x0d\x1c-\x1f]|[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"
#: The pre-tokens of byte-level BPE files of this kind. Fixed value.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _spelled(token: str) -> bytes:
    return bytes(_SPELLING[c] for c in token)


_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How such files spell bytes: printable ones as themselves, the others as code points from 256 on, in order.
_SPELLING = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def blocks(batch: pa.RecordBatch, column: int, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes in a text column, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


class Encoder:
    _all: ClassVar[dict] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocabulary = {_spelled(token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in special}
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(b" ")]] = True
        import tiktoken

        #: The same vocabulary; an id is also its merge's rank, so both libraries merge alike. This one is faster on new words.
        self.ranks = tiktoken.Encoding("words", pat_str=_PRE_TOKENS, mergeable_ranks=vocabulary, special_tokens={})

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """One encoder a worker process and file."""
        if path not in cls._all:
            cls._all[path] = cls(path)
        return cls._all[path]

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, missing: list[str]) -> None:
        for at in range(0, len(missing), 5000):
            some = missing[at : at + 5000]
            ids = np.asarray(self.ranks.encode_ordinary(" " + " ".join(some)), dtype="<u4")
            edges = np.append(np.flatnonzero(self.opens[ids]), len(ids))
            body, edges = ids.tobytes(), (4 * edges).tolist()
            self.kept.update(zip(some, (body[a:b] for a, b in zip(edges, edges[1:], strict=False)), strict=True))

    def _words(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each after a space, and how many each has."""
        coded = flat.dictionary_encode()
        names = coded.dictionary.to_pylist()
        kept = self.kept
        if missing := [w for w in names if w not in kept]:
            if len(kept) + len(missing) > KEPT_WORDS:
                kept.clear()
                missing = names
            self._learn(missing)
        ids = [kept[w] for w in names]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = size[which]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return table[np.arange(total) + np.repeat(begin[which] - (ends - n), n)], n

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; none of a null one."""
        texts = pc.fill_null(texts, "")
        out: list = [None] * len(texts)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
        for i in np.flatnonzero(odd):
            out[i] = self.encode(texts[int(i)].as_py())
        plain = np.flatnonzero(~odd)
        if len(plain):
            split = pc.split_pattern(texts.take(pa.array(plain)), " ")
            offsets = split.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            flat = split.flatten()
            heads = flat.take(pa.array(offsets[:-1])).to_pylist()
            rest = np.ones(len(flat), dtype=bool)
            rest[offsets[:-1]] = False
            ids, n = self._words(flat.filter(pa.array(rest)))
            words = offsets - np.arange(len(offsets))  # as each text's first word is not among them
            edges = np.concatenate(([0], np.cumsum(n)))[words]
            for k, (i, head) in enumerate(zip(plain, heads, strict=True)):
                out[i] = np.concatenate((self.encode(head), ids[edges[k] : edges[k + 1]]))
        return out
