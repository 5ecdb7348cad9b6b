"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can end its encoding. Storing that token for each prefix gives the
encoding by walking back, lets bytes be appended exactly, and after an edit only the part whose pre-tokens changed is
encoded again.

Null texts count as empty; an empty text has no ids and decodes to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushql.llm.common import small_batches, whole_text

WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Distinct pre-tokens whose ids a worker keeps; beyond it they are forgotten and found again.
CACHE = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _category(kind: str, top: int) -> str:
    out, start = [], None
    for i in range(top + 1):
        inside = i < top and unicodedata.category(chr(i))[0] == kind
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(2)
def splitter(wide: bool):
    """The public pre-token pattern with its classes spelled out, which the plain engine runs three times as fast.

    ``wide`` covers all of Unicode, else the basic plane, whose classes are looked up in one step.
    """
    top = sys.maxunicode + 1 if wide else 0x10000
    letter, number = _category("L", top), _category("N", top)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall


def pretokens(text: str) -> list[str]:
    return splitter(bool(text) and max(text) > "￿")(text)


class PrefixEncoder:
    """Encodes byte strings by the ranks of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        #: Ends of tokens: beyond the longest known end before a place, no token ends there.
        self.ends = {token[k:] for token in ranks for k in range(1, len(token))}
        self._fits: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """The encoding by definition: join the neighbours of the lowest rank until none joins."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, sys.maxsize), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == sys.maxsize:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay as they are when encoded together."""
        pair = (left, right)
        if (known := self._fits.get(pair)) is None:
            if len(self._fits) > CACHE:
                self._fits.clear()
            known = self._fits[pair] = self.merged(left + right) == [left, right]
        return known

    def extend(self, data: bytes, last: list[bytes]) -> list[bytes]:
        """Add to ``last``, which has the last token of each prefix, those of the longer prefixes of ``data``."""
        ranks, ends, fits = self.ranks, self.ends, self.fits
        for end in range(len(last) + 1, len(data) + 1):
            # One token alone fits, so the order of trying is free: from the shortest, as most last tokens are short.
            for start in range(end - 1, -1, -1):
                token = data[start:end]
                if token in ranks and (start == 0 or fits(last[start - 1], token)):
                    last.append(token)
                    break
                if token not in ends:
                    raise ValueError(f"the vocabulary lacks byte {data[end - 1]}")
        return last

    def walk_back(self, last: list[bytes]) -> list[int]:
        out, end = [], len(last)
        while end:
            token = last[end - 1]
            out.append(self.ranks[token])
            end -= len(token)
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self.walk_back(self.extend(piece, []))

    def encode_text(self, text: str) -> list[int]:
        return [i for piece in pretokens(text) for i in self.encode(piece.encode("utf-8", "replace"))]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class GrowingPiece:
    """One byte string that grows; each append costs only its own bytes."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.encoder.extend(self.data, self.last)

    def ids(self) -> list[int]:
        return self.encoder.walk_back(self.last)


class EditableText:
    """A text with its ids; an edit encodes again only pre-tokens near it."""

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text, self.pieces = encoder, text, pretokens(text)
        self.encoded = [encoder.encode(p.encode()) for p in self.pieces]

    def ids(self) -> list[int]:
        return [i for piece in self.encoded for i in piece]

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of the code points from start to end; returns how many pre-tokens were encoded again."""
        first = at = 0
        begins = []
        for piece in self.pieces:
            begins.append(at)
            at += len(piece)
        while first < len(begins) and begins[first] + len(self.pieces[first]) < start - 1:
            first += 1
        first = max(0, first - 2)
        while first and self.pieces[first].isspace():
            first -= 1
        from_ = begins[first] if begins else 0
        self.text = self.text[:start] + new + self.text[end:]
        moved = len(new) - (end - start)
        old = {b + moved: i for i, b in enumerate(begins) if b >= end}
        fresh, at, rest = [], from_, len(self.pieces)
        for match in _finditer(self.text, from_):
            if match.start() in old and match.start() >= start + len(new):
                rest = old[match.start()]
                break
            fresh.append(match.group())
        self.pieces[first:rest] = fresh
        self.encoded[first:rest] = [self.encoder.encode(p.encode()) for p in fresh]
        return len(fresh)


def _finditer(text: str, start: int):
    return splitter(bool(text) and max(text) > "￿").__self__.finditer(text, start)


class _Known(dict):
    """Ids of pre-tokens as little-endian bytes, found on first use."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        out = self[piece] = np.array(self.encoder.encode(piece.encode("utf-8", "replace")), dtype="<u4").tobytes()
        return out


@lru_cache(2)
def _known(path: str) -> _Known:
    return _Known(PrefixEncoder(read_ranks(path)))


def encoded(path: str, text: Column) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256, ids binary) of a text; ``path`` is the rank file on every machine.

    ids are little-endian unsigned 32-bit integers, one after the other.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        known = _known(path)
        piece, back = known.__getitem__, known.encoder.bytes_of.__getitem__
        rows = []
        for text in texts:
            ids = b"".join(map(piece, pretokens(text or "")))
            decoded = hashlib.sha256()
            for at in range(0, len(ids), 1 << 20):
                decoded.update(b"".join(map(back, np.frombuffer(ids[at : at + (1 << 20)], "<u4").tolist())))
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest(), ids))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return run(text)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every row's whole text."""
    small_batches(docs)
    return docs.select("doc_id", encoded(path or vocabulary(), whole_text()).alias("made")).select("doc_id", "made.*")
