"""Byte-level BPE by prefix dynamic programming: each byte prefix has one valid last token."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import by_few, table, tidy

#: Pieces whose ids a task remembers in each of two generations, the longest of them in bytes, and answers of adjoin() it remembers.
REMEMBERED, REMEMBERED_BYTES, REMEMBERED_PAIRS = 200_000, 64, 200_000
#: Pieces that are kept from task to task.
KEPT = 60_000
#: Prefixes whose last tokens are remembered.
REMEMBERED_PREFIXES = 200_000
#: Bytes of ids that are sent on together.
OUTPUT_BYTES = 1 << 22
#: Bytes of a piece up to which its table is filled from the end, only where it is needed; a longer one's is filled from the start.
MOST_NESTED = 300
#: What a match of the pattern may look at behind its own end, in characters ('ll is given up two characters after its start).
LOOKAHEAD = 3


class Vocabulary:
    """Ranks of byte strings, with what decides whether two tokens may stand side by side.

    tails: the usable tokens, and as -1 all else that one of them ends in.
    halves: the two tokens that the merges of a token's bytes join last (a single byte is its own halves). A token that the
    merges of its own bytes don't reach has none, and only stands for a piece that is that token as a whole.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.usable: dict[bytes, int] = {}
        self.tails: dict[bytes, int] = {}
        self.pairs: dict[int, bool] = {}
        self.prefixes: dict[bytes, int] = {}
        self.span = max(ranks.values(), default=0) + 1
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no rank for the bytes {missing[:5]}")
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank], self.usable[token] = (rank, rank), rank
                continue
            last: list[int] = []
            self.extend(token, last, 0)
            found = self.walk(last, len(token))
            if len(found) == 2:
                self.halves[rank], self.usable[token] = (found[0], found[1]), rank
            self.pairs.clear()  # a pair of before may have a token now
        self.sizes = {r: len(b) for r, b in self.bytes.items()}
        self.tails = {token[i:]: -1 for token in self.usable for i in range(1, len(token))} | self.usable

    def adjoin(self, left: int, right: int) -> bool:
        """Whether left and right stay two tokens where they meet, by undoing their merges from the last to the first.

        With every undone merge, the two tokens at the seam are those that stood there before it; had they a merge of lower rank than
        the one undone, that would have come first, across the seam.
        """
        halves, names, usable = self.halves, self.bytes, self.usable
        limit = 1 << 60
        while True:
            if usable.get(names[left] + names[right], limit) < limit:
                return False
            if left > right and (h := halves[left]) != (left, left):
                limit, left = left, h[1]
            elif (h := halves[right]) != (right, right):
                # Of merges equal in rank the left one comes first, so one of right's own rank across the seam is before it.
                limit, right = right + 1, h[0]
            elif (h := halves[left]) != (left, left):
                limit, left = left, h[1]
            else:
                return True

    def extend(self, piece: bytes, last: list[int], begin: int) -> None:
        """Writes last[i], for i from begin on: the last token of the first i + 1 bytes. The entries before begin must be there.

        A prefix ends in exactly one token t for which the rest's last token and t may stand side by side.
        """
        usable, pairs, span, longest = self.usable, self.pairs, self.span, self.longest
        for end in range(begin + 1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = usable.get(piece[start:end])
                if token is None:
                    continue
                if start:
                    pair = last[start - 1] * span + token
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= REMEMBERED_PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.adjoin(last[start - 1], token)
                    if not fits:
                        continue
                last.append(token)
                break

    def walk(self, last: list[int], upto: int) -> list[int]:
        """The tokens of the first upto bytes, from the last one back."""
        out = []
        while upto:
            token = last[upto - 1]
            out.append(token)
            upto -= len(self.bytes[token])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        if len(piece) > MOST_NESTED:
            last: list[int] = []
            self.extend(piece, last, 0)
            return self.walk(last, len(piece))
        known, sizes = self.prefixes, self.sizes
        if len(known) >= REMEMBERED_PREFIXES:
            known.clear()
        out, rest = [], piece
        while rest:
            token = known.get(rest)
            if token is None:
                token = self._last(rest)
            out.append(token)
            rest = rest[: -sizes[token]]
        out.reverse()
        return out

    def _last(self, prefix: bytes) -> int:
        """The last token of a prefix, by those of shorter ones: what extend() does, from the end. Prefixes are remembered from piece to piece."""
        tails, pairs, known = self.tails, self.pairs, self.prefixes
        ends, start = [], len(prefix) - 1
        while start >= 0 and (token := tails.get(prefix[start:])) is not None:
            if token >= 0:
                ends.append((start, token))
            start -= 1
        while ends:
            start, token = ends.pop()
            if start:
                rest = prefix[:start]
                before = known.get(rest)
                if before is None:
                    before = self._last(rest)
                pair = before * self.span + token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= REMEMBERED_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.adjoin(before, token)
                if not fits:
                    continue
            known[prefix] = token
            return token
        raise AssertionError("each byte is a token, so each prefix has a last one")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


class PrefixTable:
    """A byte string that can be appended to and edited, with its last tokens; it is encoded exactly at any time."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        begin = len(self.piece)
        self.piece += more
        self.vocabulary.extend(self.piece, self.last, begin)

    def prefix(self, upto: int) -> list[int]:
        """The ids of the first upto bytes."""
        return self.vocabulary.walk(self.last, upto)

    def ids(self) -> list[int]:
        return self.prefix(len(self.piece))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new in place of the bytes from start to end; returns how many entries were computed.

        An entry depends only on the bytes of its prefix's last tokens, through the entries of the longest token's length
        before it. Once so many entries in a row are as they were, all later ones are too.
        """
        v = self.vocabulary
        old, behind = self.last[end:], len(self.piece) - end
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = self.last[:start]
        v.extend(self.piece[: start + len(new)], self.last, start)
        computed, same = len(new), 0
        for k in range(behind):
            upto = start + len(new) + k + 1
            v.extend(self.piece[:upto], self.last, upto - 1)
            computed += 1
            same = same + 1 if self.last[-1] == old[k] and len(v.bytes[old[k]]) <= k + 1 else 0
            if same >= v.longest:
                self.last += old[k + 1 :]
                break
        return computed


class Encoder:
    """Encodes texts piece by piece, as a pattern splits them, and remembers frequent pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.known: dict[str, tuple[str, int, bytes, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes, bytes]] = {}

    def forget(self) -> None:
        """Lets go of most of what was remembered, as at the end of a task: of the pieces all but the first ones, which are the frequent ones."""
        self.known, self.older = dict(islice(self.known.items(), KEPT)), {}
        self.vocabulary.prefixes.clear()

    def piece(self, piece: str) -> tuple[str, int, bytes, bytes]:
        """The ids joined by commas, their number, the bytes they decode to, and the ids as 32-bit integers."""
        found = self.known.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                ids = self.vocabulary.encode(piece.encode())
                found = (",".join(map(str, ids)), len(ids), self.vocabulary.decode(ids), array("i", ids).tobytes())
            if len(found[2]) <= REMEMBERED_BYTES:
                if len(self.known) >= REMEMBERED:
                    self.known, self.older = {}, self.known
                self.known[piece] = found
        return found

    def pieces(self, text: str) -> list[tuple[str, int, bytes, bytes]]:
        parts = self.split(text)
        found = list(map(self.known.get, parts))
        if None in found:
            found = [f or self.piece(p) for f, p in zip(found, parts)]
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for found in self.pieces(text) for i in found[0].split(",")]

    def decode(self, ids: list[int]) -> bytes:
        return self.vocabulary.decode(ids)


class Draft:
    """A text under way: appends and edits encode anew only the pieces near them."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.pieces = encoder, []
        self.pieces = encoder.split(text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> list[int]:
        return [int(i) for p in self.pieces for i in self.encoder.piece(p)[0].split(",")]

    def append(self, more: str) -> None:
        at = sum(map(len, self.pieces))
        self.replace(at, at, more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Puts new in place of the characters from start to end; returns how many pieces were split anew.

        Pieces that end well before start stay: no match looks further than LOOKAHEAD behind its end, but for white space, which
        ends a piece at the text's end only. Splitting goes on till it meets an old piece's start behind the edit.
        """
        first, at = 0, 0
        while first < len(self.pieces) and at + len(self.pieces[first]) + LOOKAHEAD <= start:
            at += len(self.pieces[first])
            first += 1
        text = self.text
        shift = len(new) - (end - start)
        starts, where = {}, at
        for i in range(first, len(self.pieces)):
            if where >= end:
                starts[where + shift] = i
            where += len(self.pieces[i])
        whole = text[:start] + new + text[end:]
        fresh, rest = [], []
        pattern = self.encoder.pattern
        while at < len(whole):
            if at >= start + len(new) and at in starts:
                rest = self.pieces[starts[at] :]
                break
            match = pattern.match(whole, at)
            fresh.append(match[0])
            at = match.end()
        self.pieces = self.pieces[:first] + fresh + rest
        return len(fresh)


def load_ranks(path: str) -> dict[bytes, int]:
    """A file of base64 and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each process: the vocabulary file is installed with the library on every machine."""
    return Encoder(Vocabulary(load_ranks(path)), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs, and with ids the ids themselves.

    A null text is empty; an empty text has no ids, whose digests are those of nothing. Texts are taken whole; special tokens' strings are ordinary text.
    Rows keep their order and repeat as they do; an empty table gives an empty one; further columns are not looked at.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    names = [x.split()[0] for x in schema.split(", ")]

    shown, number, decoded, packed = map(itemgetter, range(4))

    def rows(batch: pa.RecordBatch, at: int, out: list[list]) -> pa.RecordBatch:
        columns = [batch.column(0).slice(at, len(out[0])), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
        if ids:
            flat = np.frombuffer(b"".join(out[3]), np.int32)
            columns.append(pa.ListArray.from_arrays(np.cumsum([0, *out[0]]).astype(np.int32), pa.array(flat)))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path, pattern)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            at = held = 0
            for value in batch.column(1):
                found = known.pieces(value.as_py() or "")
                out[0].append(sum(map(number, found)))
                out[1].append(hashlib.sha256(",".join(map(shown, found)).encode()).hexdigest())
                out[2].append(hashlib.sha256(b"".join(map(decoded, found))).hexdigest())
                if ids:
                    out[3].append(b"".join(map(packed, found)))
                    held += len(out[3][-1])
                if held >= OUTPUT_BYTES:
                    yield rows(batch, at, out)
                    at, held, out = at + len(out[0]), 0, [[], [], [], []]
            yield rows(batch, at, out)
        known.forget()
        tidy()

    return by_few(docs).selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def standard() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_documents() of all documents."""
    return encode_documents(table(spark, sf_dir, "documents"), *standard())
