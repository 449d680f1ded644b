"""Byte-level BPE as a bounded-lookahead streaming transducer.

Encoding.  After every input byte the transducer knows the last token of the
BPE encoding of the prefix read so far: the one vocabulary token ending there
that stays apart from the last token of the shorter prefix.  The encoding of
any prefix is a chain of such tokens, so a token may be emitted once the chains
of all prefixes that a later token can still start from run through it.  A
later token starts at most ``lookahead`` bytes back, and ``lookahead`` follows
from the merge list (the longest merged token); what lies before the common
point of those chains is final and leaves the window, so memory does not grow
with the text.

Decoding.  Token bytes go through an incremental UTF-8 machine that keeps an
unfinished character (at most 3 bytes) between blocks and writes U+FFFD for
each ill-formed part.

Vocabulary files stay where they are: their path is a parameter.

Nulls: a null text encodes as an empty array and decodes as ``''``; so does an
empty one.  Ids may be null or repeat; every input row gives one output row.
Extra columns are not carried.
"""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.llm.common import ship, slices

#: The split pattern of byte-level BPE vocabularies (a fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_CHARS = 1 << 16
#: Bytes that an encoder's memory of texts may hold.
CACHE_BYTES = 192 << 20
#: Token pairs whose staying apart is remembered (about 100 bytes each).
PAIRS = 200_000
#: Bytes read before the transducer looks for a common point to emit up to.
FLUSH = 512


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte: bytes without a printable Latin-1 form follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Transducer:
    """The state machine of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.id_of = {bytes(back[c] for c in token): i for token, i in vocab.items()}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in self.id_of.items():
            self.bytes_of[i] = token
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        as_bytes = [tuple(bytes(back[c] for c in half) for half in m) for m in merges]
        self.rank = {(self.id_of[a], self.id_of[b]): (r, self.id_of[a + b]) for r, (a, b) in enumerate(as_bytes)}
        #: No later token starts further back than the longest one that merging can give.
        self.lookahead = max((len(a) + len(b) for a, b in as_bytes), default=1)
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        #: Of each token that an encoding can hold: the rank of its last merge and that merge's halves; single bytes have rank -1.
        self.made: list[int] = [-1] * size
        self.halves: list[tuple[int, int]] = [(-1, -1)] * size
        for token, i in self.id_of.items():
            ids = [self.single[b] for b in token]
            before = self.merged(ids, stop=2)
            if before == [i]:
                whole = True
            elif whole := len(before) == 2 and before[0] >= 0 and self.rank.get(tuple(before), (0, -1))[1] == i:
                self.made[i], self.halves[i] = self.rank[before[0], before[1]][0], (before[0], before[1])
            if whole:  # else no encoding ever holds it
                self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.apart: dict[int, bool] = {}

    def merged(self, ids: list[int], stop: int = 1) -> list[int]:
        """The definition: merge the pair of least rank, leftmost first, until none or ``stop`` tokens are left."""
        ids = list(ids)
        while len(ids) > stop:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two tokens.

        The merges that made both are taken back, latest first (of equal ranks
        the right one, as merging goes from the left).  At each step the pair that
        then touches must not be one that would have been merged by then.
        """
        key = left * 1_000_003 + right
        if (known := self.apart.get(key)) is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            known = self.apart[key] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        rank, made, halves = self.rank, self.made, self.halves
        before = 1 << 60
        while True:
            touching = rank.get((left, right))
            if touching is not None and touching[0] < before:
                return False
            a, b = made[left], made[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, halves[left][1]
            else:
                before, right = b + 1, halves[right][0]

    def piece(self, data: bytes) -> Iterator[int]:
        """Token ids of one pre-split piece, each as soon as it is final."""
        reach, apart = self.lookahead, self.apart
        last, start = [-1], 0  # last[i]: last token of the encoding of data[start:start+i]; -1 at a final boundary
        before = -1  # the final token just before the window
        # the automaton reads the bytes once and names the tokens that end at each, longest first
        for at, (size, token) in self.automaton.iter(data.decode("latin-1")):
            here = at + 1 - start
            if len(last) > here or size > here:
                continue
            left = last[here - size] if here > size else before
            if left >= 0:
                known = apart.get(left * 1_000_003 + token)
                if not (self.stays_apart(left, token) if known is None else known):
                    continue
            last.append(token)
            if here >= FLUSH + reach:
                cut = self._common(last, reach)
                if cut:
                    done = self._chain(last, cut)
                    yield from done
                    before, start, last = done[-1], start + cut, [-1, *last[cut + 1 :]]
        yield from self._chain(last, len(last) - 1)

    def short(self, data: bytes) -> list[int]:
        """``piece`` for pieces shorter than the window, where nothing has to leave early."""
        apart, last = self.apart, [-1]
        sizes = [0]
        for at, (size, token) in self.automaton.iter(data.decode("latin-1")):
            if len(last) <= at + 1:
                left = last[at + 1 - size]
                if left >= 0:
                    known = apart.get(left * 1_000_003 + token)
                    if known is None:
                        known = self.stays_apart(left, token)
                    if not known:
                        continue
                last.append(token)
                sizes.append(size)
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= sizes[at]
        out.reverse()
        return out

    def _chain(self, last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def _common(self, last: list[int], reach: int) -> int:
        """The furthest boundary that the chains of the last ``reach`` prefixes share."""
        heads = set(range(len(last) - reach, len(last)))
        while len(heads) > 1:
            top = max(heads)
            heads.remove(top)
            heads.add(top - len(self.bytes_of[last[top]]))
        return heads.pop()


class Remembered(dict):
    """Text -> int32 bytes of its token ids, for the texts met of late.

    When half its bound in bytes is reached, what it holds becomes the older
    half, of which entries come back as they are met again.
    """

    #: What an entry holds besides its characters and ids.
    ENTRY_BYTES = 200

    def __init__(self, encode, bound: int):
        self.encode, self.half, self.held, self.older = encode, bound // 2, 0, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.encode(text)
        if len(text) <= 64:
            self.held += self.ENTRY_BYTES + 2 * len(text) + len(ids)
            if self.held > self.half:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[text] = ids
        return ids


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """Cut where a non-space is followed by white space: the split pattern always breaks there."""
    import regex

    gap, at = regex.compile(r"(?<=\S)\s"), 0
    while len(text) - at > size:
        found = gap.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Encoder:
    def __init__(self, path: str, remembered: int = CACHE_BYTES):
        import regex

        self.transducer = Transducer(path)
        self.split = regex.compile(SPLIT).findall
        # pieces, and whole stretches between single spaces that split into several
        self.known = Remembered(self._encoded, remembered)
        self.wide = regex.compile(r"\s\x20").search
        added = sorted(self.transducer.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def _encoded(self, text: str) -> bytes:
        pieces = self.split(text)
        if len(pieces) > 1:
            return b"".join(map(self.known.__getitem__, pieces))
        data = text.encode()
        return array("i", self.transducer.short(data) if len(data) <= FLUSH else self.transducer.piece(data)).tobytes()

    def _plain(self, text: str) -> bytes:
        out = []
        for block in blocks(text):
            if self.wide(block):
                out += map(self.known.__getitem__, self.split(block))
            else:  # each space follows a non-space, so the split pattern breaks before it
                first, *rest = block.split(" ")
                out += map(self.known.__getitem__, self.split(first))
                out += map(self.known.__getitem__, [" " + run for run in rest])
        return b"".join(out)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if self.special is None or not any(s in text for s in self.transducer.added):
            return np.frombuffer(self._plain(text), np.int32)
        parts = []
        for k, part in enumerate(self.special.split(text)):
            parts.append(np.array([self.transducer.added[part]], np.int32).tobytes() if k % 2 else self._plain(part))
        return np.frombuffer(b"".join(parts), np.int32)


@lru_cache(maxsize=1)
def encoder_of(path: str, remembered: int = CACHE_BYTES) -> Encoder:
    """One per Python worker: what it has learnt serves all its tasks."""
    return Encoder(path, remembered)


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every token id, all that decoding needs of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back, vocab = byte_alphabet(), spec["model"]["vocab"]
    out = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token)
    for t in spec["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


@lru_cache(maxsize=1)
def decoder_of(path: str) -> Decoder:
    return Decoder(token_bytes(path))


class Decoder:
    """Incremental byte-to-text machine over token ids."""

    BLOCK = 1 << 16

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of = bytes_of

    def text(self, ids: np.ndarray) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        get, out = self.bytes_of.__getitem__, []
        for at in range(0, len(ids), self.BLOCK):
            out.append(machine.decode(b"".join(map(get, ids[at : at + self.BLOCK].tolist()))))
        out.append(machine.decode(b"", True))
        return "".join(out)


#: Bytes of text whose results travel back together.
SLICE_BYTES = 1 << 20


def _coded(docs: DataFrame, path: str, id_col: str, text_col: str, ids_col: str, decoded_col: str | None, remembered: int = CACHE_BYTES) -> DataFrame:
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    ship(rows.sparkSession)
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        encoder = encoder_of(path, remembered)
        decoder = Decoder(encoder.transducer.bytes_of)
        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                arrays = [encoder.ids(t.as_py()) for t in some.column(1)]
                ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
                out = {id_col: some.column(0), ids_col: pa.ListArray.from_arrays(ends, pa.array(values))}
                if decoded_col:
                    out[decoded_col] = pa.array(map(decoder.text, arrays), pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    more = f", `{decoded_col}` string" if decoded_col else ""
    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>{more}")


def bpe_encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``id_col`` and ``ids_col`` array<int> for every row; no shuffle."""
    return _coded(docs, path, id_col, text_col, ids_col, None)


def bpe_round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "token_ids", decoded_col: str = "decoded", remembered: int = CACHE_BYTES) -> DataFrame:
    """``bpe_encode`` with the text that the ids decode to, in one pass and so with one vocabulary in a worker, which remembers pieces up to ``remembered`` bytes."""
    return _coded(docs, path, id_col, text_col, ids_col, decoded_col, remembered)


def bpe_decode(tokens: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with ``text_col`` added; no shuffle."""
    rows = tokens.select(id_col, ids_col)
    ship(rows.sparkSession)
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        decoder = decoder_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = [decoder.text(s.values.to_numpy(zero_copy_only=False)) if s.is_valid else "" for s in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string())], names=[id_col, ids_col, text_col])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>, `{text_col}` string")


def bpe_digests(docs: DataFrame, path: str, remembered: int = CACHE_BYTES) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every document, from the operator's own output."""
    return bpe_round_trip(docs, path, remembered=remembered).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
