"""Token counts of whole texts by a public tokenizer, in Arrow functions that return lengths only.

Texts are cut at boundaries that the tokenizer's own splitting never crosses: before a single space or line feed
between two characters that are surely not white space, between an ASCII letter and a punctuation mark, and between an
ideograph or kana and a CJK mark. That holds for byte-level files with their own pattern and no prefix space; any other file, and one with a special token that such a
cut would part, encodes every text whole. Batches are balanced by bytes, the pieces of a batch are made
distinct, and the library encodes each distinct piece once. A worker remembers short pieces, up to MEMO_BYTES; pieces over LONG
bytes (runs of a script without blanks) are encoded where they occur and not kept. A text's tokens are those of its pieces in order, so the
counts are those of the whole text, special strings included.

Defined results: null and empty texts have 0 bytes and 0 tokens, repeated rows and null ids come back as they are,
an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

BATCH_BYTES = 2 << 20
#: Memory of the pieces that a worker remembers before it forgets the rare ones, with ENTRY bytes for each besides its own and
#: its ids'; longer pieces than LONG are not remembered.
MEMO_BYTES, ENTRY, LONG = 96 << 20, 220, 64

_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # lead bytes of all white space outside ASCII
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?&%$#*\"()"]] = True  # none that a special token's string has inside


#: Marks of CJK text (、。！，：；？) as their last two bytes, by their first: none is a letter, a number or white space.
_CJK_MARKS = ((0xE3, 0x8081), (0xE3, 0x8082), (0xEF, 0xBC81), (0xEF, 0xBC8C), (0xEF, 0xBC9A), (0xEF, 0xBC9B), (0xEF, 0xBC9F))


#: What str.strip() takes for white space, of ASCII.
_WHITE = bytes([*range(0x09, 0x0E), *range(0x1C, 0x21)])


def _cjk_cuts(data: np.ndarray) -> np.ndarray:
    """Places of CJK marks that follow a letter: ideographs U+5000 to U+9FBF, kana U+3041 to U+307F and U+3080 to U+3096."""
    at = np.flatnonzero((data[3:-2] == 0xE3) | (data[3:-2] == 0xEF)) + 3
    if not len(at):
        return at
    rest = data[at + 1].astype(np.int64) << 8 | data[at + 2]
    mark = np.zeros(len(at), bool)
    for lead, value in _CJK_MARKS:
        mark |= (data[at] == lead) & (rest == value)
    at = at[mark]
    first, second, third = data[at - 3], data[at - 2], data[at - 1]
    tail = (second & 0xC0 == 0x80) & (third & 0xC0 == 0x80)
    letter = (first >= 0xE5) & (first <= 0xE8) | (first == 0xE9) & (second < 0xBF) | (first == 0xE3) & ((second == 0x81) & (third >= 0x81) | (second == 0x82) & (third >= 0x80) & (third <= 0x96))
    return at[tail & letter]


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of pieces: rows, single blanks (space, line feed) with no white space on either side, marks after letters."""
    if len(bounds) and len(data) >= 6:
        cjk = _cjk_cuts(data)
    else:
        cjk = np.zeros(0, np.int64)
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n >= 3:
        blank = (data[1:-1] == 0x20) | (data[1:-1] == 0x0A)
        last, lead2, lead3 = data[:-2], np.zeros(n - 2, bool), np.zeros(n - 2, bool)
        lead2[1:] = _ODD_LEAD[data[: n - 3]]
        lead3[2:] = _ODD_LEAD[data[: n - 4]] if n > 3 else False
        solid_before = _PLAIN[last] | ((last >= 0x80) & ~lead2 & ~lead3)
        after = data[2:]
        solid_after = _PLAIN[after] | ((after >= 0x80) & ~_ODD_LEAD[after])
        cut[1 : n - 1] = blank & solid_before & solid_after
    cut[1:n] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    cut[cjk] = True
    cut[bounds] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """Encodes rows of text through a tokenizers file; each distinct piece goes to the library once.

    Fresh pieces that start with a space are joined into longer texts first, as no token crosses their bounds; the
    bytes of each token tell where a piece's tokens end. A worker keeps its encoder between tasks; when the memory is used up, pieces that were
    met in one batch only are forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.safe = self._safe()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        special = set(self.library.get_added_tokens_decoder())
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # byte-level files write each byte as one character
            self.token_bytes[i] = len(token.encode()) if i in special else len(token)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.bytes = 0
        self.settled = pa.array([], pa.binary())
        self.met, self.begins, self.sizes, self.flat = (np.zeros(0, t) for t in (np.uint8, np.int64, np.int64, np.uint32))

    def _safe(self) -> bool:
        """Whether the file splits texts as piece_starts supposes."""
        file = json.loads(self.library.to_str())
        splitter = file.get("pre_tokenizer") or {}
        plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space", True) and not file.get("normalizer")
        special = [np.frombuffer(b"a" + t["content"].encode() + b"a", np.uint8) for t in file.get("added_tokens", [])]
        return bool(plain) and all(len(piece_starts(x, np.array([0, len(x)]))) == 1 for x in special)

    def _cost(self, pieces: list[bytes], tokens: int) -> int:
        return sum(map(len, pieces)) + ENTRY * len(pieces) + 4 * tokens

    def _forget(self) -> None:
        """Keep pieces that were met in more than one batch, unless they take over half the memory themselves."""
        kept = np.flatnonzero(self.met > 1)
        pieces = list(self.place)
        pieces = [pieces[i] for i in kept]
        sizes = self.sizes[kept]
        if self._cost(pieces, int(sizes.sum())) > MEMO_BYTES // 2:
            self._clear()
            return
        upto = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = self.flat[np.repeat(self.begins[kept] - upto[:-1], sizes) + np.arange(upto[-1])]
        self.place = {p: i for i, p in enumerate(pieces)}
        self.settled = pa.array(pieces, pa.binary())
        self.bytes = self._cost(pieces, len(self.flat))
        self.met, self.begins, self.sizes = np.ones(len(kept), np.uint8), upto[:-1], sizes

    def _drop_from(self, n: int) -> None:
        """Forget the pieces learned from number n on, which are the last ones."""
        for _ in range(len(self.place) - n):
            self.place.popitem()
        tokens = int(self.begins[n]) if n < len(self.begins) else len(self.flat)
        self.met, self.begins, self.sizes, self.flat = self.met[:n].copy(), self.begins[:n].copy(), self.sizes[:n].copy(), self.flat[:tokens].copy()

    def _learn(self, fresh: list[bytes]) -> None:
        joined = [p for p in fresh if p[0] == 0x20 and (p[1:] == p.strip(_WHITE) != b"" if p.isascii() else p[1:].decode() == p.decode().strip() != "")] if self.safe else []
        alone = list(set(fresh).difference(joined))
        fresh = joined + alone
        texts = [b"".join(joined[lo : lo + 64]).decode() for lo in range(0, len(joined), 64)] + [p.decode() for p in alone]
        got = self.library.encode_batch_fast(texts, add_special_tokens=False)
        flat = np.concatenate([np.asarray(e.ids, np.uint32) for e in got])
        if self.safe:
            upto = np.searchsorted(np.cumsum(self.token_bytes[flat]), np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)))) + 1
        else:
            upto = np.cumsum([len(e.ids) for e in got])
        sizes = np.diff(np.concatenate([[0], upto]))
        self.begins = np.concatenate([self.begins, len(self.flat) + upto - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])
        self.met = np.concatenate([self.met, np.zeros(len(fresh), np.uint8)])
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
        self.bytes += self._cost(fresh, len(flat))

    def rows(self, data: np.ndarray, bounds: np.ndarray, keep_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens of each row, and all ids in order if they are asked for."""
        starts = piece_starts(data, bounds) if self.safe else np.unique(bounds[:-1][np.diff(bounds) > 0])
        if not len(starts):
            return np.zeros(len(bounds) - 1, np.int64), np.zeros(0, np.uint32) if keep_ids else None
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        index, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        if self.bytes > MEMO_BYTES:
            self._forget()
        place = self.place
        # Pieces of long standing are found among all at once, the others one by one.
        at = pc.index_in(distinct, self.settled).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        rest = np.flatnonzero(at < 0)
        asked = distinct.take(pa.array(rest)).to_pylist()
        at[rest] = np.fromiter(map(place.get, asked, repeat(-1)), np.int64, len(asked))
        missing = np.flatnonzero(at[rest] < 0)
        new, unknown = rest[missing], [asked[i] for i in missing.tolist()]
        if fresh := [p for p in unknown if len(p) <= LONG]:
            self._learn(fresh)
        known, held = len(place), self.bytes
        if long := [p for p in unknown if len(p) > LONG]:
            self._learn(long)
        at[new] = np.fromiter(map(place.__getitem__, unknown), np.int64, len(unknown))
        self.met[at] = np.minimum(self.met[at] + 1, 2)
        at = at[index]
        sizes = self.sizes[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(upto[np.searchsorted(starts, bounds)])
        ids = self.flat[np.repeat(self.begins[at] - upto[:-1], sizes) + np.arange(upto[-1])] if keep_ids else None
        if long:
            self._drop_from(known)
            self.bytes = held
        if len(place) > 1.5 * len(self.settled) + 10_000:
            self.settled = pa.array(list(place), pa.binary())
        return counts, ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer_file)
        for batch in T.slices(batches, "text", BATCH_BYTES):
            data, bounds = T.raw(batch["text"])
            counts, _ = known.rows(data, bounds, keep_ids=False)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(bounds)), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
