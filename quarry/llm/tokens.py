"""Exact token ids, fast: a text is cut where no pre-token can span, and a chunk met before is not encoded again.

Byte-level vocabularies of this family start a pre-token at a space or line feed that stands right before a printing
character, so a text may be cut there; vocabularies that drop white space may be cut at any ASCII white space. Both part a letter from
a stop that ends a word; those that drop white space also part letters, single digits and other signs. A text that holds the string of a special token is encoded whole. What a chunk's ids are
depends on nothing but the chunk.

Chunks are told apart by 64-bit hashes; two different ones meet with a chance of 2**-64.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import BREAK, ragged, span_hashes, text_bytes

#: The memory of a worker: places for chunks (a power of two, two places for each hash) and ids of chunks. When the ids
#: are full it starts anew.
PLACES, POOL_IDS = 1 << 21, 1 << 23
#: A chunk of more ids is not remembered.
MOST_IDS = 1 << 14
#: Bytes of new chunks handed to the tokenizer as one text.
TEXT_BYTES = 4096

DIGIT = b"7"

_U = np.uint64
#: Bytes after a space or line feed that show the next character to be no white space.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[0x21:0x7F] = True
_PLAIN[0xC3:0xF5] = True
_PLAIN[0xE1:0xE4] = False  # some white space of Unicode starts with these
_LETTER, _STOP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP[list(b".,;:!?")] = True
#: Kinds of ASCII characters that pre-tokens part: letters 1, digits 2, others 3; 0 beside which no cut is made.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[_LETTER] = 1
_KIND[48:58] = 2
_KIND[ord("'")] = 0
_encoders: dict[tuple, Encoder] = {}


class Encoder:
    """ids(buf, edges): the ids of texts. special_as_text: the strings of special tokens are ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = special_as_text
        self.special = sorted(x.content.encode() for x in self.model.get_added_tokens_decoder().values())
        # Does the vocabulary keep spaces? Then " a" differs from "a".
        self.spaces = self._each([b"a"])[0].tolist() != self._each([b" a"])[0].tolist()
        self.folds = all(np.array_equal(*self._each([a, a.lower()])) for a in (b"A", b"Wq", b"INST"))
        samples = [b"ab-c1", b"12", b"x3f", b"a.b", b"(a)", b"9%"]
        cut = [[x[i : i + 1] for i in range(len(x))] for x in samples if x != b"ab-c1"] + [[b"ab", b"-", b"c", b"1"]]
        self.parts = not self.spaces and all(
            np.array_equal(whole, np.concatenate(self._each(pieces))) for whole, pieces in zip(self._each(samples[1:] + samples[:1]), cut))
        size = self.model.get_vocab_size()
        self.wide = size > 1 << 16
        # What tells new chunks apart that are encoded as one text: their bytes, or a digit's id between them (a chunk
        # with that digit is encoded alone).
        self.bytes_of = np.zeros(size, dtype=np.int64)
        if self.spaces:
            for token, i in self.model.get_vocab().items():
                self.bytes_of[i] = len(token)
        a, x, b, parted = (i.tolist() for i in self._each([b"a", DIGIT, b"b", b"a " + DIGIT + b" b"]))
        self.mark = x[0] if not self.spaces and len(x) == 1 and parted == a + x + b else None
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(PLACES, dtype=np.uint64)
        self.at = np.zeros(PLACES, dtype=np.uint32)
        self.size = np.full(PLACES, -1, dtype=np.int16)
        self.pool = np.zeros(1 << 16, dtype="<u4" if self.wide else "<u2")
        self.used = 0

    def _each(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.model.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4") for x in found]

    def _joined(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that may follow one another in a text, and the number of each one's."""
        lengths = ends - starts
        sizes = np.zeros(len(starts), dtype=np.int64)
        if self.spaces:
            cut = np.flatnonzero(np.diff(np.cumsum(lengths) // TEXT_BYTES, prepend=-1))
            raw = buf[ragged(starts, lengths)]
            bounds = np.append(np.concatenate(([0], np.cumsum(lengths)))[cut], len(raw)).tolist()
            ids = np.concatenate(self._each([raw[i:j].tobytes() for i, j in zip(bounds, bounds[1:])]))
            here = np.cumsum(self.bytes_of[ids])
            last = np.searchsorted(here, np.cumsum(lengths))
            if len(last) and not (here[last] == np.cumsum(lengths)).all():
                raise ValueError("a token spans two chunks")
            sizes[:] = np.diff(last, prepend=-1)
            return ids, sizes
        rows = np.array_split(np.arange(len(starts)), -(-len(starts) // 500))
        if self.mark is None:
            raw = buf.tobytes()
            rows = [[raw[i:j] for i, j in zip(starts[r].tolist(), ends[r].tolist())] for r in rows]
            found = self.model.encode_batch([[x.decode() for x in r] for r in rows], is_pretokenized=True, add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, dtype="<u4") for x in found])
            sizes[:] = np.concatenate([np.bincount(np.array(x.word_ids, dtype=np.int64), minlength=len(r)) for x, r in zip(found, rows)])
            return ids, sizes
        mark = np.frombuffer(b" " + DIGIT + b" ", dtype=np.uint8)
        both = np.concatenate((buf, mark))
        texts = []
        for r in rows:
            s = np.stack((starts[r], np.full(len(r), len(buf))), axis=1).reshape(-1)
            n = np.stack((lengths[r], np.full(len(r), len(mark))), axis=1).reshape(-1)
            texts.append(both[ragged(s, n)].tobytes())
        ids = np.concatenate(self._each(texts))
        at = np.flatnonzero(ids == self.mark)
        sizes[:] = np.diff(at, prepend=-1) - 1
        return np.delete(ids, at), sizes

    def _chunks(self, buf: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text of each chunk, and whether it may be encoded beside others only."""
        raw = buf.tobytes()
        odd = np.zeros(len(edges) - 1, dtype=bool)
        if not self.model.encode_special_tokens:
            for s in self.special:
                i = raw.find(s)
                while i >= 0:
                    odd[np.searchsorted(edges, i, side="right") - 1] = True
                    i = raw.find(s, i + 1)
        full = np.flatnonzero(np.diff(edges) > 0)
        stop = np.zeros(len(buf) + 1, dtype=bool)
        stop[1:-1] = _LETTER[buf[:-1]] & _STOP[buf[1:]]
        stop[:-2] &= (buf[1:] == 32) | (buf[1:] == 10)
        stop[edges[full]] = False
        stop = stop[:-1]
        if self.spaces:
            safe = np.zeros(len(buf), dtype=bool)
            safe[:-1] = ((buf[:-1] == 32) | (buf[:-1] == 10)) & _PLAIN[buf[1:]]
            safe[edges[full + 1] - 1] = False  # what comes next is another text
            safe[edges[full]] = True
            safe |= stop
            starts = np.flatnonzero(safe)
            ends = np.append(starts[1:], len(buf))
            owner = np.searchsorted(edges, starts, side="right") - 1
            alone = (starts == edges[owner]) | stop[starts]
        else:
            gap = BREAK[buf]
            first = np.concatenate(([True], gap[:-1]))
            last = np.concatenate((gap[1:], [True]))
            first[edges[full]] = True
            last[edges[full + 1] - 1] = True
            if self.parts:
                kind = _KIND[buf]
                stop[1:] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
                stop[edges[full]] = False
            first |= stop
            last[:-1] |= stop[1:]
            starts, ends = np.flatnonzero(~gap & first), np.flatnonzero(~gap & last) + 1
            owner = np.searchsorted(edges, starts, side="right") - 1
            alone = np.diff(np.concatenate(([0], np.cumsum(buf == DIGIT[0])))[np.stack((starts, ends))], axis=0)[0] > 0
        if odd.any():
            keep = ~odd[owner]
            whole = np.flatnonzero(odd)
            starts, ends = np.concatenate((starts[keep], edges[whole])), np.concatenate((ends[keep], edges[whole + 1]))
            owner, alone = np.concatenate((owner[keep], whole)), np.concatenate((alone[keep], np.ones(len(whole), dtype=bool)))
            order = np.argsort(starts, kind="stable")
            starts, ends, owner, alone = starts[order], ends[order], owner[order], alone[order]
        return starts, ends, owner, alone

    def _place(self, key: np.ndarray) -> np.ndarray:
        """Where each key is held, or -1."""
        a, b = (key & _U(PLACES - 1)).astype(np.int64), (key >> _U(40) & _U(PLACES - 1)).astype(np.int64)
        in_a = (self.keys[a] == key) & (self.size[a] >= 0)
        in_b = (self.keys[b] == key) & (self.size[b] >= 0)
        return np.where(in_a, a, np.where(in_b, b, -1))

    def _learn(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if (sizes > MOST_IDS).any():
            some = sizes <= MOST_IDS
            keys, ids, sizes = keys[some], ids[np.repeat(some, sizes)], sizes[some]
        if self.used + len(ids) > POOL_IDS:
            self.forget()
            if len(ids) > POOL_IDS:
                return
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        a, b = (keys & _U(PLACES - 1)).astype(np.int64), (keys >> _U(40) & _U(PLACES - 1)).astype(np.int64)
        place = np.where(self.size[a] < 0, a, b)
        self.keys[place], self.at[place], self.size[place] = keys, at, sizes
        # Of keys that took one place the last one's three values stay, since each array is written in the same order.

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is the empty text."""
        ids, edges = self.ids(*text_bytes(pa.array(texts, pa.string())))
        return [ids[i:j].tobytes() for i, j in zip(edges, edges[1:])]

    def ids(self, buf: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts buf[edges[i]:edges[i + 1]], end to end, and the edges of each text's ids."""
        if self.folds and len(buf):  # but for a letter that a combining mark may follow
            capital = (buf >= 65) & (buf <= 90)
            capital[:-1] &= buf[1:] < 128
            folded = buf + capital * np.uint8(32)
        else:
            folded = buf
        starts, ends, owner, alone = self._chunks(buf, edges)
        if not len(starts):
            return np.zeros(0, dtype="<u4"), np.zeros(len(edges), dtype=np.int64)
        key = span_hashes(folded, starts, ends)
        place = self._place(key)
        new = np.flatnonzero(place < 0)
        size = np.where(place < 0, 0, self.size[place]).astype(np.int64)
        at = self.at[place].astype(np.int64)
        fresh = np.zeros(0, dtype=self.pool.dtype)
        if len(new):
            keys, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            pick = new[first]
            one = alone[pick]
            sizes = np.zeros(len(pick), dtype=np.int64)
            parts = [np.zeros(0, dtype="<u4")]
            for which in (np.flatnonzero(~one), np.flatnonzero(one)):
                if not len(which):
                    continue
                s, e = starts[pick[which]], ends[pick[which]]
                if one[which[0]]:
                    each = self._each([buf[i:j].tobytes() for i, j in zip(s.tolist(), e.tolist())])
                    parts += each
                    sizes[which] = [len(x) for x in each]
                else:
                    ids, sizes[which] = self._joined(buf, s, e)
                    parts.append(ids)
            order = np.concatenate((np.flatnonzero(~one), np.flatnonzero(one)))
            fresh = np.concatenate(parts).astype(self.pool.dtype)
            base = np.zeros(len(pick), dtype=np.int64)
            base[order] = np.cumsum(sizes[order]) - sizes[order]
            # What is known is read before the memory may start anew.
            known = np.flatnonzero(place >= 0)
            pool = np.concatenate((fresh, self.pool[ragged(at[known], size[known])]))
            at[known] = len(fresh) + np.cumsum(size[known]) - size[known]
            size[new], at[new] = sizes[back], base[back]
            self._learn(keys[order], fresh, sizes[order])
        else:
            pool = self.pool
        out = pool[ragged(at, size)].astype("<u4")
        return out, np.concatenate(([0], np.cumsum(np.bincount(owner, weights=size, minlength=len(edges) - 1).astype(np.int64))))


def with_end(ids: np.ndarray, edges: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts with an end id after each, and their edges."""
    after = edges + np.arange(len(edges))
    out = np.full(after[-1], end_id, dtype="<u4")
    inner = np.ones(len(out), dtype=bool)
    inner[after[1:] - 1] = False
    out[inner] = ids
    return out, after


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker's own encoder for a vocabulary file. It lives on for the worker's next tasks, until ``release``; its
    memory has a bound."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]



def release() -> None:
    """Drops the worker's encoders: it may go on with other work that needs the memory."""
    _encoders.clear()
