"""Exact ids of the public word-BPE tokenizer at corpus speed.

Texts of ASCII and Latin-1 letters are cut into words on their bytes and each new word is encoded once, by the same merges; its ids are kept
in a table bounded by TABLE_BITS. Texts with anything else (other scripts, combining marks, control characters, special-token strings) go
through the tokenizers library itself.
"""

from __future__ import annotations

import json

import numpy as np

from tessella.llm import bytesops as B

END_ID = 1
TABLE_BITS = 21
_KEEP: dict[str, "WordBPE"] = {}

_CLASS = np.full(256, 4, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other, 4 not handled here
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[33:127] = 3
_CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[0xC3] = 1
_CLASS[0x80:0xC0] = 1  # after 0xC3 only; else the text is not handled here


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _unicode_bytes() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBPE:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        stand_in, ranks = _unicode_bytes(), {}
        for word, i in vocab.items():
            if word.startswith("<|") and word.endswith("|>"):
                continue
            whole = word.endswith("</w>") and len(word) > 4
            ranks[bytes(stand_in[c] for c in (word[:-4] if whole else word)) + b"\0" * whole] = i
        self.piece = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.library = Tokenizer.from_file(path)
        self._reset()

    def _reset(self) -> None:
        self.keys, self.vals = np.zeros(1 << TABLE_BITS, B.U), np.full(1 << TABLE_BITS, -1, np.int32)
        self.start, self.size, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint16)
        self.n = self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of each word, -1 for new ones; linear probing."""
        mask = B.U(len(self.keys) - 1)
        at = h & mask
        out = np.where(self.keys[at] == h, self.vals[at], -2)
        todo = np.flatnonzero(out == -2)
        while len(todo):
            v = self.vals[at[todo]]
            hit = (self.keys[at[todo]] == h[todo]) & (v >= 0)
            out[todo[hit]] = v[hit]
            out[todo[v < 0]] = -1
            todo = todo[~hit & (v >= 0)]
            at[todo] = (at[todo] + B.U(1)) & mask
        return out

    def _add(self, h: np.ndarray, words: list[bytes]) -> None:
        mask, keys, vals = len(self.keys) - 1, self.keys, self.vals
        for key, word in zip(h.tolist(), words):
            got = self.piece(word + b"\0")
            while self.n >= len(self.start):
                self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
            while self.used + len(got) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(got)] = got
            self.start[self.n], self.size[self.n] = self.used, len(got)
            at = key & mask
            while vals[at] >= 0:
                at = (at + 1) & mask
            keys[at], vals[at] = key, self.n
            self.n += 1
            self.used += len(got)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block, each with END_ID after it, and their offsets.

        A long document is encoded in pieces cut at white space, which no token crosses.
        """
        if len(off) == 2 and len(buf) > 2 * B.BLOCK:
            at = B.cuts(buf)
            parts = [self._encode(buf[i:j], np.array([0, j - i]))[0][:-1] for i, j in zip(at, at[1:])]
            ids = np.concatenate([*parts, np.array([END_ID], np.uint16)])
            return ids, np.array([0, len(ids)])
        return self._encode(buf, off)

    def _encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(off) - 1
        low = B.lowered(buf).copy()
        code = _CLASS[low]
        lead = low == 0xC3
        second = np.zeros(len(low), bool)
        second[1:] = lead[:-1]
        second[off[:-1][off[:-1] < len(low)]] = False
        low[second & (low >= 0x80) & (low <= 0x9E)] += 0x20
        bad = (code == 4) | ((low >= 0x80) & ~lead & ~second) | (second & ((low == 0x97) | (low == 0xB7)))
        special = low == ord("<")
        special[:-1] &= low[1:] == ord("|")
        bad |= special
        odd = np.zeros(len(low) + 1, np.int64)
        np.cumsum(bad, out=odd[1:])
        strange = odd[off[1:]] > odd[off[:-1]]
        word = code != 0
        st = word.copy()
        st[1:] &= (code[1:] != code[:-1]) | (code[1:] == 2)
        b = off[:-1][np.diff(off) > 0]
        st[b] = word[b]
        self._contractions(low, code, st, off)
        s = np.flatnonzero(st)
        stop = st.copy()
        stop |= ~word
        stop[b] = True
        stops = np.append(np.flatnonzero(stop), len(low))
        e = stops[np.searchsorted(stops, s, "right")]
        h = B.span_hash(B.prefix(low), s, e)
        if self.n > len(self.keys) // 2:
            self._reset()
        ix = self._find(h)
        new = np.flatnonzero(ix < 0)
        if len(new):
            new = new[~strange[np.searchsorted(off, s[new], "right") - 1]]
            fresh, one = np.unique(h[new], return_index=True)
            raw, one = low.tobytes(), new[one]
            for k in range(0, len(fresh), 1 << (TABLE_BITS - 2)):
                part = slice(k, k + (1 << (TABLE_BITS - 2)))
                if self.n + len(fresh[part]) > len(self.keys) * 3 // 4:
                    return self._slow(buf, off)
                self._add(fresh[part], [raw[i:j] for i, j in zip(s[one[part]].tolist(), e[one[part]].tolist())])
            ix = self._find(h)
        ok = ix >= 0
        count = np.where(ok, self.size[np.maximum(ix, 0)], 0).astype(np.int64) if self.n else np.zeros(len(ix), np.int64)
        acc = np.concatenate([[0], np.cumsum(count)])
        first = np.searchsorted(s, off)
        size = acc[first[1:]] - acc[first[:-1]]
        begin = np.where(ok, self.start[np.maximum(ix, 0)], 0)
        flat = self.ids[np.repeat(begin - acc[:-1], count) + np.arange(acc[-1])]
        apart = {}
        for d in np.flatnonzero(strange):
            apart[int(d)] = np.array(self.library.encode(buf[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint16)
            size[d] = len(apart[int(d)])
        bounds = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.empty(bounds[-1], np.uint16)
        out[bounds[1:] - 1] = END_ID
        if apart:
            for d in range(n):
                out[bounds[d] : bounds[d + 1] - 1] = apart[d] if d in apart else flat[acc[first[d]] : acc[first[d + 1]]]
        else:
            keep = np.ones(len(out), bool)
            keep[bounds[1:] - 1] = False
            out[keep] = flat
        return out, bounds

    @staticmethod
    def _contractions(low: np.ndarray, code: np.ndarray, st: np.ndarray, off: np.ndarray) -> None:
        """'s 't 're 've 'm 'll 'd are words of their own wherever an apostrophe begins one."""
        p = np.flatnonzero((low == 39) & st)
        if not len(p):
            return
        end = off[np.searchsorted(off, p, "right")]
        a = np.where(p + 1 < end, low[np.minimum(p + 1, len(low) - 1)], 0)
        b = np.where(p + 2 < end, low[np.minimum(p + 2, len(low) - 1)], 0)
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        st[p[two | three] + 1] = False
        for q, n, stop in ((p[two], 2, end[two]), (p[three], 3, end[three])):
            q, stop = q + n, stop
            q = q[q < stop]
            st[q[code[q] == 1]] = True

    def _slow(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One block with more new words than the table takes: by the library."""
        raw = buf.tobytes()
        got = [np.array([*self.library.encode(raw[i:j].decode("utf-8", "replace"), add_special_tokens=False).ids, END_ID], np.uint16) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
        return np.concatenate(got), np.concatenate([[0], np.cumsum([len(x) for x in got])])


def word_bpe(path: str) -> WordBPE:
    """The tokenizer of this Python worker."""
    if path not in _KEEP:
        _KEEP[path] = WordBPE(path)
    return _KEEP[path]
