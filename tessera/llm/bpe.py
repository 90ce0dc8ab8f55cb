"""Fast encoding of single words under a byte-level BPE file.

The file's merges are loaded into a rank-ordered merger.  Where the model
marks word ends, each byte is written as two (a plain or final mark, then the
byte), so that "last byte of a word" is a symbol of its own as in the file.
Words outside the plain cases (special strings, control separators, text that
is not in normal form) are left to the tokenizer of the file.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

PLAIN, FINAL = 0xFE, 0xFF  # bytes that UTF-8 never uses


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in keep}
    rest = [b for b in range(256) if b not in set(keep)]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


ENDS = [bytes([b - 32]) if 97 <= b <= 122 else b"" for b in range(256)]


def _merger(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Kept(dict):
    """Word -> value by ``make``, in two generations of at most ``most`` words each.

    When the young generation is full it becomes the old one, whose words come
    back on their next use: frequent words stay, and memory is bounded.
    """

    def __init__(self, make, most: int, base=()):
        super().__init__(base)
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
            if len(word) > 64:
                return got
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


class WordBpe:
    """``ids(word)``: the ids of a word that holds no white space inside."""

    def __init__(self, path: str, cache: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], _byte_chars()
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.specials = tuple(t["content"] for t in spec["added_tokens"])
        self.suffix = bool(suffix)
        ranks, ids = {}, []

        def put(key: bytes, i: int):
            if key not in ranks:
                ranks[key] = len(ids)
                ids.append(i)

        def symbols(token: str) -> bytes:
            if not suffix:
                return bytes(chars[c] for c in token)
            final = token.endswith(suffix)
            body = [chars[c] for c in (token[: -len(suffix)] if final else token)]
            marks = [PLAIN] * (len(body) - final) + [FINAL] * final
            return bytes(x for pair in zip(marks, body) for x in pair)

        for b in range(256):
            put(bytes([b]), 0)
        if suffix:
            for c in chars:
                for token in (c, c + suffix):
                    put(symbols(token), vocab[token])
        else:
            ids[:256] = [vocab[c] for c, b in sorted(chars.items(), key=lambda x: x[1])]
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            put(symbols(a + b), vocab[a + b])
        self.id_of = np.array(ids, "<u4")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+" if suffix else (
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.raw = [x.tobytes() for x in self.id_of]
        self.marks = {c: self.slow(c).tobytes() for c in ".,;:!?"}
        self.split = regex.compile(pattern).findall
        self.merge = _merger(ranks)
        if suffix:  # most words end in a to z: their final byte can stand as a capital, which lower case never uses
            near: dict[bytes, int] = {bytes([b]): 0 for b in range(256)}
            for key, r in sorted(ranks.items(), key=lambda x: x[1]):
                if len(key) > 1:
                    marks, body = key[::2], key[1::2]
                    if any(65 <= b <= 90 for b in body) or FINAL in marks and not 97 <= body[-1] <= 122:
                        continue
                    near[body[:-1] + bytes([body[-1] - 32]) if FINAL in marks else body] = r
            order = {k: n for n, (k, _) in enumerate(sorted(near.items(), key=lambda x: (len(x[0]) > 1, x[1])))}
            self.near = _merger(order)
            back = np.zeros(len(order), np.int64)
            for k, n in order.items():
                back[n] = near[k]
            for b in range(256):  # single bytes: plain, or final where they stand as capitals
                key = bytes([FINAL, b + 32]) if 65 <= b <= 90 else bytes([PLAIN, b])
                back[order[bytes([b])]] = ranks[key]
            self.near_rank = back.tolist()
            raw = [self.id_of[r].tobytes() for r in self.near_rank]
            self.near_ids = raw.__getitem__
        self.cores = Kept(self._core, cache)

    def slow(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def ranks(self, word: str) -> list[int]:
        """Merger ranks of a word; only their number and ``id_of`` mean anything."""
        if not self.suffix:
            if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
                return self.merge(word.encode())
            return [r for p in self.split(word) for r in self.merge(p.encode())]
        word = word.lower()
        pieces = [word] if word.isalpha() else self.split(word)
        out = []
        for p in pieces:
            raw = p.encode()
            if 97 <= raw[-1] <= 122:
                out += map(self.near_rank.__getitem__, self.near(raw[:-1] + ENDS[raw[-1]]))
                continue
            two = bytearray(2 * len(raw))
            two[::2] = bytes([PLAIN]) * len(raw)
            two[1::2] = raw
            two[-2] = FINAL
            out += self.merge(bytes(two))
        return out

    def plain(self, word: str) -> bool:
        return word.isascii() or ("Σ" not in word and "İ" not in word and unicodedata.is_normalized("NFC", word))

    def _core(self, core: str) -> bytes:
        """Ids of a lower-case word of letters, in the model that marks word ends."""
        raw = core.encode()
        if 97 <= raw[-1] <= 122:
            return b"".join(map(self.near_ids, self.near(raw[:-1] + ENDS[raw[-1]])))
        return b"".join(map(self.raw.__getitem__, self.ranks(core)))

    def ids(self, word: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.suffix and (word.isascii() or self.plain(word)):
            if word.isalpha():
                return self.cores[word.lower()]
            last = word[-1]
            if last in ".,;:!?" and word[:-1].isalpha():
                return self.cores[word[:-1].lower()] + self.marks[last]
        return b"".join(map(self.raw.__getitem__, self.ranks(word))) if self.plain(word) else self.slow(word).tobytes()

    def count(self, word: str) -> int:
        return len(self.ranks(word)) if self.plain(word) else len(self.slow(word))
