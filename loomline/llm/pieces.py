"""Tokenizing by pieces that no token crosses, so that each distinct piece is encoded once a batch.

SentencePiece (a BPE model whose pieces hold the space mark at their start only): a text
splits before every space that follows another character. Byte-level BPE: a text splits before
a single space between two characters that aren't white space, and between an ASCII letter or
digit and an ASCII mark but the apostrophe, where its pattern ends a word in any case. ``check_sentencepiece`` and ``check_byte_level`` refuse models for which this
does not hold. Texts with Unicode white space or special strings go to the library whole.

Distinct byte-level pieces are encoded as one text, since their joints are such positions
again; the tokens' lengths in bytes then tell the pieces apart.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from loomline.llm.common import buffers

#: White space beyond ASCII as UTF-8: U+0085, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_CACHE: dict[str, tuple] = {}
#: Distinct pieces a Python worker remembers, by model, and numbers kept for them; beyond either it starts anew.
REMEMBERED, REMEMBERED_IDS = 500_000, 16 << 20
#: Pairs of tokens that a Python worker remembers.
PAIRS = 1_000_000
#: A character of private use; between pieces of a model that hasn't it, it keeps them apart.
SEAL = "\ue000"
#: Bytes of joined pieces that the library gets at once.
JOINED = 1 << 20


def check_sentencepiece(model) -> None:
    mark = "▁"
    for i in range(model.get_piece_size()):
        if mark in model.id_to_piece(i).lstrip(mark):
            raise ValueError(f"piece {i} holds a space inside")
    if model.encode("a  b ", out_type=str) != [p for x in ("a", " b", "") for p in (model.encode(x, out_type=str) or [mark])]:
        raise ValueError("the model normalises white space")


def check_byte_level(spec: dict) -> None:
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or (spec.get("model") or {}).get("type") != "BPE":
        raise ValueError("not a byte-level BPE without prefix space")


class Known:
    """Ids (or other numbers) of the pieces seen so far. encode: (bytes of distinct pieces end to end, their offsets) -> (bounds, ids)."""

    def __init__(self, encode: Callable):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """The number of each of these distinct pieces; bounds and ids hold its ids."""
        if len(self.number) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self.clear()
        words = pieces.to_pylist()
        found = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            raw, offsets = buffers(pieces.take(pa.array(new)))
            bounds, ids = self.encode(raw.tobytes(), offsets)
            found[new] = np.arange(len(self.number), len(self.number) + len(new))
            self.number.update(zip((words[k] for k in new.tolist()), found[new].tolist(), strict=True))
            self.bounds = np.concatenate((self.bounds, bounds[1:] + self.bounds[-1]))
            self.ids = np.concatenate((self.ids, ids))
        return found


class Node:
    """A suffix of the text so far that some token begins with: the tokens that end here, longest first, and what follows."""

    __slots__ = ("text", "ends", "next")

    def __init__(self, text: str, ends: list[tuple[int, str, dict[str, bool]]]):
        self.text, self.ends, self.next = text, ends, {}


class PrefixCounts:
    """Tokens of every prefix of a piece, by dynamic programming over its characters.

    A sequence of BPE tokens is the encoding of its text just if each two neighbours are the
    encoding of theirs. So the last token of a prefix is the one token ending there that fits the
    last token of what is before it; the count is one more than there. An automaton of the tokens,
    made as far as texts need it, gives those that end at a character. A character that the model
    lacks becomes its bytes and joins with nothing.
    """

    def __init__(self, model):
        check_sentencepiece(model)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        words = [model.id_to_piece(i) for i in plain]
        if SEAL in words or not any(model.is_byte(i) for i in range(model.get_piece_size())):
            raise ValueError("not a model that falls back to bytes")
        self.model, self.pairs = model, 0
        self.skip = len(model.encode(SEAL))
        #: tokens that encode to themselves, each with the tokens asked for before it: whether both stay as they are
        self.tokens = {w: {} for w, i, ids in zip(words, plain, model.encode([SEAL + w for w in words]), strict=True) if ids[self.skip :] == [i]}
        if any(c not in self.tokens for w in self.tokens for c in w):
            raise ValueError("a token has a character that is no token")
        self.heads = {w[:n] for w in self.tokens for n in range(len(w) + 1)}
        self.nodes = {"": Node("", [])}

    def step(self, node: Node, char: str) -> Node:
        text = node.text + char
        while text not in self.heads:
            text = text[1:]
        if text not in self.nodes:
            ends = [(n, text[-n:], self.tokens[text[-n:]]) for n in range(len(text), 0, -1) if text[-n:] in self.tokens]
            self.nodes[text] = Node(text, ends)
        # other characters than the tokens' are too many to remember
        if text:
            node.next[char] = self.nodes[text]
        return self.nodes[text]

    def fits(self, a: str, b: str, known: dict[str, bool]) -> bool:
        if self.pairs >= PAIRS:
            self.pairs = 0
            for x in self.tokens.values():
                x.clear()
        self.pairs += 1
        known[a] = self.model.encode(SEAL + a + b, out_type=str)[self.skip :] == [a, b]
        return known[a]

    def count(self, piece: str) -> list[int]:
        """Tokens of the first 0, 1, 2 ... characters of the piece, with the space mark that the model puts before it."""
        counts, last, node = [0], [""], self.nodes[""]
        for k, char in enumerate("▁" + piece.replace(" ", "▁"), 1):
            node = node.next.get(char) or self.step(node, char)
            for n, token, known in node.ends:
                before = last[k - n]
                if not before or (known[before] if before in known else self.fits(before, token, known)):
                    counts.append(counts[k - n] + 1)
                    last.append(token)
                    break
            else:
                if node.text:
                    raise ValueError(f"no token ends a prefix of {piece!r}")
                counts.append(counts[-1] + len(char.encode()))
                last.append("")
        return counts[1:]


def sentencepiece_prefixes(path: str) -> Known:
    """Known pieces by their bytes: the tokens of the prefix that ends with each byte, -1 inside a character."""
    key = path + " prefixes"
    if key not in _CACHE:
        import sentencepiece

        table = PrefixCounts(sentencepiece.SentencePieceProcessor(model_file=path))

        def encode(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            out: list[int] = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                piece = raw[a:b].decode()
                counts = table.count(piece)[1:]
                if len(piece) == b - a:
                    out += counts
                else:
                    for c, n in zip(piece, counts, strict=True):
                        out += [-1] * (len(c.encode()) - 1)
                        out.append(n)
            return offsets - offsets[0], np.array(out, np.int32)

        _CACHE[key] = (Known(encode),)
    return _CACHE[key][0]


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    return bounds, np.fromiter((x for ids in lists for x in ids), np.int32, int(bounds[-1]))


def byte_level_encoder(path: str) -> tuple[Known, tuple[bytes, ...]]:
    """(known pieces, special strings)."""
    if path not in _CACHE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        spec = json.loads(model.to_str())
        check_byte_level(spec)
        special = tuple(x["content"].encode() for x in spec.get("added_tokens", []))
        # a byte-level token has one character for each byte
        length = np.zeros(model.get_vocab_size(), np.int64)
        for token, i in model.get_vocab().items():
            length[i] = len(token)

        def encode(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            data = np.frombuffer(raw, np.uint8)
            white = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
            start, end = offsets[:-1], offsets[1:]
            plain = end - start >= 2
            plain[plain] &= (data[start[plain]] == 32) & ~white[start[plain] + 1] & ~white[end[plain] - 1]
            if WIDE_SPACE.search(raw) or any(x in raw for x in special):
                for k in np.flatnonzero(plain):
                    piece = raw[start[k] : end[k]]
                    plain[k] = not WIDE_SPACE.search(piece) and not any(x in piece for x in special)
            alone = np.flatnonzero(~plain)
            some = model.encode_batch([raw[start[k] : end[k]].decode() for k in alone.tolist()], add_special_tokens=False)
            counts = np.zeros(len(plain), np.int64)
            counts[alone] = [len(x.ids) for x in some]
            which = np.flatnonzero(plain)
            parts, done = [], 0
            sizes = np.cumsum((end - start)[which])
            while done < len(which):
                upto = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + JOINED)))
                k = which[done:upto]
                text = b"".join(raw[a:b] for a, b in zip(start[k].tolist(), end[k].tolist(), strict=True)).decode()
                ids = np.array(model.encode(text, add_special_tokens=False).ids, np.int32)
                stops = np.searchsorted(np.cumsum(length[ids]), np.cumsum(end[k] - start[k]), side="left") + 1
                counts[k] = np.diff(np.concatenate(([0], stops)))
                parts.append(ids)
                done = upto
            bounds = np.concatenate(([0], np.cumsum(counts)))
            out = np.empty(int(bounds[-1]), np.int32)
            joined = np.repeat(plain, counts)
            out[joined] = np.concatenate(parts) if parts else []
            out[~joined] = [i for x in some for i in x.ids]
            return bounds, out

        _CACHE[path] = Known(encode), special
    return _CACHE[path]


def sentencepiece_cuts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start, and which of them begin with a space that the model adds by itself."""
    start = np.zeros(len(data) + 1, bool)
    space = np.concatenate((data == 32, [False]))
    first = np.concatenate(([0], ends))
    start[1:-1] = space[1:-1] & ~space[:-2]
    if len(data) > 3:  # U+2581 is the mark that the model puts for a space
        start[3:-1] &= ~((data[2:-1] == 0x81) & (data[1:-2] == 0x96) & (data[:-3] == 0xE2))
    start[first] = False
    cut = start.copy()
    start[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(start[:-1])
    return at, cut[at]


def byte_level_cuts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.zeros(len(data) + 1, bool)
    white = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
    first = np.concatenate(([0], ends))
    if len(data) > 2:
        start[1:-2] = (data[1:-1] == 32) & ~white[:-2] & ~white[2:]
    lower = data | 32
    word = ((lower >= 97) & (lower <= 122)) | ((data >= 48) & (data <= 57))
    mark = (data > 32) & (data < 127) & ~word & (data != 39)
    start[1:-1] |= (word[:-1] & mark[1:]) | (mark[:-1] & word[1:])
    start[first] = False
    space = ends[np.diff(first) > 0] - 1
    start[space[data[space] == 32]] = False  # a document's last byte
    start[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(start[:-1])
    return at, np.zeros(len(at), bool)


def encode_pieces(data: np.ndarray, at: np.ndarray, drop: np.ndarray, known: Known) -> np.ndarray:
    """The known number of each piece. drop: leave out the piece's first byte."""
    if not len(at):
        return np.zeros(0, np.int64)
    keep = np.ones(len(data), bool)
    keep[at[drop]] = False
    offsets = (np.append(at, len(data)) - np.concatenate(([0], np.cumsum(drop)))).astype(np.int32)
    raw = np.ascontiguousarray(data[keep])
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    coded = pieces.dictionary_encode()
    return known.numbers(coded.dictionary)[coded.indices.to_numpy()]


def gather(numbers: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the pieces in their order, and how many each piece has."""
    begin = offsets[numbers]
    counts = offsets[numbers + 1] - begin
    where = np.arange(int(counts.sum())) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
    return ids[where], counts
