"""Encoding whole texts with the tokenizers library, once for each distinct word.

Pre-tokenizers of the byte-level and word-end families never join a non-space character with the
space after it, nor a letter with an ASCII mark after it, so a text may be cut there without changing its ids. Every
distinct word is encoded once by the library and kept in a table bounded in bytes; texts with unusual white space,
control characters or the string of a special token are handed over whole.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Bytes of words and their ids that a worker remembers.
TABLE_BYTES = 128 << 20
#: Characters of a text that are split into words at once.
SEGMENT = 1 << 20
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_CHUNK = re.compile(r" ?[^ \n]+|\n(?=[^ \n])|[ \n]+[^ \n]*")
_ODD = re.compile("[^\\S \\n]|[\\x00-\\x09\\x0b-\\x1f\\x7f-\\x9f᠎​﻿]")
_LETTERS = re.compile(rf"[{_LATIN}]+")
_STOP = re.compile(rf"(?<=[{_LATIN}])([,.;:!?])(?=[ \n]|\Z)")
_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: Before a word that no space precedes; texts that hold it themselves are never split.
_BARE = "\0"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: chr(b) for b in plain}
    for extra, b in enumerate(b for b in range(256) if b not in chars):
        chars[b] = chr(256 + extra)
    return [chars[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_of(path: str, pattern: str | None = None):
    """A tokenizers.Tokenizer of a .json file, as the library reads it, or of a .tiktoken file of ranks.

    Ranks merge any two neighbours whose joined bytes have a rank, lowest rank first; so each way to
    split a token in two known parts becomes a merge, in the order of the token's rank.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    if not path.endswith(".tiktoken"):
        return Tokenizer.from_file(path)
    ranks, chars = read_ranks(path), byte_chars()
    name = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [(name[token[:i]], name[token[i:]]) for token, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    made = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made


def segments(text: str) -> Iterator[str]:
    """A long text in parts of about SEGMENT characters, cut before spaces between words."""
    at = 0
    while len(text) - at > SEGMENT and (found := _CUT.search(text, at + SEGMENT)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Encoder:
    """encode(texts) gives all ids in one int32 array and the number of ids of each text.

    A key of the table is a word that follows a space, or after _BARE a string that stands for itself. Line ends, and single
    marks that end a word of letters, are keys of their own.

    mark: a string between words that always yields the one id after which the next word starts anew; most: bytes
    held. The table has two generations: when the younger one holds half of that, it becomes the older one and the
    oldest words are forgotten; words that are met again move up.
    """

    def __init__(self, tokenizer, mark: str = "\n", most: int = TABLE_BYTES):
        self.tokenizer, self.mark, self.most = tokenizer, mark, most
        self.special = [str(t) for t in tokenizer.get_added_tokens_decoder().values()]
        ids = self._ids(f"a{mark}a")
        self.joins, self.mark_id = len(ids) == 3, ids[1]
        self.lowers = self._ids("ÉA") == self._ids("éa")
        self.bare = self._ids(" hello") == self._ids("hello")
        self.model, self.table = tokenizer.model, dict(enumerate(byte_chars()))
        probe = [" hello", "hello", " Économie", "zqxvkjq", " Straße"]
        self.direct = self._letters(probe) == list(map(self._raw, probe))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _raw(self, text: str) -> bytes:
        return array("i", self._ids(text)).tobytes()

    def _letters(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of strings of letters, which no pattern splits, straight from the library's model."""
        joined = "\n".join(texts)
        if self.lowers:
            joined = joined.lower()
        if self.bare:
            joined = joined.replace(" ", "")
        found = self.model.tokenize
        return [array("i", [t.id for t in found(w)]).tobytes() for w in joined.encode().decode("latin-1").translate(self.table).split(self.table[10])]

    def _put(self, keys: Sequence[str], ids: Sequence[bytes]) -> None:
        self.young.update(zip(keys, ids, strict=True))
        self.held += 180 * len(keys) + sum(map(len, keys)) + sum(map(len, ids))

    def _learn(self, keys: set[str]) -> None:
        """Encode new keys: letters by the model alone, other words many in one call of the library, joined by the mark, where that cuts them apart."""
        letters = [k for k in keys if (w := k[1:] if k[:1] == _BARE else k).isalpha() and (w.isascii() or _LETTERS.fullmatch(w))] if self.direct else []
        if letters:
            self._put(letters, self._letters([k[1:] if k[:1] == _BARE else " " + k for k in letters]))
        rest = {k: k[1:] if k[:1] == _BARE else " " + k for k in keys.difference(letters)}
        plain = [k for k, t in rest.items() if self.joins and k.strip(_BARE) and t.isprintable() and " " not in t[1:] and not self._named(t)]
        for at in range(0, len(plain), 2000):
            own = plain[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(rest[k] for k in own)], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) == len(own) - 1:
                raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                self._put(own, [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends[:-1])], ends, strict=True)])
        alone = [k for k in rest if k not in self.young]
        self._put(alone, [self._raw(rest[k]) for k in alone])

    def _named(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def _keys(self, text: str) -> list[str]:
        if self._named(text):
            return [_BARE + text]
        line = text.replace("\n", " ")
        if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":
            own = _STOP.sub(f" {_BARE}\\1", text).replace("\n", f" {_BARE}\n {_BARE}").split(" ")
            own[0] = _BARE + own[0]
            return own
        if _ODD.search(text):
            return [_BARE + text]
        return [c[1:] if c[0] == " " and c[1:2] not in ("", " ", "\n") else _BARE + c for c in _CHUNK.findall(text)]

    def _encode(self, texts: Sequence[str]) -> list[bytes]:
        rows = [self._keys(t) for t in texts]
        new = set().union(*rows).difference(self.young)
        known = [k for k in new if k in self.old]
        self._put(known, [self.old[k] for k in known])
        self._learn(new.difference(known))
        out = [b"".join(map(self.young.__getitem__, own)) for own in rows]
        for key in new:
            if len(key) > 100:
                self.held -= 180 + len(key) + len(self.young.pop(key))
        if self.held > self.most // 2:
            self.old, self.young, self.held = self.young, {}, 0
        return out

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if all(len(t) <= SEGMENT for t in texts):
            out = self._encode(texts)
        else:
            out = [b"".join(self._encode([s])[0] for s in segments(t)) for t in texts]
        counts = np.fromiter(map(len, out), np.int64, len(out)) // 4
        return np.frombuffer(b"".join(out), np.int32), counts


_last: list[tuple[tuple, Encoder]] = []


def encoder(path: str, pattern: str | None = None, mark: str = "\n", most: int = TABLE_BYTES) -> Encoder:
    """The worker's own encoder of a vocabulary file. A worker keeps the one that it used last, also between tasks."""
    key = (path, pattern, mark, most)
    if not _last or _last[0][0] != key:
        _last.clear()
        _last.append((key, Encoder(tokenizer_of(path, pattern), mark, most)))
    return _last[0][1]
