"""Byte-pair encoding by a walk over a trie of words, and decoding.

The encoding of a word is the one sequence of tokens in which every two neighbours stay apart under the merge rules. So the
last token of every prefix is decided by the last tokens of shorter prefixes: it is the token that ends there and may follow
the last token of what is left of it. Distinct words of a slice of documents are put into a trie; a depth-first walk
carries the last token of every prefix down to its children, so prefixes that words share are encoded once, and each word's
tokens are read off backwards where the word ends.

The trie is kept as the sorted list of its words, which is its depth-first order: a word leaves the path of the word before
it where the two first differ, and the states of the path up to there are its own.

Words do not move between tasks: finding the tokens of a word costs less than sending it. Tasks remember the tokens of words
they have seen, up to about twice :data:`REMEMBERED` words. Words beyond :data:`LONG_WORD` bytes take the same steps along paths of
their own, without being remembered.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import slices

LONG_WORD = 256
REMEMBERED = 1 << 18
REMEMBERED_PAIRS = 1 << 20
#: Code points cut into words at once; cuts are made where a space follows another character, which no word spans.
CHUNK = 1 << 19

# Fixed value: the pattern that byte-level vocabularies of this kind cut texts with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, Vocabulary] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if it shows, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Cutter:
    """Cuts texts into words by :data:`PATTERN`, with letters and digits as the tokenizer library knows them.

    Its tables of Unicode may be older than those of the pattern module. It is asked for all code points that the tables of
    Python don't have either; a text with one that it does not know as the pattern module does is cut by the library.
    """

    def __init__(self) -> None:
        import regex
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        new = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
        foreign = set()
        for kind in (r"\p{L}", r"\p{N}"):
            here = "".join(regex.findall(f"{kind}+", new))
            foreign.update(ord(c) for x, _ in Split(Regex(kind), "removed").pre_tokenize_str(here) for c in x)
        places = np.array(sorted(foreign), np.int64)
        spans = np.split(places, np.flatnonzero(np.diff(places) > 1) + 1) if places.size else []
        self.fast = regex.compile(PATTERN)
        self.foreign = re.compile("[" + "".join(f"{chr(x[0])}-{chr(x[-1])}" for x in spans) + "]") if spans else None
        self.slow = Split(Regex(PATTERN), "isolated")

    def words(self, text: str) -> list[str]:
        if self.foreign is not None and not text.isascii() and self.foreign.search(text):
            return [w for w, _ in self.slow.pre_tokenize_str(text)]
        return self.fast.findall(text)


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, cut = said["model"], said["pre_tokenizer"]
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or said["normalizer"]:
            raise ValueError("not a plain byte-level vocabulary")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("options of the vocabulary are not supported")
        special = said["added_tokens"]
        if any(t[k] for t in special for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("options of special tokens are not supported")
        letters = byte_letters()
        self.words = Cutter().words
        self.cut = regex.compile(r"\S(?=\s)")
        self.special = {t["content"]: t["id"] for t in special}
        by_length = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if special else None
        self.pieces = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        ids = {piece: i for i, piece in self.pieces.items()}
        self.pieces |= {t["id"]: t["content"].encode() for t in special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Halves of each merged token; the number of the merge that makes it, -1 for a byte; number of the merge of a pair.
        self.halves: dict[int, tuple[int, int]] = {}
        self.born = dict.fromkeys(self.pieces, -1)
        self.merge: dict[tuple[int, int], int] = {}
        for number, (x, y) in enumerate(pairs):
            x, y = model["vocab"][x], model["vocab"][y]
            made = ids[self.pieces[x] + self.pieces[y]]
            if made in self.halves or self.born[x] >= number or self.born[y] >= number:
                raise ValueError("merges are not in the order of their parts")
            self.halves[made], self.born[made], self.merge[x, y] = (x, y), number, number
        # A token counts if its own text is encoded as this token.
        whole: dict[int, bool] = {}
        for t in sorted(ids.values(), key=self.born.__getitem__):
            halves = self.halves.get(t)
            whole[t] = len(self.pieces[t]) == 1 if halves is None else whole[halves[0]] and whole[halves[1]] and self._apart(*halves, self.born[t])
        self.ids = {p: t for p, t in ids.items() if whole[t]}
        if sum(len(p) == 1 for p in self.ids) != 256:
            raise ValueError("the vocabulary lacks bytes")
        #: Everything a token can end with, and the token that it is, if it is one.
        self.endings = {p[i:]: None for p in self.ids for i in range(len(p))} | self.ids
        self.longest = max(map(len, self.ids))
        self._pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _apart(self, x: int, y: int, until: int) -> bool:
        """Whether no merge with a number below ``until`` joins the end of token ``x`` with the start of ``y``.

        Runs the merges backwards: the tokens at the border are taken apart, the last one made first. A merge across the
        border happens if its turn comes before the border tokens become parts of larger ones; of equal merges the left
        one comes first.
        """
        x_until = y_until = until
        while True:
            number = self.merge.get((x, y))
            if number is not None and number < x_until and number <= y_until and number < until:
                return False
            if self.born[x] > self.born[y]:
                x_until, x = self.born[x], self.halves[x][1]
            elif y in self.halves:
                y_until, y = self.born[y], self.halves[y][0]
            else:
                return True

    def follows(self, x: int, y: int) -> bool:
        """Whether token ``y`` may stand behind token ``x``."""
        key = x << 32 | y
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= REMEMBERED_PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self._apart(x, y, 1 << 62)
        return found

    def extend(self, word: bytes, last: list[int] | array) -> None:
        """Append to ``last`` the last token of the encoding of each prefix of ``word``; ``last[i]`` is the one of ``i`` bytes."""
        ids, endings, pairs, missing, longest = self.ids.get, self.endings.get, self._pairs.get, -1, self.longest
        for end in range(len(last), len(word) + 1):
            token = ids(word[:end]) if end <= longest else None
            if token is None:
                found = []
                for start in range(end - 1, 0, -1):
                    token = endings(word[start:end], missing)
                    if token == missing:
                        break
                    if token is not None:
                        found.append((start, token))
                while found:
                    start, token = found.pop()
                    before = last[start]
                    apart = pairs(before << 32 | token)
                    if self.follows(before, token) if apart is None else apart:
                        break
            last.append(token)

    def read_off(self, last: list[int] | array, end: int) -> bytes:
        tokens = []
        while end:
            tokens.append(last[end])
            end -= len(self.pieces[last[end]])
        return struct.pack(f"<{len(tokens)}I", *reversed(tokens))

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words, 4 bytes each: a depth-first walk over their trie."""
        out, last, before = {}, [-1], b""
        for word in sorted(words):
            if len(word) > LONG_WORD:
                alone = array("i", [-1])
                self.extend(word, alone)
                out[word] = self.read_off(alone, len(word))
                continue
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            self.extend(word, last)
            out[word] = self.read_off(last, len(word))
            before = word
        return out

    def cut_words(self, text: str) -> Iterator[list[str]]:
        """Words of a text, a chunk at a time; a special token is a list of its own."""
        for i, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if i % 2:
                yield [part]
                continue
            at = 0
            while at < len(part):
                edge = self.cut.search(part, at + CHUNK) if len(part) - at > CHUNK else None
                to = edge.end() if edge else len(part)
                yield self.words(part[at:to])
                at = to

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, 4 bytes each."""
        cut = [list(self.cut_words(t or "")) for t in texts]
        words = set().union(*(part for text in cut for part in text))
        known, older = self.known, self.older
        if len(known) >= REMEMBERED:
            # Words of the last REMEMBERED new ones that come again are taken over, so common words stay.
            known, older = {}, known
            self.known, self.older = known, older
        new = words - known.keys()
        again = new & older.keys()
        known.update((w, older[w]) for w in again)
        new -= again
        special = new & self.special.keys()
        found = self.encode_words([w.encode() for w in new - special])
        known.update((w, found[w.encode()]) for w in new - special)
        known.update((w, struct.pack("<I", self.special[w])) for w in special)
        out = [b"".join([known[w] for part in text for w in part]) for text in cut]
        for w in new:
            if len(w) > LONG_WORD:
                del known[w]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit numbers) of every row.

    A null text is encoded as an empty one, which has no ids; very long texts are encoded whole. Strings of special tokens in
    a text become these tokens. Repeated rows, and rows with a null id, stay rows of their own; other columns are not read.
    An empty table gives no rows. ``path`` must lead to the vocabulary file on every executor.
    """
    vocabulary(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for part in slices(batches, "body"):
            ids = coder.encode(part.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body")).mapInArrow(rows, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with ``text``; bytes that are no text become U+FFFD, null ids no text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for part in slices(batches, "ids"):
            texts = [None if x is None else coder.decode(x) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the text decoded from them, for every row."""
    both = decode(encode(docs, path), path)
    return both.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
