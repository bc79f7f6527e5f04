"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

For a merge list in which every token is made by exactly one merge, the
encoding of each prefix of a word is fixed by its *last token*: token ``t``
ending at position ``i`` is the last one exactly if the last token at
``i - len(t)`` and ``t`` stay apart when their bytes are merged together.
So a word needs one last token per prefix, and words that share a prefix
share these states.  Each batch puts its distinct new words in a trie (laid
out over the sorted word list: a node is a range of words) and walks it depth
first, so the states of a shared prefix are computed once.

Rows never move: documents are encoded where they are scanned, the vocabulary
(50k entries, fixed) is broadcast, and what a task remembers is bounded by
``CACHE_ENTRIES``.

Defined results: a null text counts as empty; an empty text has no tokens.
Special tokens found in a text are encoded as their own id, as the tokenizer
file asks for.  Other columns pass through; a column named like a result is
replaced.  Repeated rows are encoded each, very long texts whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_value, tidy, trim, with_fields

by_value(__name__)

#: Words and pieces in each half of a task's memory (about 60 MB a half).
CACHE_ENTRIES = 250_000
#: Steps of the automaton in a task's memory (about 7 MB).
STEP_ENTRIES = 65_536
#: Characters of the texts that are taken apart together (about 25 bytes of memory each).
SLICE_CHARS = 1_000_000
NEVER = (1 << 31) - 1

# Ranges of letters (first row) and numbers (second row) of the
# tokenizer's Unicode version (16) that this Python's tables (15.1) lack.
LETTERS_ADDED: tuple[tuple[int, int], ...] = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F,
    0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390,
    0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460,
    0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_ADDED: tuple[tuple[int, int], ...] = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character:
    printable Latin-1 bytes stand for themselves, the others for the
    characters from U+0100 on, in byte order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_rules(path: str) -> dict:
    """Vocabulary, merges and special tokens of a byte-level BPE file, as
    plain data that can be broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        raise ValueError(f"{path} is no byte-level BPE tokenizer")
    alphabet = _byte_alphabet()
    raw = lambda s: bytes(alphabet[c] for c in s)
    vocab = {raw(s): i for s, i in spec["model"]["vocab"].items()}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    merges = [(raw(a), raw(b)) for a, b in merges]
    if len({a + b for a, b in merges}) != len(merges):
        raise ValueError("a token is made by two merges; last tokens would not be unique")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return {"vocab": vocab, "merges": merges, "special": special}


def endings(vocab: dict[bytes, int]) -> dict[str, array]:
    """Automaton of the tokens that end at a place, as packed arrays that can be
    broadcast.  A state is the longest beginning of a token that what was read
    ends with (0: none), numbered by length; ``edge`` holds how each is reached,
    from its beginning by a byte, and ``fail`` the next shorter one.  ``token`` is the
    state that is the longest token a state ends with (0: none), ``shorter``
    the longest one below that; ``id`` is a state's own token."""
    edge, fail, token, shorter, length, ids = array("q"), *(array("i", [0]) for _ in range(4)), array("i", [-1])
    number, goes = {b"": 0}, {}
    for p in sorted({t[:i] for t in vocab for i in range(1, len(t) + 1)}, key=len):
        state, before, b = len(length), number[p[:-1]], p[-1]
        number[p] = goes[before << 8 | b] = state
        edge.append(before << 8 | b)
        f = before
        while f:
            f = fail[f]
            if f << 8 | b in goes:
                f = goes[f << 8 | b]
                break
        fail.append(f)
        length.append(len(p))
        token.append(state if p in vocab else token[f])
        shorter.append(token[f] if p in vocab else shorter[f])
        ids.append(vocab.get(p, -1))
    return {"edge": edge, "fail": fail, "token": token, "shorter": shorter, "length": length, "id": ids}


def edges(rules: dict, side: int) -> tuple[array, array, array]:
    """For each token, the tokens that stand at its right (1) or left (0)
    edge while it is being built, from a byte up, each with the rank of
    the merge that ends it: where a token's begin, the tokens, the ranks (packed,
    for there are some hundred thousand)."""
    vocab = rules["vocab"]
    made = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in enumerate(rules["merges"])}
    begin, tokens, ends = array("i", bytes(4 * (max(vocab.values(), default=-1) + 1))), array("i"), array("i")
    for whole in vocab.values():
        chain, t, end = [], whole, NEVER
        while True:
            chain.append((t, end))
            if t not in made:
                break
            end, t = made[t][2], made[t][side]
        begin[whole] = len(tokens)
        tokens.extend([x for x, _ in reversed(chain)])
        ends.extend([x for _, x in reversed(chain)])
    return begin, tokens, ends


def with_tables(rules: dict) -> dict:
    """The rules with what every encoder derives from them, made once and broadcast;
    the merges as two rows of tokens."""
    vocab = rules["vocab"]
    return {"vocab": vocab, "special": rules["special"], "endings": endings(vocab), "right": edges(rules, 1), "left": edges(rules, 0),
            "pairs": tuple(array("i", [vocab[m[side]] for m in rules["merges"]]) for side in (0, 1))}


def _class(wanted: str, added: tuple[tuple[int, int], ...]) -> str:
    """Ranges, as the inside of a pattern's brackets, of the characters whose
    category starts with ``wanted``."""
    more = {c for a, b in added for c in range(a, b + 1)}
    out, start = [], None
    for c in range(0x110001):
        inside = c < 0x110000 and (unicodedata.category(chr(c))[0] == wanted or c in more)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return "".join(out)


def split_pattern() -> str:
    """Pattern that cuts a text into words: contractions, letters, numbers or
    other characters with one blank before, and white space."""
    space = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    letter, number = _class("L", LETTERS_ADDED), _class("N", NUMBERS_ADDED)
    return (rf" ?[{letter}]+| ?[{number}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{space}{letter}{number}]+"
            rf"|[{space}]+(?![^{space}])|[{space}]+")


class Encoder:
    """Encodes words with a memory of what it has met; one per task."""

    def __init__(self, rules: dict, pattern: str):
        rules = rules if "endings" in rules else with_tables(rules)
        self.vocab, self.special = rules["vocab"], rules["special"]
        self.pattern = re.compile(pattern)
        self.gap = re.compile(r"(?<=\S) (?=\S)")
        others = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
        self.uneven = {k: ["  "] + [x for c in others if k or c.isascii() for x in (" " + c, c + " ")] for k in (0, 1)}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.rank = {pair: r for r, pair in enumerate(zip(*rules["pairs"], strict=True))}
        self.right, self.left = rules["right"], rules["left"]
        found = rules["endings"]
        self.fail, self.token, self.shorter, self.length, self.id_of = (found[k] for k in ("fail", "token", "shorter", "length", "id"))
        self.goes = dict(zip(found["edge"], range(1, len(self.length))))
        self.steps: dict[int, int] = {}              # steps met that leave the beginning of a token
        self.bytes_of = {i: t for t, i in self.vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}            # words and pieces met of late ...
        self.before: dict[str, bytes] = {}           # ... and those before them

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` together gives exactly
        these two tokens: no merge across the border has an earlier turn than
        the merges that build up either side (at the same rank the left one
        goes first)."""
        (begin, us, us_end), (begin_v, vs, vs_end) = self.right, self.left
        i, j = begin[a], begin_v[b]
        while True:
            u_end, v_end = us_end[i], vs_end[j]
            r = self.rank.get((us[i], vs[j]), NEVER)
            if r < u_end and r <= v_end and r < NEVER:
                return False
            if u_end == NEVER and v_end == NEVER:
                return True
            if u_end <= v_end:
                i += 1
            else:
                j += 1

    def _step(self, edge: int) -> int:
        """The state after a state and a byte that no token goes on with."""
        state, b, goes = edge >> 8, edge & 255, self.goes
        while state:
            state = self.fail[state]
            if state << 8 | b in goes:
                state = goes[state << 8 | b]
                break
        self.steps[edge] = state
        return state

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Token ids (packed) of distinct words, by depth-first traversal of
        their trie.  A node is a range of the sorted words; ``last``, ``at`` and
        ``states`` hold, for each prefix on the path from the root, its last token,
        where that token starts and the state of the automaton (see :func:`endings`)."""
        words = sorted(set(words))
        apart, packed, out = self.apart, self.packed, {}
        goes, steps, token, shorter, length, id_of = self.goes, self.steps, self.token, self.shorter, self.length, self.id_of
        if len(apart) > CACHE_ENTRIES:
            apart.clear()
        if len(steps) > STEP_ENTRIES:
            steps.clear()
        last, at, states = [-1], [0], [0]
        stack = [(0, len(words), 0)] if words else []
        while stack:
            lo, hi, end = stack.pop()                # words[lo:hi] share their first `end` bytes
            del last[end + 1:], at[end + 1:], states[end + 1:]
            state = states[end]
            first, final = words[lo], words[hi - 1]
            shared = len(first)
            if hi - lo > 1:
                shared = end
                while shared < len(first) and first[shared] == final[shared]:
                    shared += 1
            for b in first[end:shared]:              # the states along the node's edge
                end += 1
                edge = state << 8 | b
                state = goes.get(edge)
                if state is None:
                    state = steps.get(edge)
                    if state is None:
                        state = self._step(edge)
                ends = token[state]
                while ends:                          # tokens that end here, the longest first
                    start, t = end - length[ends], id_of[ends]
                    if not start:
                        break
                    key = last[start] << 32 | t
                    fits = apart.get(key)
                    if fits is None:
                        fits = apart[key] = self.stays_apart(last[start], t)
                    if fits:
                        break
                    ends = shorter[ends]
                else:
                    raise ValueError(f"no token ends at byte {end} of {first[:60]!r}")
                last.append(t)
                at.append(start)
                states.append(state)
            if len(first) == end:
                ids, i = [], end
                while i:
                    ids.append(packed[last[i]])
                    i = at[i]
                out[first] = b"".join(ids[::-1])
                lo += 1
            children = []
            while lo < hi:
                b = words[lo][end]
                nxt = hi if words[hi - 1][end] == b else bisect_left(words, words[lo][:end] + bytes((b + 1,)), lo, hi)
                children.append((lo, nxt, end))
                lo = nxt
            stack.extend(reversed(children))
        return out

    def _cut(self, text: str) -> list[str]:
        """Keys of the pieces that are encoded by themselves: cut at each
        single blank that has no other white space beside it.  A key that does
        not start with a blank stands for itself with a blank before it; a key
        that does, for what follows."""
        if text[0].isspace() or text[-1].isspace() or any(x in text for x in self.uneven[not text.isascii()]):
            parts = self.gap.split(text)
        else:
            parts = text.split(" ")
        parts[0] = self._key(parts[0])
        return parts

    @staticmethod
    def _key(piece: str) -> str:
        return piece[1:] if len(piece) > 1 and piece[0] == " " != piece[1] else " " + piece

    def _words(self, key: str) -> list[str]:
        """Keys of the words of a piece."""
        if key.isalpha():
            return [key]
        if key[-1] in ".," and key[:-1].isalpha():
            return [key[:-1], " " + key[-1]]
        return [self._key(w) for w in self.pattern.findall(key[1:] if key[0] == " " else " " + key)]

    def _learn(self, pieces: set[str]) -> None:
        """Bring pieces into ``known``; only what neither memory holds is
        encoded.  The older half of the memory goes when the newer is full."""
        known, before = self.known, self.before
        cut, raw = {}, {}
        for p in pieces:
            if p in before:
                known[p] = before[p]
            elif p.isalpha():                        # a word as it is
                raw[p] = b" " + p.encode()
            else:
                cut[p] = ws = self._words(p)
                for w in ws:
                    if w in raw or w in known:
                        continue
                    if w in before:
                        known[w] = before[w]
                    else:
                        raw[w] = (w[1:] if w[0] == " " else " " + w).encode()
        ids = self.encode_words(raw.values())
        for w, b in raw.items():
            known[w] = ids[b]
        for p, ws in cut.items():
            if len(ws) != 1 or ws[0] != p:
                known[p] = b"".join([known[w] for w in ws])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE_ENTRIES:
            self.before, self.known = self.known, {}
        known, rows, missing = self.known.get, [], set()
        for text in texts:
            row: list = []
            special = self.cut is not None and any(s in text for s in self.special)
            for i, part in enumerate(self.cut.split(text) if special else [text]):
                if i % 2:
                    row.append(self.packed[self.special[part]])
                elif part:
                    keys = self._cut(part)
                    ids = list(map(known, keys))
                    if None in ids:
                        gaps = [(j, keys[j]) for j, x in enumerate(ids) if x is None]
                        missing.update([k for _, k in gaps])
                        row.append((ids, gaps))
                    else:
                        row.append(b"".join(ids))
            rows.append(row)
        self._learn(missing)
        known = self.known
        for row in rows:
            for i, part in enumerate(row):
                if isinstance(part, tuple):
                    ids, gaps = part
                    for j, k in gaps:
                        ids[j] = known[k]
                    row[i] = b"".join(ids)
        return [row[0] if len(row) == 1 else b"".join(row) for row in rows]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _slices(batch: pa.RecordBatch, column: str, max_chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch whose texts hold about ``max_chars`` together, so a
    task's memory does not grow with the batch."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    lo = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= max_chars or i == len(texts) - 1:
            yield batch.slice(lo, i + 1 - lo), texts[lo:i + 1]
            lo, chars = i + 1, 0


def encode(docs: DataFrame, tokenizer_path: str, *, text: str = "text", decode: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` (long) and ``ids`` (binary: little-endian
    unsigned 32-bit token ids); with ``decode`` also ``decoded``, the text
    that the ids stand for."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((with_tables(load_rules(tokenizer_path)), split_pattern()))   # fixed size
    fields = [("n_tokens", "bigint"), ("ids", "binary")] + [("decoded", "string")] * decode
    schema = with_fields(docs.schema, fields)
    kept = [f.name for f in schema.fields[:-len(fields)]]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        trim()
        for whole in batches:
            for batch, texts in _slices(whole, text):
                coder = coder or Encoder(*shared.value)
                ids = coder.encode_batch(texts)
                cols = [batch.column(c) for c in kept]
                cols += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    cols.append(pa.array([coder.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer_path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that the binary id column stands for (null: empty)."""
    shared = df.sparkSession.sparkContext.broadcast(load_rules(tokenizer_path))
    schema = with_fields(df.schema, [(out, "string")])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        of = {i: t for t, i in rules["vocab"].items()} | {i: s.encode() for s, i in rules["special"].items()}
        for batch in batches:
            texts = [b"".join(map(of.__getitem__, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace")
                     for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())],
                                             [f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
