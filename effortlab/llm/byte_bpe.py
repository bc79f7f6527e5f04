"""Byte-level BPE with the tokenizers library over Arrow batches.

A rank file lists byte strings; the library wants printable strings and
merges.  Both follow from the ranks: each byte has a printable character (the
byte table), and the merge that makes a token is the last pair that is left
when the token's bytes are merged by the lower ranks alone.  Where that always
leaves two parts, merging by this list equals merging by ranks: lower ranks
are used up before a token's own turn, so a pair next to each other then is
the pair found here.  Any other rank file is refused.

Encoding: a match of the pattern never spans a single blank between two other
characters but begins with it, so texts are cut there and the library
encodes every distinct piece of a slice of the batch once; what a task remembers of
earlier slices is bounded.  Long texts go through in strides, so memory follows
the stride, or the longest stretch without such a blank.  Offsets come from
the ids: the lengths of the tokens in bytes give byte offsets, and the text's
own bytes say to which character each belongs.  A token that holds part of a
character spans that character.

Decoding reverses the byte table.  The bytes are exact.  As text, a character
whose bytes lie in several tokens appears with the token that completes it,
and bytes that are no UTF-8 become U+FFFD.

Defined results: a null text counts as empty, an empty text has no tokens;
null ids decode to nothing, an id that the vocabulary lacks stops the job.
Special tokens are ordinary text.  Other columns pass through, a column named
like a result is replaced; repeated rows are encoded each, empty tables stay
empty.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_value, with_fields

by_value(__name__)

#: Characters that are encoded together.
SLICE_CHARS = 500_000
#: Pieces in each half of a task's memory, and the longest piece that it keeps.
REMEMBERED, LONGEST = 200_000, 64
#: Pieces that the library encodes as one text.
ROW = 20_000
#: Marks that often follow a word.
MARKS = ".,;:!?"


def byte_table() -> dict[int, str]:
    """Printable character of each byte: printable Latin-1 bytes stand for
    themselves, the others for the characters from U+0100 on, in byte order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts left of ``token`` when its bytes are merged by ranks below its own."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        turns = [ranks.get(a + b, len(ranks)) for a, b in zip(parts, parts[1:])]
        first = min(range(len(turns)), key=turns.__getitem__)
        if turns[first] >= ranks[token]:
            break
        parts[first:first + 2] = [parts[first] + parts[first + 1]]
    if len(parts) != 2 or any(ranks.get(p, len(ranks)) >= ranks[token] for p in parts):
        raise ValueError(f"no merge of lower ranks makes {token!r}")
    return parts[0], parts[1]


def tokenizer_spec(path: str, pattern: str) -> str:
    """The library's tokenizer for a rank file, as JSON that can be broadcast."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    ranks, table = load_ranks(path), byte_table()
    shown = lambda token: "".join(map(table.__getitem__, token))
    merges = [tuple(map(shown, last_pair(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    tokenizer = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer.to_str()


class Coder:
    """A task's tokenizer with the table of its tokens' bytes."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # a task has one core
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec)
        self.library.model._resize_cache(0)                  # it would meet no word twice
        byte_of = {c: b for b, c in byte_table().items()}
        vocab = self.library.get_vocab()
        self.bytes_of: list[bytes | None] = [None] * (max(vocab.values(), default=-1) + 1)
        for shown, i in vocab.items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, shown))
        self.lengths = np.array([len(b or b"") for b in self.bytes_of], np.int64)
        self.blank = re.compile(r"(?<=\S) (?=\S)")
        others = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
        #: what tells that a blank stands beside other white space (in ASCII texts, in all)
        self.uneven = [["  "] + [x for c in others if c.isascii() or not ascii for x in (" " + c, c + " ")] for ascii in (False, True)]
        self.known: dict[str, bytes] = {}            # pieces met of late ...
        self.before: dict[str, bytes] = {}           # ... and those before them

    def strides(self, text: str, size: int) -> Iterator[str]:
        """``text`` cut at the first fitting blank after every ``size`` characters."""
        at = 0
        while len(text) - at > size and (cut := self.blank.search(text, at + size)):
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:]

    def pieces(self, stride: str, first: bool) -> list[str]:
        """Keys of a stride's pieces: a key stands for itself with a blank before
        it, but one that begins with a blank for what follows."""
        if not first:
            stride = stride[1:]                      # the blank at which it was cut
        if stride[:1].isspace() or stride[-1:].isspace() or any(x in stride for x in self.uneven[stride.isascii()]):
            keys = self.blank.split(stride)
        else:
            keys = stride.split(" ")
        if first:
            keys[0] = " " + keys[0]
        return keys

    def learn(self, keys: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the newer memory lacks; short ones are remembered."""
        found, parts, new = {}, {}, set()
        for k in keys:
            if k in self.before:
                found[k] = self.before[k]
            elif k[-1] in MARKS and k[:-1].isalpha():        # letters, then a mark: two matches of the pattern
                parts[k] = k[:-1], " " + k[-1]
                new.update(p for p in parts[k] if p not in self.known and p not in keys)
            else:
                new.add(k)
        for k in [k for k in new if k in self.before]:
            found[k] = self.before[k]
            new.remove(k)
        row = [k for k in new if k[0] != " " and not k[-1].isspace()]
        found.update(zip(row, self.in_a_row(row)))
        odd = [k for k in new if k[0] == " " or k[-1].isspace()]
        raw = [k[1:] if k[0] == " " else " " + k for k in odd]
        for k, e in zip(odd, self.library.encode_batch_fast(raw, add_special_tokens=False), strict=True):
            found[k] = array("i", e.ids).tobytes()
        for k, (word, mark) in parts.items():
            found[k] = (found.get(word) or self.known[word]) + (found.get(mark) or self.known[mark])
        self.known.update((k, ids) for k, ids in found.items() if len(k) <= LONGEST)
        return found

    def in_a_row(self, keys: list[str]) -> Iterator[bytes]:
        """Ids of pieces that begin and end with no white space: encoded as one
        text, each behind a blank, and told apart by the lengths of their tokens."""
        for lo in range(0, len(keys), ROW):
            part = keys[lo:lo + ROW]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum([len(k.encode()) + 1 for k in part])
            at = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            first = 0
            for end in at.tolist():
                yield ids[first:end].tobytes()
                first = end

    def encode_slice(self, strides: list[tuple[str, bool]]) -> list[bytes]:
        """Ids of each stride, as 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        rows, missing = [], set()
        for stride, first in strides:
            keys = self.pieces(stride, first)
            ids = list(map(self.known.get, keys))
            gaps = [(i, keys[i]) for i, x in enumerate(ids) if x is None] if None in ids else []
            missing.update(k for _, k in gaps)
            rows.append((ids, gaps))
        found = self.learn(missing)
        for ids, gaps in rows:
            for i, k in gaps:
                ids[i] = found[k]
        return [b"".join(ids) for ids, _ in rows]

    def encode(self, texts: list[str], size: int = SLICE_CHARS) -> list[np.ndarray]:
        """Ids of each text."""
        parts: list[list[bytes]] = [[] for _ in texts]
        rows: list[int] = []
        held: list[tuple[str, bool]] = []
        chars = 0

        def flush() -> None:
            for row, ids in zip(rows, self.encode_slice(held), strict=True):
                parts[row].append(ids)
            rows.clear()
            held.clear()

        for row, text in enumerate(texts):
            for i, stride in enumerate(self.strides(text, size)):
                rows.append(row)
                held.append((stride, i == 0))
                chars += len(stride)
                if chars >= size:
                    flush()
                    chars = 0
        flush()
        return [np.frombuffer(b"".join(p), np.int32) for p in parts]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: its first character, the one after its last, and whether
        it begins inside a character."""
        ends = np.cumsum(self.lengths[ids])
        begins = ends - self.lengths[ids]
        leads = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        character = np.cumsum(leads) - 1                     # of every byte
        return character[begins].astype(np.int32), (character[ends - 1] + 1).astype(np.int32), ~leads[begins]

    def raw(self, ids: list[int]) -> bytes:
        try:
            if min(ids, default=0) >= 0:
                return b"".join(map(self.bytes_of.__getitem__, ids))
        except (IndexError, TypeError):
            pass
        lacking = next(i for i in ids if not 0 <= i < len(self.bytes_of) or self.bytes_of[i] is None)
        raise ValueError(f"id {lacking} is not in the vocabulary")

    def shown(self, ids: list[int]) -> list[str]:
        """Text that each token adds when the tokens are decoded one after the other."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.raw([t]), i == len(ids) - 1) for i, t in enumerate(ids)]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows that hold about a slice of characters."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    first = chars = 0
    for i, text in enumerate(texts, 1):
        chars += len(text)
        if chars >= SLICE_CHARS or i == len(texts):
            yield batch.slice(first, i - first), texts[first:i]
            first, chars = i, 0


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text",
           offsets: bool = False, decoded: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` (long) and ``ids`` (array of int); with
    ``offsets`` also ``starts`` and ``ends`` (arrays of int, in characters of
    the text) and ``n_split`` (int: tokens that begin inside a character); with
    ``decoded`` also ``decoded`` (binary: the bytes that the ids stand for)."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_spec(ranks_path, pattern))      # fixed size
    fields = [("n_tokens", "bigint"), ("ids", "array<int>")]
    fields += [("starts", "array<int>"), ("ends", "array<int>"), ("n_split", "int")] * offsets
    fields += [("decoded", "binary")] * decoded
    schema = with_fields(docs.schema, fields)
    names = [f.name for f in schema.fields]
    kept = names[:-len(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for whole in batches:
            for batch, texts in _groups(whole, text):
                coder = coder or Coder(shared.value)
                ids = coder.encode(texts)
                cols = [batch.column(c) for c in kept]
                cols += [pa.array([len(x) for x in ids], pa.int64()), _lists(ids, pa.int32())]
                if offsets:
                    begins, ends, inside = zip(*[coder.spans(t, x) for t, x in zip(texts, ids)])
                    cols += [_lists(list(begins), pa.int32()), _lists(list(ends), pa.int32()),
                             pa.array([int(x.sum()) for x in inside], pa.int32())]
                if decoded:
                    cols.append(pa.array([coder.raw(x.tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, *, ids: str = "ids", pieces: bool = False) -> DataFrame:
    """``df`` with ``decoded`` (string) of an id array; with ``pieces`` also
    ``pieces`` (array of string: what each token adds to the text)."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_spec(ranks_path, pattern))        # fixed size
    fields = [("decoded", "string")] + [("pieces", "array<string>")] * pieces
    schema = with_fields(df.schema, fields)
    names = [f.name for f in schema.fields]
    kept = names[:-len(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Coder(shared.value)
            lists = [x or [] for x in batch.column(ids).to_pylist()]
            cols = [batch.column(c) for c in kept]
            cols.append(pa.array([coder.raw(x).decode("utf-8", "replace") for x in lists], pa.string()))
            if pieces:
                cols.append(pa.array([coder.shown(x) for x in lists], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.mapInArrow(run, schema)
