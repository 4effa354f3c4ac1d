"""Harmonic packing: tokens of documents into sequences of a fixed capacity, each worker by itself.

A document is cut into whole sequences and a tail. The tail goes to a reciprocal-capacity class: class k holds pieces of
at most capacity / k tokens, k of them to a bin. Where a tail would fill its place badly, a piece of exactly the next
reciprocal length is cut off first (class k + 1 is then filled without a gap), so padding stays under a few per cent. The
bins that are still open when a worker's rows end are emptied into common sequences, cut at the capacity and at last at
powers of two, which need no padding. No row is shuffled, and a lost task is redone alike from its own split.

A null or empty text is the end token alone; repeated rows are packed as often as they occur; a null doc_id stays null;
extra columns are ignored; a very long text is cut into many whole sequences, of which none is kept back; ties are packed as
they come; an empty table gives no piece.
"""

from __future__ import annotations

import json
import re
import struct
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import caches, keep_only, table, words_of

FILL, MOST_CUTS = 0.98, 3
#: What a tokenizer file must say of letters and white space for words to be encoded each by itself, in lower case.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = [
    {
        "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
        "behavior": "Removed", "invert": True
    },
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def splits_words(path: str) -> bool:
    """Whether the tokenizer drops white space, splits at it and lower-cases, as NORMAL and SPLIT say."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    steps = lambda part, name: (whole.get(part) or {}).get(name)
    return steps("normalizer", "normalizers") == NORMAL and steps(
        "pre_tokenizer", "pretokenizers"
    ) == SPLIT and not whole.get("post_processor")


class LowerWords:
    """Ids of lower-case words of Latin letters under a BPE vocabulary with word ends, merged by tiktoken's kernel.

    The mark of a word's end is a byte that no UTF-8 text has. Where ids rise with the merges' ranks, they are the ranks; a
    vocabulary of any other form gets no such table (``of`` gives None), and the library encodes all words."""

    END, LETTERS = b"\xff", re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.merge = tiktoken.Encoding(
            "words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}
        )._encode_single_piece

    @classmethod
    def of(cls, path: str) -> LowerWords | None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model.get("vocab"), model.get("end_of_word_suffix")
        if model.get("type") != "BPE" or not end or model.get("ignore_merges") or model.get("dropout"):
            return None
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ids = [vocab.get(m.replace(" ", "", 1), -1) for m in merged]
        # The usual visible stand-ins of bytes: printable ones are themselves, the others follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = {chr(b): b for b in shown} | {
            chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(shown)))
        }
        if ids != sorted(set(ids)) or ids[0] < 2 * len(stand) or not all(
            c in vocab and c + end in vocab for c in stand
        ):
            return None
        ranks = {bytes([b]): vocab[c] for c, b in stand.items()} | {
            bytes([b]) + cls.END: vocab[c + end] for c, b in stand.items()
        }
        for m, i in zip(merged, ids):
            token = m.replace(" ", "", 1)
            tail = token.endswith(end)
            ranks[bytes(stand[c] for c in token.removesuffix(end)) + cls.END * tail] = i
        return cls(ranks)

    def __call__(self, word: bytes) -> bytes:
        return array("I", self.merge(word + self.END)).tobytes()


class WordIds:
    """Ids (little-endian 32-bit bytes) of words between ASCII white space, for tokenizers that drop white space and so treat
    each word by itself. New words are encoded many at a time, with a mark between them; what has been seen is kept up to a
    bound, beyond which only the words of the texts at hand stay. Any other tokenizer gets whole texts."""

    MOST, MARK, TAIL = 400_000, "|", b".,;:!?&#*%$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.by_word = Tokenizer.from_file(path), {}, splits_words(path)
        if not self.by_word:
            return
        (self.mark,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.lower = LowerWords.of(path) if sys.byteorder == "little" and array("I").itemsize == 4 else None

    def _encode(self, words: list[bytes]) -> list[bytes]:
        return self._whole([w.decode("utf-8", "surrogatepass") for w in words])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [
            struct.pack(f"<{len(e.ids)}I", *e.ids)
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _encode_joined(self, words: list[bytes]) -> list[bytes]:
        text = f" {self.MARK} ".encode().join(words).decode("utf-8", "surrogatepass")
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        marks = (4 * np.flatnonzero(ids == self.mark)).tolist()
        if len(marks) != len(words) - 1:
            return self._encode(words)
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *(m + 4 for m in marks)], [*marks, len(raw)])]

    def learn(self, seen: set[bytes]) -> None:
        fresh = seen.difference(self.words)
        if len(self.words) + len(fresh) > self.MOST:
            self.words = {w: self.words[w] for w in seen if w in self.words}
        known, lower, letters = self.words, self.lower, LowerWords.LETTERS.fullmatch
        rest, tailed = [], []
        for word in fresh:
            # A word of letters is what it is in lower case, then the marks that end it.
            core = word.rstrip(self.TAIL)
            key = core.lower()
            if lower is None or not letters(key):
                rest.append(word)
                continue
            ids = known.get(key)
            if ids is None:
                ids = known[key] = lower(key)
            if len(core) < len(word):
                tailed.append((word, ids, word[len(core) :]))
            else:
                known[word] = ids
        mark = self.MARK.encode()
        rest.extend({tail for _, _, tail in tailed}.difference(known, rest))
        marked = [w for w in rest if mark in w]
        known.update(zip(marked, self._encode(marked)))
        plain = [w for w in rest if mark not in w]
        for i in range(0, len(plain), 5000):
            known.update(zip(plain[i : i + 5000], self._encode_joined(plain[i : i + 5000])))
        for word, ids, tail in tailed:
            known[word] = ids + known[tail]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return self._whole([t or "" for t in texts])
        words = [words_of(t) for t in texts]
        self.learn(set().union(*words))
        get = self.words.__getitem__
        return [b"".join(map(get, ws)) for ws in words]


_known: dict[str, WordIds] = caches.setdefault("packing", {})


def word_ids(path: str) -> WordIds:
    """The worker's own, kept from task to task (a function of the module, so that tasks refer to it and carry no copy)."""
    keep_only("packing")
    return _known.get(path) or _known.setdefault(path, WordIds(path))


def classes(length: int, capacity: int) -> list[tuple[int, int]]:
    """(class, piece length) of a tail, in order."""
    out = []
    while length:
        k = capacity // length
        if k * length >= FILL * capacity or len(out) == MOST_CUTS:
            return [*out, (k, length)]
        out.append((k + 1, capacity // (k + 1)))
        length -= capacity // (k + 1)
    return out


class Packer:
    """Open bins of one worker. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.bins, self.out = capacity, first, {}, []

    def close(self, pieces: list) -> None:
        at = 0
        for piece in pieces:
            self.out.append((*piece, self.next, at))
            at += len(piece[2]) // 4
        self.next += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.capacity:
            self.close([(doc_id, at, ids[4 * at : 4 * (at + self.capacity)], total)])
            at += self.capacity
        for k, n in classes(total - at, self.capacity):
            pieces = self.bins.setdefault(k, [])
            pieces.append((doc_id, at, ids[4 * at : 4 * (at + n)], total))
            at += n
            if len(pieces) == k:
                self.close(self.bins.pop(k))

    def finish(self) -> None:
        rest = [p for k in sorted(self.bins) for p in self.bins[k]]
        self.bins, left = {}, sum(len(p[2]) for p in rest) // 4
        rest.reverse()
        while left:
            room = size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            pieces = []
            while room:
                doc_id, start, ids, total = rest.pop()
                n = min(room, len(ids) // 4)
                pieces.append((doc_id, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.append((doc_id, start + n, ids[4 * n :], total))
                room -= n
            self.close(pieces)
            left -= size


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """docs (doc_id, text) to pieces: doc_id, start, length, ids (binary, little-endian 32-bit), doc_tokens, sequence_id, offset."""
    names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        encoder = word_ids(tokenizer)
        packer, end = Packer(capacity, TaskContext.get().partitionId() << 36), struct.pack("<I", end_id)

        def flush():
            rows, packer.out = packer.out, []
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(zip(*rows[i : i + 20_000]), kinds)], names
                )

        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.ids(part.column(1).to_pylist())):
                    packer.add(doc_id, ids + end)
                yield from flush()
        packer.finish()
        yield from flush()

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return made.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids", "doc_tokens", "sequence_id",
        "offset"
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), tokenizer_path()))
