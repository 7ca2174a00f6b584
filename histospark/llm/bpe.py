"""Byte-level BPE encoding and decoding.

Each distinct pre-token is merged by a segment tree over the ranks of its adjacent pairs: a leaf
holds ``rank * width + position``, an inner node the least of its children, so the root is the
leftmost pair of lowest rank. A merge changes three leaves; each change climbs to the root in a
logarithmic number of steps, until the root says that no pair can merge. Trees of equal width are
rows of one array, so many pre-tokens advance together; a few are merged one by one in plain integers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern by which byte-level BPE splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: White space other than the space and the line feed, and what mustn't stand together for ``plain``.
OTHER_ASCII = [chr(c) for c in (0, 9, 11, 12, 13, 28, 29, 30, 31)]
OTHER = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
RUNS = ["  ", "\n\n", " \n", "\n "]
NONE = 2**62


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: chr(b) for b in own}
    for b in range(256):
        chars.setdefault(b, chr(256 + len(chars) - len(own)))
    return [chars[b] for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and added tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        alphabet = byte_alphabet()
        as_byte = {c: b for b, c in enumerate(alphabet)}
        self.byte_ids = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.base = max(vocab.values()) + 1
        pairs = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], dtype=np.uint32 if self.base < 65536 else np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        texts = {i: bytes(as_byte[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.bytes = [texts.get(i, b"") for i in range(max(texts) + 1)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids; NONE where the pair never merges."""
        key = (left * self.base + right).astype(self.pairs.dtype)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def merges(self) -> dict[int, int]:
        """Merge rank of each pair that merges, by left * base + right."""
        if not hasattr(self, "_merges"):
            self._merges = dict(zip(self.pairs.tolist(), self.ranks.tolist(), strict=True))
            self._merged = self.merged.tolist()
        return self._merges

    def byte_ranks(self) -> np.ndarray:
        """Merge rank of each pair of bytes."""
        if not hasattr(self, "_byte_ranks"):
            self._byte_ranks = self.rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        return self._byte_ranks


def merge_rows(vocabulary: Vocabulary, words: list[bytes], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words of 2 to ``width`` bytes, end to end, and how many each word has; width is a power of two."""
    n, shift = len(words), width.bit_length() - 1
    kind = np.int32 if shift <= 14 and len(vocabulary.merged) < 1 << 16 else np.int64
    none = np.iinfo(kind).max
    filled = np.arange(width) < size[:, None]
    raw = np.zeros((n, width), dtype=np.int64)
    raw[filled] = np.frombuffer(b"".join(words), dtype=np.uint8)
    ids = np.zeros((n, width + 1), dtype=np.int64)
    ids[:, :width] = vocabulary.byte_ids[raw]
    after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))  # the next living position; from the last one, a place beyond
    before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
    tree = np.full((n, 2 * width), none, dtype=kind)
    rank = vocabulary.byte_ranks()[raw[:, :-1] * 256 + raw[:, 1:]]
    tree[:, width : 2 * width - 1] = np.where(filled[:, 1:] & (rank < NONE), (rank << shift) + np.arange(width - 1), none)
    for node in range(shift - 1, -1, -1):
        lo = 1 << node
        np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2], out=tree[:, lo : 2 * lo])
    alive = filled
    rows = np.nonzero(tree[:, 1] < none)[0]
    while rows.size:
        root = tree[rows, 1]
        at = root & (width - 1)
        gone = after[rows, at]
        ids[rows, at] = vocabulary.merged[root >> shift]
        alive[rows, gone] = False
        nxt = after[rows, gone]
        after[rows, at] = nxt
        inside = nxt < size[rows]
        before[rows[inside], nxt[inside]] = at[inside]
        first = before[rows, at]
        led = first >= 0
        lefts, rights = (np.concatenate(x) for x in ((at[inside], first[led]), (nxt[inside], at[led])))
        of = np.concatenate((rows[inside], rows[led]))
        found = vocabulary.rank(ids[of, lefts], ids[of, rights])
        changed, node = np.concatenate((rows, rows, rows[led])), np.concatenate((at, gone, first[led])) + width
        tree[rows, at + width] = none
        tree[rows, gone + width] = none
        tree[of, lefts + width] = np.where(found < NONE, (found << shift) + lefts, none)
        while node[0] > 1:
            node = node >> 1
            tree[changed, node] = np.minimum(tree[changed, 2 * node], tree[changed, 2 * node + 1])
        rows = rows[tree[rows, 1] < none]
    return ids[:, :width][alive], alive.sum(axis=1)


def merge_word(vocabulary: Vocabulary, word: bytes, width: int) -> list[int]:
    """The ids of one word by the same segment tree in plain integers: a merge of few words costs less than numpy's calls."""
    n, base, ranks = len(word), vocabulary.base, vocabulary.merges().get
    merged, none = vocabulary._merged, 1 << 62
    ids = vocabulary.byte_ids[np.frombuffer(word, np.uint8)].tolist()
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    shift = width.bit_length() - 1
    tree = [none] * (2 * width)
    for k in range(n - 1):
        rank = ranks(ids[k] * base + ids[k + 1])
        if rank is not None:
            tree[width + k] = (rank << shift) + k
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b

    def put(node: int, value: int) -> None:
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            value = value if value < other else other
            node >>= 1
            if tree[node] == value:
                return
            tree[node] = value

    while (root := tree[1]) < none:
        at = root & (width - 1)
        gone = after[at]
        nxt = after[gone]
        ids[at] = merged[root >> shift]
        ids[gone] = -1
        after[at] = nxt
        put(width + gone, none)
        rank = None
        if nxt < n:
            before[nxt] = at
            rank = ranks(ids[at] * base + ids[nxt])
        put(width + at, none if rank is None else (rank << shift) + at)
        first = before[at]
        if first >= 0:
            rank = ranks(ids[first] * base + ids[at])
            put(width + first, none if rank is None else (rank << shift) + first)
    return [i for i in ids if i >= 0]


#: Fewer words than this are merged one by one.
FEW = 16


class Encoder:
    """Encodes texts; remembers at most ``most`` pieces of text with their ids."""

    def __init__(self, vocabulary: Vocabulary, most: int = 60_000, cells: int = 1 << 17):
        self.vocabulary, self.most, self.cells = vocabulary, most, cells
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True)))) if vocabulary.added else None

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece, as little-endian 32-bit integers; pre-tokens of like length are merged together."""
        tokens = list(map(self.split.findall, pieces))
        raw = [t.encode("utf-8", "surrogatepass") for own in tokens for t in own]
        if not raw:
            return dict.fromkeys(pieces, b"")
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        count, found = np.ones(len(raw), dtype=np.int64), []
        width = 1 << np.ceil(np.log2(size)).astype(np.int64)
        for w in np.unique(width).tolist():
            of = np.nonzero(width == w)[0]
            if w == 1:
                found.append((of, self.vocabulary.byte_ids[np.frombuffer(b"".join([raw[i] for i in of.tolist()]), dtype=np.uint8)]))
                continue
            step = max(1, self.cells // w)
            for k in range(0, len(of), step):
                some = of[k : k + step]
                if len(some) < FEW:
                    for i in some.tolist():
                        ids = np.array(merge_word(self.vocabulary, raw[i], w), np.int64)
                        count[i] = len(ids)
                        found.append((np.array([i]), ids))
                    continue
                ids, count[some] = merge_rows(self.vocabulary, [raw[i] for i in some.tolist()], size[some], w)
                found.append((some, ids))
        ends = np.cumsum(count)
        flat = np.zeros(ends[-1], dtype="<i4")
        for of, ids in found:
            n = count[of]
            flat[np.repeat(ends[of] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = ids
        of = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)))
        cuts = np.concatenate(([0], ends))[of] * 4
        every = flat.tobytes()
        return {p: every[a:b] for p, a, b in zip(pieces, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)}

    def segments(self, text: str) -> list[str | int]:
        """Stretches of ordinary text, and ids where the text holds an added token's string."""
        if not self.marks or not self.marks.search(text):
            return [text]
        out, end = [], 0
        for m in self.marks.finditer(text):
            out += [text[end : m.start()], self.vocabulary.added[m[0]]]
            end = m.end()
        return [*out, text[end:]]

    def parts(self, text: str) -> list[str]:
        """Pieces that pre-tokenize on their own: where every white space is one space or line feed
        between other characters, a space begins a piece and a line feed is one."""
        if text and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in (RUNS + OTHER_ASCII if text.isascii() else RUNS + OTHER_ASCII + OTHER)):
            return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        return [text]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        split = [[s if isinstance(s, int) else self.parts(s) for s in self.segments(t)] for t in texts]
        wanted: set[str] = set()
        wanted.update(*(s for doc in split for s in doc if not isinstance(s, int)))
        missing = [p for p in wanted if p not in self.young]
        self.young.update((p, self.old[p]) for p in missing if p in self.old)
        learned = self.learn([p for p in missing if p not in self.young])
        long = {p: ids for p, ids in learned.items() if len(p) > 200}  # whole texts aren't kept
        self.young.update((p, ids) for p, ids in learned.items() if p not in long) if long else self.young.update(learned)
        get = (lambda p: long[p] if p in long else self.young[p]) if long else self.young.__getitem__
        return [np.frombuffer(b"".join(np.int32(s).astype("<i4").tobytes() if isinstance(s, int) else b"".join(map(get, s)) for s in doc), dtype="<i4") for doc in split]


#: One for each worker process and file.
ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(Vocabulary(path))
    return ENCODERS[path]


def bpe_encode(text: Column, path: str, step: int = 1024) -> Column:
    """Token ids of each text (array<int>), without special tokens added.

    A null or empty text has no ids. The string of an added token inside a text becomes its id, as
    the file asks. Texts are encoded ``step`` at a time, so that memory stays bounded.
    """

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            yield pd.Series([ids for k in range(0, len(texts), step) for ids in own.encode(texts[k : k + step])], dtype=object)

    return encode(text)


def bpe_decode(ids: Column, path: str) -> Column:
    """The text of each array of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD.

    Null or empty arrays give the empty text; ids that the file lacks add nothing.
    """

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = encoder(path).vocabulary.bytes
        for batch in batches:
            yield pd.Series([decoded(known, x) for x in batch], dtype=object)

    return decode(ids)


def bpe_round_trip(text: Column, path: str, step: int = 192) -> Column:
    """struct<ids, decoded>: the token ids of each text, and the text that these ids give, in one pass through a
    worker. Both are as bpe_encode and bpe_decode have them."""

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            ids = [x for k in range(0, len(texts), step) for x in own.encode(texts[k : k + step])]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([decoded(own.vocabulary.bytes, x) for x in ids], dtype=object)})

    return both(text)


def decoded(known: list[bytes], ids: np.ndarray | None) -> str:
    if ids is None:
        return ""
    listed = ids.tolist()
    if listed and not (min(listed) >= 0 and max(listed) < len(known)):
        listed = [i for i in listed if 0 <= i < len(known)]
    return b"".join(map(known.__getitem__, listed)).decode("utf-8", "replace")
