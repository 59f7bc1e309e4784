"""Token ids of whole texts by a public byte-pair vocabulary.

A text of any length is cut into pieces that are encoded in parallel on different executors. At each join, the ids next to
it are encoded again as one window, which grows until the ids at both its edges agree with what is there. For byte-pair
merges by rank a sequence is the encoding of its text if each two neighbours are the encoding of their joint text, so
agreement at both edges proves the whole. Pieces are cut where the pretokenizer must cut; a run that has no such place is
cut in halves, as a tree, and joined in this way.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files on the driver; a parameter of every function below.
TOKENIZERS = "/opt/tokenizers"
#: Characters of a text encoded as one piece; bytes of a run without a place to cut that are merged at once.
PIECE, RUN = 16_384, 4_096
# The pretokenizer's pattern, as the vocabulary defines it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, vocabulary: bytes):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.core = self.enc._core_bpe
        self.words = regex.compile(PATTERN)
        # a pretoken is of one class but for a space before it or a contraction
        self.unbroken = regex.compile(r"\p{L}{%d}|\p{N}{%d}|[^\s\p{L}\p{N}]{%d}|\s{%d}" % ((RUN // 4,) * 4))
        self.bytes = {i: b for b, i in ranks.items()}

    def word(self, data: bytes) -> list[int]:
        """The ids of one pretoken."""
        if len(data) <= RUN:
            return self.core.encode_single_piece(data)
        half = len(data) // 2
        return self.join(self.word(data[:half]), self.word(data[half:]))

    def _fits(self, a: int, b: int) -> bool:
        return self.core.encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring parts of one pretoken, from the ids of each."""
        if not left or not right:
            return left + right
        k = 0
        while True:
            a, b = left[: len(left) - k], right[k:]
            mid = left[len(left) - k :] + right[:k]
            mid = self.core.encode_single_piece(b"".join(self.bytes[i] for i in mid)) if mid else []
            inner = ([a[-1]] if a else []) + mid[:1], mid[-1:] + ([b[0]] if b else [])
            edges = [x for x in inner if len(x) == 2] if mid else ([[a[-1], b[0]]] if a and b else [])
            if all(self._fits(*e) for e in edges):
                return a + mid + b
            k = 1 if not k else 2 * k
            k = min(k, max(len(left), len(right)))

    def text(self, text: str) -> list[int]:
        """The ids of a text; runs without a cut of more than RUN bytes are merged as a tree. Every pretoken is taken from
        the whole text, since white space is cut by what follows it."""
        if len(text) <= RUN // 4 or not self.unbroken.search(text):
            return self.enc.encode_ordinary(text)
        return self.until(text, len(text))

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in self.words.finditer(text)]

    def until(self, text: str, stop: int) -> list[int]:
        """The ids of the pretokens of `text` that start before `stop`, each seen with what follows it."""
        return [i for m in self.words.finditer(text) if m.start() < stop for i in self.word(m[0].encode("utf-8"))]

    def stitch(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """The ids of left + right from the ids of each: the window begins near the end of `left` and grows until a
        pretoken of the joint text starts where one of `right` starts; from there on both agree."""
        if not left or not right:
            return left_ids + right_ids
        # a contraction looks two characters ahead, so the last pretoken but one may change too
        from_ = max(0, len(left) - 4 * RUN)
        known = self.starts(left[from_:])
        begin = from_ + known[-2] if from_ and len(known) > 3 else self.starts(left)[-2:][0]
        tail = left[begin:]
        keep = len(left_ids) - len(self.text(tail))
        size = 64
        while True:
            head = right[:size]
            own = set(self.starts(head))
            joint = [s - len(tail) for s in self.starts(tail + head)]
            # the last pretoken of the window may go on beyond it, so it proves nothing
            last = len(right) if size >= len(right) else max([s for s in own if s < len(head)], default=0)
            meet = next((s for s in joint if s > 0 and s in own and s < last), None)
            if meet is not None or size >= len(right):
                meet = len(right) if meet is None else meet
                skip = len(self.until(head, meet))
                return left_ids[:keep] + self.until(tail + head, len(tail) + meet) + right_ids[skip:]
            size *= 4


def encoder(name: str, folder: str = TOKENIZERS) -> Encoder:
    """The process's encoder of a vocabulary in a folder that this process can read."""
    return loaded(f"{folder}/{name}", lambda: vocabulary_bytes(name, folder))


def vocabulary_bytes(name: str, folder: str) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def loaded(key: str, data: Callable[[], bytes]) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(data())
    return _encoders[key]


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, piece: int = PIECE) -> DataFrame:
    """(id_col, ids): every row's ids, without special tokens, whose strings count as ordinary text. Null and empty texts have
    an empty list. Rows are kept as they are, repeated ids included; texts longer than `piece` characters are encoded in
    pieces that different tasks may take."""
    # the driver reads the file once and ships it: under 1 MB, whatever the data
    shipped, key = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary, folder)), f"{folder}/{vocabulary}"
    src = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def short(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = loaded(key, lambda: shipped.value)
        for p in parts:
            yield pd.DataFrame({id_col: p[id_col], "ids": [enc.text(t) for t in p["text"]]})

    def pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = loaded(key, lambda: shipped.value)
        for p in parts:
            p["ids"] = [enc.text(t) for t in p["part"]]
            yield p

    def joined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = loaded(key, lambda: shipped.value)
        for p in parts:
            out = []
            for xs in p["xs"]:
                nodes = [(x["part"], list(x["ids"])) for x in xs]
                while len(nodes) > 1:  # neighbours in pairs: a tree
                    nodes = [(a[0] + b[0], enc.stitch(a[0], a[1], b[0], b[1])) for a, b in zip(nodes[::2], nodes[1::2])] + nodes[len(nodes) - len(nodes) % 2 :]
                out.append(nodes[0][1])
            yield pd.DataFrame({id_col: p[id_col], "ids": out})

    kind = df.schema[id_col].dataType.simpleString()
    one = src.where(F.length("text") <= piece).mapInPandas(short, f"`{id_col}` {kind}, ids array<int>")
    long = src.where(F.length("text") > piece).withColumn("row", F.monotonically_increasing_id())
    cut = long.select(id_col, "row", F.posexplode(F.expr(f"transform(sequence(0, int((length(text) - 1) / {piece})), i -> substring(text, i * {piece} + 1, {piece}))")).alias("n", "part"))
    cut = cut.repartition(F.xxhash64("row", "n")).mapInPandas(pieces, f"`{id_col}` {kind}, row long, n int, part string, ids array<int>")
    lists = cut.groupBy(id_col, "row").agg(F.array_sort(F.collect_list(F.struct("n", "part", "ids"))).alias("xs")).drop("row")
    return one.unionByName(lists.mapInPandas(joined, f"`{id_col}` {kind}, ids array<int>"))
