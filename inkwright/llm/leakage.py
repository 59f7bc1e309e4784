"""Test passages inside training text, by winnowing.

Texts are sequences of words without case. Of every window of WINDOW neighbouring K-grams the one with the least hash is
kept, so two texts that share a run of WINDOW + K - 1 words keep at least one K-gram of it in common, at the same place of the
run. A kept gram carries the words around it, as far as a run through it can reach, so that a hit is decided where it is met:
the words of both sides are compared outward from the gram, and no text is read again.

The grams of the items are held by every task while they are few (bytes are counted); the corpus then doesn't move. Beyond
that, grams of both sides meet in a shuffle and carry their words with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwright.operators.scale import join_split, stage

#: Words in a run that counts; words in a gram; grams in a window, such that WINDOW + K - 1 = RUN.
RUN, K = 12, 5
#: Items whose kept grams, with the words around them, take up to this many bytes are held by every task.
HELD = 64 << 20
#: Documents' characters looked at together.
AT_ONCE = 2_000_000
# Characters without width.
NO_WIDTH = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_text(text: str) -> str:
    import re
    import unicodedata

    if not text.isascii():
        text = unicodedata.normalize("NFC", re.sub(f"[{NO_WIDTH}]", "", text))
    return text.casefold()


def words(text: str) -> list[str]:
    """Runs of letters and digits, without case and characters without width."""
    import re

    return re.findall(r"[^\W_]+", word_text(text))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of all texts, and how many words each text has."""
    import xxhash

    known: dict[str, int] = {}
    out, count = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        ws = words(t)
        count[i] = len(ws)
        for w in ws:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
    return np.array(out, np.uint64), count


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    g = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            g = (g ^ h[j : len(h) - k + 1 + j]) * _BASE
            g ^= g >> np.uint64(29)
    return g


def fingerprints(texts: list[str], k: int = K, run: int = RUN, hashed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word position, hash) of the kept grams. Ties keep the rightmost. Texts shorter than a run have none."""
    h, count = hashed or word_hashes(texts)
    window = run - k + 1
    grams = _grams(h, k)
    n = len(grams) - window + 1
    if n <= 0:
        return (np.array([], np.int64),) * 2 + (np.array([], np.uint64),)
    at = np.arange(n)
    best, where = grams[:n].copy(), at.copy()
    for j in range(1, window):
        other = grams[j : n + j]
        less = other <= best
        best[less], where[less] = other[less], at[less] + j
    start = np.concatenate([[0], np.cumsum(count)])
    of = np.searchsorted(start, at, side="right") - 1
    inside = at + run <= start[of + 1]
    kept = np.unique(where[inside])
    of = np.searchsorted(start, kept, side="right") - 1
    return of, kept - start[of], grams[kept]


def around(h: np.ndarray, text_of: np.ndarray, of: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """The word hashes around each kept gram, `reach` to its left and right; 0 beyond the text's ends."""
    width = 2 * reach + K
    cols = at[:, None] + np.arange(-reach, width - reach)
    inside = (cols >= 0) & (cols < len(h))
    cols = np.clip(cols, 0, max(len(h) - 1, 0))
    return np.where(inside & (text_of[cols] == of[:, None]), h[cols], np.uint64(0))


def run_lengths(a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """For each pair of surroundings, how many words in a row agree through the gram in the middle."""
    same = (a == b) & (a != 0)
    core = same[:, reach : len(a[0]) - reach].all(axis=1) if len(a) else np.zeros(0, bool)
    left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(axis=1) if reach else 0
    right = np.cumprod(same[:, len(same[0]) - reach :], axis=1).sum(axis=1) if reach and len(a) else 0
    return np.where(core, left + right + K, 0) if len(a) else np.zeros(0, np.int64)


def kept_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, surroundings) of the kept grams of all texts."""
    reach = RUN - K
    h, count = word_hashes(texts)
    of, at, grams = fingerprints(texts, hashed=(h, count))
    start = np.concatenate([[0], np.cumsum(count)])
    return of, grams, around(h, np.repeat(np.arange(len(texts)), count), of, at + start[of], reach)


def _batches(p: pd.DataFrame) -> Iterator[pd.DataFrame]:
    size = p["text"].str.len().cumsum() // AT_ONCE  # few long texts at once
    for _, q in p.groupby(size):
        yield q


def _gram_rows(df: DataFrame, key: str, kind: str, ctx: str) -> DataFrame:
    """(key, gram, ctx): the kept grams of each text with the words around them, as bytes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for q in _batches(p):
                of, grams, ctxs = kept_grams(q["text"].tolist())
                yield pd.DataFrame({key: q[key].to_numpy()[of], "gram": grams.view(np.int64), ctx: [c.tobytes() for c in ctxs]})

    return df.where(F.length("text") > 0).mapInPandas(run, f"`{key}` {kind}, gram long, `{ctx}` binary")


def leaked_items(documents: DataFrame, items: DataFrame, held: int = HELD) -> DataFrame:
    """(doc_id, item_id): documents that hold at least RUN consecutive words of an item. Null and empty texts hold nothing;
    an item or document of fewer words than a run takes part in no pair; repeated ids give one pair."""
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    tests = items.select("item_id", "text").where("item_id is not null and text is not null")
    dk, ik = docs.schema["doc_id"].dataType.simpleString(), tests.schema["item_id"].dataType.simpleString()
    reach, width = RUN - K, 8 * (2 * (RUN - K) + K)
    wanted = stage(_gram_rows(tests, "item_id", ik, "own").distinct(), "prints")
    if wanted.count() * (width + 24) <= held:
        rows = wanted.orderBy("gram").toPandas()  # within `held` bytes
        shared = documents.sparkSession.sparkContext.broadcast((rows["gram"].to_numpy(np.int64), rows["item_id"].to_numpy(), np.frombuffer(b"".join(rows["own"]), np.uint64).reshape(len(rows), width // 8)))

        def found(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grams, ids, own = shared.value
            for p in parts:
                for q in _batches(p):
                    of, kept, ctx = kept_grams(q["text"].tolist())
                    kept = kept.view(np.int64)
                    lo, hi = np.searchsorted(grams, kept, side="left"), np.searchsorted(grams, kept, side="right")
                    out = set()
                    hits, many = np.flatnonzero(hi > lo), (hi - lo)
                    for part in np.array_split(hits, max(1, int(many[hits].sum()) // 200_000 + 1)) if len(hits) else []:  # bounds the pairs in memory
                        one = np.repeat(part, many[part])
                        two = np.arange(len(one)) - np.repeat(np.cumsum(many[part]) - many[part], many[part]) + np.repeat(lo[part], many[part])
                        good = run_lengths(ctx[one], own[two], reach) >= RUN
                        out |= set(zip(of[one[good]].tolist(), two[good].tolist()))
                    pairs = sorted(out)
                    yield pd.DataFrame({"doc_id": q["doc_id"].to_numpy()[[i for i, _ in pairs]], "item_id": ids[[j for _, j in pairs]]}).drop_duplicates()

        return docs.where(F.length("text") > 0).mapInPandas(found, f"doc_id {dk}, item_id {ik}").distinct()

    met = join_split(_gram_rows(docs, "doc_id", dk, "ctx"), wanted, ["gram"])

    @F.pandas_udf("boolean")
    def runs(ctx: pd.Series, own: pd.Series) -> pd.Series:
        both = [np.frombuffer(b"".join(x), np.uint64).reshape(len(x), width // 8) for x in (ctx, own)]
        return pd.Series(run_lengths(*both, reach) >= RUN)

    return met.where(runs("ctx", "own")).select("doc_id", "item_id").distinct()
