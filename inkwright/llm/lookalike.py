"""Text that looks the same in one consistent form.

Compatibility forms become plain, characters without width go, spaces and hyphens become one kind each. Then every token is
a lattice: each letter may stand for any letter of the same shape in another script. The form that counts is the path with
the best score by Viterbi: a bigram model of letters over all texts, plus a price for changing the script inside a token.
The lattice depends only on the shapes, so tokens written with other letters of the same shapes get the same path. A few
letters look like letters of two shapes; for these the best path decides which shape is meant, token by token.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwright.operators.scale import join_hot, join_split, stage

# Letters of one shape in different scripts (Latin, then Greek, Cyrillic, Armenian, Coptic, Cherokee, Lisu; Han,
# then kana).
SHAPES = (
    "AΑАᎪꓮⲀ BΒВᏴꓐⲂ CϹСᏟꓚⲤ DᎠꓓ EΕЕᎬꓰ FϜꓝ GԌᏀꓖ HΗНᎻꓧⲎ IΙІӀꓲⲒ JͿЈᎫꓙ KΚКᏦꓗⲔ LᏞꓡ MΜМᎷꓟⲘ NΝꓠⲚ OΟОՕꓳⲞ PΡРᏢꓑⲢ QԚ RᎡꓣ SЅՏᏚꓢ TΤТᎢꓔⲦ "
    "UՍꓴ VᏙꓦѴ WԜᎳꓪ XΧХꓫⲬ YΥҮꓬⲨ ZΖᏃꓜ "
    "aа cϲсⲥ dԁ eе gɡց hһհ iі jϳј nո oοоօⲟ pрⲣ qԛզ sѕ uս vνѵ wԝ xхⲭ yу lӏ ΓГⲄ ΠПⲠ ΦФⲪ ΛЛ "
    "口ロ 工エ 力カ 二ニ 卜ト 夕タ 八ハ 三ミ"
).split()
# Letters that look like one of several shapes, by the first letter of each.
EITHER = {"ɑ": "aα", "ĸ": "κк"}
HYPHENS = "‐‑‒⁃˗−﹣－֊᠆"
#: Compatibility forms that look different from their plain letter.
APART = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")
#: Log price of a change of script between neighbours in a token.
SCRIPT_PRICE = -6.0

_BETWEEN = re.compile("([ -])")
_CLASS = {c: s for s in SHAPES for c in s}
#: What a shape may stand for.
_READINGS = _CLASS | {c: "".join(_CLASS.get(x, x) for x in xs) for c, xs in EITHER.items()}


def script(c: str) -> str:
    """Latin, Greek, ... by the character's name; empty for digits, marks and signs, which go with every script."""
    return unicodedata.name(c, "").split(" ")[0] if unicodedata.category(c)[0] == "L" else ""


def _plain(c: str) -> str:
    if c in HYPHENS:
        return "-"
    if unicodedata.category(c) == "Zs" or c in "\t\n\r\v\f\x85":
        return " "
    if unicodedata.decomposition(c).startswith(APART):
        return c
    return unicodedata.normalize("NFKD", c)


def _ignorable(c: str) -> bool:
    """Characters without width: format characters, selectors, fillers, controls."""
    o = ord(c)
    return unicodedata.category(c) in ("Cf", "Cc") and c not in "\t\n\r\v\f\x85" or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


@lru_cache(maxsize=200_000)
def _char(c: str) -> str:
    return "" if _ignorable(c) else _plain(c)


def compatible(text: str) -> str:
    """Normalized for compatibility, marks apart from their letters and in their fixed order."""
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFD", "".join(map(_char, text)))


def shape(token: str) -> str:
    """One letter for each shape: the first of its class."""
    return "".join(_CLASS.get(c, c)[0] for c in token)


def bucket(c: str) -> str:
    """A letter as the model counts it: ideographs without a look-alike are one, which bounds the model by the alphabets."""
    return "㐀" if c not in _READINGS and ("㐀" <= c <= "鿿" or c > "\uffff") else c


class Lattice:
    """Viterbi over look-alike letters, under bigram counts {(a, b): n} of the texts' own letters."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        total: dict[str, int] = {}
        for (a, _), n in counts.items():
            total[a] = total.get(a, 0) + n
        self.counts, self.total = counts, total
        self.best = lru_cache(maxsize=500_000)(self._best)
        self.known = lru_cache(maxsize=500_000)(self.word)

    def _step(self, a: str, b: str) -> float:
        left, right = bucket(a), bucket(b)
        score = math.log((self.counts.get((left, right), 0) + 0.1) / (self.total.get(left, 0) + 100))
        x, y = script(a), script(b)
        return score + (SCRIPT_PRICE if x and y and x != y else 0.0)

    def _best(self, token: str) -> str:
        """The best path of a token given by its shapes; ties go to the class's first letter."""
        paths = {"^": (0.0, "")}
        for c in token:
            paths = {y: max(((s + self._step(x, y), p + y) for x, (s, p) in paths.items()), key=lambda t: t[0]) for y in _READINGS.get(c, c)}
        return max(paths.items(), key=lambda t: t[1][0])[1][1]

    def word(self, token: str) -> str:
        return self.best(shape(token)) if token else token

    def form(self, text: str | None) -> str:
        if not text:
            return ""
        plain = compatible(text)
        parts = _BETWEEN.split(plain)
        parts[::2] = [self.known(w) for w in parts[::2]]
        out = "".join(parts)
        return out if out.isascii() else unicodedata.normalize("NFC", out)


def bigrams(texts: DataFrame, columns: list[str]) -> dict[tuple[str, str], int]:
    """Counts of neighbouring letters over all texts, in their compatible form. Only pairs that touch a letter with look-alikes
    matter to a path, so at most one row per such pair comes to the driver: a bound given by the alphabets (see `bucket`), not
    by the data's size."""

    @F.pandas_udf("string")
    def plain(words: pd.Series) -> pd.Series:
        return words.map(lambda w: w if w.isascii() and w.isprintable() else "".join(map(bucket, compatible(w))))

    letters = "".join(sorted({*_READINGS, *"".join(_READINGS.values())}))
    words = texts.select(F.explode(F.split(F.concat_ws(" ", *columns), r"[\s\-]+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = words.select("n", F.explode(F.split(plain("w"), "[ -]+")).alias("w"))
    w = F.concat(F.lit("^"), F.col("w"))
    pairs = words.where("length(w) > 0").select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).alias("p"))
    counted = pairs.where(F.length(F.translate("p", letters, "")) < 2).groupBy("p").agg(F.sum("n").alias("n"))
    return {(r.p[0], r.p[1]): r.n for r in counted.toLocalIterator()}


def consistent(df: DataFrame, columns: list[str], suffix: str = "_form") -> DataFrame:
    """`df` with the consistent form of each of `columns` beside it. Null stays apart from text only in the column itself: its
    form is the empty text. Whole texts of any length are formed."""
    counts = df.sparkSession.sparkContext.broadcast(bigrams(df, columns))

    @F.pandas_udf("string")
    def form(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(counts.value)
        for s in parts:
            known = {t: lattice.form(t) for t in s.dropna().unique()}
            yield s.map(known).fillna("")

    return df.select("*", *(form(F.col(c)).alias(c + suffix) for c in columns))


def lookalike_pairs(corpus: DataFrame) -> DataFrame:
    """(term_id_1, term_id_2): rows of one file and field that look alike in en and zh but differ in their characters in either.
    Null counts as empty text; a null file or field is one of its own. Rows written exactly alike are one class; the classes of
    a look are paired, then give way to their rows, the smaller class first, so that no join pairs rows that differ in nothing."""
    rows = corpus.select("term_id", "file_name", "field", F.coalesce("en", F.lit("")).alias("en"), F.coalesce("zh", F.lit("")).alias("zh")).where("term_id is not null")
    key = lambda *cs: F.unhex(F.md5(F.to_json(F.struct(*cs), {"ignoreNullFields": "false"})))
    keyed = stage(consistent(rows, ["en", "zh"]).select("term_id", key("file_name", "field", "en_form", "zh_form").alias("k"), key("file_name", "field", "en", "zh").alias("c")), "looks")
    classes = keyed.groupBy("k", "c").agg(F.count("*").alias("rows"))
    mixed = classes.groupBy("k").agg(F.count("*").alias("c"), F.sum("rows").alias("n")).where("c > 1").select("k", "n")
    some = stage(join_hot(keyed, mixed, ["k"], "n", keyed.count()).select("term_id", "k", "c"), "alike")
    sizes = some.groupBy("k", "c").agg(F.count("*").alias("n"))
    a, b = sizes.select("k", F.struct("n", "c").alias("a")), sizes.select("k", F.struct("n", "c").alias("b"))
    pairs = a.join(b, "k").where(F.col("a") < F.col("b")).select(F.col("a.c").alias("c1"), F.col("b.c").alias("c2"))
    one = join_split(pairs, some.select(F.col("c").alias("c1"), F.col("term_id").alias("t1")), ["c1"]).select("c2", "t1")
    both = join_split(one, some.select(F.col("c").alias("c2"), F.col("term_id").alias("t2")), ["c2"]).where("t1 <> t2")
    return both.select(F.least("t1", "t2").alias("term_id_1"), F.greatest("t1", "t2").alias("term_id_2")).distinct()
