"""Quality rules: base counts, then divergence from a language reference.

Pass 1 reads every document and sums, per reference language, two histograms of each document that passes
the base rule: character classes, and common words against all other words. Every document has the
same say, whatever its length. Pass 2 compares each document with its language's reference by the
Jensen-Shannon distance (base 2, 0 to 1) and rejects it if

* the character distance exceeds ``char_limit`` and the text has ``min_chars`` code points at least, or
* the word distance exceeds the language's word limit and it has the language's least number of words.

The word limit is ``word_share`` of the distance that a text without any common word has from the language's reference, so it
follows from the whole corpus and bites whatever part common words have there. The least number of words is ``MIN_WORDS``,
or more where common words are rarer: ``MIN_COMMON`` of them must be expected, else a good text is as far off by chance.

References cover the languages of ``COMMON``, and one more that pools all other documents, which is compared
by characters only; they are a few dozen integers each, whatever the input. Sums are of integers, so
reruns agree. A language without documents has no reference and rejects nothing.

Words are ``[^\\x20\\x09-\\x0D]+``. Null or empty texts have no words and fail the base rule; rows with null or
repeated ``doc_id`` are judged each on its own; an empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import WHITE, column, keep, slices

# Frequent function words of each language.
COMMON = {
    "en": "the of and to in a is that it as for was with on be by at this are or".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus pas".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
OTHER = "other"
CLASSES = 5
"""Numbers and lower-case or caseless letters, upper-case letters, white space and controls, prose punctuation, other signs."""
PROSE = ".,;:'\"?()-"
SYMBOLS = "#*$%&|<>"
CHAR_LIMIT, WORD_SHARE, MIN_CHARS, MIN_WORDS, MIN_COMMON = 0.135, 0.8, 200, 100, 24
PARTS = 1_000_000


def class_table() -> np.ndarray:
    """Class of each code point of the basic plane; the rest count as letters."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        if kind in ("Lu", "Lt"):
            out[c] = 1
        elif kind[0] in "ZC":
            out[c] = 2
        elif kind[0] in "PS":
            out[c] = 3 if chr(c) in PROSE else 4
    return out


def char_histogram(text: str) -> np.ndarray:
    table = keep("char_classes", class_table)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(table[np.where(points < 1 << 16, points, 97)], minlength=CLASSES)


def common_forms(lang: str) -> list[list[bytes]]:
    """Ways in which each common word is met: plain or capital, with a prose sign after it or not."""
    return [[f.encode() for w in (word, word.capitalize()) for f in (w, w + ",", w + ".", w + ";", w + ":")] for word in COMMON[lang]]


def word_histogram(counts: dict[bytes, int], total: int, lang: str) -> np.ndarray | None:
    if lang not in COMMON:
        return None
    seen = [sum(counts.get(f, 0) for f in forms) for forms in keep(("common", lang), lambda: common_forms(lang))]
    return np.array([*seen, total - sum(seen)])


def base_counts(text: bytes) -> tuple[dict[str, int], dict[bytes, int]]:
    """The base counts of a text and how often each of its words occurs."""
    words = text.split()
    chars = text.decode("utf-8", "replace")
    white = sum(text.count(bytes([c])) for c in WHITE)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    repeated = 0
    if len(ids) >= 3:
        pairs = ids[:-1] * len(number) + ids[1:]
        pairs = np.unique(pairs, return_inverse=True)[1]
        _, back, n = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        again = n[back] > 1
        mark = np.zeros(len(ids), bool)
        for shift in range(3):
            mark[shift:len(again) + shift] |= again
        repeated = int(mark.sum())
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    counts = dict(zip(number, np.bincount(ids, minlength=len(number)).tolist())) if len(ids) else {}
    return {"n_words": len(words), "word_chars": len(chars) - white, "n_symbols": sum(text.count(s.encode()) for s in SYMBOLS),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated}, counts


def fails_base(c: dict[str, int]) -> bool:
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = sum(np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q)) / 2
    return float(np.sqrt(max(0.0, d)))


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray | None]]:
    """Per language the summed histograms of characters and common words over (text, lang)."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    c, words = base_counts(text)
                    if fails_base(c):
                        continue
                    lang = lang if lang in COMMON else OTHER
                    own = [char_histogram(text.decode("utf-8", "replace")), word_histogram(words, c["n_words"], lang)]
                    vector = np.concatenate([np.rint(h * (PARTS / h.sum())).astype(np.int64) for h in own if h is not None])
                    total[lang] = total.get(lang, 0) + vector
        rows = [(g, i, int(v)) for g, t in total.items() for i, v in enumerate(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))],
                                         names=["lang", "place", "parts"])

    got = docs.mapInArrow(sums, "lang string, place int, parts long").groupBy("lang", "place").agg(F.sum("parts").alias("parts"))
    vectors: dict[str, dict[int, int]] = {}
    for r in got.collect():  # (languages of COMMON + 1) * a few dozen numbers
        vectors.setdefault(r["lang"], {})[r["place"]] = r["parts"]
    out = {}
    for lang, v in vectors.items():
        full = np.array([v[i] for i in range(len(v))], np.float64)
        out[lang] = full[:CLASSES], full[CLASSES:] if lang in COMMON else None
    return out


def word_bounds(refs: dict, word_share: float = WORD_SHARE) -> dict[str, tuple[float, float]]:
    """Per language of ``COMMON`` the word limit and the least number of words; none where no common word was met."""
    out = {}
    for lang, (_, common) in refs.items():
        if common is not None and common[:-1].sum() > 0:
            bare = np.zeros(len(common))
            bare[-1] = 1
            out[lang] = word_share * distance(bare, common), max(MIN_WORDS, MIN_COMMON * common.sum() / common[:-1].sum())
    return out


def verdict(text: str, c: dict[str, int], words: dict[bytes, int], lang: str | None, refs: dict,
            bounds: dict[str, tuple[float, float]], char_limit: float = CHAR_LIMIT) -> tuple[float, float, bool]:
    """Character distance, word distance and whether the document is near its language's reference."""
    lang = lang if lang in COMMON else OTHER
    chars, common = refs.get(lang, (None, None))
    word_limit, least = bounds.get(lang, (1.0, float("inf")))
    dc = distance(char_histogram(text), chars) if chars is not None and len(text) >= MIN_CHARS else 0.0
    dw = distance(word_histogram(words, c["n_words"], lang), common) if c["n_words"] >= least else 0.0
    return dc, dw, dc <= char_limit and dw <= word_limit


def judge(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_share: float = WORD_SHARE, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of ``docs`` under ``doc``, then the base counts, base_failed, char_distance, word_distance and kept."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    lang = F.col(lang_col).cast("string").alias("lang")
    refs = references(docs.select(text, lang))
    bounds = word_bounds(refs, word_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    c, words = base_counts(text)
                    failed = fails_base(c)
                    dc, dw, near = (0.0, 0.0, False) if failed else verdict(
                        text.decode("utf-8", "replace"), c, words, lang, refs, bounds, char_limit)
                    rows.append((*c.values(), failed, dc, dw, near))
                cols = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([part.column("doc"), *cols], names=["doc", *names])

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance",
             "word_distance", "kept"]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("doc"), text, lang)
    found = T.StructType.fromDDL("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                 "base_failed boolean, char_distance double, word_distance double, kept boolean")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *found]))
