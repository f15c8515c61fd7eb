"""Keyword-stuffed and link-list pages (problem 9).

A text is cut at the punctuation that ends sentences into what stands in sentences
and the rest, and both into blocks. Each block is compressed by itself after what
varies in any list is reduced to a mark each: links, tags, numbers and names. What counts is
its ratio (compressed bytes to characters) against the usual ratio of blocks of the same
length and language in the whole corpus. A block far below is extremely redundant: repeated
keywords and phrases, and lists of links, tags and product rows, whose forms repeat. Redundancy
is confirmed by low density of sentence punctuation: only blocks outside sentences count. A
page is flagged if such blocks cover more than half of its characters.

Prose or verse without full stops lies outside sentences but isn't redundant; a review
that says the same sentence again and again is redundant but lies in sentences. Neither is flagged.

The language is the lang column's where that is two letters that mostly come with the text's
writing system; else the writing system, read off the letters, stands for it.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import materialize

#: Characters of a block; the rest of a text under SHORT characters (half as many without spaces) isn't measured.
BLOCK, SHORT = 600, 40
#: Redundant: ratio under REDUNDANT times the usual one.
REDUNDANT = 0.9
#: Longest sentence in characters, and in the scripts without spaces.
SENTENCE, SENTENCE_CJK = 240, 130
#: Least share of different words of a sentence (pairs of letters in scripts without spaces), and of those that the
#: KEPT stretches before it don't have.
DISTINCT, FRESH, KEPT = 0.55, 0.35, 3
#: Texts of fewer characters are remarks, no pages (characters of scripts without spaces count twice).
REMARK = 120
#: A text cut off in a sentence: rest without an end, of at most so many characters after a sentence.
REST = 110
#: Width of the length classes, steps of the histogram of ratios, blocks that make a baseline of their own.
CLASS, STEPS, ENOUGH = 60, 400, 30
#: Baseline of a class with fewer blocks.
USUAL = 0.55

# Forms of layout tags, links and tags, and of the marks that end a sentence.
_BREAK = r"</?(?:p|br|div|li|ul|ol|b|i|em|strong|span|tr|td)\b[^>]{0,60}>"
_DOT = r"(?:\.|\s?\[\.\]\s?|\s?\(dot\)\s?|\s\.\s)"
_LINK = rf"<a\b[^>]*>|</a>|\p{{L}}{{2,8}}://\S+(?:{_DOT}[\p{{Ll}}\d-]++)*+(?:/\S*)?|(?<![\p{{L}}\d-])[\p{{L}}\d-]++(?:{_DOT}[\p{{Ll}}\d-]{{2,}}+)++(?:/\S*)?"
_MAYBE = r"[^\W_]\.[^\W_]|\[\.\]|\(dot\)| \. |://|<a|</a"  # no link without one of these
_TAG = r"(?<![\p{L}\d])(?:[@#][\p{L}\d_'’-]++)++"
_END = r"""(?<=[^\s.,;:|/])\s?[.!?؟。！？…]+["'»”)’]*(?=\s|$)|[。！？؟]|\n+|(?<=[\p{Ll}\p{Lo}]{2})[.!?](?=\p{Lu})"""
_WORD = r"\p{L}[\p{L}\p{M}'’-]*"
_NUMBER = r"\d+(?:[.,:]\d+)*"
_NAME = r"(?<!\p{L})\p{Lu}\p{Ll}[\p{L}\p{M}'’]*"
_SPLIT = r"(?<=\p{L})[*_.-](?=\p{L})"

# Letters of the writing systems, as ranges of code points.
_RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "cyrillic": ((0x400, 0x52F),),
    "arabic": ((0x620, 0x64A), (0x66E, 0x6D3), (0x750, 0x77F), (0x8A0, 0x8C9), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)),
    "cjk": ((0xE01, 0xE3A), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D)),
}
_SCRIPTS = list(_RANGES)
_KIND = np.zeros(0x10001, np.int8)
for _i, _ranges in enumerate(_RANGES.values()):
    for _a, _b in _ranges:
        _KIND[_a : _b + 1] = _i + 1


class Judge:
    """The blocks and measures of one text; baseline: (writing system, language, length class) -> usual ratio."""

    def __init__(self, baseline: dict[tuple[str, str, int], float] | None = None) -> None:
        import regex

        self.baseline = baseline or {}
        self.brk = regex.compile(_BREAK, regex.I)
        self.maybe, self.control = re.compile(_MAYBE, re.I), re.compile("[\x80-\x9f]")
        self.runs = re.compile("\x01+|\x03+")
        self.link, self.tag, self.end, self.word, self.number, self.name, self.split = (regex.compile(p) for p in (_LINK, _TAG, _END, _WORD, _NUMBER, _NAME, _SPLIT))

    def plain(self, text: str) -> str:
        """Without layout tags; UTF-8 that was read as Latin-1 is read again."""
        if self.control.search(text):
            try:
                text = text.encode("latin-1").decode("utf-8")
            except UnicodeError:
                pass
        return self.brk.sub("\n", text).strip()

    def script(self, text: str) -> str:
        """The writing system of most letters; "other" without any."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _KIND[np.minimum(c, len(_KIND) - 1)]
        n = np.bincount(kind, minlength=len(_SCRIPTS) + 1)[1:]
        return _SCRIPTS[int(n.argmax())] if n.any() else "other"

    def marked(self, text: str) -> str:
        """The text with every character of a link or tag replaced by a mark."""
        text = text.replace("\x01", " ").replace("\x03", " ")
        if self.maybe.search(text):
            text = self.link.sub(lambda m: "\x01" * len(m.group()), text)
        return self.tag.sub(lambda m: "\x03" * len(m.group()), text)

    def form(self, text: str) -> str:
        """A marked text with one mark for each link, tag, name and number, in lower case, words in one piece."""
        t = self.runs.sub(lambda m: m.group()[0], text)
        return self.number.sub("0", self.split.sub("", self.name.sub("\x02", t))).lower()

    def ratio(self, block: str) -> float:
        """Bytes of the compressed form of a block for each of its characters."""
        z = zlib.compressobj(9, zlib.DEFLATED, -12, 7)
        return (len(z.compress(self.form(block).encode("utf-8", "surrogatepass"))) + len(z.flush())) / max(1, len(block))

    def sentences(self, text: str, script: str) -> np.ndarray:
        """Mask of the characters of a marked text that lie in sentences: of bounded length, mostly no links, of at least
        three words (five characters without spaces) that vary and differ from those before, up to a mark that a small letter doesn't follow."""
        inside = np.zeros(len(text), bool)
        longest, cjk = (SENTENCE_CJK, True) if script == "cjk" else (SENTENCE, False)
        at = 0
        before: deque[set[str]] = deque(maxlen=KEPT)
        few = lambda part: (part.count("\x01") + part.count("\x03")) * 2 < len(part)
        for m in self.end.finditer(text):
            b = m.end()
            ends = "\n" not in m.group()
            if ends and text[b : b + 2].strip()[:1].islower():
                continue
            part = text[at:b]
            if b - at <= longest:
                words = [part[i : i + 2] for i in range(len(part) - 1)] if cjk else self.word.findall(part.lower())
                own = set(words)
                if ends and len(words) >= (5 if cjk else 3) and few(part) and len(own) >= DISTINCT * len(words) and len(own.difference(*before)) >= FRESH * len(own):
                    inside[at:b] = True
                before.append(own)
            at = b
        if 0 < at and inside[at - 1] and len(text) - at <= REST and few(text[at:]):
            inside[at:] = True
        return inside

    def blocks(self, text: str | None) -> tuple[int, str, list[tuple[bool, int, float]]]:
        """Characters, writing system, and (outside sentences, characters, ratio) of every block; no blocks of remarks and nulls."""
        t = self.plain(text or "")
        if not t:
            return 0, "other", []
        t = self.marked(t)
        script = self.script(t)
        if len(t) * (2 if script == "cjk" else 1) < REMARK:
            return len(t), script, []
        inside = self.sentences(t, script)
        edge = np.flatnonzero(np.diff(inside)) + 1
        cuts = [0, *edge.tolist(), len(t)]
        out = []
        first = bool(inside[0])
        for kind in (True, False):  # inside, outside
            part = "".join(t[a:b] for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if (first ^ (k % 2 == 1)) == kind)
            if len(part) < (SHORT // 2 if script == "cjk" else SHORT):
                continue
            n = max(1, round(len(part) / BLOCK))
            for i in range(n):
                a, b = i * len(part) // n, (i + 1) * len(part) // n
                out.append((not kind, b - a, self.ratio(part[a:b])))
        return len(t), script, out

    def shares(self, n: int, script: str, lang: str | None, blocks: Iterable[tuple[bool, int, float]]) -> tuple[float, float, float]:
        """Shares of n characters in redundant blocks outside sentences, in redundant blocks, and outside sentences."""
        flagged = redundant = rest = 0
        for outside, size, ratio in blocks:
            low = ratio < REDUNDANT * usual(self.baseline, script, lang, size)
            flagged, redundant, rest = flagged + size * (low and outside), redundant + size * low, rest + size * outside
        return flagged / max(1, n), redundant / max(1, n), rest / max(1, n)

    def measure(self, text: str | None, lang: str | None = None) -> tuple[float, float, float]:
        """shares() of a text; 0 for remarks and nulls."""
        n, script, blocks = self.blocks(text)
        return self.shares(n, script, lang, blocks)


def length_class(n: int) -> int:
    return min(BLOCK + 3 * CLASS, n // CLASS * CLASS)


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The blocks of every row, in one pass: (id_col, chars, script, lang, outside, sizes, ratios) with arrays of the blocks.

    lang is the first two letters of lang_col in lower case, null if it doesn't begin with two letters a to z, or where there is no such column.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for b in batches:
            got = [judge.blocks(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), b.column(1), *(pa.array([[x[i] for x in g[2]] for g in got], pa.list_(k)) for i, k in enumerate((pa.bool_(), pa.int32(), pa.float64())))],
                names=[id_col, "chars", "script", "lang", "outside", "sizes", "ratios"],
            )

    lang = F.nullif(F.lower(F.regexp_extract(lang_col, "^\\s*([A-Za-z]{2})(?![A-Za-z])", 1)), F.lit("")) if lang_col in docs.columns else F.lit(None).cast("string")
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, lang.alias("_lang"), text_col).mapInArrow(f, f"`{id_col}` {kind}, chars bigint, script string, lang string, outside array<boolean>, sizes array<int>, ratios array<double>")


def baselines(blocks: DataFrame) -> dict[tuple[str, str, int], float]:
    """Usual (median) ratio of the blocks in sentences by (writing system, language, length class), language "" for all of a writing system.

    blocks: a table of read(). What reaches the driver is one row per writing system, language (two letters), class and step.
    """
    one = blocks.select("script", F.coalesce("lang", F.lit("")).alias("lang"), F.explode(F.arrays_zip("outside", "sizes", "ratios")).alias("b")).where("NOT b.outside")
    size = F.least(F.lit(BLOCK + 3 * CLASS), F.floor(F.col("b.sizes") / CLASS) * CLASS).cast("int")
    step = F.least(F.lit(STEPS), F.floor(F.col("b.ratios") * (STEPS / 2))).cast("int")
    rows = one.groupBy("script", "lang", size.alias("size"), step.alias("step")).agg(F.count("*").alias("n")).collect()
    of_lang: dict[str, dict[str, int]] = {}
    for r in rows:
        scripts = of_lang.setdefault(r["lang"], {})
        scripts[r["script"]] = scripts.get(r["script"], 0) + r["n"]
    main = {g: max(sorted(s), key=lambda k: s[k]) for g, s in of_lang.items() if g}
    hist: dict[tuple[str, str, int], dict[int, int]] = {}
    for r in rows:
        for lang in {"", r["lang"]} if main.get(r["lang"]) == r["script"] else {""}:
            h = hist.setdefault((r["script"], lang, r["size"]), {})
            h[r["step"]] = h.get(r["step"], 0) + r["n"]
    out = {}
    for key, h in hist.items():
        total, run = sum(h.values()), 0
        for step in sorted(h) if total >= ENOUGH else ():
            run += h[step]
            if run * 2 >= total:
                out[key] = (step + 0.5) / (STEPS / 2)
                break
    return out


def usual(base: dict[tuple[str, str, int], float], script: str, lang: str | None, size: int) -> float:
    """The baseline of a block: of its language, else of its writing system, else of the writing system's nearest class."""
    k = length_class(size)
    for key in ((script, lang or "", k), (script, "", k)):
        if key in base:
            return base[key]
    near = [(abs(c - k), c) for s, g, c in base if s == script and not g]
    return base[script, "", min(near)[1]] if near else USUAL


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Rows (id_col, flagged_share, redundant_share, outside_share), one for each row of docs.

    Shares of the characters in redundant blocks outside sentences, in redundant blocks, and outside sentences.
    Null, empty and blank texts and remarks have shares of 0. Texts are measured
    whole and read once; the baselines come from the written measures of all blocks. Other columns aren't read.
    """
    blocks = materialize(read(docs, id_col, text_col, lang_col), "blocks")
    base = baselines(blocks)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(base)
        for b in batches:
            out = [judge.shares(*row[:3], zip(*row[3:], strict=True)) for row in zip(*(b.column(i).to_pylist() for i in range(1, 7)), strict=True)]
            m = np.array(out, float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[:, i]) for i in range(3))], names=[id_col, "flagged_share", "redundant_share", "outside_share"])

    kind = dict(docs.dtypes)[id_col]
    return blocks.mapInArrow(f, f"`{id_col}` {kind}, flagged_share double, redundant_share double, outside_share double")


def spam_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of measures() with more than half of their characters flagged."""
    return measures(docs, id_col, text_col, lang_col).where("flagged_share > 0.5")
