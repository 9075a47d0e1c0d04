"""Quality rules: clean a text line by line first, then judge what is left.

Every line that has a word is held against the line rules below; lines that
fail are removed. A document is rejected when the removed lines held more than
``most_lost`` of its words, or when a base rule for the whole text fails (too
few words, or too many words inside windows of eight that occur again).

Results in special cases: null and empty texts have no words, so they fail the
base rules; repeated rows are judged each on its own; an empty table gives no
rows; extra columns don't matter. Texts of any length are judged whole; the work
for one text is linear in its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spark_analog.llm.common import Codes, annotate, chain, word_hash

SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"
_INNER = bytes(range(0x80, 0xC0))  # bytes that only continue a code point
_END = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "]", "。", "！", "？", "।", "؟")
_SEPARATORS = frozenset("|>»›•·/\\<«‹-–—→")
#: Words of menus and page furniture.
NAVIGATION = re.compile(
    r"^\W*(home|menu|search|log ?in|log ?out|sign (in|up)|register|next|previous|prev|back( to top)?"
    r"|read more|more|contact( us)?|about( us)?|share( this)?|print|sitemap|skip to content|top)\W*$",
    re.I)
#: Phrases of page furniture and legal lines.
BOILERPLATE = re.compile(
    r"all rights reserved|cookie (policy|settings)|(uses?|accept) cookies|enable javascript"
    r"|javascript (is )?(disabled|required)|terms (of|and) (use|service|conditions)|privacy policy"
    r"|lorem ipsum|subscribe to our|sign up for our|copyright (©|\(c\)|\d{4})|©\s*\d{4}"
    r"|licensed under|click here|powered by", re.I)


@dataclass(frozen=True)
class Rules:
    """``short``: a line of fewer words must end like a sentence. ``symbol_share``:
    symbols over word characters. ``shout_share``: words ending in two or more
    marks such as ``!!`` or ``%%%``, over the words of a line (of ``long`` words
    or more). ``bar_share``: separators that stand alone, over a line's words."""
    short: int = 4
    long: int = 5
    symbol_share: float = 0.2
    shout_share: float = 0.3
    bar_share: float = 0.2
    most_lost: float = 0.5
    least_words: int = 20
    repeat_percent: int = 30
    repeat_window: int = 8


FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_bad_lines", T.LongType()), T.StructField("n_lost_words", T.LongType()),
    T.StructField("kept", T.BooleanType()), T.StructField("clean_text", T.StringType())])


_MARKED = re.compile(rb"[!?#*$%&]{2,}$")


def line_fault(line: bytes, found: list[bytes], rules: Rules) -> str | None:
    """Name of the first rule that a line (with at least one word) breaks."""
    n = len(found)
    alone = sum(1 for w in found if len(w) <= 3 and w.decode("utf-8", "replace") in _SEPARATORS)
    text = line.decode("utf-8", "replace").strip()
    if alone and alone >= rules.bar_share * n or NAVIGATION.match(text):
        return "navigation"
    if BOILERPLATE.search(text):
        return "boilerplate"
    marks = len(line) - len(line.translate(None, SYMBOLS))
    if marks > rules.symbol_share * max(1, sum(map(len, found)) - marks):
        return "symbols"
    if n >= rules.long and sum(1 for w in found if _MARKED.search(w)) > rules.shout_share * n:
        return "marks"
    if n < rules.short and not text.endswith(_END):
        return "punctuation"
    return None


def repeat_words(codes: np.ndarray, width: int) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    windows = chain(codes, width)
    if len(windows) < 2:
        return 0
    _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge(text: bytes | None, rules: Rules, codes: Codes, with_text: bool = True) -> tuple:
    text = text or b""
    found = text.split()
    n = len(found)
    chars = len(text.translate(None, _BLANK + _INNER))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    twice = bad = lost = 0
    good = []
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            good.append(line)
            continue
        twice += line in seen
        seen.add(line)
        if line_fault(line, own, rules):
            bad += 1
            lost += len(own)
        else:
            good.append(line)
    again = repeat_words(codes.of(found), rules.repeat_window)
    failed = n < rules.least_words or 100 * again > rules.repeat_percent * n
    kept = not failed and lost <= rules.most_lost * n
    clean = b"\n".join(good).decode("utf-8", "replace") if with_text else None
    return n, chars, symbols, twice, again, failed, bad, lost, kept, clean


def kernel(rules: Rules = Rules(), with_text: bool = True):
    def make():
        codes = Codes(word_hash)

        def run(texts):
            rows = [judge(t, rules, codes, with_text) for t in texts]
            return {f.name: [r[i] for r in rows] for i, f in enumerate(FIELDS)}
        return run
    return make


def clean(docs: DataFrame, rules: Rules = Rules(), text: str = "text",
          keep: list[str] | None = None, with_text: bool = True) -> tuple[DataFrame, str]:
    """``docs`` with a struct of the base figures, the verdict and the cleaned text."""
    return annotate(docs, kernel(rules, with_text), FIELDS, text, "rules", keep)
