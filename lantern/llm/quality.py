"""Line-first quality rules: judge every line, drop the failures, then reject documents that lost too much text.

A line with a word fails by
  punctuation  symbols outweigh a tenth of its word characters, exclamation marks exceed a third of its words, or it
               is short and ends without a closing mark;
  navigation   menu separators exceed a quarter of its words;
  boilerplate  it holds a stock phrase (cookies, sign-in, licence and copyright lines, ...);
  repetition   the same line stood earlier in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import prepare, read
from lantern.llm.ngram import Words, pair_key

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
CLOSING = ".!?…:;\"'”’»)]。！？"
# Stock phrases of page furniture, in lower case.
PHRASES = (
    "all rights reserved", "licensed under", "released under the", "copyright (c)", "privacy policy", "cookie policy", "use cookies", "uses cookies",
    "accept cookies", "terms of use", "terms of service", "terms and conditions", "enable javascript", "sign in to", "log in to", "sign up for",
    "subscribe to our", "click here", "read more", "share this", "powered by", "skip to content",
)


@dataclass(frozen=True)
class Rules:
    least_words: int = 50
    #: Per cent of the words that may lie in repeated windows of three.
    most_repeated: int = 50
    #: Lines with fewer words need a closing mark.
    short_line: int = 8
    #: Per cent of the word characters that a document must keep.
    least_kept: int = 50


def line_fails(line: str, words: int, chars: int, rules: Rules) -> bool:
    """By the rules that need no other line."""
    if 10 * sum(map(line.count, SYMBOLS)) > chars or 3 * line.count("!") > words or 4 * sum(map(line.count, SEPARATORS)) > words:
        return True
    if words < rules.short_line and line.rstrip(SPACE)[-1:] not in CLOSING:
        return True
    low = line.lower()
    return any(x in low for x in PHRASES)


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(hashes) < 4:
        return 0
    windows = pair_key(pair_key(hashes[:-2], hashes[1:-1]), hashes[2:])
    order = np.argsort(windows)
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    often = np.zeros(len(windows), dtype=bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    covered = np.zeros(len(hashes), dtype=bool)
    for i in range(3):
        covered[i : i + len(windows)] |= often
    return int(covered.sum())


def judge(text: str, words: Words, rules: Rules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines removed, chars kept, cleaned text."""
    own = text.encode("utf-8", "surrogatepass").split()
    n_words = len(own)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    repeat = repeated_words(np.fromiter(map(words.__getitem__, own), dtype=np.uint64, count=n_words))
    seen: set[str] = set()
    dup = removed = left = 0
    kept_lines = []
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            kept_lines.append(line)
            continue
        size = len(line) - sum(map(line.count, SPACE))
        again = line in seen
        seen.add(line)
        dup += again
        if again or line_fails(line, n, size, rules):
            removed += 1
        else:
            left += size
            kept_lines.append(line)
    failed = n_words < rules.least_words or 100 * repeat > rules.most_repeated * n_words
    kept = not failed and 100 * left >= rules.least_kept * chars
    return n_words, chars, symbols, dup, repeat, failed, kept, removed, left, "\n".join(kept_lines)


_FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_removed_lines long, kept_chars long"


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """One row per input row: its counts, the verdict and, on request, the text without its failing lines.

    A null text has no words, and like an empty one fails for being short. Null and repeated ids and repeated rows
    are judged like any other row. Extra columns are not read. No rows give no rows. No data is shuffled.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()] * with_text
    names = [x.split()[0] for x in _FIELDS.split(", ")] + ["text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [(i.as_py(), *judge(t.as_py() or "", words, rules))[: len(names)] for i, t in zip(*part.columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return source.mapInArrow(run, _FIELDS + ", text string" * with_text)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The (doc_id, text) of the documents that stay, without their failing lines."""
    return quality(docs, id_col, text_col, rules, with_text=True).where("kept").select("doc_id", "text")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents, by the default rules."""
    return quality(read(spark, sf_dir, "documents"))


_RULES = Rules()
_WORD = r"[^\x20\x09-\x0D]+"
_CLASS = "[" + "".join("\\" + c if c in "]\\^-[" else c for c in CLOSING) + "]"
OP7_SQL = f"""
with doc as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
 line as (select r, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as k from doc),
 judged as (
  select r, k, line, len(regexp_extract_all(line, '{_WORD}')) as n, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) as size,
         len(regexp_extract_all(line, '[#*$%&|<>]')) as symbols, len(regexp_extract_all(line, '!')) as marks,
         len(regexp_extract_all(line, '[{SEPARATORS}]')) as separators, row_number() over (partition by r, line order by k) > 1 as again
  from line where regexp_matches(line, '{_WORD}')),
 by_doc as (
  select r, sum(n) as n_words, sum(size) as word_chars, sum(symbols) as n_symbols, sum(again::int) as n_dup_lines, sum(bad::int) as n_removed_lines, sum(case when bad then 0 else size end) as kept_chars
  from (select *, again or 10 * symbols > size or 3 * marks > n or 4 * separators > n
           or (n < {_RULES.short_line} and not regexp_matches(line, '{_CLASS.replace("'", "''")}[\\x20\\x09-\\x0D]*$'))
           or regexp_matches(lower(line), '{"|".join(re.escape(x).replace(chr(92) + " ", " ") for x in PHRASES)}') as bad from judged) group by r),
 word as (select r, unnest(w) as w, unnest(range(len(w))) as i from (select r, regexp_extract_all(text, '{_WORD}') as w from doc)),
 win as (select r, i, w, lead(w) over o as w2, lead(w, 2) over o as w3 from word window o as (partition by r order by i)),
 often as (select r, i, count(*) over (partition by r, w, w2, w3) > 1 and w3 is not null as often from win),
 cover as (select r, max(often::int) over (partition by r order by i rows between 2 preceding and current row) as c from often),
 rep as (select r, sum(c) as n_repeat_words from cover group by r),
 f as (select doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars, cast(coalesce(n_symbols, 0) as bigint) as n_symbols,
   cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
   cast(coalesce(n_removed_lines, 0) as bigint) as n_removed_lines, cast(coalesce(kept_chars, 0) as bigint) as kept_chars
   from doc left join by_doc using (r) left join rep using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {_RULES.least_words} or 100 * n_repeat_words > {_RULES.most_repeated} * n_words as base_failed,
  not (n_words < {_RULES.least_words} or 100 * n_repeat_words > {_RULES.most_repeated} * n_words) and 100 * kept_chars >= {_RULES.least_kept} * word_chars as kept,
  n_removed_lines, kept_chars
from f
"""
