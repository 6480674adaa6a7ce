"""Line-first cleaning: lines are judged one by one, failing lines go, and a document that loses too
much of its text goes with them."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

# Phrases of page furniture, held against a line in lower case.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "sign in",
    "sign up",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
)
#: Separators of menus and tables: a line with this many is navigation.
SEPARATORS, MOST_SEPARATORS = "|»·•", 3
#: Marks that end a sentence, with what may close it.
END = re.compile(r"[.!?…:;][\"'”’»)\]]*[\x20\x09-\x0D]*$")
#: A line without such an end needs as many words.
LEAST_OPEN_WORDS = 10
#: Marks of which a line may have this share of its characters at most.
MARKS, MOST_MARKS = re.compile(r"[#*$%&|<>{}~^_=+!?\\]"), 0.15
#: A document may lose this share of its words at most.
MOST_LOST = 0.5

SYMBOL = re.compile(r"[#*$%&|<>]")


def line_fails(line: str, n_words: int) -> bool:
    """The verdict on one line that has words, apart from whether it repeats an earlier one."""
    low = line.lower()
    return (
        sum(map(line.count, SEPARATORS)) >= MOST_SEPARATORS
        or any(p in low for p in BOILERPLATE)
        or (n_words < LEAST_OPEN_WORDS and not END.search(line))
        or len(MARKS.findall(line)) > MOST_MARKS * len(line)
    )


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of width words found twice or more."""
    if len(words) <= width:
        return 0
    flat, ends, at = b" ".join(words), [], 0
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *ends[:-1]]
    windows = [flat[s : e - 1] for s, e in zip(starts, ends[width - 1 :])]
    if len(set(windows)) == len(windows):
        return 0
    seen, n, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + width - max(upto, i)
            upto = i + width
    return n


def judge(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean text."""
    text = text or ""
    words = text.encode().split()
    n_words = len(words)
    word_chars = len(b"".join(words).decode())
    seen: set[str] = set()
    n_dup = lost = 0
    clean = []
    for line in text.split("\n"):
        n = len(WORD.findall(line))
        if not n:
            clean.append(line)
            continue
        dup = line in seen
        seen.add(line)
        n_dup += dup
        if dup or line_fails(line, n):
            lost += n
        else:
            clean.append(line)
    n_repeat = repeat_words(words)
    failed = n_words < 10 or 100 * n_repeat > 20 * n_words
    return n_words, word_chars, len(SYMBOL.findall(text)), n_dup, n_repeat, failed, not failed and lost <= MOST_LOST * n_words, "\n".join(clean)


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clean: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, the counts, base_failed, kept, and with clean the text of the
    lines that stay.

    Null text counts as empty and fails; lines without words are neither judged nor counted; rows with
    null or repeated ids each get their row. An empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FIELDS.split(", ")] + ["clean_text"] * clean
        for b in batches:
            rows = [judge(t.as_py())[: len(names)] for t in b.column(1)]
            cols = list(zip(*rows)) or [[]] * len(names)
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] * clean
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, {FIELDS}" + ", clean_text string" * clean)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the text of the lines that stay; n_chars follows the text.
    Columns, their order and types are those of docs, whatever their names. Null, empty and wordless texts are
    rejected; a text of any length is judged whole; rows that repeat are judged one by one, and null ids do
    not matter. An empty table gives an empty result."""
    fields, at = docs.schema, docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(t.as_py()) for t in b.column(at)]
            stay = pa.array([x[6] for x in found], pa.bool_())
            cols = list(b.columns)
            cols[at] = pa.array([x[7] for x in found], pa.string())
            if chars is not None:
                cols[chars] = pa.array([len(x[7]) for x in found], pa.int64()).cast(cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names).filter(stay)

    return docs.mapInArrow(run, fields)


ORACLE = r"""
with w as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
), windows as (
  select doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') as win
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1))) as i from w)
), twice as (
  select doc_id, i from windows qualify count(*) over (partition by doc_id, win) > 1
), repeated as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from twice) group by doc_id
), lines as (
  select doc_id, k, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from w)
), judged as (
  select doc_id, n, row_number() over (partition by doc_id, line order by k) > 1 as dup,
    len(regexp_extract_all(line, '[|»·•]')) >= 3
    or regexp_matches(lower(line), 'all rights reserved|click here|cookie policy|enable javascript|lorem ipsum|privacy policy|read more|sign in|sign up|subscribe to our newsletter|terms of service|terms of use')
    or (n < 10 and not regexp_matches(line, '[.!?…:;]["''”’»)\]]*[\x20\x09-\x0D]*$'))
    or len(regexp_extract_all(line, '[#*$%&|<>{}~^_=+!?\\]')) > 0.15 * length(line) as bad
  from lines where n > 0
), lost as (
  select doc_id, count(*) filter (dup) as n_dup, sum(n) filter (dup or bad) as lost from judged group by doc_id
), base as (
  select w.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup, 0)::bigint as n_dup_lines,
    coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(lost, 0) as lost
  from w left join repeated r using (doc_id) left join lost using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and lost <= 0.5 * n_words as kept
from base
"""
