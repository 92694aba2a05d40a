"""Text cleaning as Column expressions; each maps null to null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without blanks at both ends; a pattern for the end would try every blank of a long run."""
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def drop_cid_codes(text: Column) -> Column:
    """Font codes such as (cid:12) vanish, runs of blanks are one, three or more line ends two."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\(cid:\d+\)", ""), " +", " ")
    return strip(F.regexp_replace(bare, r"\n\s*\n\s*\n+", "\n\n"))


def drop_slip_notice(text: Column) -> Column:
    """A slip-opinion notice at the start, up to the court's link."""
    head = F.substring(text, 1, 500)
    noticed = head.contains("NOTICE") & head.contains("SLIP OPINION")
    cut = F.regexp_replace(text, r"(?is)\A.*?NOTICE:\s*SLIP\s*OPINION.*?(?:courts\.wa\.gov/opinions|linked there\.)\s*", "")
    return F.when(noticed, strip(cut)).otherwise(text)


#: Marks of a notice page. Fixed values.
NOTICE_MARKS = ("notice: slip opinion", "not the court's final written decision", "slip opinion that begins on the next page", "slip opinions are the written opinions that are originally filed")


def is_notice_page(text: Column) -> Column:
    """Two marks or more on a page of under 3000 characters."""
    marks = sum((F.lower(text).contains(m).cast("int") for m in NOTICE_MARKS), F.lit(0))
    return F.coalesce((marks >= 2) & (F.length(text) < 3000), F.lit(False))


def collapse(text: Column) -> Column:
    """C4: runs of line ends, then of blanks, are one."""
    return F.regexp_replace(F.regexp_replace(text, r"\n+", "\n"), " +", " ")


#: Running heads of filings. Fixed values.
HEADS = (r"IN THE .* COURT.*", r"STATE OF .*", r"COUNTY OF .*", r"No\.\s*\d+.*", r"Case No\..*", r"Docket.*")


def drop_running_heads(text: Column) -> Column:
    """Lines that are page numbers or running heads."""
    for pattern in (r"(?m)^\s*\d+\s*$", r"(?m)^\s*-\s*\d+\s*-\s*$", *[rf"(?mi)^\s*{h}$" for h in HEADS]):
        text = F.regexp_replace(text, pattern, "")
    return text


def repair(text: Column) -> Column:
    """Hyphenated line ends joined, spaces around punctuation and parentheses, zero-width characters. A run of blanks is tried from its start only."""
    for pattern, to in ((r"(?U)(\w)-[^\S\n]*+\n\s*+(\w)", "$1$2"), (r"(?<!\s)\s++([,.;:!?])", "$1"), (r"([,.;:!?])\s*+([A-Z])", "$1 $2"), (r"(?<!\s)\s*+\(\s*+", " ("), (r"(?<!\s)\s*+\)\s*+", ") "), (r"[\x{200b}-\x{200d}\x{feff}]", "")):
        text = F.regexp_replace(text, pattern, to)
    return text


def plain_dashes(text: Column) -> Column:
    """En and em dashes are hyphens."""
    return F.translate(text, "–—", "--")


GAP_MARK = "\n\n[...document continues...]\n\n"


def sampled(text: Column, most: int) -> Column:
    """Of a longer text the first 40 %, the centre and the last 25 %, parted by marks."""
    head, tail = int(most * 0.40), int(most * 0.25)
    middle = most - head - tail
    start = F.floor(F.length(text) / 2).cast("int") - middle // 2
    parts = F.concat(F.substring(text, 1, head), F.lit(GAP_MARK), F.substring(text, start + 1, F.lit(middle)), F.lit(GAP_MARK), F.right(text, F.lit(tail)))
    return F.when(F.length(text) > most, parts).otherwise(text)


def embedding_text(summary: Column, text: Column) -> Column:
    """The summary, an empty line and the first 4000 characters, where the text has over 100."""
    return F.when(F.length(text) > 100, F.concat(F.coalesce(summary, F.lit("")), F.lit("\n\n"), F.substring(text, 1, 4000)))


def preview(text: Column, length: int = 200) -> Column:
    """C11."""
    return F.substring(text, 1, length)


def case_summary(title: Column, court: Column, issues: Column, text: Column) -> Column:
    """Labelled lines, the first three issues of 100 characters, the first 500 of the text."""
    short = F.transform(F.slice(issues, 1, 3), lambda x: F.substring(x, 1, 100))
    return F.concat_ws("\n", F.concat(F.lit("Case: "), title), F.concat(F.lit("Court: "), court), F.concat(F.lit("Issues: "), F.array_join(short, "; ")), F.substring(text, 1, 500))
