"""Lines to pages, one page after another.

Where a page ends follows from where it begins and from the lines around its last place. Lines are dealt by document once, as a few flags
without their texts, and sorted; a task goes through its documents in order. What a page's end asks of its line (its block's beginning, end and kind, the
headings of the block before it, the next full line) comes from array operations over some thousand lines at a time; only page ends are visited one by one.
A task holds a document's flags, some 30 bytes a line, no more than the document's text took in the task that read it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.helpers import group_starts, numbered, whole_groups
from quire.jobs.folders import written

#: Kinds of blocks that stay whole if they fit on a page: fixed values.
WHOLE = ("artset", "artwork", "figure", "sourcecode", "table")
#: How far above a page's end headings are looked for, and how many lines may lie between two of them: fixed values.
LOOK_BACK, APART = 14, 3


#: What a line's tag says: fixed values.
OTHER, SECTION, KEPT_WHOLE, UNTAGGED = range(4)


def _headings_above(heading: np.ndarray, top: int, end: int) -> int:
    """How many lines a break moves up so that no heading stays alone: headings at most three lines apart, the nearest first."""
    up = 0
    for j in range(1, min(LOOK_BACK, end - top) + 1):
        if heading[end - j] and j - up <= APART and up < LOOK_BACK - 2:
            up = j
    return up


def pages_of(starts: list[int], blank: np.ndarray, block: np.ndarray, inside: np.ndarray, tag: np.ndarray, *, first: int, height: int, few: int, start_lines: int) -> np.ndarray:
    """The page of each line of documents that begin at ``starts`` (the last one is the number of lines). ``inside``: whether a line is in a block."""
    n = starts[-1]
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    own = np.flatnonzero(inside)
    own = own[np.lexsort((block[own], doc[own]))]  # lines by block, in order
    new = np.ones(len(own), bool)
    new[1:] = (doc[own][1:] != doc[own][:-1]) | (block[own][1:] != block[own][:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(own)))
    beg, stop, before = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    beg[own], stop[own] = np.repeat(own[at], sizes), np.repeat(own[at + sizes - 1] + 1, sizes)
    plain = ((tag[own] == OTHER) | (tag[own] == KEPT_WHOLE)).astype(np.int64)
    so_far = np.cumsum(plain) - plain
    before[own] = so_far - np.repeat(so_far[at], sizes)
    heading = tag == SECTION
    full = np.append(np.minimum.accumulate(np.where(blank, n, np.arange(n))[::-1])[::-1], n)  # the first full line from here on
    page = np.zeros(n, np.int32)
    for lo, hi in itertools.pairwise(starts):
        line, number = lo, 1
        while line < hi:
            end = line + (first if line == lo else height)
            if end >= hi:
                cut = hi
            else:
                moved = end
                if not inside[end]:
                    moved = end - _headings_above(heading, lo, end)
                else:
                    b, e = int(beg[end]), int(stop[end])
                    kind, left, right, size = tag[b], end - b, e - end, e - b
                    if kind == SECTION:
                        moved = b if before[end] <= start_lines else end
                    elif kind == KEPT_WHOLE:
                        moved = b if size < height or left <= start_lines else end
                    elif (1 <= left <= few and size > left) or (1 <= right <= few and size > right):
                        moved = b
                cut = moved if moved > line else end
            page[line:cut] = number
            line, number = int(full[cut]), number + 1
    return page


def paginate(lines: DataFrame, *, doc: str, line: str, blank: str, block: str, tag: str, first: int = 52, height: int = 48, few: int = 2, start_lines: int = 5, shard: int = 1024) -> DataFrame:
    """``doc``, ``line``, ``page`` of every line, page 0 for blank lines dropped at a page's top.

    ``lines`` has a row for each line, numbered from 0 without gaps in each document: whether it is ``blank``, the ``block`` of lines that it
    belongs to (null between blocks) and the ``tag`` of its element. The first page has room for ``first`` lines, others for ``height``.
    A page that would end between blocks ends before the headings just above; in a section's block, before the block unless
    more than ``start_lines`` lines of it that are no headings fit; in a figure, table or code, before it if it fits on a page or no
    more than ``start_lines`` fit; in any other, before it if up to ``few`` lines would stand alone on either page. A page always has a line.
    Null documents are left out; a document without lines has no pages. A task takes whole documents of ``shard`` lines or more together at a time.
    """
    told = F.when(F.col(tag) == "section", SECTION).when(F.col(tag).isin(*WHOLE), KEPT_WHOLE).when(F.col(tag).isNull(), UNTAGGED).otherwise(OTHER)
    src = lines.select(
        F.col(doc).alias("doc"), F.col(line).cast("long").alias("line"), F.col(block).alias("block"),
        (told + F.when(F.coalesce(blank, F.lit(False)), 4).otherwise(0)).alias("told"),
    ).filter("doc IS NOT NULL")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(parts, "doc", shard):
            told, block = t["told"].to_numpy(), t["block"]
            numbers = pages_of(
                group_starts(t["doc"]), told >= 4, numbered(block), block.is_valid().to_numpy(), told % 4,
                first=first, height=height, few=few, start_lines=start_lines,
            )
            yield from t.select(["doc", "line"]).append_column("page", pa.array(numbers)).to_batches()

    out = src.repartition("doc").sortWithinPartitions("doc", "line").mapInArrow(run, f"doc {dict(src.dtypes)['doc']}, line long, page int")
    return out.select(F.col("doc").alias(doc), F.col("line").alias(line), "page")


def paged_contents(lines: DataFrame, *, doc: str, line: str, blank: str, block: str, tag: str, title: str, **how) -> DataFrame:
    """``doc``, ``nth``, ``title``, ``page``, ``entry_page``: each heading with its page, and the page of its own entry.

    The contents stand before the text, an entry for each heading (line with tag ``section``) and a blank line; they take as many lines whatever
    their page numbers are, so pages are laid out once, with the contents' lines in place, and then looked up.
    """
    own = W.partitionBy("doc")
    src = lines.select(F.col(doc).alias("doc"), F.col(line).cast("long").alias("line"), F.col(blank).alias("blank"), F.col(block).cast("long").alias("block"), F.col(tag).alias("tag"), F.col(title).alias("title"))
    heads = written(src.filter("tag = 'section'").select("doc", "line", "title", F.row_number().over(own.orderBy("line")).alias("nth"), F.count(F.lit(1)).over(own).alias("m")))
    size = heads.groupBy("doc").agg(F.max("m").alias("m"))
    body = src.join(size, "doc", "left").select("doc", (F.col("line") + F.coalesce(F.col("m") + 1, F.lit(0))).alias("line"), "blank", "block", "tag")
    entries = heads.select("doc", (F.col("nth") - 1).cast("long").alias("line"), F.lit(False).alias("blank"), F.lit(-1).cast("long").alias("block"), F.lit("toc").alias("tag"))
    gap = size.select("doc", F.col("m").alias("line"), F.lit(True).alias("blank"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("string").alias("tag"))
    paged = paginate(body.unionByName(entries).unionByName(gap), doc="doc", line="line", blank="blank", block="block", tag="tag", **how)
    # each heading asks for two lines' pages: its own and its entry's
    asked = heads.select("doc", "nth", F.explode(F.array(F.col("line") + F.col("m") + 1, (F.col("nth") - 1).cast("long"))).alias("line"))
    found = written(asked.join(paged, ["doc", "line"]).select("doc", "nth", "line", "page"))
    out = heads.select("doc", "nth", "title", (F.col("line") + F.col("m") + 1).alias("at")).join(found, ["doc", "nth"])
    out = out.groupBy("doc", "nth", "title").agg(F.max(F.when(F.col("line") == F.col("at"), F.col("page"))).alias("page"), F.max(F.when(F.col("line") != F.col("at"), F.col("page"))).alias("entry_page"))
    return out.select(F.col("doc").alias(doc), F.col("nth").cast("long").alias("nth"), "title", "page", "entry_page")
