"""One JSON object, however large, as many small ones, read in parallel.

A text file with ``}`` as its line separator splits at any byte, so Spark's own reader deals ranges
of a single object to tasks; a range begins behind a ``}``. What a range means depends on what came
before it: whether its start lies in a string, and in which containers. Both are found by composing
the effects of ranges:

1. Every range counts its quotes; the sum before a range tells whether it starts in a string.
2. From its first ``}`` that is no part of a string on, a range is read as structure: how many of the
   containers open before it it closes, and which it leaves open. What lies before, and what
   follows its last such ``}``, are joined with the neighbours' ends to pieces of their own.
3. With the containers open at its start known, every range gives lines that open these containers,
   hold some of its entries, and close what is open. Only the outermost containers may be parted;
   a record that lies across ranges is joined from its parts.

So one object becomes lines that each hold some of its entries. Lines with an object each are read
the same way.
"""

import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopwise.workspace import staged

LINE_BYTES = 1 << 16
BATCH_ROWS, BATCH_CHARS = 1 << 12, 1 << 20  # of the lines that are handed over together
PARTED = 16  # lines of so many times their size are ended within an entry
ESCAPED = re.compile(r"\\.", re.S)
# a string, and what it opens if it is the key of a container; or a bracket
TOKEN = re.compile(r'("(?:[^"\\]|\\.)*")(\s*:\s*[{\[])?|[{}\[\]]', re.S)
EFFECT = "file string, start long, piece int, closed int, opened array<string>"


def quotes(text: str) -> int:
    """Quotes that begin or end a string."""
    return (ESCAPED.sub("", text) if "\\" in text else text).count('"')


def walk(text: str, open_: list[str]) -> int:
    """Brings the open containers up to date with text that begins outside a string. A container is
    what opens it: its key, if it has one, and its bracket. Returns how many were closed that were not
    in the list."""
    below = 0
    for m in TOKEN.finditer(text):
        if m[1] is not None:
            if m[2] is not None:
                open_.append(m[1] + ":" + m[2][-1])
        elif m[0] in "{[":
            open_.append(m[0])
        elif open_:
            open_.pop()
        else:
            below += 1
    return below


def fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start, value): what lies before every ``}``, in order within each range of a file."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str | None]]:
    """((file, start), text) of the fragments, and a None after the last of each range."""
    now = None
    for batch in batches:
        for file, start, value in zip(*(c.to_pylist() for c in batch.columns)):
            if now is not None and now != (file, start):
                yield now, None
            now = (file, start)
            yield now, value + "}"
    if now is not None:
        yield now, None


def of_files(batches: Iterable[pa.RecordBatch], files: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of some files. A filter by Spark would leave the other files out of the scan, and Spark cuts files
    into ranges by the size of all that it reads: the same file would have other ranges."""
    wanted = pa.array(files, pa.string())
    for batch in batches:
        found = batch.filter(pc.is_in(batch.column(0), value_set=wanted))
        if found.num_rows:
            yield found


def counted_quotes(raw: DataFrame) -> DataFrame:
    """``quotes`` of every range, added up by Spark."""
    bare = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    n = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    return raw.select("file", "start", n.alias("n")).groupBy("file", "start").agg(F.sum("n").alias("quotes"))


def parts_of(batches, inside: set[tuple[str, int]]):
    """(key, kind, text) of every range: kind 0 is text before its first ``}`` outside a string, given
    in one, 1 are texts that begin and end outside strings, 2 is the text after its last such ``}``; None at its end."""
    held, odd, head = [], 0, False
    now = None
    for key, text in _ranges(batches):
        if key != now:
            now, head = key, key in inside
            held, odd = [], int(head)
        if text is not None:
            held.append(text)
            odd = (odd + quotes(text)) % 2
            if odd:
                continue
            yield key, 0 if head else 1, "".join(held)
            held, head = [], False
            continue
        if held:
            # a range that lies in one string as a whole is all head
            yield key, 0 if head else 2, "".join(held)
        yield key, 3, None


def range_effects(batches, inside: set[tuple[str, int]]):
    """(file, start, piece, closed, opened, text): the effect of the range behind its head (piece 1),
    and the texts of its head (0) and of its end (2)."""
    closed, opened = 0, []
    schema = pa.schema(
        [("file", pa.string()), ("start", pa.int64()), ("piece", pa.int32()), ("closed", pa.int32()), ("opened", pa.list_(pa.string())), ("text", pa.string())]
    )
    for (file, start), kind, text in parts_of(batches, inside):
        if kind == 1:
            closed += walk(text, opened)
            continue
        row = (file, start, kind, None, None, text) if kind in (0, 2) else (file, start, 1, closed, opened, None)
        if kind == 3:
            closed, opened = 0, []
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)


def in_batches(values: Iterable[str]) -> Iterator[pa.RecordBatch]:
    """The values in batches of some rows and not much more than ``BATCH_CHARS`` characters: objects of a few
    hundred bytes would cost more to hand over one by one than to read."""
    held, size = [], 0
    for value in values:
        held.append(value)
        size += len(value)
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.string())})
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.string())})


class Lines:
    """Objects made of the entries of a text, given piece by piece. Text before the first place where a
    line may begin is the head, text behind the last place where one may end is the tail."""

    def __init__(self, open_: list[str], size: int, depth: int):
        self.open, self.size, self.depth = list(open_), size, depth
        self.head: list[str] = []
        self.started = len(open_) <= depth
        self.held: list[str] = []
        self._begin()

    def _begin(self):
        self.before, self.safe_open = list(self.open), list(self.open)
        self.length = self.safe = 0

    def add(self, text: str) -> str | None:
        """A line, if one is full."""
        if walk(text, self.open):  # the bracket behind the file's last text, put there by the reader
            text = text[:-1]
        if not self.started:
            self.head.append(text)
            if len(self.open) <= self.depth:
                self.started = True
                self._begin()
            return None
        self.held.append(text)
        self.length += len(text)
        if len(self.open) > self.depth:
            return None
        self.safe, self.safe_open = len(self.held), list(self.open)
        full = self.length >= self.size and (len(self.open) <= 1 or self.length >= PARTED * self.size)
        return self.line() if full or not self.open else None

    def line(self) -> str | None:
        body = "".join(self.held[: self.safe]).lstrip()
        body = body[1:] if body.startswith(",") else body
        closing = "".join("}" if c[-1] == "{" else "]" for c in reversed(self.safe_open))
        out = "".join(self.before) + body + closing if body.strip() else None
        self.held, self.before = self.held[self.safe :], list(self.safe_open)
        self.length = self.safe = 0
        return out

    def ends(self) -> list[tuple[int, str, list[str] | None]]:
        """After the last line: (0, head, None) and (1, tail, what is open before it), if there are any."""
        out = [(0, "".join(self.head), None)] if self.head else []
        return out + ([(1, "".join(self.held), list(self.before))] if self.held else [])


def small_objects(spark: SparkSession, path: str | list[str], line_bytes: int = LINE_BYTES, depth: int = 3) -> DataFrame:
    """One column ``value``: objects of about ``line_bytes`` that together hold the entries of all
    objects in the files of ``path``, one large object each or many small ones.

    Entries keep their text. The ``depth`` outermost containers may be parted, at the end of a range or
    when a line grows long, and each part has the keys of all containers around it; what lies deeper
    stays whole. Empty files give no lines; a file that is no JSON gives lines that are none.
    The driver holds one small row for each range of a file (128 MB, unless Spark is told otherwise).
    """
    raw = fragments(spark, path)
    counted = staged(counted_quotes(raw), "json-quotes")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    inside = {(r["file"], r["start"]) for r in counted.withColumn("odd", odd).where("odd").select("file", "start").collect()}

    schema = "file string, start long, piece int, closed int, opened array<string>, text string"
    found = staged(raw.mapInArrow(lambda batches: range_effects(batches, inside), schema), "json-ranges")
    # an end, the ranges that lie in one string as a whole, and the head behind them are one piece
    ends = found.where("text IS NOT NULL")
    so_far = Window.partitionBy("file").orderBy("start", "piece")
    number = F.sum(F.when(F.col("piece") == 2, 1).otherwise(0)).over(so_far)
    joined = ends.withColumn("number", number).groupBy("file", "number").agg(
        F.min(F.struct("start", "piece")).alias("first"),
        F.sort_array(F.collect_list(F.struct("start", "piece", "text"))).alias("texts"),
    )
    joined = joined.select("file", F.col("first.start").alias("start"), F.array_join("texts.text", "").alias("text"))
    joined = staged(joined, "json-joined")

    def effects(batches):
        for batch in batches:
            files, starts, texts = (c.to_pylist() for c in batch.columns)
            opened = [[] for _ in texts]
            closed = [walk(t, o) for t, o in zip(texts, opened)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(files), pa.array(starts, pa.int64()), pa.array([2] * len(files), pa.int32()),
                    pa.array(closed, pa.int32()), pa.array(opened, pa.list_(pa.string())),
                ],
                names=["file", "start", "piece", "closed", "opened"],
            )

    whole = found.where("piece = 1").select("file", "start", "piece", "closed", "opened")
    whole = whole.unionByName(joined.mapInArrow(effects, EFFECT))
    stacks: dict[tuple[str, int, int], list[str]] = {}
    last: dict[str, list[str]] = {}
    file, stack = None, []
    for r in whole.orderBy("file", "start", "piece").toLocalIterator():
        if r["file"] != file:
            file, stack = r["file"], []
        stacks[file, r["start"], r["piece"]] = stack
        last[file] = stack = stack[: max(0, len(stack) - r["closed"])] + list(r["opened"])

    def segments(batches, joined_texts: bool) -> Iterator[tuple[tuple[str, int, int], Iterable[str]]]:
        """Key and texts of the ranges behind their heads, or of the joined texts."""
        if joined_texts:
            for batch in batches:
                for file, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                    yield (file, start, 2), [text]
            return
        parts = parts_of(batches, inside)
        for key, kind, text in parts:
            if kind == 1:
                first = text
                yield (*key, 1), itertools.chain([first], (t for _, _, t in itertools.takewhile(lambda p: p[1] == 1, parts)))

    def each_line(batches, joined_texts):
        for key, texts in segments(batches, joined_texts):
            now = Lines(stacks[key], line_bytes, depth)
            for text in texts:
                if (line := now.add(text)) is not None:
                    yield line
            if (line := now.line()) is not None:
                yield line

    def lines(batches, joined_texts):
        return in_batches(each_line(batches, joined_texts))

    def ends_of(batches, joined_texts):
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
        for key, texts in segments(batches, joined_texts):
            now = Lines(stacks[key], line_bytes, depth)
            for text in texts:
                now.add(text)
            now.line()
            for end in now.ends():
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*key, *end), kinds)], names=names)

    def cut(batches):
        for batch in batches:
            for texts, open_ in zip(*(c.to_pylist() for c in batch.columns)):
                now = Lines(open_, line_bytes, depth)
                out = [now.add("".join(texts)), now.line()]
                yield pa.RecordBatch.from_pydict({"value": pa.array([x for x in out if x is not None], pa.string())})

    out = raw.mapInArrow(lambda b: lines(b, False), "value string")
    if not joined.isEmpty():
        out = out.unionByName(joined.mapInArrow(lambda b: lines(b, True), "value string"))
    # a file without a deeper stack has no ends: its ranges begin and end where a line may
    deep = {file for (file, _, _), stack in stacks.items() if len(stack) > depth}
    if not deep:
        return out
    deep = sorted(deep | {file for file, stack in last.items() if len(stack) > depth})
    # records that lie across ranges: a tail, and the heads behind it
    names = ["file", "start", "piece", "side", "text", "open"]
    schema = "file string, start long, piece int, side int, text string, open array<string>"
    parts = [raw.mapInArrow(lambda b: ends_of(of_files(b, deep), False), schema), joined.mapInArrow(lambda b: ends_of(of_files(b, deep), True), schema)]
    parts = parts[0].unionByName(parts[1])
    so_far = Window.partitionBy("file").orderBy("start", "piece", "side")
    parts = parts.withColumn("number", F.sum("side").over(so_far)).groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("start", "piece", "side", "text"))).alias("texts"), F.max("open").alias("open")
    )
    records = staged(parts.select("texts.text", "open"), "json-records")
    return out.unionByName(records.mapInArrow(cut, "value string"))
