"""Main text of web pages by wrappers: union-free regular expressions inferred for every host.

A page's tags become a stream of block elements and text slots. The page's own expression folds
tandem repeats into repeated groups. The expressions of a host are then aligned one with the other:
what both have is merged, what only one has becomes optional, neighbours that became alike become a
repeated group, and differing texts are slots. The host's wrapper so describes all its pages. Each
slot of it is judged once, as main text or as part of the frame around it, and every page is read
with the best choice of slots of its host's wrapper that it has. Words in class, id and role are
hints: an element that holds the page's largest article, or nearly all its text, is no frame,
whatever it is called.
"""

import contextlib
import functools
import html
import json
import re
import sys
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.tables import read, small_batches
from stopwise.llm.url_filter import host_of
from stopwise.workspace import staged

# Elements of HTML by their behaviour.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd link mark meta q rp rt ruby s samp"
    " script small span strike strong sub sup time tt u var wbr".split()
)
OPAQUE = set(
    "audio button canvas dialog head iframe input label math noscript object option script select"
    " style svg template textarea title video".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
    "tfoot": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"},
}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
FRAME = set("aside footer nav menu".split())
SOFT = {"form"}  # frames unless they hold the page
FRAME_WORDS = set(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies disqus gdpr hidden login menu nav navbar navigation newsletter notice notices notification popup promo"
    " promoted related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe toolbar"
    " widget widgets".split()
)
OUTER_WORDS = set("footer header masthead foot topbar".split())
# words that may stand beside these in one name, as in ad-slot
PLAIN_WORDS = set(
    "area bar block body bottom box buttons center column container content fixed footer form group header holder icons"
    " inner item items left link links list main modal outer overlay page panel post posts primary right row secondary"
    " section side site slot small sticky text top unit wrap wrapper zone".split()
)
MAIN_WORDS = set("article content entry main post story".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|svg|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?"
    r"(?:</\1\s*>|\Z)|<[/a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
LETTERS = re.compile(r"[a-z]+")
NAMES = re.compile(r"[a-z]+(?:[^a-z\s]+[a-z]+)*")
LONG = 64  # nodes side by side, folded, that are still told apart by their order
WHOLE = 0.9  # share of a page's text that no frame holds
ENOUGH = 0.25  # share of the text outside frames that a choice of slots must hold


def frame_mark(names: list[str]) -> str:
    """! if a name says that an element is a frame, ^ if it says that it is one outside of articles.
    A name counts as a whole: all its words are words of frames or go with them, as in ad-slot, and
    not as in has-sidebar or category-social."""
    marks = ""
    for name in names:
        words = LETTERS.findall(name)
        for mark, known in (("!", FRAME_WORDS), ("^", OUTER_WORDS)):
            others = [w for w in words if w not in known]
            if len(others) < len(words) and all(w in PLAIN_WORDS or w in FRAME_WORDS for w in others):
                marks += mark
    return "!" if "!" in marks else marks[:1]


@functools.lru_cache(100_000)
def tag(markup: str) -> tuple[str, str, bool]:
    """Name, label (the name, the words of class, id and role, and the mark of a frame) and whether it
    is an end tag."""
    m = NAME.match(markup)
    if m is None:
        return "", "", False
    name = m[1].lower()
    if markup[1] == "/":
        return name, name, True
    names = []
    for key, *values in MARKS.findall(markup, m.end()):
        if key.lower() == "hidden":
            names.append("hidden")
        names += NAMES.findall("".join(values).lower())
    words = sorted({w for n in names for w in LETTERS.findall(n)})
    # html and body are about the whole page
    return name, ".".join([name, *words]) + ("" if name in ("html", "body") else frame_mark(names)), False


@functools.lru_cache(100_000)
def label_name(label: str) -> str:
    return label.partition(".")[0].rstrip("!^~")


def blocks(page: str):
    """(labels, numbers, text) of every block of a page, in order: the labels of the elements it is
    in, outermost first, and their numbers in the page. Elements of one label, each directly in the
    other, count as one.

    Elements that are left open end where HTML lets them end: a paragraph before the next block, an
    item before the next item, everything else with its parent.
    """
    stack: list[tuple[str, str, int]] = []
    held: list[str] = []
    at = 0

    def block():
        own = [x for k, x in enumerate(stack) if not k or x[1] != stack[k - 1][1]]
        return tuple(x[1] for x in own), tuple(x[2] for x in own), "".join(held)

    for m in MARKUP.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        markup = m[0]
        if m[1] or markup.startswith(("<!", "<?")):
            continue
        name, label, end = tag(markup)
        if name in INLINE:
            if name == "br":
                held.append(" ")
            continue
        if not name:
            continue
        if held:
            yield block()
            held = []
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        shut, stop = CLOSES.get(name), HOLDERS.get(name, ())
        if shut:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] in shut:
                    del stack[k:]
                    break
        if name not in VOID:
            stack.append((name, label, m.start()))
    if at < len(page):
        held.append(page[at:])
    if held:
        yield block()


def settled(page: str) -> list[tuple[tuple[str, ...], tuple[int, ...], str]]:
    """The blocks of a page that have text. An element named as a frame keeps its mark only if it holds
    neither the page's article nor nearly all text outside menus, sidebars and footers; a form is a
    frame under the same rule. The page's article is the largest article or main element in no
    element named as a frame, or the largest of all."""
    found = [b for b in blocks(page) if b[2].strip()]
    sizes: dict[int, int] = {}
    articles: dict[int, list[int]] = {}
    inside: dict[int, set[int]] = {}
    total = 0
    for labels, numbers, text in found:
        names = [label_name(x) for x in labels]
        if any(n in OPAQUE or n in FRAME for n in names):
            continue
        size = len(text)
        total += size
        article = next((k for k, n in enumerate(names) if n in ("article", "main")), None)
        if article is not None:
            apart = all(x[-1] not in "!^" for x in labels[: article + 1])
            articles.setdefault(numbers[article], [apart, 0])[1] += size
        for k, (label, number, name) in enumerate(zip(labels, numbers, names)):
            if label[-1] in "!^" or name in SOFT:
                sizes[number] = sizes.get(number, 0) + size
                if article is not None and article >= k:
                    inside.setdefault(number, set()).add(numbers[article])
    largest = max(articles, key=articles.get, default=None)
    free = {n for n, size in sizes.items() if size >= WHOLE * total or largest in inside.get(n, ())}
    if not free:
        return found
    return [
        (tuple(x.rstrip("!^") + "~" if n in free else x for x, n in zip(labels, numbers)), numbers, text)
        for labels, numbers, text in found
    ]


def tidy(text: str) -> str:
    return " ".join(html.unescape(text).split())


# An expression is a list of nodes [label, quantifier, children]: quantifier 0 once, 1 optional,
# 2 repeated, 3 both; label "#" is a text slot and "()" a group.


def packed(nodes: list) -> str:
    """An expression as text: level, label and quantifier of every node, parents first."""
    out, todo = [], [(0, n) for n in reversed(nodes)]
    while todo:
        level, (label, quantifier, children) = todo.pop()
        out.append((level, label, quantifier))
        todo += [(level + 1, n) for n in reversed(children)]
    return json.dumps(out)


def unpacked(text: str) -> list:
    open_: list[list] = [[]]
    for level, label, quantifier in json.loads(text):
        del open_[level + 1 :]
        open_[level].append([label, quantifier, []])
        open_.append(open_[level][-1][2])
    return open_[0]


def expression(places: list[tuple[tuple[str, ...], tuple[int, ...]]]) -> list:
    """The expression of one page from the labels and numbers of its blocks."""
    root: list = []
    open_: list[tuple[int, list]] = []
    for labels, numbers in places:
        k = 0
        while k < min(len(open_), len(labels)) and open_[k][0] == numbers[k]:
            k += 1
        del open_[k:]
        for label, number in zip(labels[k:], numbers[k:]):
            children = open_[-1][1] if open_ else root
            node = [label, 0, []]
            children.append(node)
            open_.append((number, node[2]))
        (open_[-1][1] if open_ else root).append(["#", 0, []])
    # the innermost lists first, without recursion over the page's depth
    lists, todo = [], [root]
    while todo:
        nodes = todo.pop()
        lists.append(nodes)
        todo += [n[2] for n in nodes if n[2]]
    for nodes in reversed(lists):
        nodes[:] = folded(nodes)
    return root


def folded(nodes: list) -> list:
    """Tandem repeats become repeated groups, the shortest period first, until none is left. What is
    still long after runs of one label are folded becomes one repeated group of any of its nodes."""
    runs: list = []
    for node in nodes:
        if runs and runs[-1][0] == node[0] != "()":
            runs[-1] = merged_node(runs[-1], node)
            runs[-1][1] |= 2
        else:
            runs.append(node)
    nodes = runs
    if len(nodes) > LONG:
        any_: dict[str, list] = {}
        for node in nodes:
            for part in node[2] if node[0] == "()" else [node]:
                any_[part[0]] = merged_node(any_[part[0]], part) if part[0] in any_ else part
        return [["()", 3, [[n[0], n[1] | 1, n[2]] for n in any_.values()]]]
    period = 2
    while period <= len(nodes) // 2:
        k, changed = 0, False
        while k < len(nodes):
            one, two = nodes[k : k + period], nodes[k + period : k + 2 * period]
            if len(two) == period and [x[0] for x in one] == [x[0] for x in two] and "()" not in {x[0] for x in one}:
                nodes[k : k + 2 * period] = [["()", 2, [merged_node(x, y) for x, y in zip(one, two)]]]
                changed = True
            elif nodes[k][0] == "()" and [x[0] for x in nodes[k][2]] == [
                x[0] for x in nodes[k + 1 : k + 1 + len(nodes[k][2])]
            ]:
                size = len(nodes[k][2])
                group = [merged_node(x, y) for x, y in zip(nodes[k][2], nodes[k + 1 : k + 1 + size])]
                nodes[k : k + 1 + size] = [["()", 2, group]]
                changed = True
            else:
                k += 1
        period = 2 if changed and period > 2 else period + 1
    return nodes


def merged_node(a: list, b: list) -> list:
    return [a[0], a[1] | b[1], merged(a[2], b[2])]


def merged(a: list, b: list) -> list:
    """The expression of what either expression describes."""
    out = []
    one, two = [x[0] for x in a], [x[0] for x in b]
    if one == two:
        return folded([merged_node(x, y) for x, y in zip(a, b)])
    match = SequenceMatcher(None, one, two, autojunk=False)
    for kind, a1, a2, b1, b2 in match.get_opcodes():
        if kind == "equal":
            out += [merged_node(x, y) for x, y in zip(a[a1:a2], b[b1:b2])]
        else:
            out += [[x[0], x[1] | 1, x[2]] for x in a[a1:a2] + b[b1:b2]]
    return folded(out)


def slots(nodes: list):
    """Paths of the text slots of an expression."""
    todo = [((), n) for n in reversed(nodes)]
    while todo:
        path, (label, _, children) = todo.pop()
        if label == "#":
            yield path
        else:
            here = path if label == "()" else (*path, label)
            todo += [(here, n) for n in reversed(children)]


def main_slots(nodes: list, constant: set[tuple[str, ...]]) -> list[list[tuple[str, ...]]]:
    """The slots that may hold main text, the best choice first: what an article or main element holds;
    elements named as content; all slots whose text is not the same on all pages; all slots but
    those of menus, sidebars, footers and the like; and last what only its name calls a frame."""
    every = list(dict.fromkeys(slots(nodes)))
    paths = [p for p in every if not _framed(p)]
    return [
        [p for p in paths if inside(p)]
        for inside in (
            lambda p: any(label_name(x) in ("article", "main") for x in p),
            lambda p: any(MAIN_WORDS & set(x.rstrip("!^~").split(".")[1:]) for x in p),
            lambda p: p not in constant and not _outer(p),
            lambda p: not _outer(p),
        )
    ] + [[p for p in every if not _hard(p)]]


def _hard(path: tuple[str, ...]) -> bool:
    return any(label_name(x) in OPAQUE or label_name(x) in FRAME or (label_name(x) in SOFT and x[-1] != "~") for x in path)


def _framed(path: tuple[str, ...]) -> bool:
    held = False
    for label in path:
        name = label_name(label)
        if label[-1] == "!" or (not held and (name == "header" or label[-1] == "^") and label[-1] != "~"):
            return True
        held = held or name in ("article", "main")
    return _hard(path)


def _outer(path: tuple[str, ...]) -> bool:
    return any(label_name(x) in ("header", "footer") for x in path)


def chosen_text(found: list, choices: list[frozenset]) -> str:
    """The text of the first choice of slots that holds enough of what lies outside frames."""
    sizes = [sum(len(t) for p, _, t in found if p in c) for c in choices]
    for size, choice in zip(sizes, choices):
        if size and size >= ENOUGH * max(sizes[:-1]):
            return "\n\n".join(t for t in [tidy(t) for p, _, t in found if p in choice] if t)
    return ""


@contextlib.contextmanager
def room(found: list):
    """Merging two expressions goes as deep as these; leave Python room for the deepest."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 1000 + 6 * max((len(b[0]) for b in found), default=0)))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def learn(pages: DataFrame) -> DataFrame:
    """(host, wrapper, path, low, high, first, last) of pages with columns host and html: the distinct
    page expressions, and for every slot the smallest and largest hash of its text and of its pages."""

    def run(batches):
        for batch in batches:
            wrappers, texts = set(), {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = settled(page or "")
                with room(found):
                    wrappers.add((host, packed(expression([b[:2] for b in found]))))
                whole = xxhash.xxh64_intdigest(page or "") >> 1
                together: dict = {}
                for p, _, t in found:
                    together.setdefault(p, []).append(t)
                for p, t in together.items():
                    h = xxhash.xxh64_intdigest(tidy(" ".join(t))) >> 1
                    low, high, first, last = texts.get((host, p), (h, h, whole, whole))
                    texts[host, p] = (min(low, h), max(high, h), min(first, whole), max(last, whole))
            rows = [(h, w, *[None] * 5) for h, w in sorted(wrappers)]
            rows += [(h, None, "\n".join(p), *ends) for (h, p), ends in texts.items()]
            kinds = [pa.string(), pa.string(), pa.string(), *[pa.int64()] * 4]
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["host", "wrapper", "path", "low", "high", "first", "last"],
            )

    schema = "host string, wrapper string, path string, low long, high long, first long, last long"
    return pages.select("host", "html").mapInArrow(run, schema)


def host_wrappers(expressions: DataFrame, fan_in: int = 32) -> DataFrame:
    """(host, wrapper): one for every host, from (host, wrapper). Rounds of merges of about
    ``fan_in`` expressions each keep any group small."""

    def merge(key, frame):
        expressions = [unpacked(w) for w in sorted(frame["wrapper"])]
        with room([(p,) for e in expressions for p in slots(e)]):
            whole = functools.reduce(merged, expressions)
        return frame.iloc[:1].assign(wrapper=packed(whole))[["host", "wrapper"]]

    now = staged(expressions.distinct(), "page-expressions")
    while True:
        sizes = now.groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0]
        if most is None or most == 1:
            return now
        # half the groups of the round before, so that every round gets further
        groups = F.ceil(F.col("n") / fan_in)
        salted = now.join(sizes, F.col("host") == F.col("_host")).withColumn(
            "salt", F.when(F.col("n") <= fan_in, 0).otherwise(F.pmod(F.xxhash64("wrapper"), groups))
        )
        now = salted.select("host", "wrapper", "salt").groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string")
        now = staged(now, "merged-wrappers")


@functools.lru_cache(10_000)
def _chosen(main: str) -> list[frozenset]:
    return [frozenset(tuple(p) for p in choice) for choice in json.loads(main)]


def extract_text(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Adds text and n_chars to every page; its other columns stay, columns of these names
    are replaced.

    Null html counts as empty and gives an empty text; pages with a null url or one without a host
    share the empty host; a page cut off in the middle of a tag loses that tag only; elements may be
    nested thousands deep; repeated rows give repeated rows; an empty table gives an empty result.
    """
    named = pages.drop("text", "n_chars", "_h", "_main").withColumn("_host", host_of(F.col(url_column)))
    learned = staged(learn(named.select(F.col("_host").alias("host"), F.col(html_column).alias("html"))), "page-slots")
    wrappers = host_wrappers(learned.where("wrapper IS NOT NULL").select("host", "wrapper"))
    constant = learned.where("path IS NOT NULL").groupBy("host", "path").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    # one page says nothing about what its host's pages have in common
    constant = constant.where("low = high AND first < last").groupBy(F.col("host").alias("_h")).agg(F.collect_list("path").alias("paths"))

    def judge(batches):
        for batch in batches:
            hosts, texts, paths = (c.to_pylist() for c in batch.columns)
            main = [
                json.dumps(main_slots(unpacked(w), {tuple(x.split("\n")) for x in p or ()})) for w, p in zip(texts, paths)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(main, pa.string())], names=["_h", "_main"])

    judged = wrappers.join(constant, F.col("host") == F.col("_h"), "left").select("host", "wrapper", "paths")
    # written, so that its size decides how it meets the pages
    specs = staged(judged.mapInArrow(judge, "_h string, _main string"), "host-slots")

    @F.pandas_udf("string")
    def text_of(page, main):
        return page.combine(main, lambda p, m: chosen_text(settled(p or ""), _chosen(m or "[[]]")))

    joined = named.join(specs, F.col("_host") == F.col("_h"), "left")
    read_pages = joined.withColumn("text", text_of(html_column, "_main"))
    return read_pages.withColumn("n_chars", F.length("text").cast("long")).drop("_host", "_h", "_main")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
