"""Main text of web pages by wrapper induction.

All different pages of a host are parsed, in bounded groups; DOM trees are
aligned pair by pair along each group by simple tree matching, and constant
texts are counted over all pairs of the host.  Aligned nodes with equal text are template,
nodes whose text varies are content slots.  The wrapper of a host (digests of
template texts with their paths) then cleans every page of the host.

Elements article and main are a hint: if they hold at least a third of the text that the
wrapper leaves on the page, only the outermost ones are walked, all of them; else the whole page is.  A template node
loses its own text only; its children are judged for themselves, but inline
elements in a line of varying text stay, and so do headings inside an article that recur on a host's pages.

Defined cases: null html is empty, with empty text and n_chars 0; a page of a
host with no wrapper falls back on element kinds; repeated rows keep a row
each; an empty table gives no rows; pages of any length and depth are parsed whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROP = set("script style noscript template nav footer header aside form button select option textarea iframe svg canvas object head title dialog menu".split())
BLOCK = set("address article blockquote body caption dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 html li main ol p pre section summary table tbody td tfoot th thead tr ul hr".split())
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|cookies?|newsletter|subscribe|sidebar|menu|nav(?:bar|igation)?|breadcrumbs?|footer|comments?(?:[_-]?(?:section|list|area|thread|container|wrap(?:per)?|box|block|form))?|disqus|replies|popup|modal)(?:$|[\s_-](?!policy|guide|rules))", re.I)
# Words that also have plain meanings: they count only as the whole class, or joined by a hyphen or underscore.
WEAK = re.compile(r"^(?:promo|banner|consent|notice|header|reply|related|share|social|widget)s?(?:[_-][\w-]*)?$", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    __slots__ = ("tag", "kind", "kids", "text", "own", "sub", "full", "cls", "word", "id", "shape", "chars")

    def __init__(self, tag, kind=""):
        self.tag, self.kind, self.kids, self.text = tag, kind, [], []


class Tree(HTMLParser):
    """A forgiving DOM: text and children share one ordered list."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.root.chars = 0
        self.stack = [self.root]
        self.open: dict[str, int] = {}

    def updatepos(self, i, j):
        """Line numbers are not asked for."""
        return j

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and self.stack[-1].tag == "p" or tag in ("li", "tr", "td", "th", "dt", "dd", "option") and self.stack[-1].tag == tag:
            self.open[self.stack.pop().tag] -= 1
        a = dict(attrs)
        node = Node(tag, " ".join(filter(None, (a.get("class"), a.get("id"), a.get("role")))))
        if "hidden" in a or a.get("aria-hidden") == "true":
            node.kind += " popup"
        self.stack[-1].kids.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        while self.stack[-1].tag != tag:
            self.open[self.stack.pop().tag] -= 1
        self.open[self.stack.pop().tag] -= 1

    def handle_data(self, data):
        self.root.chars += len(data)
        self.stack[-1].kids.append(data)


def parse(html: str) -> Node:
    # Walks go as deep as a page nests; calls of Python functions take no machine stack.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * html.count("<") + 10000))
    t = Tree()
    t.feed(html)
    t.close()
    return t.root


def dropped(n: Node, inside: bool = False) -> bool:
    """``inside`` an article, a header element holds its title and stays."""
    if n.tag == "header" and inside:
        return False
    return n.tag in DROP or bool(n.kind and n.tag not in ("body", "html", "article", "main") and (NOISE.search(n.kind) or WEAK.match(n.kind)))


def step(path: str, n: Node) -> str:
    """Path of a child as a digest of fixed length, however deep it lies."""
    return hashlib.blake2b(f"{path}/{n.tag}.{n.kind}".encode("utf-8", "surrogatepass"), digest_size=9).hexdigest()


def own_text(n: Node) -> str:
    return " ".join("".join([k for k in n.kids if isinstance(k, str)]).split())


def kids(n: Node) -> list[Node]:
    return [k for k in n.kids if not isinstance(k, str)]


def number(n: Node, seen: dict, inside: bool = False) -> None:
    """Give the nodes that may be kept their text, class, greatest score and an id that equal subtrees share."""
    n.own, n.sub = own_text(n), [k for k in kids(n) if not dropped(k, inside)]
    for k in n.sub:
        number(k, seen, inside or k.tag in ("article", "main"))
    n.full = 1 + bool(n.own) + sum(k.full for k in n.sub)
    n.cls = seen.setdefault((n.tag, n.kind), len(seen))
    n.word = seen.setdefault(n.own, len(seen)) if n.own else -1
    n.id = seen.setdefault((n.cls, n.own, tuple(k.id for k in n.sub)), len(seen))
    n.shape = seen.setdefault((n.cls, None, tuple(k.shape for k in n.sub)), len(seen))


def texts(n: Node) -> list[int]:
    """Texts of a subtree in document order, -1 where a node has none."""
    out, todo = [], [n]
    while todo:
        k = todo.pop()
        out.append(k.word)
        todo.extend(reversed(k.sub))
    return out


def known_scores(x: list[Node], y: list[Node], same: np.ndarray, done: dict) -> np.ndarray:
    """Match scores of many pairs at once, -1 where only an alignment of the pair can tell.

    Subtrees without a common text score by their shapes alone, so one alignment serves all pairs of two shapes.
    In subtrees of one shape whose common texts all stand in equal places every node
    and every common text is matched, and no match can do better.
    """
    a, b = [texts(k) for k in x], [texts(k) for k in y]
    spots = []
    for side in (a, b):
        rows: dict[int, dict[int, int]] = {}
        for i, words in enumerate(side):
            for w in words:
                if w >= 0:
                    of = rows.setdefault(w, {})
                    of[i] = of.get(i, 0) + 1
        spots.append(rows)
    common = np.zeros(same.shape, np.int64)
    for w in spots[0].keys() & spots[1].keys():
        left, right = spots[0][w], spots[1][w]
        common[np.ix_([*left], [*right])] += np.minimum(np.array([*left.values()])[:, None], np.array([*right.values()]))
    out = np.full(same.shape, -1, np.int64)
    plain = done.setdefault("plain", {})
    for i, j in np.argwhere(same & (common == 0)).tolist():
        key = x[i].shape, y[j].shape
        if key not in plain:
            plain[key] = align(x[i], y[j], done)[0]
        out[i, j] = plain[key]
    for shape in {k.shape for k in x} & {k.shape for k in y}:
        i, j = [i for i, k in enumerate(x) if k.shape == shape], [j for j, k in enumerate(y) if k.shape == shape]
        left, right = np.array([a[k] for k in i]), np.array([b[k] for k in j])
        level = np.zeros((len(i), len(j)), np.int64)
        for u, v in zip(left.T, right.T):
            level += (u[:, None] == v) & (u[:, None] >= 0)
        own, cells = common[np.ix_(i, j)], np.ix_(i, j)
        out[cells] = np.where(level == own, left.shape[1] + level, out[cells])
    return out


def align(a: Node, b: Node, done: dict) -> tuple[int, list]:
    """Simple tree matching over all children: score of the best ordered match and the aligned children.

    A node scores 1, and 1 more for an equal text.  Equal heads and tails reach
    the greatest score there is, so they are set aside before the table is filled.
    """
    if a.cls != b.cls:
        return 0, []
    if a.id == b.id:
        return a.full, list(zip(a.sub, b.sub))
    got = done.get((a.id, b.id))
    if got is not None and got[2] is a and got[3] is b:
        return got[:2]
    x, y = a.sub, b.sub
    lo, hi, most = 0, 0, min(len(x), len(y))
    while lo < most and x[lo].id == y[lo].id:
        lo += 1
    while hi < most - lo and x[-1 - hi].id == y[-1 - hi].id:
        hi += 1
    pairs = [*zip(x[:lo], y[:lo]), *zip(x[len(x) - hi:], y[len(y) - hi:])]
    score = 1 + (a.word == b.word >= 0) + sum(p.full for p, _ in pairs)
    x, y = x[lo:len(x) - hi], y[lo:len(y) - hi]
    if len(x) == len(y) == 1:
        got = 0
        if x[0].cls == y[0].cls:
            got = align(x[0], y[0], done)[0] if x[0].sub and y[0].sub else 1 + (x[0].word == y[0].word >= 0)
            pairs.append((x[0], y[0]))
        score += got
    elif x and y:
        same = np.array([k.cls for k in x])[:, None] == np.array([k.cls for k in y])
        words = np.array([k.word for k in x])[:, None]
        s = same + (same & (words >= 0) & (words == np.array([k.word for k in y]))).astype(np.int64)
        deep = np.array([bool(k.sub) for k in x])[:, None] & np.array([bool(k.sub) for k in y])
        if np.count_nonzero(same & deep) > 16:
            known = known_scores(x, y, same & deep, done)
            s = np.where(same & deep & (known >= 0), known, s)
            deep &= known < 0
        for i, j in np.argwhere(same & deep).tolist():
            s[i, j] = align(x[i], y[j], done)[0]
        w = np.zeros((len(x) + 1, len(y) + 1), np.int64)
        for i in range(len(x)):
            np.maximum.accumulate(np.maximum(w[i, 1:], w[i, :-1] + s[i]), out=w[i + 1, 1:])
        score += int(w[-1, -1])
        i, j = len(x), len(y)
        while i and j:
            if s[i - 1, j - 1] and w[i, j] == w[i - 1, j - 1] + s[i - 1, j - 1]:
                i, j = i - 1, j - 1
                pairs.append((x[i], y[j]))
            elif w[i, j] == w[i - 1, j]:
                i -= 1
            else:
                j -= 1
    done[a.id, b.id] = score, pairs, a, b
    return score, pairs


def template_key(path: str, own: str) -> str:
    return hashlib.blake2b(f"{path}|{own}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def constants(a: Node, b: Node) -> set[str]:
    """Keys of aligned nodes with equal text."""
    done: dict = {}
    out, todo = set(), [(a, b, "")]
    while todo:
        x, y, path = todo.pop()
        if x.word == y.word >= 0:
            out.add((path, x.own))
        todo.extend((p, q, step(path, p)) for p, q in align(x, y, done)[1])
    return {template_key(p, t) for p, t in out}


def evidence(pages) -> tuple[int, dict[str, int]]:
    """Pairs aligned, a chain over all different pages, and in how many of them each key is constant."""
    seen: dict = {}
    trees = [parse(p) for p in sorted(set(pages), key=lambda p: hashlib.md5(p.encode("utf-8", "surrogatepass")).digest())]
    for t in trees:
        number(t, seen)
    same: dict[str, int] = {}
    for a, b in zip(trees, trees[1:]):
        for key in constants(a, b):
            same[key] = same.get(key, 0) + 1
    return max(0, len(trees) - 1), same


def induce(pages: list[str]) -> list[str]:
    """Template keys: constant in most alignments of different pages."""
    total, same = evidence(pages)
    return sorted(k for k, n in same.items() if total and n * 3 >= total * 2)


def main_roots(root: Node) -> list[tuple[Node, str]]:
    """Outermost article and main elements with their paths, in document order."""
    found, todo = [], [(root, "")]
    while todo:
        n, path = todo.pop()
        if n.tag in ("article", "main") or n.kind in ("main", "article"):
            found.append((n, path))
        elif not dropped(n):
            todo.extend((k, step(path, k)) for k in reversed(kids(n)))
    return found


def extract(html: str, template: set[str]) -> str:
    if not html:
        return ""
    blocks: list[str] = []
    parts: list[str] = []

    def end():
        t = " ".join("".join(parts).split())
        if t:
            blocks.append(t)
        parts.clear()

    def walk(n: Node, path: str, inside: bool = False, main: bool = False):
        """``inside``: the element stands in a line of varying text, which stays whole; ``main``: in an article."""
        if dropped(n, main):
            return
        main = main or n.tag in ("article", "main")
        block = n.tag in BLOCK
        if block:
            end()
        own = own_text(n) if template else ""
        heading = main and n.tag in HEADINGS  # a heading that recurs in the articles of a host names the slot below it, and stays
        constant = bool(own) and not heading and not (inside and not block) and template_key(path, own) in template
        line = bool(own) and not constant or inside and not block
        for k in n.kids:
            if isinstance(k, str):
                parts.append(" " if constant else k)
            else:
                if k.tag == "br":
                    parts.append(" ")
                walk(k, step(path, k) if template else "", line, main)
        if block:
            end()

    root = parse(html)
    for n, path in main_roots(root):
        walk(n, path, main=True)
    end()
    # The marks of article and main are believed while they hold at least a third of what would be left without them.
    held = sum(map(len, blocks))
    if not blocks or 3 * held < root.chars:
        marked = blocks.copy()
        blocks.clear()
        walk(root, "")
        end()
        if marked and 3 * held >= sum(map(len, blocks)):
            return "\n\n".join(marked)
    return "\n\n".join(blocks)


def host_of(url) -> "F.Column":
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, per_group: int = 16, seed: int = 9, max_broadcast: int = 100000) -> DataFrame:
    """``host, template`` from all different pages of a host.

    Pages fall by hash into groups of about ``per_group``; the host's first page
    by hash joins every group, so that no page stays alone.  Groups are aligned
    for themselves and their counts added up by host and key.
    """
    from .common import checkpointed

    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), "html").filter("html is not null")
    rows = rows.withColumn("place", F.struct(F.xxhash64(F.lit(seed), F.xxhash64("html")).alias("h"), "page_id"))
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("place.h").alias("different"), F.min("place").alias("first")).filter("n > 1")
    hosts = checkpointed(hosts.select("host", "first", F.greatest(F.lit(1), F.floor(F.col("different") / per_group)).alias("groups")))
    u = F.pmod(F.col("place.h"), F.lit(1 << 30)) / float(1 << 30)
    group = F.when(F.col("place").eqNullSafe(F.col("first")), F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).otherwise(F.array(F.floor(u * F.col("groups"))))
    dealt = rows.join(F.broadcast(hosts) if hosts.count() <= max_broadcast else hosts, "host").select("host", "html", F.explode(group).alias("group"))

    @F.pandas_udf("pairs long, same array<struct<key string, n long>>")
    def learn(groups: pd.Series) -> pd.DataFrame:
        found = [evidence(g) for g in groups]
        return pd.DataFrame({"pairs": [t for t, _ in found], "same": [[{"key": k, "n": n} for k, n in s.items()] for _, s in found]})

    found = dealt.groupBy("host", "group").agg(F.collect_set("html").alias("g")).select("host", learn("g").alias("r"))
    found = checkpointed(found.select("host", "r.*"))
    total = found.groupBy("host").agg(F.sum("pairs").alias("total")).filter("total >= 1")
    counts = found.select("host", F.explode("same").alias("k")).groupBy("host", "k.key").agg(F.sum("k.n").alias("n"))
    return counts.join(total, "host").filter("n * 3 >= total * 2").groupBy("host").agg(F.collect_list("key").alias("template"))


def extract_pages(pages: DataFrame, per_group: int = 16, max_broadcast: int = 100000) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    from .common import checkpointed

    learned = checkpointed(wrappers(pages, per_group, max_broadcast=max_broadcast))
    side = F.broadcast(learned) if learned.count() <= max_broadcast else learned

    @F.pandas_udf("string")
    def clean(html: pd.Series, template: pd.Series) -> pd.Series:
        return pd.Series([extract(h or "", set(t) if t is not None else set()) for h, t in zip(html, template)], dtype=object)

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(side, "host", "left")
    out = rows.select("page_id", "url", clean("html", "template").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
