"""HTML extraction by a tree-structured graphical model over the DOM.

Nodes are block elements and the runs of text in them. Each has a potential from its features, each parent and child a
potential from their kinds; sum-product messages go up and down the tree once and give every run's
probability of being article. Both are trained from labelled pages.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrace.llm.html_pages import labelled_pages
from citetrace.llm.html_tree import GROUPS, Tree, parse

#: Copies of each layout that the model is fitted on: the bound of the labelled sample.
COPIES = 8
THRESHOLD = 0.5

# Whole headings of reader comments and of lists of other pages, and a note of rights. A heading that may as well be a section's own
# ("Discussion", "Response", "Related work", "Popular culture") is none of them.
TALK = re.compile(
    r"\W*(?:(?:\d+|no|reader|user|visitor|all|view|show|recent|latest|your)\s+)*comments?\W*\d*\W*$"
    r"|\W*\d+\s+(?:responses?|replies|reply|thoughts?|reactions?)(?:\s+(?:to|on)\b.{0,50})?\W*$"
    r"|\W*(?:leave|add|post|write)\s+(?:a|your)\s+(?:reply|comment)\W*$|\W*join\s+the\s+(?:conversation|discussion)\W*$|\W*(?:responses|replies)\W*\d*\W*$"
    r"|\W*(?:\d+\s+)?(?:kommentare?|commentaires?|comentarios?)\W*\d*\W*$",
    re.I,
)
MORE = re.compile(
    r"\W*(?:related|recommended|popular|trending|latest|recent|top|other)\s+(?:articles|posts|stories|news|videos|links|pages|topics|content|now)\W*$|\W*(?:recommended\s+for\s+you|read\s+next|up\s+next|trending|sponsored|advertisement)\W*$"
    r"|\W*you\s+(?:may|might)\s+(?:also\s+)?(?:like|enjoy)\b.{0,30}$|\W*more\s+(?:stories|articles|posts|news)\b.{0,40}$|\W*more\s+from\b.{0,40}$|\W*more\s+like\s+this\W*$|\W*most\s+(?:read|popular|viewed|shared)\b.{0,20}$"
    r"|\W*(?:share\s+this|follow\s+us|subscribe)\b.{0,30}$|\W*(?:our\s+)?newsletter(?:\s+sign\W?up)?\W*$",
    re.I,
)
RIGHTS = re.compile(r"\s*(?:copyright\W*(?:©|\(c\)|\d{4}|by\b)|©|\(c\)\s*\d{4})", re.I)
HEADINGS = {f"h{n}": n for n in range(1, 7)}

TAGS = "article main section div p li ul ol h1 h2 h3 td th table blockquote pre nav header footer aside form button figure dialog body #text".split()
TAG_OF = {t: i for i, t in enumerate(TAGS)}
NUMBERS = 8
REGIONS = frozenset("header footer nav aside form button dialog menu search fieldset".split())
PLAIN = frozenset("body div td table tbody tr center".split())
EDGE_KINDS = 8
WIDTH = len(TAGS) + 1 + len(GROUPS) + NUMBERS + 1



def after_heads(tree: Tree) -> tuple[list[bool], list[bool]]:
    """Of each node: whether it is, stands after or is in what stands after a heading of comments, and of other pages.

    A heading reaches to the next one of its level or above among its siblings.
    """
    n = len(tree.parent)
    first: list[str | None] = [None] * n  # the text of headings
    for i, text in enumerate(tree.text):
        if text is not None:
            p = tree.parent[i]
            if first[p] is None:
                first[p] = text
    out = []
    for words in (TALK, MORE):
        flag, level = [False] * n, [0] * n
        for i in range(1, n):
            p = tree.parent[i]
            rank = HEADINGS.get(tree.kind[i])
            if rank:
                hit = bool(first[i]) and len(first[i]) < 60 and words.match(first[i]) is not None
                if hit and not level[p]:
                    level[p] = rank
                elif not hit and rank <= level[p]:
                    level[p] = 0
            flag[i] = flag[p] or level[p] > 0
        out.append(flag)
    return out[0], out[1]


def features(tree: Tree, flags: tuple[list[bool], list[bool]]) -> np.ndarray:
    """A row for each node: kind, names, what it stands after, and numbers of its text and of the text below it."""
    n = len(tree.parent)
    x = np.zeros((n, WIDTH), dtype=np.float32)
    chars, link, ends, runs = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        text = tree.text[i]
        if text is not None:
            chars[i] = len(text)
            link[i] = len(text) * min(1.0, tree.linked[i])
            ends[i] = sum(text.count(c) for c in ".!?。")
            runs[i] = 1
        p = tree.parent[i]
        if p >= 0:
            chars[p] += chars[i]
            link[p] += link[i]
            ends[p] += ends[i]
            runs[p] += runs[i]
    numbers = len(TAGS) + 1 + len(GROUPS)
    for i in range(n):
        x[i, TAG_OF.get(tree.kind[i], len(TAGS))] = 1
        for g in tree.groups[i]:
            x[i, len(TAGS) + 1 + g] = 1
    c, lk, e, r = (np.array(v, dtype=np.float32) for v in (chars, link, ends, runs))
    run = np.array([t is not None for t in tree.text])
    x[:, numbers] = lk / np.maximum(c, 1)
    x[:, numbers + 1] = ~run * np.minimum(np.log1p(c / np.maximum(r, 1)) / 5, 1.2)
    x[:, numbers + 2] = ~run * (e > 0)
    x[:, numbers + 3] = run * (c < 25)
    x[:, numbers + 4] = ~run * (c / np.maximum(r, 1) < 25)
    x[:, numbers + 5], x[:, numbers + 6] = flags
    x[:, numbers + 7] = [t is not None and len(t) < 400 and RIGHTS.match(t) is not None for t in tree.text]
    x[:, -1] = 1
    return x


def kinds_of(tree: Tree, flags: tuple[list[bool], list[bool]]) -> list[int]:
    """The kind of the edge to each node's parent: into what stands after a heading (7), to a run (6), else what the child is and whether the parent is a plain box."""
    out = []
    for kind, groups, p, talk, more in zip(tree.kind, tree.groups, tree.parent, *flags, strict=True):
        if p >= 0 and (talk and not flags[0][p] or more and not flags[1][p]):
            out.append(7)
        elif kind == "#text":
            out.append(6)
        else:
            child = 1 if kind in REGIONS or any(groups) else 2 if groups or kind in ("article", "main") else 0
            out.append(2 * child + (p >= 0 and tree.kind[p] in PLAIN and not tree.groups[p]))
    return out


def sum_product(parent: list[int], kinds: list[int], unary: list[float], pot: list) -> tuple[list[float], list[float]]:
    """P(1) of each node of a tree whose parents come first, and P(equal to its parent) of each node but the root.

    unary: log odds of a node alone; pot[kind][parent label][label] of an edge, symmetric.
    """
    n = len(parent)
    clip = lambda v: 30.0 if v > 30 else -30.0 if v < -30 else v
    up = list(unary)  # log odds of a node from itself and what is below it
    sent = [0.0] * n  # log odds that it sends to its parent
    for i in range(n - 1, 0, -1):
        o = math.exp(clip(up[i]))
        (a, b), (c, d) = pot[kinds[i]]
        sent[i] = math.log((c + d * o) / (a + b * o))
        up[parent[i]] += sent[i]
    out, same = list(up), [0.0] * n
    for i in range(1, n):
        rest = math.exp(clip(out[parent[i]] - sent[i]))
        (a, b), (c, d) = pot[kinds[i]]
        out[i] = up[i] + math.log((b + d * rest) / (a + c * rest))
        o = math.exp(clip(up[i]))
        same[i] = (a + d * o * rest) / (a + b * o + c * rest + d * o * rest)
    return [1 / (1 + math.exp(-clip(v))) for v in out], same


class Model:
    """Weights of the node potentials and, for each kind of edge, log potentials of (parent, child)."""

    def __init__(self, weights: np.ndarray, edges: np.ndarray):
        self.weights, self.edges = weights, edges

    def marginals(self, tree: Tree) -> list[float]:
        """P(article) of each node by one upward and one downward pass of sum-product messages."""
        flags = after_heads(tree)
        return sum_product(tree.parent, kinds_of(tree, flags), (features(tree, flags) @ self.weights).tolist(), np.exp(self.edges).tolist())[0]

    def extract(self, page: str | None, threshold: float = THRESHOLD) -> str:
        if not page:
            return ""
        tree = parse(page)
        if len(tree.parent) < 2:
            return ""
        keep = self.marginals(tree)
        return " ".join(t for t, p in zip(tree.text, keep, strict=True) if t is not None and p >= threshold)


def train(pages: list[str] | None = None, steps: int = 25, climbs: int = 120, ridge: float = 1.0) -> Model:
    """Fit on pages whose article stands between ``[[`` and ``]]``. An element is article if it holds any of it.

    Node weights and edge couplings start from each label given its parent's and climb the likelihood of whole pages,
    whose gradient is what is seen less what the messages expect.
    """
    xs, ys, zs, whole = [], [], [], []
    for page in pages or labelled_pages(COPIES):
        tree = parse(page.replace("[[", "\x01").replace("]]", "\x02"))
        marked, inside, share = [], False, [[0, 0] for _ in tree.parent]
        for i, text in enumerate(tree.text):
            if text is None:
                marked.append(0)
                continue
            own = inside or "\x01" in text
            inside = (inside or "\x01" in text) and "\x02" not in text.rsplit("\x01", 1)[-1]
            clean = text.replace("\x01", "").replace("\x02", "").strip()
            tree.text[i] = clean or "\x00"
            if text.strip("\x01\x02 ") == "":
                own = False
            marked.append(int(own))
            p = i
            while p >= 0:
                share[p][own] += len(clean)
                p = tree.parent[p]
        drop = [t == "\x00" for t in tree.text]
        y = [int(s[1] > 0) for s in share]
        for i, d in enumerate(drop):
            if d:
                tree.text[i] = ""
        flags = after_heads(tree)
        x, kinds = features(tree, flags), kinds_of(tree, flags)
        whole.append((tree.parent, kinds, x.astype(np.float64), np.array(y, dtype=np.float64), np.array(drop)))
        beside = np.zeros((len(y), EDGE_KINDS))
        for i in range(1, len(y)):
            if not drop[i]:
                beside[i, kinds[i]] = 2 * y[tree.parent[i]] - 1
        for i in range(len(y)):
            if not drop[i]:
                xs.append(x[i])
                ys.append(y[i])
                zs.append(beside[i])
    x, y = np.hstack([np.array(xs, dtype=np.float64), np.array(zs)]), np.array(ys, dtype=np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    w[WIDTH:] = np.maximum(w[WIDTH:], 0.2) / 2
    m, v = np.zeros(len(w)), np.zeros(len(w))
    spin = np.array([[1.0, -1.0], [-1.0, 1.0]])
    for step in range(1, climbs + 1):  # Adam
        g = -ridge * 0.1 * w
        pot = np.exp(w[WIDTH:, None, None] * spin).tolist()
        for parent, kinds, x, y, drop in whole:
            p, same = sum_product(parent, kinds, (x @ w[:WIDTH]).tolist(), pot)
            g[:WIDTH] += x.T @ np.where(drop, 0, y - np.array(p))
            seen = (y == y[parent]).astype(float) - np.array(same)
            seen[0] = 0
            np.add.at(g, WIDTH + np.array(kinds), 2 * np.where(drop, 0, seen))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w[WIDTH:] = np.maximum(w[WIDTH:], 0.05)
    return Model(w[:WIDTH].astype(np.float32), w[WIDTH:, None, None] * spin)


def _extracting(model: Model, threshold: float):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.large_string())])

    def of(batches):
        for batch in batches:
            texts = [model.extract(page.as_py(), threshold) for page in batch.column("html")]
            yield pa.record_batch([batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.large_string())], schema=schema)

    return of


def extract_text(pages: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``. A null or empty html, or one without an article, gives ''.

    A page is read whole, in time linear in its length, however its tags nest. Repeated rows give repeated rows, null ids and urls stay null;
    other columns are not read. An empty table gives no rows.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = own.mapInArrow(_extracting(model or train(), threshold), "page_id long, url string, text string")
    return out.select("*", F.length("text").cast("long").alias("n_chars"))
