"""A tree-structured graphical model that tells the content of a page from what surrounds it.

Every block element and every run of text has a binary state (content or not). Features of a node favour a state, and
parent-child potentials, which depend on the kind of the child, tie the states along the tree. Sum-product messages, up from
the leaves and down from the root, give the exact marginal of every node; training follows the exact gradient of the
likelihood of labelled pages, which is convex. Many pages are one forest and are worked on level by level in numpy.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np

from tallyframe.llm.html_tree import Page, read_page

# Training steps, step size, and the weight of the penalty on squares of weights.
STEPS = 200
RATE = 0.1
PENALTY = 0.3
# A feature counts that stands in so many labelled pages.
LEAST_PAGES = 2

KINDS = ("run", "item", "heading", "section")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_ITEMS = frozenset(("p", "li", "td", "th", "tr", "dt", "dd", "pre", "blockquote"))


def _kind(page: Page, number: int) -> int:
    tag = page.nodes[number].tag
    return 0 if not tag else 2 if tag in _HEADINGS else 1 if tag in _ITEMS else 3


def _size(number: int) -> int:
    """0, 1, 2, 3 or 4 for 0, 1-3, 4-15 and so on by powers of four."""
    return (number.bit_length() + 1) // 2


def _share(part: float, whole: float) -> int:
    """None, up to a third, up to two thirds, more."""
    return 0 if part <= 0 or whole <= 0 else 1 + int(min(3 * part / whole, 2.0))


def features(page: Page) -> list[list[str]]:
    """The binary features of each node."""
    nodes = page.nodes
    count = len(nodes)
    length, linked, runs, ended, items = ([0] * count for _ in range(5))
    for number in range(count - 1, -1, -1):
        node = nodes[number]
        if not node.tag:
            length[number] = len(node.text)
            linked[number] = node.linked
            runs[number] = 1
            ended[number] = node.text[-1:] in ".!?。！？…\"”»" and len(node.text) > 40
        items[number] += node.tag == "p"
        if node.parent >= 0:
            for column in (length, linked, runs, ended, items):
                column[node.parent] += column[number]
    alike = Counter((node.parent, node.tag) for node in nodes)
    out: list[list[str]] = []
    before, heading, title = 0, False, page.title.casefold()
    total = max(length[0], 1)
    for number, node in enumerate(nodes):
        if node.tag:
            found = [
                f"tag {node.tag}",
                f"size {_size(length[number])}",
                f"links {_share(linked[number], length[number])}",
                f"mean {_size(length[number] // max(runs[number], 1))}",
                f"sentences {_share(ended[number], runs[number])} {min(runs[number], 3)}",
                f"paragraphs {_size(items[number])}",
                f"page {_share(length[number], total)}",
            ]
            found.append(f"alike {node.tag} {_size(alike[node.parent, node.tag])}")
            found += [f"word {word}" for word in node.words]
            if not node.words:
                found.append("unnamed")
            if node.tag == "h1":
                heading = True
        else:
            text = node.text
            within = nodes[node.parent].tag
            found = [
                f"in {within}",
                f"run {_size(len(text))}",
                f"run links {_share(node.linked, len(text))}",
                f"run end {text[-1:] in '.!?。！？…' and 1} {_size(len(text)) > 3}",
                f"run at {_share(before, total)} {heading}",
            ]
            if "©" in text or text[:9].casefold() == "copyright" or "all rights reserved" in text[-200:].casefold():
                found.append("copyright")
            if title and len(text) >= 8 and within in _HEADINGS:
                own = text.casefold()
                found.append(f"title {own[:40] in title or title[:40] in own}")
            before += len(text)
        out.append(found)
    return out


@dataclass
class Level:
    """The nodes of one depth, those of one parent side by side: their parents, and where each parent's nodes begin."""

    nodes: np.ndarray
    above: np.ndarray
    starts: np.ndarray


@dataclass
class Forest:
    """Nodes of many pages: features as (node, feature) pairs, parents, kinds, and the levels below the roots."""

    size: int
    owner: np.ndarray
    feature: np.ndarray
    parent: np.ndarray
    kind: np.ndarray
    levels: list[Level]


def forest(pages: list[Page], numbers: dict[str, int]) -> Forest:
    owner, feature, parent, kind, depth = [], [], [], [], []
    for page in pages:
        start = len(parent)
        for number, found in enumerate(features(page)):
            above = page.nodes[number].parent
            parent.append(start + above if above >= 0 else -1)
            depth.append(depth[start + above] + 1 if above >= 0 else 0)
            kind.append(_kind(page, number))
            known = [numbers[name] for name in found if name in numbers]
            owner += [start + number] * len(known)
            feature += known
    columns = [np.array(column, np.int64) for column in (owner, feature, parent, kind)]
    order = np.lexsort((columns[2], depth))
    levels = []
    for nodes in np.split(order, np.flatnonzero(np.diff(np.array(depth)[order])) + 1)[1:]:
        above = columns[2][nodes]
        levels.append(Level(nodes, above, np.flatnonzero(np.append(True, above[1:] != above[:-1]))))
    return Forest(len(parent), *columns, levels)


def _sum_product(trees: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all nodes, and of all edges (child, state of the parent, state of the child).

    ``unary``: log potentials (node, state); ``pair``: (kind of the child, state of the parent, state of the child).
    """
    belief = unary.copy()
    up = np.zeros_like(unary)
    for level in reversed(trees.levels):
        table = pair[trees.kind[level.nodes]] + belief[level.nodes][:, None, :]
        sent = np.logaddexp(table[:, :, 0], table[:, :, 1])
        up[level.nodes] = sent
        belief[level.above[level.starts]] += np.add.reduceat(sent, level.starts)
    joint = np.zeros((trees.size, 2, 2))
    for level in trees.levels:
        outside = belief[level.above] - up[level.nodes]
        table = pair[trees.kind[level.nodes]] + outside[:, :, None]
        down = np.logaddexp(table[:, 0], table[:, 1])
        table = np.exp(table + belief[level.nodes][:, None, :] - (belief[level.nodes] + down).max(axis=1)[:, None, None])
        joint[level.nodes] = table / table.sum(axis=(1, 2))[:, None, None]
        belief[level.nodes] += down
    belief -= np.logaddexp(belief[:, 0], belief[:, 1])[:, None]
    return np.exp(belief), joint


@dataclass(frozen=True)
class Model:
    numbers: dict[str, int]
    # Log odds of content by feature, and potentials by kind of the child, state of the parent and of the child.
    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """The probability of content of each node of each page."""
        trees = forest(pages, self.numbers)
        if not trees.size:
            return [np.zeros(0) for _ in pages]
        content = _sum_product(trees, _unary(trees, self.weights), self.pair)[0][:, 1]
        return np.split(content, np.cumsum([len(page.nodes) for page in pages])[:-1])


def _unary(trees: Forest, weights: np.ndarray) -> np.ndarray:
    odds = np.bincount(trees.owner, weights[trees.feature], trees.size)
    return np.stack([-odds / 2, odds / 2], axis=1)


def label(page: Page, content: str) -> np.ndarray:
    """States of the nodes of a page whose content is known, as blocks joined by empty lines.

    A run of text is content if it is one of the blocks, taken in order; an element is, if most of its text is.
    """
    blocks = content.split("\n\n") if content else []
    state = np.zeros(len(page.nodes), np.int64)
    at = 0
    for number, node in enumerate(page.nodes):
        if not node.tag and at < len(blocks) and node.text == blocks[at]:
            state[number], at = 1, at + 1
    inside, whole = np.zeros(len(page.nodes)), np.zeros(len(page.nodes))
    for number in range(len(page.nodes) - 1, -1, -1):
        node = page.nodes[number]
        if not node.tag:
            whole[number], inside[number] = len(node.text), len(node.text) * state[number]
        else:
            state[number] = 2 * inside[number] > whole[number]
        if node.parent >= 0:
            whole[node.parent] += whole[number]
            inside[node.parent] += inside[number]
    return state


def train(labelled: list[tuple[str, str]], steps: int = STEPS) -> Model:
    """Fit the model to pages with their known content; as many as the caller bounds, on one machine."""
    pages = [read_page(page) for page, _ in labelled]
    seen = Counter(name for page in pages for name in {f for found in features(page) for f in found})
    numbers = {name: n for n, name in enumerate(sorted(name for name, times in seen.items() if times >= LEAST_PAGES))}
    trees = forest(pages, numbers)
    state = np.concatenate([label(page, content) for page, (_, content) in zip(pages, labelled)])
    child = np.flatnonzero(trees.parent >= 0)
    wanted = np.bincount(trees.feature, state[trees.owner], len(numbers))
    cells = (trees.kind[child] * 2 + state[trees.parent[child]]) * 2 + state[child]
    wanted_pair = np.bincount(cells, minlength=4 * len(KINDS)).reshape(-1, 2, 2)

    weights, pair = np.zeros(len(numbers)), np.zeros((len(KINDS), 2, 2))
    moments = [np.zeros_like(x) for x in (weights, weights, pair, pair)]
    for step in range(1, steps + 1):
        content, joint = _sum_product(trees, _unary(trees, weights), pair)
        slope = wanted - np.bincount(trees.feature, content[trees.owner, 1], len(numbers)) - PENALTY * weights
        had = np.zeros_like(pair)
        np.add.at(had, trees.kind[child], joint[child])
        slope_pair = wanted_pair - had - PENALTY * pair
        # Adam: steps of like size for rare and for common features.
        for place, (values, gradient) in enumerate(((weights, slope), (pair, slope_pair))):
            mean, square = moments[2 * place], moments[2 * place + 1]
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient**2 - square)
            rate = RATE * (1 - step / (steps + 1))
            values += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(numbers, weights, pair)
