"""Main text of web pages by minimum cuts: what is content, what is boilerplate, is decided for all blocks of a page at once.

A page becomes blocks of text with features (see `page_model`). A logistic regression gives each block the log-odds of being
content; that is its cost, the capacity of its edge to the source (content) or to the sink (boilerplate). Edges between
blocks hold together what is near: neighbours in page order, and blocks of one element or of elements side by side in the DOM.
The minimum cut is the labelling with the least sum of costs and cut edges; max-flow finds it.

The regression is fitted by Spark on hand-labelled pages and, with the same total weight, on blocks of a bounded sample of the corpus that
stand in an element which says what it holds (such as article or nav). Pages are worked on one by one; nothing is shuffled.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import small_batches, tidy
from statloom.llm.page_model import FEATURES, MAIN, SEED_PAGES, SIDE, Block, blocks_of, features
from statloom.session import cut_lineage

#: Pages the classifier is fitted on (expected number); penalty of the regression; largest cost of a block.
SAMPLE, PENALTY, LARGEST = 2_000, 0.01, 8.0
#: Capacities: neighbours in page order, of one element, of elements with one parent.
NEXT, SAME, KIN = 0.25, 0.75, 0.5

Edges = dict[tuple[int, int], float]


def proximity(blocks: Sequence[Block]) -> Edges:
    """Capacities between blocks: each with the next one on the page, of its element, and of its element's parent."""
    edges: Edges = {}

    def near(a: int, b: int, capacity: float) -> None:
        edges[a, b] = edges.get((a, b), 0.0) + capacity

    last_of_element: dict[int, int] = {}
    last_of_parent: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            near(i - 1, i, NEXT)
        if b.element in last_of_element:
            near(last_of_element[b.element], i, SAME)
        if b.parent in last_of_parent:
            near(last_of_parent[b.parent], i, KIN)
        last_of_element[b.element] = last_of_parent[b.parent] = i
    return edges


def max_flow(arcs: list[list[list]], source: int, sink: int) -> list[bool]:
    """Push the most flow from source to sink by shortest augmenting layers; which nodes the source still reaches.

    `arcs[u]` holds [v, capacity left, place of the arc back in arcs[v]].
    """
    n = len(arcs)
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, left, _ in arcs[u]:
                if left > 1e-12 and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[sink] < 0:
            return [depth >= 0 for depth in level]
        current, path, u = [0] * n, [], source
        while True:
            if u == sink:
                flow = min(arcs[a][i][1] for a, i in path)
                for a, i in path:
                    arc = arcs[a][i]
                    arc[1] -= flow
                    arcs[arc[0]][arc[2]][1] += flow
                # back to the first arc that is used up
                k = next(k for k, (a, i) in enumerate(path) if arcs[a][i][1] <= 1e-12)
                u = path[k][0]
                del path[k:]
            elif current[u] < len(arcs[u]):
                v, left, _ = arcs[u][current[u]]
                if left > 1e-12 and level[v] == level[u] + 1:
                    path.append((u, current[u]))
                    u = v
                else:
                    current[u] += 1
            elif path:
                u, _ = path.pop()
                current[u] += 1
            else:
                break


def minimum_cut(costs: Sequence[float], edges: Edges) -> list[bool]:
    """For each node whether it is on the source's side of the minimum cut; positive costs pull there, negative ones away.

    A node whose cost is larger than all its edges together is on its own side in every minimum cut: it is settled at
    once, and its edges count as costs of its neighbours. The rest is left to max-flow.
    """
    n = len(costs)
    pull = list(costs)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), capacity in edges.items():
        around[a][b] = around[a].get(b, 0.0) + capacity
        around[b][a] = around[b].get(a, 0.0) + capacity
    total = [sum(w.values()) for w in around]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        u = queue.popleft()
        if side[u] is not None or abs(pull[u]) <= total[u]:
            continue
        side[u] = pull[u] > 0
        for v, capacity in around[u].items():
            if side[v] is None:
                pull[v] += capacity if side[u] else -capacity
                total[v] -= capacity
                queue.append(v)
    rest = [u for u in range(n) if side[u] is None]
    if rest:
        number = {u: i for i, u in enumerate(rest)}
        source, sink = len(rest), len(rest) + 1
        arcs: list[list[list]] = [[] for _ in range(len(rest) + 2)]

        def join(a: int, b: int, there: float, back: float) -> None:
            arcs[a].append([b, there, len(arcs[b])])
            arcs[b].append([a, back, len(arcs[a]) - 1])

        for u in rest:
            if pull[u] > 0:
                join(source, number[u], pull[u], 0.0)
            elif pull[u] < 0:
                join(number[u], sink, -pull[u], 0.0)
            for v, capacity in around[u].items():
                if v > u and v in number:
                    join(number[u], number[v], capacity, capacity)
        reached = max_flow(arcs, source, sink)
        for u in rest:
            side[u] = reached[number[u]]
    return [bool(s) for s in side]


def main_text(html: str | None, weights: np.ndarray, intercept: float) -> str:
    """The content blocks of a page, in page order, one a line."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    costs = np.clip(np.array(features(blocks)) @ weights + intercept, -LARGEST, LARGEST)
    content = minimum_cut(costs.tolist(), proximity(blocks))
    return "\n".join(b.text for b, kept in zip(blocks, content) if kept)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of blocks in elements that say what they hold, with that as the label."""
    for batch in small_batches(batches, "html"):
        rows, labels = [], []
        for html in batch.column("html"):
            blocks = blocks_of(html.as_py())
            for b, row in zip(blocks, features(blocks)):
                if b.place in (MAIN, SIDE):
                    rows.append(row)
                    labels.append(float(b.place == MAIN))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64())], ["row", "label"])


def fit(pages: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and intercept of the block classifier.

    Fitted on SEED_PAGES and on blocks of about SAMPLE pages, drawn by a hash of the url and the page's text, with equal total weights.
    """
    spark = pages.sparkSession
    seeds = []
    for page in SEED_PAGES:
        blocks = blocks_of(page)
        seeds += [(row, float(b.label or 0)) for b, row in zip(blocks, features(blocks))]
    count = pages.count()
    draw = F.shiftrightunsigned(F.xxhash64("url", "html"), 11) / F.lit(2.0**53)
    drawn = pages.where(draw < SAMPLE / max(count, 1)).select("html")
    own = cut_lineage(drawn.mapInArrow(tidy(_labelled), "row array<double>, label double"), "blocks")
    found = own.count()
    given = spark.createDataFrame([(*s, max(found, 1) / len(seeds)) for s in seeds], "row array<double>, label double, weight double")
    rows = own.withColumn("weight", F.lit(1.0)).unionByName(given).select(array_to_vector("row").alias("features"), "label", "weight")
    model = LogisticRegression(regParam=PENALTY, weightCol="weight", maxIter=50).fit(rows)
    return np.array(model.coefficients.toArray()), float(model.intercept)


def _extracted(weights: np.ndarray, intercept: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html", 4_000_000):
            texts = [main_text(html.as_py(), weights, intercept) for html in batch.column("html")]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points), one row per input row.

    The text is the article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and reader
    comments: blocks joined in page order by one line feed, character references decoded, white space inside a block as one
    blank. A null or empty page, or one without content, has an empty text. Rows are worked on one by one, repeated ones as
    often as they are there, whatever their ids (null ones too); other columns are not read. An empty table gives an empty result.
    Broken markup is read as far as it goes: unclosed elements end with what encloses them.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    weights, intercept = fit(pages)
    return pages.mapInArrow(tidy(_extracted(weights, intercept)), "page_id bigint, url string, text string, n_chars bigint")


__all__ = ["FEATURES", "extract_main_text", "fit", "main_text", "max_flow", "minimum_cut", "proximity"]
