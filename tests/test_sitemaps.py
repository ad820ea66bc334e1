"""The sitemap queries over whole tables, and the queue against a plain one."""

import random
from collections import defaultdict, deque

import pytest

from quarryline.operators import paging
from quarryline.plans import catalogue


def test_all_edges_are_walked(spark, tmp_path):
    edges = [(0, 100), (100, 250), (250, 3), (3, 777), (777, 8), (100, 0), (500, 600), (0, 100)]
    spark.createDataFrame(edges, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.QUERIES["sitemap_bfs_whole"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(0, 0), (3, 3), (100, 1), (250, 2), (777, 4)]


def test_all_pages_are_read(spark, tmp_path):
    spark.range(7).withColumnRenamed("id", "page_id").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.QUERIES["sitemap_urls_whole"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.n, r["loc"]) for r in got) == [(i, 1, f"https://example.org/{i}") for i in range(7)]


def queue(edges, items, root, max_requests, max_depth, max_items, fan_out):
    """A plain queue: fetch, append, follow."""
    children = defaultdict(list)
    for parent, place, child in sorted(edges):
        children[parent].append(child)
    out, taken, pushed, seen, todo = [], 0, 0, set(), deque([(root, 0)])
    while todo and len(out) < max_requests:
        node, depth = todo.popleft()
        n = items.get(node, 0)
        out.append((node, depth, len(out) + 1, taken, n if max_items is None else min(n, max_items - taken)))
        taken += n
        if max_items is not None and taken >= max_items:
            break
        if depth < max_depth:
            for child in children[node]:
                if child in seen:
                    continue
                seen.add(child)
                pushed += 1
                if fan_out is not None and pushed > fan_out:
                    todo.clear()
                    break
                todo.append((child, depth + 1))
    return out


@pytest.mark.parametrize("limits", [(1000, 6, None, None), (17, 6, None, None), (1000, 2, 40, None), (1000, 6, None, 12), (30, 4, 60, 25), (1000, 0, None, None), (1000, 5, 0, 0)])
def test_queue_order_and_limits(spark, limits):
    rnd = random.Random(str(limits))
    edges = [(s, rnd.randrange(40), place, rnd.randrange(40)) for s in range(6) for place in range(90)]
    items = {(s, n): rnd.randrange(6) for s in range(6) for n in range(30)}
    want = []
    for s in range(6):
        mine = {n: c for (x, n), c in items.items() if x == s}
        if limits[2] != 0:
            want += [(s, *r) for r in queue([e[1:] for e in edges if e[0] == s], mine, s, *limits)]
    e = spark.createDataFrame(edges, "source int, parent int, place int, child int")
    i = spark.createDataFrame([(s, n, c) for (s, n), c in items.items()], "source int, node int, n long")
    roots = spark.createDataFrame([(s, s) for s in range(6)], "source int, node int")
    got = sorted(map(tuple, paging.sitemap_queue(e, i, roots, *limits).collect()))
    assert got == sorted(want)
