import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import cells, nearest
from mnemospark.session import new_folder
from tests import brute

MEMORY = "id {}, user_id string, project_id string, importance_score double, embedding array<float>"
REQUEST = "qid {}, user_id string, project_id string, embedding array<float>"


def make(seed, n_memories, n_requests, dims=6, clusters=None):
    """Random rows; user ``big`` owns most of them."""
    rng = np.random.default_rng(seed)

    def vectors(n):
        v = rng.normal(size=(n, dims))
        if clusters:
            v = v * 0.15 + rng.normal(size=(clusters, dims))[rng.integers(clusters, size=n)]
        return np.float32(v)

    def rows(n, key):
        return [
            {
                key: i,
                "user_id": str(rng.choice(["big", "big", "big", "b", "c"])),
                "project_id": rng.choice([None, "p", "q", ""]),
                "importance_score": float(rng.choice([0.0, 0.4, 0.9])),
                "embedding": [float(x) for x in v],
            }
            for i, v in enumerate(vectors(n))
        ]

    memories, requests = rows(n_memories, "id"), rows(n_requests, "qid")
    for copy in range(0, n_memories, 5):  # equal vectors must tie by id
        memories[copy]["embedding"] = memories[0]["embedding"]
    return memories, requests


def frames(spark, memories, requests, key="long"):
    cast = str if key == "string" else int
    m = [(cast(r["id"]), r["user_id"], r["project_id"], r["importance_score"], r["embedding"]) for r in memories]
    q = [(cast(r["qid"]), r["user_id"], r["project_id"], r["embedding"]) for r in requests]
    return (
        spark.createDataFrame(m, MEMORY.format(key)).repartition(5),
        spark.createDataFrame(q, REQUEST.format(key)).repartition(3),
    )


def test_search_reads_only_the_users_that_ask(spark, tmp_path):
    rows = [(k, f"u{k % 5}", "p", 0.5, [1.0, float(k)]) for k in range(50)]
    schema = "id long, user_id string, project_id string, importance_score double, embedding array<double>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/m")
    stored = spark.read.parquet(f"{tmp_path}/m")
    asked = spark.createDataFrame(
        [(1, "u1", "p", [1.0, 2.0]), (2, "u3", "p", [1.0, 0.0])],
        "qid int, user_id string, project_id string, embedding array<double>",
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = nearest.nearest_memories(asked, stored, 3)
    plan = found._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "In(user_id, [" in pushed and "project_id" in pushed
    assert found.count() == 6


def check(found, memories, requests, k, floor=None, cast=int):
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.similarity))
    for q in requests:
        want = brute.nearest(q, memories, k, floor)
        if cast is str:
            want = brute.nearest(q, [dict(m, id=str(m["id"])) for m in memories], k, floor)
        have = got.get(cast(q["qid"]), [])
        assert [i for i, _ in have] == [i for i, _ in want]
        assert [s for _, s in have] == pytest.approx([s for _, s in want], abs=1e-11)


@pytest.mark.parametrize("route", ["scan", "blocks", "small blocks"])
def test_same_as_brute_force(spark, monkeypatch, route):
    if route == "small blocks":
        monkeypatch.setattr(nearest, "MEMORY_BLOCK_ROWS", 40)
        monkeypatch.setattr(nearest, "REQUEST_BLOCK_ROWS", 7)
    memories, requests = make(1, 300, 40)
    m, q = frames(spark, memories, requests)
    limit = 4096 if route == "scan" else 0
    check(nearest.nearest_memories(q, m, 5, broadcast_requests=limit), memories, requests, 5)


def test_string_ids_and_payload(spark):
    memories, requests = make(2, 60, 8)
    m, q = frames(spark, memories, requests, "string")
    for limit in (4096, 0):
        found = nearest.nearest_memories(q, m, 3, broadcast_requests=limit, columns=["importance_score"])
        check(found, memories, requests, 3, cast=str)
        assert found.filter("importance_score <= 0").isEmpty()


def test_vectors_without_direction_are_left_out(spark):
    memories, requests = make(3, 30, 4)
    memories[3]["embedding"] = [0.0] * 6
    memories[4]["embedding"] = None
    m, q = frames(spark, memories, requests)
    check(nearest.nearest_memories(q, m, 30), memories, requests, 30)
    report = {r.user_id: r for r in nearest.missing_vectors(m).collect()}
    assert sum(r.without_vector for r in report.values()) == 1


def test_tiles_inside_a_block(spark, monkeypatch):
    from mnemospark.functions import blocks

    monkeypatch.setattr(blocks, "MEMORY_TILE", 16)
    monkeypatch.setattr(blocks, "REQUEST_TILE", 3)
    memories, requests = make(4, 120, 10)
    import pandas as pd
    import pyarrow as pa

    as_table = lambda rows, key: pa.Table.from_pandas(
        pd.DataFrame(rows).rename(columns={"user_id": "scope"}), preserve_index=False
    )
    live = [r for r in memories if r["importance_score"] > 0]
    found = blocks.keep_best(
        list(
            blocks.match_blocks(
                blocks.Block.read(as_table(requests, "qid"), "qid"),
                blocks.Block.read(as_table(live, "id"), "id"),
                blocks.MatchRule(4),
            )
        ),
        4,
    ).to_pylist()
    for q in requests:
        want = [i for i, _ in brute.nearest(q, memories, 4)]
        assert [r["id"] for r in found if r["qid"] == q["qid"]] == want


def test_single_request(spark):
    memories, requests = make(5, 80, 5)
    m, _ = frames(spark, memories, requests)
    for q in requests:
        found = nearest.find_by_vector(m, q["embedding"], q["user_id"], q["project_id"], 6)
        assert [r.id for r in found.collect()] == [i for i, _ in brute.nearest(q, memories, 6)]


def test_cells(spark, monkeypatch):
    """All probes are exact; the pruned threshold search is exact; few probes recall."""
    monkeypatch.setattr(nearest, "MEMORY_BLOCK_ROWS", 50)
    memories, requests = make(6, 250, 30, clusters=8)
    m, q = frames(spark, memories, requests)
    cells = nearest.fit_cells(m, n_cells=8)
    all_cells = nearest.nearest_memories_approx(q, m, cells, probes=8, k=5)
    check(all_cells, memories, requests, 5)
    pruned = nearest.nearest_memories(
        q, m, 3, min_similarity=0.93, cells=cells, broadcast_requests=0
    )
    check(pruned, memories, requests, 3, floor=0.93)
    exact = nearest.nearest_memories(q, m, 5)
    few = nearest.nearest_memories_approx(q, m, cells, probes=2, k=5)
    recall = nearest.recall_report(exact, few).agg({"recall": "avg"}).first()[0]
    assert 0.4 < recall <= 1.0


def test_pruning_leaves_cells_out(spark):
    memories, requests = make(7, 250, 30, clusters=8)
    m, q = frames(spark, memories, requests)
    cells = nearest.fit_cells(m, n_cells=8)
    wanted = q.withColumnRenamed("user_id", "scope")
    reach = nearest.cells_within(cells, nearest._chord(0.93))
    copies = wanted.agg(F.sum(F.size(reach("embedding")))).first()[0]
    assert copies < 30 * 8 * 0.6


def test_kept_cells(spark):
    """A table in cells: appended to, split where full, and searched by reading a part of it."""
    memories, requests = make(9, 400, 30, clusters=8)
    m, q = frames(spark, memories, requests)
    path = new_folder(spark, "cells")
    cells.create_cell_table(m.filter("id < 200"), path, n_cells=4)
    cells.append_to_cells(m.filter("id >= 200"), path)
    check(cells.search_cells(q, path, probes=4, k=5), memories, requests, 5)

    def files():
        return {f.rsplit("/", 1)[1] for f in spark.read.parquet(f"{path}/rows").inputFiles()}

    before = files()
    split = cells.split_full_cells(spark, path, full=80)
    names, centres, version = cells._centres(spark, path)
    assert split and version == 1 and not set(split) & set(names.tolist()) and len(names) == len(centres) > 4
    # Other cells were not written again.
    rows = spark.read.parquet(f"{path}/rows")
    assert before <= files()
    written = rows.filter(F.input_file_name().rlike("|".join(files() - before)))
    assert {r.cell for r in written.select("cell").distinct().collect()} == set(names.tolist()) - {0, 1, 2, 3}
    check(cells.search_cells(q, path, probes=len(names), k=5), memories, requests, 5)
    assert cells.split_full_cells(spark, path, full=400) == []
    probes = cells.fit_probes(q, path, recall=0.9, k=5)
    exact = nearest.nearest_memories(q, m, 5)
    found = cells.search_cells(q, path, probes, k=5)
    report = nearest.recall_report(exact, found).agg(F.sum("found"), F.sum("expected")).first()
    assert report[0] >= 0.9 * report[1] and probes < len(names)


def test_a_search_reads_the_partitions_of_its_cells(spark):
    memories, requests = make(10, 300, 1, clusters=8)
    m, q = frames(spark, memories, requests)
    path = new_folder(spark, "cells")
    cells.create_cell_table(m, path, n_cells=8)
    plan = cells.search_cells(q, path, probes=2, k=5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_kept_cells_have_few_files(spark):
    """However many tasks rows come from, a cell is not written by all of them."""
    memories, requests = make(12, 300, 2, clusters=8)
    m, _ = frames(spark, memories, requests)
    path = new_folder(spark, "cells")
    cells.create_cell_table(m.repartition(12), path, n_cells=6)
    assert len(spark.read.parquet(f"{path}/rows").inputFiles()) == 6
    cells.append_to_cells(m.repartition(12), path)
    assert len(spark.read.parquet(f"{path}/rows").inputFiles()) == 12
    cells.split_full_cells(spark, path, full=50)
    names, _, _ = cells._centres(spark, path)
    files = spark.read.parquet(f"{path}/rows").inputFiles()
    assert len(files) == 12 + len(set(names.tolist()) - set(range(6)))


def test_requests_are_not_copied_to_most_cells(spark, monkeypatch):
    """Sets of cells and copies for each cell give the same matches; with sets a request is one row of a block."""
    memories, requests = make(13, 400, 40, clusters=8)
    m, q = frames(spark, memories, requests)
    path = new_folder(spark, "cells")
    cells.create_cell_table(m, path, n_cells=12)
    rows, join = [], nearest._join_blocks
    monkeypatch.setattr(nearest, "_join_blocks", lambda wanted, *a: rows.append(wanted.count()) or join(wanted, *a))
    found = {}
    for share in (0.25, 1.0):
        monkeypatch.setattr(cells, "SPARSE", share)
        found[share] = {(r.qid, r.id, r.similarity, r.rank) for r in cells.search_cells(q, path, probes=7, k=5).collect()}
    asked = q.filter("embedding is not null").count()
    assert found[0.25] == found[1.0] and rows == [asked, 7 * asked]


def test_fitting_probes_searches_once(spark, monkeypatch):
    """The number of cells is that of trying each number in turn."""
    memories, requests = make(14, 400, 40, clusters=8)
    m, q = frames(spark, memories, requests)
    path = new_folder(spark, "cells")
    cells.create_cell_table(m, path, n_cells=12)
    exact = cells.search_cells(q, path, 12, 5).select("qid", "id").collect()
    tried = {p: {(r.qid, r.id) for r in cells.search_cells(q, path, p, 5).collect()} & set(map(tuple, exact)) for p in (1, 2, 4, 8)}
    searches, search = [], cells.search_cells
    monkeypatch.setattr(cells, "search_cells", lambda *a: searches.append(a) or search(*a))
    for recall in (0.3, 0.8, 0.95, 1.0):
        want = next((p for p in tried if len(tried[p]) >= recall * len(exact)), 12)
        assert cells.fit_probes(q, path, recall=recall, k=5) == want
    assert len(searches) == 4


def test_scan_route_does_not_shuffle_memories(spark):
    memories, requests = make(8, 50, 5)
    m, q = frames(spark, memories, requests)
    m = spark.read.schema(m.schema).parquet(_written(spark, m))
    plan = nearest.nearest_memories(q, m, 5)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in below
    assert "GreaterThan(importance_score,0.0)" in below


def _written(spark, df):
    path = new_folder(spark, "test")
    df.write.parquet(path)
    return path


def test_matching_holds_small_tiles():
    """Beyond the vectors themselves a pair of blocks takes little memory at a time."""
    import tracemalloc

    import pyarrow as pa

    from mnemospark.functions.blocks import Block, MatchRule, match_blocks

    def block(n, name):
        vectors = np.random.default_rng(n).normal(size=(n, 4)).astype(np.float32)
        vectors[3] = 0.0
        columns = {name: pa.array(range(n)), "scope": pa.array([1] * n), "project_id": pa.nulls(n, pa.string())}
        return Block.read(pa.table({**columns, "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32()))}), name)

    requests, memories = block(1500, "qid"), block(6000, "id")
    assert len(memories.unit) == 5999 and 3 not in memories.ids.to_pylist()
    assert np.allclose(np.linalg.norm(memories.unit, axis=1), 1.0)
    tracemalloc.start()
    found = sum(t.num_rows for t in match_blocks(requests, memories, MatchRule(5)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 5 * 1499
    assert peak < 40 << 20
