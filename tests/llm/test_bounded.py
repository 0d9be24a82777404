"""What steps hold or hand on at once stays bounded."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rollbook.llm import audit, paragraphs, secrets


def test_counts_are_added_up_without_holding_many():
    terms = [f"term{i}" for i in range(50_000)]
    part = {"lang": ["en"] * 50_000, "source": ["web"] * 50_000, "term": terms, "documents": [1] * 50_000, "occurrences": [2] * 50_000}
    before, most = pa.total_allocated_bytes(), 0

    def parts():
        nonlocal most
        for _ in range(40):
            yield pa.table(part)
            most = max(most, pa.total_allocated_bytes() - before)

    out = audit.summed(parts())
    assert sorted(out["term"].to_pylist()) == sorted(terms)
    assert set(out["documents"].to_pylist()) == {40} and set(out["occurrences"].to_pylist()) == {80}
    assert most < 32 << 20


def test_secret_search_holds_little_besides_the_texts():
    texts = pa.array(["password = abcdefghijklmnop", *("some words without a secret\n" * 300 for _ in range(1200))])
    rules = secrets.BASE + secrets.MORE
    machine = secrets.automaton(tuple(r.core for r in rules))
    tracemalloc.start()
    found = secrets.find(texts, rules, machine)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for i, x in enumerate(found) if x] == [0] and found[0] == [(0, 0, 27)]
    assert most < 64 << 20


def test_redacted_batch_keeps_nulls_and_other_texts(spark):
    docs = spark.createDataFrame([(1, "token: abcdefghijklmnop end"), (2, None), (3, "x"), (4, "")], "doc_id int, text string").coalesce(1)
    assert dict(map(tuple, secrets.redact(docs).collect())) == {1: "[secret] end", 2: None, 3: "x", 4: ""}


def test_lines_of_a_list_are_counted_in_cells(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "TILE", 16)
    rng = np.random.default_rng(5)
    sets = {k: np.unique(np.concatenate((rng.choice(30, 26, replace=False), rng.integers(30, 45, 6)))).astype(np.int64) for k in range(120)}
    rows = [(k, len(s), k if k % 3 else 0) for k, s in sets.items()]
    open_ = spark.createDataFrame(rows, "k long, n long, root long").withColumn("t", F.lit(1))
    out = paragraphs.across(open_, spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in sets.items()], "k long, shingles binary"))
    # No row for each pair of a list.
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    told = [tuple(r) for r in out.collect()]
    root = {k: r for k, _, r in rows}
    near = {(a, b) for a in sets for b in sets if a < b and root[a] != root[b]
            and 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))}
    assert near and near <= set(told) and len(told) == len(set(told))
    assert all(a < b and root[a] != root[b] for a, b in told)


def test_cells_over_several_batches():
    schema = pa.schema([("s", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("met", pa.bool_()), ("k", pa.int64()), ("n", pa.int64()),
                        ("root", pa.int64()), ("inner", pa.bool_()), ("entered", pa.list_(pa.int64()))])
    rows = [{"s": s, "i": 0, "j": 0, "met": met, "k": k, "n": 8, "root": k, "inner": False, "entered": [5, 6, 7]}
            for s in (5, 6, 7) for met in (False, True) for k in range(6)]
    whole = pa.Table.from_pylist(rows, schema)
    for size in (1, 2, 5, 12, 13, 36):
        out = list(paragraphs._meetings(iter(whole.to_batches(size))))
        pairs = sorted((a, b) for x in out for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True))
        assert pairs == [(a, b) for a in range(6) for b in range(a + 1, 6)]
